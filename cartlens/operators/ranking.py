"""Row selection and ranking within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OTHER = "OTHER"


def latest_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key under an explicit order.

    The rank filter lets Spark keep one row per key and task before the shuffle
    (window group limit), so a key that holds most rows does not flood one task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def top_groups(df: DataFrame, by: str, amount: str, n: int) -> DataFrame:
    """The n largest groups with their rank: amount descending, then name.

    Sort plus limit keeps n rows per task, so the number of groups is not limited.
    The rank window afterwards sees at most n rows.
    """
    totals = df.groupBy(by).agg(F.sum(amount).alias("_total"))
    order = [F.col("_total").desc_nulls_last(), F.col(by).asc_nulls_last()]
    top = totals.orderBy(*order).limit(n)
    return top.select(by, F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("_rank"))


def label_top_groups(df: DataFrame, by: str, amount: str, n: int, label: str, rank: str) -> DataFrame:
    """Label each row with its top-n group or OTHER (rank n + 1).

    Broadcasting is safe: the lookup holds at most n rows.
    """
    lookup = top_groups(df, by, amount, n).withColumnRenamed(by, "_member")
    joined = df.join(F.broadcast(lookup), F.col(by).eqNullSafe(F.col("_member")), "left")
    return joined.withColumns(
        {
            label: F.when(F.col("_rank").isNotNull(), F.col(by)).otherwise(F.lit(OTHER)),
            rank: F.coalesce(F.col("_rank"), F.lit(n + 1).cast("bigint")),
        }
    ).drop("_member", "_rank")


def top_n_other(df: DataFrame, by: str, amount: str, n: int, distinct_id: str) -> DataFrame:
    """Amount and distinct ids of the n largest groups and of all others together.

    Distinct ids are counted again inside OTHER; they are not the sum of the members.
    """
    slim = df.groupBy(by, distinct_id).agg(F.sum(amount).alias("_amount"))
    labelled = label_top_groups(slim, by, "_amount", n, "group_name", "group_rank")
    return labelled.groupBy("group_name", "group_rank").agg(
        F.sum("_amount").alias("amount"), F.countDistinct(distinct_id).alias("distinct_ids")
    )


def threshold_rank(df: DataFrame, qualified: Column, order: list[Column], name: str) -> DataFrame:
    """Rank the qualified rows; the others keep a NULL rank.

    Meant for aggregated rows (one per state, nation, ...).
    """
    flag = F.coalesce(qualified, F.lit(False))
    window = Window.partitionBy("_qualified").orderBy(*order)
    ranked = df.withColumn("_qualified", flag).withColumn("_position", F.row_number().over(window))
    return ranked.withColumn(
        name, F.when(F.col("_qualified"), F.col("_position").cast("bigint"))
    ).drop("_qualified", "_position")
