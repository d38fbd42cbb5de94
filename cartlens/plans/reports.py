"""Aggregate reports built from finished question results, and the data profile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlens.functions.measures import safe_ratio
from cartlens.functions.time import day_of, month_of
from cartlens.operators.samples import gap_signs
from cartlens.plans.analyses import ALL_JOINT, EXCLUDE_EARLY


def sensitivity_summary(strata: DataFrame, min_group_orders: int) -> DataFrame:
    """Re-aggregate the stored counts of Q08 per sample; percentages are never averaged."""
    base = ("on_time_orders", "on_time_low_score_orders")
    other = ("late_orders", "late_low_score_orders")
    joint = F.col("joint_eligible_orders")
    qualified = (F.col(base[0]) >= min_group_orders) & (F.col(other[0]) >= min_group_orders)
    sums = [
        "joint_eligible_orders", "answer_timestamp_orders", "early_answer_orders", *base, *other,
    ]
    totals = strata.groupBy("sample").agg(
        *[F.sum(name).alias(name) for name in sums],
        F.count_if(joint > 0).alias("populated_strata"),
        F.count_if(qualified).alias("qualified_strata"),
        F.coalesce(F.sum(F.when(qualified, joint)), F.lit(0)).alias("qualified_joint_orders"),
        *[column.alias(name) for name, column in gap_signs(strata, qualified, base, other).items()],
    )
    labels = strata.sparkSession.range(1).select(
        F.explode(F.array(F.lit(ALL_JOINT), F.lit(EXCLUDE_EARLY))).alias("sample")
    )
    counters = totals.columns[1:]
    filled = labels.join(totals, "sample", "left").withColumns(
        {name: F.coalesce(F.col(name), F.lit(0)) for name in counters}
    )
    on_time, late = safe_ratio(F.col(base[1]), F.col(base[0])), safe_ratio(F.col(other[1]), F.col(other[0]))
    return filled.withColumns(
        {
            "on_time_low_score_share": on_time,
            "late_low_score_share": late,
            "low_score_share_gap": late - on_time,
            "answer_timestamp_coverage": safe_ratio(F.col("answer_timestamp_orders"), joint),
            "qualified_joint_coverage": safe_ratio(F.col("qualified_joint_orders"), joint),
        }
    )


def partial_cohorts(cohorts: DataFrame) -> DataFrame:
    """Populated cohorts that are not fully mature or not fully observed."""
    total, eligible = F.col("total_customers"), F.col("eligible_customers")
    return cohorts.filter(
        (total > 0) & ((eligible < total) | ~F.col("fully_observed_calendar_cohort"))
    )


def _strict_sum(amount: Column) -> Column:
    return F.when(F.count_if(amount.isNull()) == 0, F.sum(amount))


def overview(results: dict[str, DataFrame]) -> DataFrame:
    """Headline figures in one row, from the finished results of Q01, Q02, Q04, Q05, Q06, Q10."""
    by = {name[:3]: df for name, df in results.items()}
    commerce = by["q01"].agg(
        _strict_sum(F.col("merchandise_value")).alias("merchandise_value"),
        F.sum("delivered_orders").alias("delivered_orders"),
        F.sum("all_orders").alias("all_orders"),
        F.sum("canceled_orders").alias("canceled_orders"),
    )
    parts = ["merchandise_change", "order_count_contribution", "average_order_value_contribution"]
    complete = reduce(lambda a, b: a & b, [F.col(name).isNotNull() for name in parts])
    largest = (
        by["q02"]
        .filter(complete)
        .orderBy(F.abs(F.col("merchandise_change")).desc(), F.col("purchase_month").asc())
        .limit(1)
        .select(F.struct("purchase_month", *parts))
        .scalar()
    )
    rank = F.col("investigation_rank")
    states = (
        by["q04"]
        .filter(rank <= 3)
        .agg(
            F.struct(
                *[
                    F.max(F.when(rank == n, F.col("customer_state"))).alias(f"state_{n}")
                    for n in (1, 2, 3)
                ]
            )
        )
        .scalar()
    )
    coverage = (
        by["q06"]
        .agg(
            F.struct(
                F.sum("delivery_eligible_orders").alias("delivery"),
                F.sum("review_eligible_orders").alias("review"),
                F.sum("joint_eligible_orders").alias("joint"),
                F.sum("late_orders").alias("late"),
            )
        )
        .scalar()
    )
    duration = (
        by["q05"]
        .filter(F.col("scope") == "WINDOW")
        .select(F.struct("duration_coverage", "median_delivery_days", "p90_delivery_days"))
        .scalar()
    )
    immature = partial_cohorts(by["q10"]).select(F.count(F.lit(1))).scalar()
    one = commerce.withColumns(
        {
            "_change": largest,
            "_states": states,
            "_coverage": coverage,
            "_duration": duration,
            "partial_cohorts": immature,
        }
    )
    delivered = F.col("delivered_orders")
    delivery, joint = F.col("_coverage.delivery"), F.col("_coverage.joint")
    return one.select(
        "merchandise_value",
        "delivered_orders",
        "all_orders",
        "canceled_orders",
        safe_ratio(F.col("merchandise_value"), delivered).alias("average_order_value"),
        safe_ratio(F.col("canceled_orders"), F.col("all_orders")).alias("canceled_order_share"),
        F.col("_change.purchase_month").alias("largest_change_month"),
        F.col("_change.merchandise_change").alias("largest_change"),
        F.col("_change.order_count_contribution").alias("largest_change_order_part"),
        F.col("_change.average_order_value_contribution").alias("largest_change_value_part"),
        *[F.col(f"_states.state_{n}").alias(f"investigation_state_{n}") for n in (1, 2, 3)],
        delivery.alias("delivery_eligible_orders"),
        F.col("_coverage.late").alias("late_orders"),
        safe_ratio(F.col("_coverage.late"), delivery).alias("late_share"),
        safe_ratio(delivery, delivered).alias("delivery_coverage"),
        safe_ratio(F.col("_coverage.review"), delivered).alias("review_coverage"),
        joint.alias("joint_eligible_orders"),
        safe_ratio(joint, delivered).alias("joint_coverage"),
        F.col("_duration.duration_coverage").alias("duration_coverage"),
        F.col("_duration.median_delivery_days").alias("median_delivery_days"),
        F.col("_duration.p90_delivery_days").alias("p90_delivery_days"),
        "partial_cohorts",
    )


def top_states(states: DataFrame, n: int = 3) -> DataFrame:
    """The states to look at first, with all their figures, in order."""
    return states.filter(F.col("investigation_rank") <= n).orderBy("investigation_rank")


def report_tables(results: dict[str, DataFrame], config) -> dict[str, DataFrame]:
    """All aggregate reports from finished results; the customer-level result is not among them."""
    by = {name[:3]: df for name, df in results.items()}
    return {
        "overview": overview(results),
        "overview_states": top_states(by["q04"]),
        "sensitivity": sensitivity_summary(by["q08"], config.min_group_orders),
        "cohorts": by["q10"],
        "partial_cohorts": partial_cohorts(by["q10"]),
    }


def row_profile(
    raw: dict[str, DataFrame],
    staged: dict[str, DataFrame],
    raw_rows: dict[str, int] | None = None,
) -> DataFrame:
    """Source and staging row counts per table; known source counts are not counted again."""

    def counted(table):
        if raw_rows is None:
            loaded = raw[table].select(F.count(F.lit(1))).scalar()
        else:
            loaded = F.lit(raw_rows[table]).cast("bigint")
        return (
            staged[table]
            .agg(F.count(F.lit(1)).alias("staged_rows"))
            .select(F.lit(table).alias("table_name"), loaded.alias("raw_rows"), "staged_rows")
        )

    return reduce(DataFrame.unionByName, [counted(table) for table in raw])


def purchase_profile(staged: dict[str, DataFrame]) -> DataFrame:
    """Orders and distinct purchase days per purchase month and status, full history."""
    ts = F.col("order_purchase_timestamp")
    return (
        staged["orders"]
        .groupBy(month_of(ts).alias("month"), F.col("order_status").alias("status"))
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.countDistinct(day_of(ts)).alias("purchase_days"),
        )
    )
