"""Writers for facts and results, and validated re-reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.operators.checks import is_one_row_per_key
from cartlens.operators.numbering import in_ranges, with_row_number
from cartlens.sources.file_lines import FAN, levels_for, tree_hash, tree_level
from cartlens.sources.scratch import landed

#: Rows in a part of an export, and the levels of the hash tree below the hash of a part.
PART_LEVELS = 2
PART_ROWS = FAN**PART_LEVELS


class ExportError(ValueError):
    """A written table does not have the promised shape."""


def write_table(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Parquet table. With a partition column, adaptive rebalancing splits large
    partitions over several files and packs small ones together."""
    if partition is None:
        df.write.mode("errorifexists").parquet(path)
        return
    balanced = df.hint("rebalance", F.col(partition))
    balanced.write.mode("errorifexists").partitionBy(partition).parquet(path)


def total_order(df: DataFrame) -> list:
    return [F.col(f"`{name}`").asc_nulls_last() for name in df.columns]


def export_csv(df: DataFrame, path: str, order: list | None = None, scratch: str | None = None) -> dict:
    """Deterministic CSV of a result: header, a total order and a hash of what was written.

    The rows are range-partitioned and numbered by the offsets of their ranges. A part is
    `PART_ROWS` consecutive rows, whatever the cluster is, so the bytes of every part and
    the hash are the same for any number of tasks. Returns the row count, the columns and
    the hash; the hashes of the parts are written beside them.
    """
    by = [*(order or []), *total_order(df)]
    numbered = with_row_number(in_ranges(df, by, "export", scratch))
    part = F.floor(F.col("no") / PART_ROWS)
    rows = numbered.withColumn("part", part).repartition("part").sortWithinPartitions("part", "no")
    names = [F.col(f"`{name}`") for name in df.columns]
    rows.select("part", *names).write.mode("errorifexists").partitionBy("part").option("header", True).csv(f"{path}/data")
    line = F.to_csv(F.struct(*names), {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    digest = F.sha2(F.coalesce(line, F.lit("")).cast("binary"), 256).alias("digest")
    leaves = numbered.select(F.lit("all").alias("export"), "no", digest)
    parts = landed(tree_level(leaves, "export", PART_LEVELS), "parts", path)
    size = parts.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    folded = tree_hash(parts, "export", levels_for(size)).first()
    return {"rows": numbered.count(), "columns": df.columns, "hash": folded["root"] if folded else None}


def read_export(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of an export with their part, as the types of the result."""
    typed = T.StructType([*schema.fields, T.StructField("part", T.LongType())])
    return spark.read.schema(typed).option("header", True).option("mode", "FAILFAST").csv(f"{path}/data")


def read_table(
    spark: SparkSession, path: str, required: list[str], key: str | None = None
) -> DataFrame:
    """Read a written table back; refuse missing columns or repeated keys."""
    df = spark.read.parquet(path)
    missing = sorted(set(required) - set(df.columns))
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if missing:
        raise ExportError(f"{name} lacks columns: {', '.join(missing)}")
    if key is not None and not is_one_row_per_key(df, key):
        raise ExportError(f"{name} does not have one row per {key}")
    return df
