"""CSV sources: declared columns, header contract, manifest and snapshot fingerprint."""

from __future__ import annotations

import csv
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.operators.checks import table_fingerprint
from cartlens.plans.staging import COLUMNS
from cartlens.sources.file_lines import landed_lines, levels_for, numbered, tree_hash
from cartlens.sources.files import matching
from cartlens.sources.quoted_csv import read_quoted


class SourceError(ValueError):
    """A source is absent or breaks its header contract."""


@dataclass(frozen=True)
class Source:
    """File name pattern below the input directory.

    ``multiline`` allows line breaks inside quoted fields; only free-text sources need it. Such files are read by
    byte ranges, with their lines landed once.
    """

    pattern: str
    multiline: bool = False


# File name patterns of the seven sources.
SOURCES = {
    "orders": Source("*_orders_dataset.csv"),
    "items": Source("*_order_items_dataset.csv"),
    "payments": Source("*_order_payments_dataset.csv"),
    "customers": Source("*_customers_dataset.csv"),
    "products": Source("*_products_dataset.csv"),
    "reviews": Source("*_order_reviews_dataset.csv", multiline=True),
    "category_translation": Source("product_category_name_translation.csv"),
}


def source_path(directory: str, table: str, locations: Mapping[str, str] | None = None) -> str:
    """Path of a source: an explicit location (file, directory or glob) or the default pattern."""
    if locations and table in locations:
        return locations[table]
    return f"{str(directory).rstrip('/')}/{SOURCES[table].pattern}"


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Column names from the first line of one file."""
    try:
        lines = spark.read.text(path)
        first = lines.filter(F.col("_metadata.file_block_start") == 0).limit(1).collect()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise SourceError(f"missing source file: {path.rsplit('/', 1)[-1]}") from error
        raise
    if not first:
        return []
    return next(csv.reader([first[0]["value"].lstrip("﻿")]), [])


def check_header(path: str, header: list[str], required: list[str]) -> None:
    name = path.rsplit("/", 1)[-1]
    missing = [column for column in required if column not in header]
    if missing:
        raise SourceError(f"{name} lacks columns: {', '.join(missing)}")
    repeated = sorted({column for column in header if header.count(column) > 1})
    if repeated:
        raise SourceError(f"{name} repeats columns: {', '.join(repeated)}")


def read_source(
    spark: SparkSession,
    directory: str,
    table: str,
    locations: Mapping[str, str] | None = None,
    multiline: bool | None = None,
    scratch: str | None = None,
) -> DataFrame:
    """All-text table. Columns beyond the declared ones are kept and tolerated.

    The lines of a multi-line source are landed below ``scratch`` (default: the shared folder of the session).
    """
    path = source_path(directory, table, locations)
    if not (locations and table in locations) and len(found := matching(spark, path)) > 1:
        raise SourceError(f"several snapshots of {table}: {', '.join(found)}")
    header = read_header(spark, path)
    check_header(path, header, list(COLUMNS[table]))
    if SOURCES[table].multiline if multiline is None else multiline:
        return read_quoted(spark, path, header, scratch)
    schema = T.StructType([T.StructField(name, T.StringType()) for name in header])
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "FAILFAST")
        .option("enforceSchema", False)
        # Parse whole rows, so that a malformed row fails also when few columns are read.
        .option("columnPruning", False)
        .csv(path)
    )


def read_sources(
    spark: SparkSession,
    directory: str,
    locations: Mapping[str, str] | None = None,
    scratch: str | None = None,
) -> dict[str, DataFrame]:
    return {table: read_source(spark, directory, table, locations, scratch=scratch) for table in SOURCES}


def file_manifest(
    spark: SparkSession,
    directory: str,
    locations: Mapping[str, str] | None = None,
    scratch: str | None = None,
) -> DataFrame:
    """Name, size and content hash of every source file, alike at every size.

    The hash is the root of a tree over the lines in their order with the file's size, so order and line ends count. It
    does not depend on how many tasks read the file.
    """
    paths = [source_path(directory, table, locations) for table in SOURCES]
    # an empty file has no lines, so names and sizes come from the listing
    listed = [
        spark.read.format("binaryFile").load(path).select(
            F.lit(table).alias("source"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")
        )
        for table, path in zip(SOURCES, paths)
    ]
    files = reduce(DataFrame.unionByName, listed)
    content = content_hashes(spark, paths, scratch)
    return files.join(content, "file", "left").select(
        "source",
        F.element_at(F.split("file", "/"), -1).alias("file"),
        "bytes",
        F.sha2(F.concat_ws(" ", "bytes", F.coalesce("root", F.lit(""))), 256).alias("sha256"),
    )


def content_hashes(spark: SparkSession, paths: list[str], scratch: str | None = None) -> DataFrame:
    """(file, root): the hash tree over the lines of each file."""
    digests = landed_lines(spark, paths, F.sha2(F.col("value").cast("binary"), 256).alias("digest"), "line-digests", scratch)
    most = digests.groupBy("file").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    return tree_hash(numbered(digests), "file", max(1, levels_for(most)))


def source_manifest(raw: Mapping[str, DataFrame]) -> DataFrame:
    """Rows, columns and row checksum of every source table, from one scan each."""
    frames = [
        table_fingerprint(df).select(
            F.lit(table).alias("source"),
            "rows",
            F.array(*[F.lit(name) for name in df.columns]).alias("columns"),
            "checksum",
        )
        for table, df in raw.items()
    ]
    manifest = frames[0]
    for frame in frames[1:]:
        manifest = manifest.unionByName(frame)
    return manifest


def snapshot_fingerprint(manifest: DataFrame) -> str:
    """One SHA-256 over the ordered manifest (a few short rows per source)."""
    entry = F.struct(*[F.col(name) for name in sorted(manifest.columns)])
    whole = F.to_json(F.sort_array(F.collect_list(entry)))
    return manifest.agg(F.sha2(whole, 256).alias("fingerprint")).first()["fingerprint"]


def snapshot_label(files: DataFrame) -> str:
    """Short label of a snapshot for display: twelve characters over file names and hashes."""
    return snapshot_fingerprint(files.select("file", "sha256"))[:12]
