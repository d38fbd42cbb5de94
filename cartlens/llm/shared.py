"""Written intermediate tables and connected components."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.sources.files import remove


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, the way any Spark job sends modules."""
    context = spark.sparkContext
    if getattr(context, "_cartlens_sent", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(os.path.realpath(tempfile.mkdtemp(prefix="cartlens-"))) / "cartlens.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._cartlens_sent = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names, which driver and executors share.

    Only where it is unset and the session is local, a temporary folder is made and used from then on.
    """
    context = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not place:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = f"file://{tempfile.mkdtemp(prefix='cartlens-')}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(place)
    return context.getCheckpointDir() if place in (context.getCheckpointDir() or "") else place


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/cartlens-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it again: lineage ends there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._cartlens_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables of `written` that nothing reads any more."""
    for table in tables:
        remove(table.sparkSession, table._cartlens_path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more.

    It does so once their objects are collected, first here, then on the driver's JVM, which else may not collect for long. What the
    first collection there lets go of holds the shuffles, which only the next one finds.
    """
    gc.collect()
    for pause in (0.2, 0):
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


def components(links: DataFrame) -> DataFrame:
    """Connected components of undirected links (columns a, b; no nulls).

    Returns (node, root) for every node that has a link; root is the smallest node of its component.
    Alternates large-star and small-star rounds until every link ends in a root. Each round takes
    minima per node and equi-joins, so a hub is pre-aggregated and its join can be split. The driver
    sees two numbers a round.
    """
    now = written(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    before = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        moved = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        spent, now = now, written(moved.union(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        discard(spent)
        state = now.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if state == before or not state.n:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
