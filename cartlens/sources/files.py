"""Small text files (pointers, status) on whatever file system the path belongs to."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _resolve(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, files = _resolve(spark, path)
    return files.exists(target)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if it is absent."""
    target, files = _resolve(spark, path)
    if not files.exists(target):
        return []
    return sorted(found.getPath().getName() for found in files.listStatus(target))


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Names that a path with wildcards stands for, in order."""
    target, files = _resolve(spark, pattern)
    return sorted(found.getPath().getName() for found in files.globStatus(target) or [])


def remove(spark: SparkSession, path: str) -> None:
    target, files = _resolve(spark, path)
    files.delete(target, True)


def read_json(spark: SparkSession, path: str):
    rows = spark.read.text(path, wholetext=True).collect()
    return json.loads(rows[0]["value"])


def _candidate(spark: SparkSession, path: str, value):
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, files = _resolve(spark, path)
    candidate = hadoop.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    stream = files.create(candidate, True)
    try:
        stream.write(bytearray(json.dumps(value, indent=2, ensure_ascii=False), "utf-8"))
    finally:
        stream.close()
    context = hadoop.FileContext.getFileContext(
        target.toUri(), spark._jsc.hadoopConfiguration()
    )
    rename = getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename")
    return context, context.makeQualified(candidate), context.makeQualified(target), rename, files


def write_json(spark: SparkSession, path: str, value) -> None:
    """Write beside the target, then replace it in one rename, so readers never see half a file."""
    context, candidate, target, rename, _ = _candidate(spark, path, value)
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(candidate, target, options)


def create_json(spark: SparkSession, path: str, value) -> bool:
    """Write a whole file if there is none yet; False if another writer was first."""
    context, candidate, target, rename, files = _candidate(spark, path, value)
    try:
        context.rename(candidate, target, spark.sparkContext._gateway.new_array(rename, 0))
    except Py4JJavaError:
        if not files.exists(target):
            raise
        files.delete(candidate, False)
        return False
    return True
