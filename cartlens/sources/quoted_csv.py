"""CSV files with line breaks inside quoted fields, read by many tasks.

A line break belongs to a field if the quotes before it are odd in number. Every stretch of lines of a byte range reports the
parity of its quotes and how many records that span lines begin in it, for both parities it may start with; a running sum over
the stretches of a file fixes which one it is. A record of one line is parsed where it stands. Only the lines of records that span
several are brought together, under the number of their record in the file.

A quote inside an unquoted field is not allowed, nor a line break in the header. As in a read of whole files, line breaks in the fields
of a file whose lines end in CRLF become LF.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.sources.file_lines import PLACE, lines, running
from cartlens.sources.scratch import landed

_OPTIONS = {"quote": '"', "escape": '"', "mode": "FAILFAST", "multiLine": "true"}


def _marked(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """Lines without headers, with the parity of quotes in the stretch before and behind each line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parity = None, 0
        for batch in batches:
            value, place = batch.column("value"), [batch.column(name) for name in PLACE]
            odd = (pc.count_substring(value, '"').to_numpy(zero_copy_only=False) % 2).astype(np.int8)
            new = np.ones(len(odd), dtype=bool)
            same = reduce(pc.and_, [pc.equal(column[1:], column[:-1]) for column in place])
            new[1:] = ~same.to_numpy(zero_copy_only=False)
            new[0] = here != tuple(column[0].as_py() for column in place)
            # parity from the start of each stretch: sums up to the line, less those up to its stretch
            total = np.cumsum(odd)
            base = np.maximum.accumulate(np.where(new, np.arange(len(odd)), 0))
            after = total - np.where(base > 0, total[base - 1], 0)
            if not new[0]:
                after[base == 0] += parity
            after %= 2
            file, cut, _ = place
            # the first line of a file; a later stretch of its first range goes on from another one
            begun = pc.and_(pc.equal(file[1:], file[:-1]), pc.equal(cut[1:], cut[:-1])).to_numpy(zero_copy_only=False)
            first = new & (cut.to_numpy() == 0)
            first[1:] &= ~begun
            first[0] &= here is None or here[:2] != (file[0].as_py(), cut[0].as_py())
            here, parity = tuple(column[-1].as_py() for column in place), int(after[-1])
            for at in np.flatnonzero(first):
                found = next(csv.reader([value[int(at)].as_py().removesuffix("\r").lstrip("﻿")]), [])
                if found != header:
                    raise ValueError(f"{file[int(at)].as_py()} has the columns {found} instead of {header}")
            made = [*batch.columns, pa.array((after ^ odd).astype(np.int8)), pa.array(after.astype(np.int8))]
            made = pa.RecordBatch.from_arrays(made, names=[*batch.schema.names, "opens", "closes"])
            yield made.filter(pa.array(~first))

    schema = "file string, cut long, seq long, value string, stretch long, opens byte, closes byte"
    return lines(spark, path).mapInArrow(run, schema)


def records(spark: SparkSession, path: str, header: list[str], scratch: str | None = None) -> DataFrame:
    """(value): the text of every record of the files at a path, headers and empty lines left out."""
    found = landed(_marked(spark, path, header), "csv-lines", scratch)
    begins = [F.count_if((F.col("opens") == p) & (F.col("closes") != p)).alias(f"begins{p}") for p in (0, 1)]
    ranges = found.groupBy(*PLACE).agg((F.sum((F.col("opens") != F.col("closes")).cast("int")) % 2).alias("parity"), *begins)
    ranges = running(ranges, "parity").withColumn("start", (F.col("before") % 2).cast("byte"))
    ranges = ranges.withColumn("begins", F.when(F.col("start") == 0, F.col("begins0")).otherwise(F.col("begins1")))
    starts = running(ranges.select(*PLACE, "start", "begins"), "begins").select(*PLACE, "start", "before")
    known = found.join(starts, PLACE)
    inside, stays = F.col("opens") != F.col("start"), F.col("closes") != F.col("start")
    plain = F.regexp_replace("value", "\r$", "")
    single = known.where(~inside & ~stays).select(plain.alias("value")).where("value <> ''")
    # the records that span lines: a stretch counts on from those that begin ahead of it
    parts = known.where(inside | stays).withColumn("new", (~inside).cast("int"))
    line = Window.partitionBy(*PLACE).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumn("record", F.col("before") + F.sum("new").over(line))
    whole = parts.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("cut", "seq", "value"))).alias("held"))
    joined = F.array_join("held.value", "\n")
    ends = F.when(joined.endswith("\r"), F.regexp_replace(F.regexp_replace(joined, "\r$", ""), "\r\n", "\n")).otherwise(joined)
    return single.union(whole.select(ends.alias("value")))


def read_quoted(spark: SparkSession, path: str, header: list[str], scratch: str | None = None) -> DataFrame:
    """All-text table of the files at a path, equal to a read of whole files with line breaks allowed in fields."""
    schema = T.StructType([T.StructField(name, T.StringType()) for name in header])
    parsed = F.from_csv("value", F.lit(schema.toDDL()), _OPTIONS)
    return records(spark, path, header, scratch).select(parsed.alias("_row")).select("_row.*")
