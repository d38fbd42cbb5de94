"""Work on groups of rows that agree in a key, without one task ever holding a large group.

Groups of more than `BLOCK` rows are cut into blocks, and every two blocks of a group meet in a task
of their own. What such a task returns must be as small as its rows (sums, or a spanning forest of
links), never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.llm.shared import ship

#: Rows in a block; a task compares two blocks at a time.
BLOCK = 1024


def in_blocks(df: DataFrame, keys: list[str], order: list[str], wanted: Column | None = None, sums: dict[str, Column] | None = None) -> DataFrame:
    """Rows of groups with at least two rows, with the two blocks (_i, _j) that each copy is for.

    `sums` are totals per group that `wanted`, a condition on groups, may use. _own tells the block of
    a row. Groups that fit one block are not copied.
    """
    group = Window.partitionBy(*keys)
    counted = df.withColumns(
        {"_n": F.count(F.lit(1)).over(group), "_r": F.row_number().over(group.orderBy(*order)) - 1}
        | {name: F.sum(c).over(group) for name, c in (sums or {}).items()}
    ).where("_n > 1")
    kept = (counted if wanted is None else counted.where(wanted)).drop(*(sums or {}))
    kept = kept.withColumn("_own", F.floor(F.col("_r") / BLOCK).cast("int"))
    last = F.floor((F.col("_n") - 1) / BLOCK).cast("int")
    other = F.explode(F.sequence(F.lit(0), last))
    return (
        kept.withColumn("_other", other)
        .withColumns({"_i": F.least("_own", "_other"), "_j": F.greatest("_own", "_other")})
        .drop("_n", "_r", "_other")
    )


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Group after group of rows that come sorted by `keys`, as arrays by column."""
    rest = None
    for batch in batches:
        if not len(batch):
            continue
        rows = {c: batch[c].to_numpy() for c in batch.columns}
        if rest is not None:
            rows = {c: np.concatenate([rest[c], v]) for c, v in rows.items()}
        new = np.zeros(len(rows[keys[0]]), dtype=bool)
        for k in keys:
            new[1:] |= rows[k][1:] != rows[k][:-1]
        starts = [0, *np.flatnonzero(new).tolist()]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            yield {c: v[a:b] for c, v in rows.items()}
        rest = {c: v[starts[-1] :] for c, v in rows.items()}
    if rest is not None:
        yield rest


def map_runs(df: DataFrame, keys: list[str], work: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray] | None], schema: T.StructType, order: Sequence[str] = ()) -> DataFrame:
    """Apply `work` to each group of block pairs, its rows in `order`; it returns columns or None."""
    every = [*keys, "_i", "_j"]
    names = schema.fieldNames()

    ship(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, size = [], 0
        for rows in runs(batches, every):
            if (made := work(rows)) is not None and (n := len(made[names[0]])):
                parts.append(made)
                size += n
            if size >= 10_000:
                yield pd.DataFrame({k: np.concatenate([p[k] for p in parts]) for k in names})
                parts, size = [], 0
        if parts:
            yield pd.DataFrame({k: np.concatenate([p[k] for p in parts]) for k in names})

    return df.repartition(*every).sortWithinPartitions(*every, *order).mapInPandas(run, schema)


def forest(near: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links, the first index of each row's component."""
    n = len(near)
    root = np.full(n, -1)
    for start in range(n):
        if root[start] >= 0:
            continue
        front = np.zeros(n, dtype=bool)
        front[start] = True
        while front.any():
            root[front] = start
            front = near[front].any(axis=0) & (root < 0)
    return root
