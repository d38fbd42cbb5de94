"""Near duplicates of embeddings by spherical-cap filters.

Filter directions form a structured random product code: a vector is turned by a fixed random rotation and cut
into `PARTS` parts, each part has `CODES` random directions, and every combination of one direction for each
part is a filter. A vector is decoded to all filters whose direction it exceeds in inner product: its own best
score less a margin, or the common threshold, whichever is lower. Vectors with equal labels that share a filter
meet there and are verified in double precision. A pair that shares several filters counts in the first of them.

Equal vectors of a label are one row with a count, so copies cost nothing. Filters with many vectors are
compared block by block; a block returns sums and a spanning forest, never pairs.

The threshold is set so that a vector has about `EXPECTED` filters; near pairs share most of theirs. The choice of
filters is the same for any number of rows.

Defined results: a vector that is null, empty or zero, or holds null or non-finite components, or has a null label,
links with nothing; vectors of different lengths don't link; repeated rows link with each other; a null key gets the
component of its vector; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.llm.runs import forest, in_blocks, map_runs
from cartlens.llm.shared import components, ship, written

PARTS = 4
CODES = 32
EXPECTED = 10
MARGIN = 0.06
SEED = 23


@lru_cache(maxsize=8)
def _code(length: int) -> tuple[np.ndarray, list[np.ndarray], float]:
    """Rotation, directions of each part, and threshold for vectors of a length."""
    wide = -(-length // PARTS) * PARTS
    rng = np.random.default_rng([SEED, length])
    turn = np.linalg.qr(rng.standard_normal((wide, wide)))[0][:, :length]
    parts = [rng.standard_normal((wide // PARTS, CODES)) for _ in range(PARTS)]
    parts = [p / np.linalg.norm(p, axis=0) / np.sqrt(PARTS) for p in parts]
    level = NormalDist().inv_cdf(1 - EXPECTED / CODES**PARTS) / np.sqrt(wide)
    return turn, parts, level


def filters(vector: np.ndarray) -> np.ndarray:
    """Numbers of all filters that a unit vector exceeds, ascending."""
    turn, codes, level = _code(len(vector))
    turned = (turn @ vector).reshape(PARTS, -1)
    scores = [t @ c for t, c in zip(turned, codes, strict=True)]
    low = min(level, sum(s.max() for s in scores) - MARGIN)
    # lists of halves, best first; only as much of a list as can still exceed is looked at
    while len(scores) > 2:
        scores = [(a[:, None] + b[None, :]).ravel() for a, b in zip(scores[::2], scores[1::2], strict=True)]
    left, right = scores
    order = np.argsort(-right)
    lead = np.flatnonzero(left + right[order[0]] >= low)
    reach = np.searchsorted(-right[order], left[lead] - low, side="right")
    return np.sort(np.concatenate([a * len(right) + order[:n] for a, n in zip(lead, reach, strict=True)]))


def _classes(df: DataFrame, key: str, vector: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Rows (_key, label, vec, usable) and the distinct usable vectors (cid, label, vec, first, copies)."""
    vec = F.col(vector).cast("array<double>")
    fine = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("vec", lambda x: x != 0)
    rows = df.select(F.col(key).alias("_key"), F.col(label).alias("label"), vec.alias("vec"))
    rows = rows.withColumn("usable", F.coalesce(F.col("label").isNotNull() & fine & some, F.lit(False)))
    classes = rows.where("usable").groupBy("label", "vec").agg(F.min("_key").alias("first"), F.count(F.lit(1)).alias("copies"))
    return rows, written(classes.withColumn("cid", F.monotonically_increasing_id()), "vectors")


def near_duplicates(df: DataFrame, cosine: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept) of every row; kept rows are the smallest keys of their components."""
    ship(df.sparkSession)
    rows, classes = _classes(df, key, vector, label)
    listed = T.StructType([T.StructField("cid", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("fs", T.ArrayType(T.IntegerType()))])

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            units = [_unit(v) for v in batch["vec"]]
            yield pd.DataFrame({"cid": batch["cid"], "size": [len(u) for u in units], "fs": [filters(u).astype(np.int32) for u in units]})

    found = written(classes.select("cid", "vec").mapInPandas(decode, listed), "filters")
    slim = found.join(classes.select("cid", "label"), "cid").select("label", "size", "cid", F.explode("fs").alias("f"))
    met = in_blocks(slim, ["label", "size", "f"], ["cid"])
    full = met.join(found.select("cid", "fs"), "cid").join(classes.select("cid", "vec", "copies"), "cid")

    def compare(group: dict[str, np.ndarray]) -> dict[str, np.ndarray] | None:
        units = np.stack([_unit(v) for v in group["vec"]])
        near = units @ units.T >= cosine
        np.fill_diagonal(near, False)
        own = group["_own"]
        if group["_i"][0] != group["_j"][0]:
            near &= own[:, None] != own[None, :]
        if not near.any():
            return None
        cid = group["cid"]
        root = cid[forest(near)]
        first_here = near & ~_share_earlier(list(group["fs"]), int(group["f"][0]))
        return {"cid": cid, "links": first_here @ group["copies"], "root": root}

    made = T.StructType([T.StructField(c, T.LongType()) for c in ("cid", "links", "root")])
    met_rows = full.select("label", "size", "f", "_i", "_j", "_own", "cid", "fs", "vec", "copies")
    sums = written(map_runs(met_rows, ["label", "size", "f"], compare, made), "vector-links")
    links = sums.groupBy("cid").agg(F.sum("links").alias("links"))
    root = components(sums.select(F.col("cid").alias("a"), F.col("root").alias("b")).distinct())
    tree = classes.join(links, "cid", "left").join(root.withColumnRenamed("node", "cid"), "cid", "left")
    tree = tree.withColumn("root", F.coalesce("root", "cid"))
    least = tree.groupBy("root").agg(F.min("first").alias("component_id"))
    known = tree.join(least, "root").select("label", "vec", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    usable = rows.where("usable").join(known, ["label", "vec"]).select("_key", "n_links", "component_id")
    alone = rows.where("not usable").select("_key", F.lit(0).cast("long").alias("n_links"), F.col("_key").alias("component_id"))
    return usable.union(alone).select(
        F.col("_key").alias(key), "n_links", "component_id", F.coalesce(F.col("_key") == F.col("component_id"), F.lit(False)).alias("kept")
    )


def _unit(values: np.ndarray) -> np.ndarray:
    v = np.asarray(values, dtype=np.float64)
    v = v / np.abs(v).max()  # so that no square overflows
    return v / np.linalg.norm(v)


def _share_earlier(lists: list[np.ndarray], f: int) -> np.ndarray:
    """Which two rows share a filter before f."""
    n = len(lists)
    row = np.repeat(np.arange(n), [len(x) for x in lists])
    every = np.concatenate(lists)
    row, every = row[every < f], every[every < f]
    _, column, times = np.unique(every, return_inverse=True, return_counts=True)
    row, column = row[times[column] > 1], column[times[column] > 1]
    shared = np.zeros((n, n), dtype=bool)
    if len(row):
        _, column = np.unique(column, return_inverse=True)
        for low in range(0, column.max() + 1, 2048):
            here = (column >= low) & (column < low + 2048)
            member = np.zeros((n, min(2048, column.max() + 1 - low)), dtype=np.float32)
            member[row[here], column[here] - low] = 1
            shared |= member @ member.T > 0
    return shared
