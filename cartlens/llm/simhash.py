"""Near duplicates by 64-bit SimHash fingerprints.

Fingerprints within `distance` differing bits are linked. They are cut into so few segments that in one
segment a linked pair differs by at most one bit: distance // 2 + 1 of them. Each fingerprint is indexed
under every segment as it is, and under every variant of a segment with one bit deleted. Rows that meet
under such a signature are compared over all bits.

Equal fingerprints are one row throughout, so exact copies cost nothing. Signatures met by one row only,
and deletion variants in which all rows agree in the deleted bit (they meet under the whole segment too),
end before the comparison. Large signatures are compared block by block and return a spanning forest of
their links, not all pairs.

Defined results: a null or empty text has no words and the fingerprint zero; a text with fewer words
than a shingle is one shingle; rows with a null key get the fingerprint of their text and the component of
that fingerprint; equal rows stay equal rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.llm.runs import forest, in_blocks, map_runs
from cartlens.llm.shared import components, ship, written

BITS = 64


def fingerprint(text: str, words: int) -> int:
    """SimHash over word shingles; a bit is set if more than half of the shingle hashes have it."""
    parts = text.encode("utf-8").lower().split()  # of bytes: A-Z and ASCII white space only
    if not parts:
        return 0
    if len(parts) > words:
        joined = memoryview(b" ".join(parts))
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
        hashes = [xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in spans]
    else:
        hashes = [xxhash.xxh64_intdigest(b" ".join(parts), 42)]
    octets = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
    # in pieces, so that a very long text needs little memory
    ones = sum(np.unpackbits(octets[i : i + 65_536], axis=1).sum(axis=0, dtype=np.int64) for i in range(0, len(octets), 65_536))
    return int.from_bytes(np.packbits(2 * ones > len(octets)).tobytes(), "big")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(key, fp): the fingerprint of every row as a signed 64-bit number."""

    ship(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in batch["_text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({key: batch[key], "fp": found})

    given = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return given.mapInPandas(run, T.StructType([df.schema[key], T.StructField("fp", T.LongType())]))


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """Links (a, b) that connect whatever distinct fingerprints within the distance connect."""
    segments = distance // 2 + 1
    width = -(-BITS // segments)
    keys = []
    for s in range(segments):
        wide = min(width, BITS - s * width)
        value = F.shiftrightunsigned("fp", s * width).bitwiseAND(F.lit((1 << wide) - 1 if wide < 64 else -1))
        for bit in (None, *range(wide)):
            part = value if bit is None else value.bitwiseAND(F.lit(~(1 << bit)))
            gone = F.lit(-1) if bit is None else F.lit(s * width + bit)
            keys.append(F.struct(F.lit(s).cast("byte").alias("s"), gone.cast("byte").alias("gone"), part.alias("part")))
    signed = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.*", "fp")
    bit = F.when(F.col("gone") >= 0, F.expr("shiftrightunsigned(fp, gone) & 1")).otherwise(F.lit(0))
    met = in_blocks(
        signed, ["s", "gone", "part"], ["fp"], (F.col("gone") < 0) | ((F.col("_ones") > 0) & (F.col("_ones") < F.col("_n"))), {"_ones": bit}
    )

    def compare(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray] | None:
        fp = np.unique(rows["fp"])
        bits = fp.view(np.uint64)
        root = forest(np.bitwise_count(bits[:, None] ^ bits[None, :]) <= distance)
        at = np.flatnonzero(root != np.arange(len(fp)))
        return {"a": fp[at], "b": fp[root[at]]}

    pair = T.StructType([T.StructField(c, T.LongType()) for c in "ab"])
    return map_runs(met.select("s", "gone", "part", "_i", "_j", "fp"), ["s", "gone", "part"], compare, pair).distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, distance: int = 3) -> DataFrame:
    """(key, fingerprint, component_id): component_id is the smallest key reachable through links."""
    rows = written(fingerprints(df, key, text, words), "fingerprints")
    fps = rows.groupBy("fp").agg(F.min(key).alias("first"))
    root = components(links(fps, distance))
    tree = fps.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = tree.groupBy("root").agg(F.min("first").alias("component_id"))
    names = tree.join(least, "root").select("fp", "component_id")
    return rows.join(names, "fp").select(
        key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, distance: int = 3) -> DataFrame:
    """One row of `df` for each group: that of the smallest key, without a key only if no row of the group has one.

    Rows that agree in the key are told apart by their text, and equal ones by a number given as they are written.
    """
    columns = df.columns
    rows = written(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    prints = fingerprints(rows.select(F.struct(key, "_row").alias("_id"), text), "_id", text, words)
    prints = written(prints.select(F.col(f"_id.{key}").alias("_key"), "_id._row", "fp"), "fingerprints")
    root = components(links(prints.select("fp").distinct(), distance))
    tree = prints.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    given = tree.join(rows.select("_row", F.xxhash64(text).alias("_hash")), "_row")
    # a minimum per group, so that a group of any size is combined before it is shuffled
    place = F.struct(F.col("_key").isNull().alias("none"), F.col("_key").alias("key"), F.col("_hash").alias("hash"), F.col("_row").alias("row"))
    first = given.groupBy("root").agg(F.min(place).alias("first")).select(F.col("first.row").alias("_row"))
    return rows.join(first, "_row").select(*columns)
