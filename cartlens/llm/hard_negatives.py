"""Hard negatives by Hilbert-ordered blocks with zone maps.

Vectors become integers, component by component. All rows are ordered along a Hilbert curve over their directions and
written as Parquet blocks of `BLOCK` rows, one record each, with the least and greatest value of every dimension. Anchors
are packed in the same order. For an anchor, interval arithmetic over a zone map bounds the scores in a block from below
and above without reading it: positive components meet the greatest values, negative ones the least. Only blocks whose
bounds meet one of the anchor's score windows are read.

Every search has two steps. The anchors first read their own chunk, where close rows are, and what they find there
raises the lower ends of their windows. Then the zone maps choose the blocks of other chunks. A task holds one chunk of
blocks (or the zone maps of one page) while the anchors that need it stream past, and keeps the best rows of each window.

The positives of an anchor are its best rows of the same label (one unbounded window). Each of them gives a window for the
negatives, rows of another label whose score is between `LOW` and `HIGH` hundredths of the positive's.

Defined results: rows with a null key, label or vector, or with a null or non-finite component take no part; vectors of
different lengths don't meet; components beyond 2^31 in size count as 2^31; rows with the anchor's key are none of its positives; equal scores
stand by key; rows that repeat a key are candidates and anchors each; a positive without negatives has no row; an empty
table has an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.llm.shared import ship, written

#: Rows in a block, blocks in a chunk, anchors in a group, zone maps in a page, columns of scores at a time.
BLOCK = 256
CHUNK = 64
GROUP = 256
PAGE = 4096
WIDE = 2048
#: Bits of each dimension on the curve.
BITS = 4
LARGEST = (1 << 31) - 1
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95
#: Beyond every score.
FAR = 1 << 62

PACKED = "kind int, chunk long, no int, size int, n int, least_label long, most_label long, ids binary, labels binary, ints binary, lo binary, hi binary"
WINS = "array<struct<at:int,w:int,lo:bigint,hi:bigint>>"


def integers(vector: np.ndarray, scale: float = 256.0) -> np.ndarray:
    return np.clip(np.floor(vector.astype(np.float64) * scale), -LARGEST, LARGEST).astype(np.int64)


def hilbert(points: np.ndarray, bits: int = BITS) -> list[bytes]:
    """Places on the Hilbert curve of points (rows) with `bits` bits in each dimension, as bytes that sort like numbers.

    By Skilling's transformation of coordinates, for all points at once.
    """
    x = points.astype(np.uint32).copy()
    n, dims = x.shape
    if not dims:
        return [b""] * n
    top = 1 << bits - 1
    bit = top
    while bit > 1:
        low = np.uint32(bit - 1)
        for i in range(dims):
            here = (x[:, i] & np.uint32(bit)) != 0
            swap = (x[:, 0] ^ x[:, i]) & low
            x[:, 0] ^= np.where(here, low, swap)
            x[:, i] ^= np.where(here, np.uint32(0), swap)
        bit >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    turn, bit = np.zeros(n, dtype=np.uint32), top
    while bit > 1:
        turn ^= np.where((x[:, -1] & np.uint32(bit)) != 0, np.uint32(bit - 1), np.uint32(0))
        bit >>= 1
    x ^= turn[:, None]
    planes = [(x >> np.uint32(b)) & np.uint32(1) for b in reversed(range(bits))]
    packed = np.packbits(np.concatenate(planes, axis=1).astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


def _places(ints: np.ndarray) -> list[bytes]:
    """Places of directions: every row is scaled by its largest component."""
    if not ints.shape[1]:
        return [b""] * len(ints)
    most = np.maximum(np.abs(ints).max(axis=1, keepdims=True), 1)
    return hilbert(np.minimum((ints / most + 1) * (1 << BITS - 1), (1 << BITS) - 1))


def _packed(df: DataFrame, key: str, vector: str, label: str, anchor: Column) -> DataFrame:
    """Blocks (kind 0) and anchor groups (kind 1) in the order of the curve, written."""
    vec = F.col(vector).cast("array<double>")
    fine = ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.where(F.col(key).isNotNull() & F.col(label).isNotNull() & fine)
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), vec.alias("vec"))
    kind = "id long, label long, anchor boolean, size int, ints binary, place binary"

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            size = batch["vec"].map(len).to_numpy()
            for s in np.unique(size):
                part = batch[size == s]
                ints = integers(np.stack([np.asarray(v, dtype=np.float64) for v in part["vec"]]))
                coded = [v.tobytes() for v in ints.astype(np.int32)]
                yield pd.DataFrame({"id": part["id"], "label": part["label"], "anchor": part["anchor"], "size": np.int32(s), "ints": coded, "place": _places(ints)})

    points = written(rows.mapInPandas(coded, kind), "points")
    order = [F.col(c) for c in ("size", "place", "id", "label")]
    ranged = points.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long"))

    def row(kind: int, chunk: int, no: int, rows: pd.DataFrame) -> tuple:
        size, labels = int(rows["size"].iloc[0]), rows["label"].to_numpy(np.int64)
        ints = np.frombuffer(b"".join(rows["ints"]), dtype=np.int32).reshape(len(rows), size)
        zone = (ints.min(axis=0).tobytes(), ints.max(axis=0).tobytes()) if kind == 0 else (None, None)
        return (kind, chunk, no, size, len(rows), int(labels.min()), int(labels.max()), rows["id"].to_numpy(np.int64).tobytes(), labels.tobytes(), ints.tobytes(), *zone)

    def chunked(rows: pd.DataFrame, chunk: int) -> pd.DataFrame:
        out = [row(0, chunk, i, rows.iloc[low : low + BLOCK]) for i, low in enumerate(range(0, len(rows), BLOCK))]
        own = rows[rows["anchor"]]
        out += [row(1, chunk, i, own.iloc[low : low + GROUP]) for i, low in enumerate(range(0, len(own), GROUP))]
        return pd.DataFrame(out, columns=[c.split()[0] for c in PACKED.split(", ")])

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, chunk = None, 0
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            while len(held) and (held["size"].iloc[0] != held["size"].iloc[-1] or len(held) >= CHUNK * BLOCK):
                n = min(int((held["size"] == held["size"].iloc[0]).sum()), CHUNK * BLOCK)
                yield chunked(held.iloc[:n], int(held["part"].iloc[0]) << 32 | chunk)
                held, chunk = held.iloc[n:].reset_index(drop=True), chunk + 1
        if held is not None and len(held):
            yield chunked(held, int(held["part"].iloc[0]) << 32 | chunk)

    return written(ranged.mapInPandas(packed, PACKED), "blocks")


class _Anchors:
    """A group of anchors with their windows as arrays: lo and hi by window and anchor (lo above hi: no window)."""

    def __init__(self, x) -> None:
        self.home, self.no, self.n, self.size = int(x.home), int(x.no), int(x.n), int(x.size)
        self.ids, self.labels = np.frombuffer(x.ids, np.int64), np.frombuffer(x.labels, np.int64)
        self.ints = np.frombuffer(x.ints, np.int32).reshape(self.n, self.size)
        wide = max((w["w"] for w in x.wins), default=-1) + 1
        self.lo, self.hi = np.full((wide, self.n), FAR), np.full((wide, self.n), -FAR)
        for w in x.wins:
            self.lo[w["w"], w["at"]], self.hi[w["w"], w["at"]] = w["lo"], w["hi"]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of a with all rows of b."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if bound < 1 << 53:  # every sum is exact in double precision
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < FAR:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return np.clip(a.astype(object) @ b.astype(object).T, -FAR, FAR).astype(np.int64)


def bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score that each row of a can have with any row within each pair of bounds."""
    plus, minus = np.maximum(a, 0), np.minimum(a, 0)
    return _products(plus, lo) + _products(minus, hi), _products(plus, hi) + _products(minus, lo)


def _best(at: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of each `at` by score and key."""
    order = np.lexsort((ids, -score, at))
    at, score, ids = at[order], score[order], ids[order]
    starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
    return at[rank < k], score[rank < k], ids[rank < k]


FOUND = "home long, no int, at int, w int, anchor long, id long, score long"


def _scored(met: DataFrame, same: bool, k: int) -> DataFrame:
    """The first k rows for each window of each anchor in each chunk, from blocks and the anchors that read them."""
    names = [c.split()[0] for c in FOUND.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, blocks = None, {}
        for batch in batches:
            out = []
            for x in batch.itertuples(index=False):
                if x.chunk != chunk:
                    chunk, blocks = x.chunk, {}
                if x.kind == 0:
                    blocks[x.no] = (np.frombuffer(x.ids, np.int64), np.frombuffer(x.labels, np.int64), np.frombuffer(x.ints, np.int32).reshape(x.n, x.size))
                    continue
                a = _Anchors(x)
                wanted = sorted(blocks) if x.read is None else [b for b in sorted(x.read) if b in blocks]
                wanted = [b for b in wanted if blocks[b][2].shape[1] == a.size]
                kept = [(np.zeros(0, np.int64),) * 3] * len(a.lo)
                for low in range(0, len(wanted), WIDE // BLOCK):
                    part = [blocks[b] for b in wanted[low : low + WIDE // BLOCK]]
                    ids, labels, ints = (np.concatenate(v) for v in zip(*part, strict=True))
                    score = _products(a.ints, ints)
                    fits = a.labels[:, None] == labels[None, :] if same else a.labels[:, None] != labels[None, :]
                    if same:
                        fits &= a.ids[:, None] != ids[None, :]
                    for w in range(len(a.lo)):
                        at, col = np.nonzero(fits & (score >= a.lo[w][:, None]) & (score <= a.hi[w][:, None]))
                        if len(at):
                            old = kept[w]
                            kept[w] = _best(np.append(old[0], at), np.append(old[1], score[at, col]), np.append(old[2], ids[col]), k)
                            full, last = kept[w][0][k - 1 :], kept[w][1][k - 1 :]
                            full = full == kept[w][0][: len(full)]  # k rows of one anchor end here
                            a.lo[w][kept[w][0][k - 1 :][full]] = last[full]
                for w, (at, score, ids) in enumerate(kept):
                    if len(at):
                        out.append(pd.DataFrame({"home": a.home, "no": a.no, "at": at, "w": w, "anchor": a.ids[at], "id": ids, "score": score})[names])
            if out:
                yield pd.concat(out)

    order = ["chunk", "kind", "home", "no"]
    return met.repartition("chunk").sortWithinPartitions(*order).mapInPandas(run, FOUND)


def _chosen(met: DataFrame, same: bool) -> DataFrame:
    """(home, no, chunk, read): blocks of other chunks whose bounds meet a window, from zone maps and anchors page by page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page, zones, stacked = None, {}, {}
        for batch in batches:
            out = []
            for x in batch.itertuples(index=False):
                if x.page != page:
                    page, zones, stacked = x.page, {}, {}
                if x.kind == 0:
                    zones.setdefault(x.size, []).append((x.chunk, x.no, x.least_label, x.most_label, x.lo, x.hi))
                    continue
                a = _Anchors(x)
                if a.size not in zones or not len(a.lo):
                    continue
                if a.size not in stacked:
                    chunk, no, least, most, lo, hi = zip(*zones[a.size], strict=True)
                    stacked[a.size] = (*map(np.array, (chunk, no, least, most)), *(np.frombuffer(b"".join(v), np.int32).reshape(len(v), a.size) for v in (lo, hi)))
                chunk, no, least, most, lo, hi = stacked[a.size]
                low, high = bounds(a.ints, lo, hi)
                label = a.labels[:, None]
                fits = (least <= label) & (label <= most) if same else (least != label) | (most != label)
                fits &= chunk != a.home
                meets = np.zeros_like(fits)
                for w in range(len(a.lo)):
                    meets |= (high >= a.lo[w][:, None]) & (low <= a.hi[w][:, None])
                needed = (fits & meets).any(axis=0)
                for c in np.unique(chunk[needed]):
                    out.append((a.home, a.no, int(c), no[needed & (chunk == c)].tolist()))
            if out:
                yield pd.DataFrame(out, columns=["home", "no", "chunk", "read"])

    order = ["page", "kind"]
    return met.repartition("page").sortWithinPartitions(*order).mapInPandas(run, "home long, no int, chunk long, read array<int>")


def _searched(blocks: DataFrame, anchors: DataFrame, pages: int, same: bool, k: int, name: str) -> DataFrame:
    """(home, no, at, w, anchor, id, score, rank): the first k rows for each window of the anchors (with `wins`)."""
    held = ["kind", "chunk", "no", "size", "n", "ids", "labels", "ints"]
    nothing = {"home": F.lit(None).cast("long"), "wins": F.lit(None).cast(WINS), "read": F.lit(None).cast("array<int>")}
    data = blocks.select(*held).withColumns(nothing)
    own = anchors.select(*held, F.col("chunk").alias("home"), "wins", nothing["read"].alias("read"))
    first = written(_scored(data.unionByName(own), same, k), f"{name}-own")
    # what the own chunk gives raises the lower ends
    full = first.groupBy("home", "no", "at", "w").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
    each = anchors.select(F.col("chunk").alias("home"), "no", F.explode("wins").alias("x")).select("home", "no", "x.*")
    each = each.join(full.drop("n"), ["home", "no", "at", "w"], "left").withColumn("lo", F.greatest("lo", F.coalesce("least", "lo")))
    raised = each.groupBy("home", "no").agg(F.collect_list(F.struct("at", "w", "lo", "hi")).alias("wins"))
    known = written(anchors.drop("wins").withColumnRenamed("chunk", "home").join(raised, ["home", "no"]), f"{name}-windows")

    zone_columns = ["kind", "size", "no", "chunk", "least_label", "most_label", "lo", "hi"]
    zones = blocks.select(*zone_columns).withColumn("page", F.pmod(F.xxhash64("chunk"), F.lit(pages)))
    every = known.withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pages - 1).cast("long"))))
    every = every.select("kind", "page", "size", "no", "home", "n", "ids", "labels", "ints", "wins")
    reads = written(_chosen(zones.unionByName(every, allowMissingColumns=True), same), f"{name}-reads")

    wanted = reads.select("chunk", F.explode("read").alias("no")).distinct()
    few = data.join(wanted, ["chunk", "no"], "left_semi")
    going = known.join(reads, ["home", "no"]).select(*held, "home", "wins", "read")
    rest = _scored(few.unionByName(going), same, k)
    line = Window.partitionBy("home", "no", "at", "w").orderBy(F.col("score").desc(), "id")
    return first.union(rest).withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k)


def hard_negatives(
    df: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where `anchor` holds."""
    ship(df.sparkSession)
    packed = _packed(df, key, vector, label, anchor)
    blocks, groups = packed.where("kind = 0"), packed.where("kind = 1")
    pages = -(-max(blocks.count(), 1) // PAGE)
    whole = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(i.alias("at"), F.lit(0).alias("w"), F.lit(-FAR).alias("lo"), F.lit(FAR).alias("hi")))
    near = written(_searched(blocks, groups.withColumn("wins", whole), pages, True, positives, "positives"), "positives")
    # 100 * negative between LOW * positive and HIGH * positive, in whole numbers
    score = F.col("score").cast("decimal(38,0)")
    low, high = F.ceil(score * LOW / 100), F.floor(score * HIGH / 100)
    window = F.struct("at", (F.col("rank") - 1).alias("w"), low.cast("long").alias("lo"), high.cast("long").alias("hi"))
    wins = near.groupBy(F.col("home").alias("chunk"), "no").agg(F.collect_list(window).alias("wins"))
    found = _searched(blocks, groups.join(wins, ["chunk", "no"]), pages, False, negatives, "negatives")
    named = near.select("home", "no", "at", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(named, ["home", "no", "at", "w"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
