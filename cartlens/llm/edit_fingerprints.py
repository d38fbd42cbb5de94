"""Document fingerprints by randomised edit embedding.

`WALKS` shared random walks go over the characters of a text. At step j of a walk, the character it stands on and a random
word for (walk, j) decide whether it moves on; so two texts that differ by few edits are walked alike, but for a stretch
behind each edit, and the sequences of characters that the walks see differ in few places. A fingerprint samples
`SLOTS` places of these sequences, the same for all texts: a slot keeps the place with the least random value among the
steps the walk took, so texts of different lengths share places by the ratio of their lengths. Of the character there,
and the one behind it, four bits are kept. The likeness of two fingerprints is the share of equal slots; unrelated texts
agree in about one slot of fourteen.

Near fingerprints are found by bit sampling: the slots are cut into `BANDS` bands, fingerprints that agree in a band meet and
are verified on all slots. Two that agree in `SIMILAR` of their slots share a band with probability 0.95 (0.8), 0.999 (0.9).
Equal fingerprints are one row there, and groups are compared block by block.

The texts of a table stand in the order of their keys; each task reads a range of them as a stream, in which the next text
follows. Only the last text of a range is completed afterwards, with the first of the next range.

Defined results: a null text counts as empty; the fingerprint of the empty text has only zeros; rows that repeat a key stand
in the order of a hash of their texts; null keys come last in descending order; a table of one row is its own next document; an
empty table has an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartlens.llm.shared import components, ship, written

WALKS = 2
SLOTS = 128
BANDS = 16
SIMILAR = 0.8
SEED = 31
#: Steps at a time, texts at a time, characters at a time, and texts below which each is walked alone.
STEPS = 128
TEXTS = 1024
CHARS = 4_000_000
ALONE = 24
#: Characters that are hashed at a time.
PIECE = 1 << 18
#: Fingerprints that are held while others of their band value stream past, and those that stream past them in one task.
REST = 512
PART = 16_384
#: The class of the place behind a text, where a walk stays; characters have the classes below.
END = 63


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(walk: int, low: int, n: int) -> np.ndarray:
    """Random words of steps low to low + n of a walk; bit c tells whether a character of class c is passed."""
    steps = np.arange(low, low + n, dtype=np.uint64) * np.uint64(WALKS) + np.uint64(walk)
    return _mixed(steps * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SEED)) & np.uint64((1 << END) - 1)


@lru_cache(maxsize=1)
def places() -> list[list[tuple[int, int]]]:
    """For each walk, (step, slot) in order: where the least random value so far of the slot stands.

    The records of a sequence of random values are drawn one after the other: after a least value u the next smaller one is
    a geometric number of steps away.
    """
    out = [[] for _ in range(WALKS)]
    for slot in range(SLOTS):
        rng = np.random.default_rng([SEED, slot])
        step, least = 0, 1.0
        while step < 1 << 40:
            out[slot % WALKS].append((step, slot))
            least *= 1 - rng.random()
            step += int(rng.geometric(max(least, 1e-15)))
    return [sorted(x) for x in out]


def _coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends, and for all places of all texts the class and the four bits; one place lies behind each text."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
    every = np.zeros(int(size.sum()) + len(texts), dtype=np.uint32)
    for t, at in zip(texts, starts.tolist(), strict=True):
        every[at : at + len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        every[at : at + len(t)] += np.uint32(1)
    kind, bits = np.empty(len(every), dtype=np.uint8), np.zeros(len(every), dtype=np.uint8)
    for low in range(0, len(every), PIECE):  # in pieces, so that only bytes are held for all of them
        some = every[low : low + PIECE + 1]
        one = (some * np.uint32(0x9E3779B1)) ^ (some >> np.uint32(7))
        one ^= one >> np.uint32(15)
        kind[low : low + PIECE] = one[:PIECE] % np.uint32(END)
        two = one[:PIECE] * np.uint32(0x85EBCA77)
        two[: len(one) - 1] += one[1:] * np.uint32(0xC2B2AE3D)
        two ^= two >> np.uint32(13)
        bits[low : low + PIECE] = (two * np.uint32(0x27D4EB2F)) >> np.uint32(28)
    kind[starts + size] = END
    return starts, starts + size, kind, bits


def _alone(kind: bytes, bits: bytes, walk: int, step: int, at: int, row: np.ndarray, ahead: list[tuple[int, int]]) -> None:
    """Walk one text from a step on to its end; kind has one place behind the text."""
    n = len(kind) - 1
    low, words = 0, []
    for here, slot in ahead:
        while step < here:
            if not low <= step < low + len(words):
                low, words = step, _words(walk, step, 1 << 14).tolist()
            stop = min(here, low + len(words))
            for word in words[step - low : stop - low]:
                at += word >> kind[at] & 1
            step = stop
            if at >= n:
                return
        if at >= n:
            return
        row[slot] = bits[at]


def sampled(texts: list[str]) -> np.ndarray:
    """Slots of every text, four bits each."""
    out = np.zeros((len(texts), SLOTS), dtype=np.uint8)
    starts, ends, kind, bits = _coded(texts)
    for walk in range(WALKS):
        lanes = np.flatnonzero(ends > starts)
        at, step = starts[lanes], 0
        marks = places()[walk]
        next_mark = 0
        while len(lanes) >= ALONE:
            passed = ((_words(walk, step, STEPS)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.int64)
            way = np.empty((STEPS + 1, len(lanes)), dtype=np.int64)
            way[0] = at
            for k in range(STEPS):
                np.add(way[k], passed[k].take(kind.take(way[k])), out=way[k + 1])
            end = ends[lanes]
            while marks[next_mark][0] < step + STEPS:
                here, slot = marks[next_mark]
                on = way[here - step]
                alive = on < end
                out[lanes[alive], slot] = bits[on[alive]]
                next_mark += 1
            step += STEPS
            left = way[STEPS] < end
            lanes, at = lanes[left], way[STEPS][left]
        for lane, place in zip(lanes.tolist(), at.tolist(), strict=True):
            low, high = int(starts[lane]), int(ends[lane])
            _alone(kind[low : high + 1].tobytes(), bits[low:high].tobytes(), walk, step, place - low, out[lane], marks[next_mark:])
    return out


def _batches(texts: list[str]) -> Iterator[list[int]]:
    """Numbers of texts of about equal length, limited in number and characters."""
    held, size = [], 0
    for i in sorted(range(len(texts)), key=lambda i: len(texts[i])):
        if held and (len(held) >= TEXTS or size + len(texts[i]) > CHARS):
            yield held
            held, size = [], 0
        held.append(i)
        size += len(texts[i])
    if held:
        yield held


def slots(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), SLOTS), dtype=np.uint8)
    for some in _batches(texts):
        out[some] = sampled([texts[i] for i in some])
    return out


def _hex(rows: np.ndarray) -> list[str]:
    return [(r[::2] << 4 | r[1::2]).tobytes().hex() for r in rows]


def _unhex(prints: list[str]) -> np.ndarray:
    packed = np.frombuffer(bytes.fromhex("".join(prints)), dtype=np.uint8).reshape(len(prints), SLOTS // 2)
    return np.stack((packed >> 4, packed & 15), axis=2).reshape(len(prints), SLOTS)


def likeness(a: str, b: str) -> float:
    """Share of equal slots of two fingerprints."""
    return float((_unhex([a]) == _unhex([b])).mean())


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) of every row."""
    ship(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = pd.DataFrame({"_key": batch["_key"].tolist(), "fingerprint": _hex(slots(batch["_text"].tolist()))})
            yield made

    given = df.select(F.col(key).cast("string").alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return given.mapInPandas(run, "_key string, fingerprint string").select(F.col("_key").cast(df.schema[key].dataType).alias(key), "fingerprint")


def edited(text: str, following: str) -> str:
    """The last third of a text replaced by as many characters from the start of the following one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


RESULT = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_KINDS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(texts: list[str], nexts: list[str], own: np.ndarray, after: np.ndarray) -> dict[str, list]:
    changed = [edited(t, n) for t, n in zip(texts, nexts, strict=True)]
    other = slots(changed)
    return {
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
        "fingerprint": _hex(own), "edited_fingerprint": _hex(other),
        "near_edited": (own == other).mean(axis=1).tolist(), "near_next": (own == after).mean(axis=1).tolist(),
    }


def edit_report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, RESULT, class_id): each text against its edited text and the next document in descending order of keys.

    class_id is the smallest key of the documents reached through near fingerprints.
    """
    ship(df.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    order = [F.col("_key").desc_nulls_last(), F.xxhash64("_text")]
    docs = df.select(F.col(key).alias("_key"), body.alias("_text"))
    ranged = docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    kind = docs.schema["_key"].dataType
    ranged = ranged.withColumn("_key", F.col("_key").cast("string"))  # as text, nulls leave large keys exact in pandas
    schema = f"_key string, {_KINDS}, _part int, first string, last string"

    names = [c.split()[0] for c in schema.split(", ")]

    def told(rows: list[tuple[str | None, str]], own: np.ndarray, part: int, begins: bool, ends: bool) -> pd.DataFrame:
        """Results of all rows but the last; of the last too, without what needs the next text, if the range ends."""
        keys, texts = map(list, zip(*rows, strict=True))
        n = len(texts) - 1
        out = {"_key": keys[:n]} | _compared(texts[:n], texts[1:], own[:n], own[1:]) | {"first": [None] * n, "last": [None] * n}
        if ends:
            tail = {"_key": keys[n], "n_chars": len(texts[n]), "fingerprint": _hex(own[n:])[0], "last": texts[n]}
            for c in out:
                out[c].append(tail.get(c))
        if begins and keys[:n] + keys[n:] * ends:
            out["first"][0] = texts[0]
        return pd.DataFrame(out | {"_part": part}, columns=names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, held_slots, begins, part = [], np.zeros((0, SLOTS), dtype=np.uint8), True, 0
        for batch in batches:
            for low in range(0, len(batch), TEXTS):
                some = batch.iloc[low : low + TEXTS]
                part = int(some["_part"].iloc[0])
                rows = list(zip(some["_key"].tolist(), some["_text"].tolist(), strict=True))
                own = np.concatenate((held_slots, slots([t for _, t in rows])))
                rows = held + rows
                if len(rows) > 1:
                    yield told(rows, own, part, begins, False)
                    begins = False
                held, held_slots = rows[-1:], own[-1:]
        if held:
            yield told(held, held_slots, part, begins, True)

    report = written(ranged.mapInPandas(run, schema), "edits")
    done = report.where(F.col("last").isNull()).select("_key", *RESULT)
    # one row for each range: its last text with the first of the next range, behind the last range that of the first one
    heads = report.where(F.col("first").isNotNull()).select(F.col("_part").alias("to"), F.col("first").alias("_next"))
    line = Window.orderBy("_part")
    turn = F.coalesce(F.lead("_part").over(line), F.min("_part").over(Window.partitionBy()))
    follows = report.where(F.col("last").isNotNull()).select("_part").withColumn("to", turn)
    tails = report.where(F.col("last").isNotNull()).join(follows, "_part").join(heads, "to").select("_key", "last", "_next")

    def complete(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, nexts = batch["last"].tolist(), batch["_next"].tolist()
            made = pd.DataFrame(_compared(texts, nexts, slots(texts), slots(nexts)))
            made.insert(0, "_key", batch["_key"].tolist())
            yield made

    every = done.union(tails.mapInPandas(complete, f"_key string, {_KINDS}"))
    known = near_classes(report.select(F.col("_key").cast(kind), "fingerprint"), "_key")
    return every.join(known, "fingerprint").select(F.col("_key").cast(kind).alias(key), *RESULT, "class_id")


def _agree(a: np.ndarray, b: np.ndarray, similar: float) -> np.ndarray:
    """Which rows of a and b agree in so many slots."""
    return (a[:, None, :] == b[None, :, :]).sum(axis=2) >= similar * SLOTS


def near_classes(prints: DataFrame, key: str, similar: float = SIMILAR) -> DataFrame:
    """(fingerprint, class_id) of all distinct fingerprints: the smallest key that is reached through near ones.

    Of the fingerprints with one band value, each is first verified against the smallest. Those near it are connected through it. Only the
    rest, in blocks, meets all others of the value.
    """
    ship(prints.sparkSession)
    classes = prints.groupBy("fingerprint").agg(F.min(key).alias("least"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "fingerprints")
    named = classes.select("cid", "fingerprint")
    wide = SLOTS // BANDS
    bands = F.array(*(F.xxhash64(F.lit(b), F.substring("fingerprint", b * wide + 1, wide)) for b in range(BANDS)))
    banded = classes.select("cid", F.explode(bands).alias("v"))
    groups = banded.groupBy("v").agg(F.min("cid").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = written(banded.join(groups, "v"), "bands")

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near = (_unhex(batch["fingerprint"].tolist()) == _unhex(batch["_first"].tolist())).sum(axis=1) >= similar * SLOTS
            yield pd.DataFrame({"cid": batch["cid"], "pivot": batch["pivot"], "near": near})

    pairs = met.where("cid <> pivot").select("cid", "pivot").distinct().join(named, "cid")
    pairs = pairs.join(named.select(F.col("cid").alias("pivot"), F.col("fingerprint").alias("_first")), "pivot")
    pairs = written(pairs.mapInPandas(verified, "cid long, pivot long, near boolean"), "pivots")
    links = pairs.where("near").select(F.col("cid").alias("a"), F.col("pivot").alias("b"))

    rest = met.join(pairs.where("not near").select("cid", "pivot"), ["cid", "pivot"]).select("v", "cid", "n")
    line = Window.partitionBy("v").orderBy("cid")
    rest = rest.withColumn("block", F.floor((F.row_number().over(line) - 1) / REST).cast("int"))
    parts = F.ceil(F.col("n") / PART).cast("int")
    sides = rest.select("v", "block", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "cid", F.lit(0).alias("side"))
    blocks = rest.groupBy("v").agg(F.max("block").alias("last"))
    every = met.join(blocks, "v").select(
        "v", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("block"), F.pmod(F.xxhash64("cid"), parts).cast("int").alias("part"), "cid", F.lit(1).alias("side")
    )

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, ids, seen = None, [], []
        for batch in batches:
            made = set()
            for (v, block, part, side), rows in batch.groupby(["v", "block", "part", "side"], sort=False):
                if (v, block, part) != here:
                    here, ids, seen = (v, block, part), np.zeros(0, dtype=np.int64), np.zeros((0, SLOTS), dtype=np.uint8)
                cid, own = rows["cid"].to_numpy(), _unhex(rows["fingerprint"].tolist())
                if side == 0:
                    ids, seen = np.append(ids, cid), np.concatenate((seen, own))
                    continue
                for low in range(0, len(cid), 64):
                    near = _agree(own[low : low + 64], seen, similar)
                    # each row with the first of the block that it is near, and the others near it with that one
                    first = near.argmax(axis=1)
                    at, column = np.nonzero(near)
                    made.update(zip(cid[low : low + 64][at].tolist(), ids[first[at]].tolist(), strict=True))
                    made.update(zip(ids[column].tolist(), ids[first[at]].tolist(), strict=True))
            yield pd.DataFrame(sorted(made), columns=["a", "b"], dtype=np.int64)

    both = sides.union(every).join(named, "cid").repartition("v", "block", "part").sortWithinPartitions("v", "block", "part", "side")
    links = links.union(both.mapInPandas(compared, "a long, b long"))
    root = components(links)
    tree = classes.join(root.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = tree.groupBy("root").agg(F.min("least").alias("class_id"))
    return tree.join(least, "root").select("fingerprint", "class_id")
