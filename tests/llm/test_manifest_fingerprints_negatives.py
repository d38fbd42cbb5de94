"""Edit fingerprints, Merkle manifest and hard negatives against plain versions, on tables with nulls, ties, repeats and no rows."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cartlens.llm import edit_fingerprints as ef
from cartlens.llm import hard_negatives as hn
from cartlens.llm import manifest, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, g string, idx long, _key string, path string"


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice("ab cd ef gh ij kl mn op qr st".split()) + str(rng.randrange(500)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = words(1, 400)
    near = base.replace("ab", "aB", 2)
    out = [
        (1, base, "en"), (2, base, "en"), (3, near, "de"), (4, None, None), (5, "", "en"), (6, "a", "fr"), (7, words(2, 30_000), "en"),
        (8, "Ünï😀x", "de"), (9, words(3, 60), None), (1 << 60, words(4, 90), "en"), ((1 << 60) + 1, "X" * 700, "fr"),
    ]
    return out + [(100 + i, words(i, 30 + i % 50), "en" if i % 3 else "de") for i in range(620)]


def table(spark, rows):
    return spark.createDataFrame([(k, t, g, "s", None if t is None else len(t), "x", "y", 7, "z", "p") for k, t, g in rows], DOCS)


# --- edit fingerprints --------------------------------------------------------------


def plain_slots(text: str) -> np.ndarray:
    """The walks as they are defined, one step at a time."""
    out = np.zeros(ef.SLOTS, dtype=np.uint8)
    _, _, kind, bits = ef._coded([text])
    for walk in range(ef.WALKS if text else 0):
        at, seen = 0, []
        random_words = ef._words(walk, 0, 50 * len(text) + 300).tolist()
        while at < len(text):
            seen.append(bits[at])
            at += random_words[len(seen) - 1] >> int(kind[at]) & 1
        for slot in range(walk, ef.SLOTS, ef.WALKS):
            out[slot] = seen[max(j for j, s in ef.places()[walk] if s == slot and j < len(seen))]
    return out


def test_slots_equal_the_walks_step_by_step():
    rng = random.Random(3)
    some = ["", "a", "ab", "é😀"] + ["".join(rng.choice("abcdef gé😀") for _ in range(rng.randrange(1, 700))) for _ in range(60)]
    found = ef.slots(some)
    assert all((found[i] == plain_slots(t)).all() for i, t in enumerate(some))
    assert (ef.slots(some[10:12]) == found[10:12]).all()  # few texts are walked alone


def test_likeness_falls_with_edits_and_is_low_between_strangers():
    rng = random.Random(4)
    draw = lambda n: "".join(rng.choices("abcdefghijklmnop ", k=n))
    base = draw(3000)
    likes = []
    for edits in (1, 10, 100, 1000):
        text = list(base)
        for _ in range(edits):
            at = rng.randrange(len(text))
            text[at : at + rng.randrange(2)] = draw(rng.randrange(2))
        likes.append(float((ef.slots([base]) == ef.slots(["".join(text)])).mean()))
    assert likes[0] > 0.9 and likes[0] >= likes[1] > likes[2] > likes[3]
    assert float((ef.slots([base]) == ef.slots([draw(3000)])).mean()) < 0.25


def test_edit_report_equals_a_plain_calculation(spark, texts):
    rows = texts + [(None, words(8, 40), "en"), (9, words(3, 60), None)]
    got = sorted(map(tuple, ef.edit_report(table(spark, rows).repartition(5)).drop("class_id").collect()), key=str)
    # ties of the key are in the order of a hash that Spark computes
    order = table(spark, rows).orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64(F.coalesce("text", F.lit(""))))
    line = [(r.doc_id, r.text or "") for r in order.select("doc_id", "text").collect()]
    slots = ef.slots([t for _, t in line])
    want = []
    for i, (key, text) in enumerate(line):
        n, follow = len(text) // 3, (i + 1) % len(line)
        changed = text[: len(text) - n] + line[follow][1][:n]
        other = ef.slots([changed])[0]
        digest = hashlib.sha256(changed.encode()).hexdigest()
        near = (float((slots[i] == other).mean()), float((slots[i] == slots[follow]).mean()))
        want.append((key, len(text), digest, ef._hex(slots[i : i + 1])[0], ef._hex(other[None])[0], *near))
    assert got == sorted(want, key=str)


def test_fingerprints_of_equal_texts_are_equal_and_keys_stay_exact(spark, texts):
    found = {r.doc_id: r.fingerprint for r in ef.fingerprints(table(spark, texts)).collect()}
    assert found[1] == found[2] != found[3] and found[4] == found[5] == "0" * ef.SLOTS
    assert set(found) == {k for k, _, _ in texts}
    assert ef.likeness(found[1], found[3]) > 0.8 > ef.likeness(found[1], found[7])


def test_near_classes_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(ef, "REST", 4)
    monkeypatch.setattr(ef, "PART", 8)
    rng, rows = random.Random(5), []
    for group in range(12):
        base = [rng.randrange(16) for _ in range(ef.SLOTS)]
        for member in range(rng.randrange(1, 14)):
            own = list(base)
            for _ in range(rng.randrange(0, 40)):
                own[rng.randrange(ef.SLOTS)] = rng.randrange(16)
            rows.append((len(rows), ef._hex(np.array([own], dtype=np.uint8))[0]))
    rows += [(1000, rows[0][1]), (None, rows[1][1])]
    got = {r.fingerprint: r.class_id for r in ef.near_classes(spark.createDataFrame(rows, "k long, fingerprint string"), "k").collect()}
    prints = sorted({p for _, p in rows})
    seen = ef._unhex(prints)
    wide = ef.SLOTS // ef.BANDS
    same = seen[:, None, :] == seen[None, :, :]
    meets = same.reshape(len(prints), len(prints), ef.BANDS, wide).all(axis=3).any(axis=2)
    near = meets & (same.sum(axis=2) >= ef.SIMILAR * ef.SLOTS)
    root = list(range(len(prints)))
    for _ in prints:
        root = [min([root[j] for j in np.flatnonzero(near[i])] + [root[i]]) for i in range(len(prints))]
    least = {}
    for key, p in rows:
        if key is not None:
            least[root[prints.index(p)]] = min(key, least.get(root[prints.index(p)], key))
    assert got == {p: least[root[i]] for i, p in enumerate(prints)}


# --- manifest -----------------------------------------------------------------------


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) by whole levels in lists."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda k, t, g: digest("".join(map(field, (k, "s", g, None if t is None else len(t), t))))

    def tree(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([digest("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
        return levels

    def siblings(levels, i):
        out = []
        for level in levels[:-1]:
            start = i // 8 * 8
            out.append(("".join(level[start:i]), "".join(level[i + 1 : start + 8])))
            i //= 8
        return out

    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r[0], r[1], r[2])))
    trees = {g: tree([leaf(k, t, g) for k, t, _ in groups[g]]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for at, g in enumerate(names):
        for i, (k, t, _) in enumerate(groups[g]):
            path = siblings(trees[g], i) + siblings(top, at)
            now = trees[g][0][i]
            if k is not None and zlib.crc32(str(k).encode()) % 3 == 0 and t is not None:
                lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
                field_chars = len(t)
                now = digest("".join(map(field, (k, "s", g, field_chars, lower))))
            for before, after in path:
                now = digest(before + now + after)
            proof = digest("".join(a + b for a, b in path))
            out.append((k, trees[g][0][i], trees[g][-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return out


def manifest_query(spark, rows, tmp_path):
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    return queries.op12_manifest(spark, str(tmp_path))


def test_manifest_equals_whole_levels(spark, texts, tmp_path):
    rows = texts + [(None, "Null key", "de"), (9, words(3, 60), None), (9, "Another", None)]
    got = sorted(map(tuple, manifest_query(spark, rows, tmp_path).collect()), key=str)
    want = sorted(plain_manifest(rows), key=str)
    assert got == want
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 8, 9, 64, 65, 513])
def test_manifest_of_every_height(spark, n, tmp_path):
    rows = [(i, f"Text {i}", "en") for i in range(n)]
    assert sorted(map(tuple, manifest_query(spark, rows, tmp_path).collect())) == sorted(plain_manifest(rows))


def test_only_every_third_level_is_stored(spark):
    rows = [(i, f"t{i}", "en") for i in range(600)]
    df = table(spark, rows).select("doc_id", "lang", F.sha2("text", 256).alias("h"), F.lit(None).cast("string").alias("other"))
    made = manifest.build(df, "doc_id", "lang", ["other"])
    assert [level.count() for level in made.levels] == [600, 2, 1]
    assert len(made.root) == 64


# --- hard negatives -----------------------------------------------------------------


def plain_negatives(rows):
    """All pairs, in whole numbers of Python."""
    fine = []
    for key, vector, label in rows:
        if key is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        moved = (label + 1) % 10 if key % 7 == 0 else label
        fine.append((key, [math.floor(256 * x) for x in vector], moved))
    out = []
    for key, v, label in fine:
        if key % 50:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), k, g) for k, w, g in fine if len(w) == len(v)]
        near = sorted((-s, k) for s, k, g in scored if g == label and k != key)[:5]
        for score, positive in near:
            p = -score
            fits = sorted((-s, k) for s, k, g in scored if g != label and 50 * p <= 100 * s <= 95 * p)[:3]
            out += [(key, positive, i + 1, k, p, -s) for i, (s, k) in enumerate(fits)]
    return sorted(out)


def vectors(n: int, dims: int):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((6, dims))
    out = []
    for i in range(n):
        v = centres[rng.integers(6)] + 0.6 * rng.standard_normal(dims)
        out.append((i, (v / np.linalg.norm(v)).astype(np.float32).tolist(), int(rng.integers(10))))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives_equal_all_pairs(spark, tmp_path, monkeypatch, small):
    if small:
        for name, value in (("BLOCK", 16), ("CHUNK", 3), ("GROUP", 2), ("PAGE", 8), ("WIDE", 32)):
            monkeypatch.setattr(hn, name, value)
    rows = vectors(900, 12)
    rows += [(1000 + i, rows[0][1], i % 4) for i in range(150)]  # copies of an anchor, with ties by key
    rows += [(2000, None, 1), (2050, [math.nan] * 12, 1), (2100, [None] + [0.5] * 11, 1), (None, rows[3][1], 2), (2150, rows[4][1], None)]
    rows += [(2200, [0.0] * 12, 3), (2250, [1.0, 2.0], 3), (2251, [1.0, 1.5], 3), (2252, [1.0, 1.0], 4), (2300, [], 5), (2350, [1e6] * 12, 2), (2351, [1e6] * 12, 2)]
    schema = "vec_id long, embedding array<float>, label int, home long, chunk string, n string, at string"
    spark.createDataFrame([(*r, 1, "c", "n", "a") for r in rows], schema).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in queries.op13_hard_negatives(spark, str(tmp_path)).collect())
    want = plain_negatives(rows)
    assert got == want
    assert len(want) > 100


def test_no_vectors_give_no_negatives(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.op13_hard_negatives(spark, str(tmp_path)).collect() == []


def test_empty_documents(spark, tmp_path):
    assert ef.edit_report(table(spark, [])).collect() == []
    assert [tuple(r)[0] for r in ef.edit_report(table(spark, [(5, "alone here", "en")])).collect()] == [5]


def test_zone_bounds_hold_every_score():
    rng = np.random.default_rng(7)
    block, anchors = rng.integers(-200, 200, (64, 10)), rng.integers(-200, 200, (20, 10))
    low, high = hn.bounds(anchors, block.min(axis=0)[None], block.max(axis=0)[None])
    score = anchors @ block.T
    assert (low <= score.min(axis=1, keepdims=True)).all() and (high >= score.max(axis=1, keepdims=True)).all()


def test_the_curve_visits_every_cell_once_and_steps_to_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        order = np.array(sorted(range(len(cells)), key=hn.hilbert(cells, bits).__getitem__))
        assert len(set(hn.hilbert(cells, bits))) == len(cells)
        assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("name, source", [("op12_manifest", "documents"), ("op13_hard_negatives", "embeddings")])
def test_sql_gives_the_same_rows(spark, tmp_path, texts, name, source):
    if source == "documents":
        table(spark, texts + [(None, "Null key", "de")]).write.parquet(f"{tmp_path}/documents.parquet")
    else:
        spark.createDataFrame(vectors(400, 8), "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    df = queries.op_queries()[name](spark, str(tmp_path))
    database = duckdb.connect()
    database.execute(f"CREATE VIEW {source} AS SELECT * FROM '{tmp_path}/{source}.parquet/*.parquet'")
    found = database.execute(queries.op_sql()[name])
    assert [c[0] for c in found.description] == df.columns
    assert sorted(found.fetchall(), key=str) == sorted(map(tuple, df.collect()), key=str)
