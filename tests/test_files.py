"""Quoted CSV by byte ranges, hash trees over lines, and exports whose bytes do not depend on the cluster."""

import csv
import hashlib
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cartlens.operators.distributions import counted_distribution
from cartlens.operators.numbering import in_ranges, with_row_number
from cartlens.sources import file_lines, results
from cartlens.sources.csv_source import content_hashes
from cartlens.sources.quoted_csv import read_quoted
from cartlens.sources.results import export_csv, read_export

COLUMNS = ["k", "a", "b"]


@pytest.fixture
def ranges_of(spark):
    """Set the size of byte ranges for a test."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {name: spark.conf.get(name) for name in names}

    def set_to(size):
        for name, value in zip(names, (size, 0)):
            spark.conf.set(name, str(value))

    yield set_to
    for name, value in before.items():
        spark.conf.set(name, value)


def write_rows(path, rows, end="\n", bom=False):
    with path.open("w", newline="", encoding="utf-8-sig" if bom else "utf-8") as stream:
        writer = csv.writer(stream, lineterminator=end)
        writer.writerow(COLUMNS)
        writer.writerows(rows)


def random_rows(seed, n, name):
    rng = random.Random(seed)
    pieces = ["a", "b", '"', "\n", "\r\n", ",", "é", "x" * 20, "", "\n\n"]
    field = lambda: "".join(rng.choice(pieces) for _ in range(rng.randrange(6)))
    return [(f"{name}-{i}", field(), field()) for i in range(n)]


def whole_files(spark, path):
    schema = ", ".join(f"{name} string" for name in COLUMNS)
    read = spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"')
    return sorted(map(tuple, read.option("multiLine", True).option("mode", "FAILFAST").csv(str(path)).collect()))


@pytest.mark.parametrize("end, bom", [("\n", False), ("\r\n", True)])
def test_quoted_files_read_by_ranges_equal_whole_files(spark, tmp_path, ranges_of, end, bom):
    for part in range(2):
        write_rows(tmp_path / f"{part}.csv", random_rows(part, 150, part), end, bom)
    want = whole_files(spark, tmp_path)
    for size in (300, 2500, 1 << 20):  # records that span several ranges, borders in quoted fields, one range
        ranges_of(size)
        assert sorted(map(tuple, read_quoted(spark, str(tmp_path), COLUMNS).collect())) == want
    assert len(want) == 300


def test_lines_of_one_range_are_dealt_by_stretches(spark, tmp_path, ranges_of, monkeypatch):
    for part in range(2):
        write_rows(tmp_path / f"{part}.csv", [*random_rows(part, 150, part), (f"{part}-long", "x\n" * 40, '"')])
    want = whole_files(spark, tmp_path)
    ranges_of(1 << 20)
    roots = sorted(row.root for row in content_hashes(spark, [str(tmp_path)]).collect())
    monkeypatch.setattr(file_lines, "STRETCH_BITS", 3)
    held = file_lines.lines(spark, str(tmp_path)).groupBy("file", "cut", "stretch").count().collect()
    assert len(held) > 3 * len({(row.file, row.cut) for row in held}) and max(row["count"] for row in held) <= 8
    assert sorted(map(tuple, read_quoted(spark, str(tmp_path), COLUMNS).collect())) == want
    assert sorted(row.root for row in content_hashes(spark, [str(tmp_path)]).collect()) == roots


def test_one_long_quoted_field_may_span_many_ranges(spark, tmp_path, ranges_of):
    rows = [("1", "x\n" * 3000, "y"), ("2", '"' * 501, "\n"), ("3", "", "end")]
    write_rows(tmp_path / "f.csv", rows)
    ranges_of(700)
    df = read_quoted(spark, str(tmp_path / "f.csv"), COLUMNS)
    assert sorted(map(tuple, df.collect())) == [(k, a or None, b) for k, a, b in rows]


def test_malformed_quoted_rows_and_other_headers_fail(spark, tmp_path):
    for name, text in (("short", "k,a,b\n1,2\n"), ("header", "k,b,a\n1,2,3\n")):
        (tmp_path / f"{name}.csv").write_text(text)
        with pytest.raises((PySparkException, Py4JJavaError)):
            read_quoted(spark, str(tmp_path / f"{name}.csv"), COLUMNS).collect()


def tree(digests):
    while True:
        digests = [hashlib.sha256("".join(digests[i : i + file_lines.FAN]).encode()).hexdigest() for i in range(0, len(digests), file_lines.FAN)]
        if len(digests) == 1:
            return digests[0]


def test_file_hashes_depend_on_order_and_line_ends_but_not_on_the_split(spark, tmp_path, ranges_of, monkeypatch):
    monkeypatch.setattr(file_lines, "FAN", 16)
    lines = [f"line {i % 7} {i}" for i in range(400)]
    texts = {"plain": "\n".join(lines), "swapped": "\n".join(lines[1:2] + lines[:1] + lines[2:]), "crlf": "\r\n".join(lines)}
    found = {}
    for size in (600, 1 << 20):
        ranges_of(size)
        for name, text in texts.items():
            (tmp_path / f"{name}.txt").write_bytes(text.encode())
            root = content_hashes(spark, [str(tmp_path / f"{name}.txt")]).collect()[0]["root"]
            assert root == tree([hashlib.sha256(x.encode()).hexdigest() for x in text.split("\n")])
            found.setdefault(name, set()).add(root)
    assert all(len(roots) == 1 for roots in found.values()) and len(set.union(*found.values())) == 3


def test_exports_have_the_same_bytes_for_any_number_of_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(results, "PART_ROWS", 256)
    monkeypatch.setattr(results, "PART_LEVELS", 1)
    rng = random.Random(2)
    rows = [(rng.randrange(50), rng.choice([None, "a,b", 'q"', "x\ny", ""]), rng.random()) for _ in range(1000)]
    df = spark.createDataFrame(rows, "n int, s string, x double")
    seen = []
    for partitions in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        path = tmp_path / str(partitions)
        described = export_csv(df.repartition(partitions), str(path))
        texts = {part.name: "".join(f.read_text() for f in part.glob("part-*.csv")) for part in (path / "data").glob("part=*")}
        hashes = spark.read.parquet(f"{path}/parts").orderBy("no").collect()
        seen.append((described, texts, [(r["no"], r["digest"]) for r in hashes]))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert seen[0] == seen[1]
    assert (seen[0][0]["rows"], sorted(seen[0][1])) == (1000, ["part=0", "part=1", "part=2", "part=3"])
    assert len(seen[0][2]) == 4
    plain = export_csv(df.filter("s is null or s not like '%\n%'"), str(tmp_path / "plain"))
    assert read_export(spark, str(tmp_path / "plain"), df.schema).count() == plain["rows"]
    changed = export_csv(df.withColumn("n", F.when(F.col("x") == rows[3][2], -1).otherwise(F.col("n"))), str(tmp_path / "other"))
    assert changed["hash"] != seen[0][0]["hash"]
    assert export_csv(df.limit(0), str(tmp_path / "none"))["rows"] == 0


def test_row_numbers_are_the_places_in_the_order(spark):
    rng = random.Random(3)
    values = [rng.choice([None, *range(40)]) for _ in range(500)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int").repartition(6)
    found = with_row_number(in_ranges(df, [F.col("v").desc_nulls_last(), F.col("i")], "numbers")).collect()
    order = sorted(range(500), key=lambda i: (values[i] is None, -(values[i] or 0), i))
    assert [r["i"] for r in sorted(found, key=lambda r: r["no"])] == order
    assert sorted(r["no"] for r in found) == list(range(500))


def test_quantiles_from_value_counts_equal_sorted_values(spark):
    rng, rows = random.Random(4), []
    for group, size in (("big", 3000), ("ties", 400), ("one", 1), ("none", 0), (None, 50)):
        rows += [(group, rng.randrange(10**12) if group == "big" else rng.randrange(9), rng.randint(1, 4)) for _ in range(size)]
        rows.append((group, None, 5))
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    counts = spark.createDataFrame(rows, "g string, _ticks long, _n long")
    found = {r["g"]: r for r in counted_distribution(counts, ["g"], {"low": 0.0, "mid": 0.5, "p90": 0.9, "top": 1.0}).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    for group in {g for g, _, _ in rows}:
        values = sorted(v for g, v, n in rows if g == group and v is not None for _ in range(n))
        row = found[group]
        assert (row["rows"], row["values"]) == (len(values) + 5, len(values))
        assert (row["min_ticks"], row["max_ticks"]) == ((values[0], values[-1]) if values else (None, None))
        for name, q in (("low", 0), ("mid", 0.5), ("p90", 0.9), ("top", 1)):
            at = (len(values) - 1) * q
            low, high = (values[int(at)], values[min(int(at) + 1, len(values) - 1)]) if values else (None, None)
            assert row[name] == (pytest.approx(low + (high - low) * (at - int(at))) if values else None)
