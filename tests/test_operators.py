"""Operators against brute force in pandas / numpy on generated rows."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cartlens.functions.casts import text_to_flag
from cartlens.functions.measures import guarded_sum, is_not_true, safe_ratio
from cartlens.functions.time import month_sequence
from cartlens.operators.calendar import day_spine, dense_grid, month_spine
from cartlens.operators.checks import (
    duplicate_rows, fk_orphans, key_conflicts, reconcile, table_fingerprint,
)
from cartlens.operators.distributions import scoped_distribution
from cartlens.operators.enrich import Lookup, star_enrich
from cartlens.operators.events import first_and_next_event
from cartlens.operators.ranking import latest_row, threshold_rank, top_n_other
from cartlens.operators.samples import sample_counts, sample_expand
from cartlens.operators.shares import contribution_share
from sample import records

RELAXED = settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
GROUPS = st.sampled_from(["hot", "hot", "hot", "a", None])
TICKS = st.one_of(
    st.none(), st.integers(-5, 5), st.integers(-(2**45), 2**45), st.integers(0, 3 * 10**6)
)


@RELAXED
@given(rows=st.lists(st.tuples(GROUPS, st.sampled_from(["x", "y"]), TICKS), min_size=1, max_size=60))
def test_scoped_quantiles_equal_numpy(spark, rows):
    df = spark.createDataFrame(rows, "g string, h string, v long")
    found = records(
        scoped_distribution(
            df, {"all": [], "g": ["g"], "h": ["h"]}, F.col("v"), {"p0": 0.0, "p50": 0.5, "p90": 0.9, "p100": 1.0},
        ),
        "scope", "g", "h",
    )
    groups = {("all", None, None): rows}
    for row in rows:
        groups.setdefault(("g", row[0], None), []).append(row)
        groups.setdefault(("h", None, row[1]), []).append(row)
    assert set(found) == set(groups)
    for key, members in groups.items():
        values = [row[2] for row in members if row[2] is not None]
        seen = found[key]
        assert (seen["rows"], seen["values"]) == (len(members), len(values))
        assert (seen["min_ticks"], seen["max_ticks"]) == ((min(values), max(values)) if values else (None, None))
        for name, q in (("p0", 0), ("p50", 50), ("p90", 90), ("p100", 100)):
            expected = np.percentile(np.array(values, dtype=float), q) if values else None
            assert seen[name] == (None if expected is None else pytest.approx(expected, rel=1e-12, abs=1e-6))


@RELAXED
@given(st.lists(st.tuples(st.sampled_from(["hot", "hot", "a", "b"]), st.integers(0, 6), st.integers(0, 9)), min_size=1, max_size=50))
def test_first_and_next_events_equal_brute_force(spark, rows):
    start = dt.datetime(2020, 1, 1)
    events = [(who, start + dt.timedelta(hours=12 * step), f"e{n}") for who, step, n in rows]
    df = spark.createDataFrame(events, "who string, at timestamp_ntz, id string")
    cutoff = dt.datetime(2020, 1, 3, 12)
    found = records(first_and_next_event(df, "who", "at", "id", 1, cutoff), "who")
    for who in {row[0] for row in events}:
        mine = [row for row in events if row[0] == who]
        times = sorted({row[1] for row in mine})
        first, later = times[0], times[1] if len(times) > 1 else None
        seen = found[who]
        assert seen["first_ts"] == first and seen["next_ts"] == later
        assert seen["first_id"] == min(row[2] for row in mine if row[1] == first)
        assert seen["next_id"] == (min(row[2] for row in mine if row[1] == later) if later else None)
        assert seen["simultaneous_rows"] == sum(row[1] == first for row in mine) - 1
        assert seen["total_rows"] == len(mine)
        assert seen["repeated"] == (later is not None and later - first <= dt.timedelta(days=1))
        assert seen["has_full_horizon"] == (first + dt.timedelta(days=1) <= cutoff)


@RELAXED
@given(st.lists(st.tuples(st.sampled_from("abcdefg"), st.integers(0, 4), st.integers(0, 9)), min_size=1, max_size=60))
def test_top_n_other_equals_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "kind string, id int, amount int")
    found = records(top_n_other(df, "kind", "amount", 3, "id"), "group_name")
    totals = {}
    for kind, _, amount in rows:
        totals[kind] = totals.get(kind, 0) + amount
    ranked = sorted(totals, key=lambda kind: (-totals[kind], kind))
    expected = {}
    for position, kind in enumerate(ranked, 1):
        name, rank = (kind, position) if position <= 3 else ("OTHER", 4)
        amount, ids, _ = expected.get(name, (0, set(), rank))
        expected[name] = (amount + totals[kind], ids | {i for k, i, _ in rows if k == kind}, rank)
    assert {n: (r["amount"], r["distinct_ids"], r["group_rank"]) for n, r in found.items()} == {
        n: (amount, len(ids), rank) for n, (amount, ids, rank) in expected.items()
    }


def test_latest_row_with_nulls_last(spark):
    rows = [("k", None, 1), ("k", 5, 2), ("k", 5, 1), ("j", None, 7)]
    df = spark.createDataFrame(rows, "k string, t int, id int")
    order = [F.col("t").desc_nulls_last(), F.col("id").asc_nulls_last()]
    found = records(latest_row(df, ["k"], order), "k")
    assert (found["k"]["t"], found["k"]["id"], found["j"]["id"]) == (5, 1, 7)


def test_guarded_sum_needs_every_value(spark):
    rows = [("ok", 1), ("ok", 2), ("hole", 1), ("hole", None), ("minus", -1), ("minus", 3)]
    df = spark.createDataFrame(rows, "k string, v int")
    found = records(
        df.groupBy("k").agg(
            guarded_sum(F.col("v")).alias("strict"), guarded_sum(F.col("v"), False).alias("signed")
        ),
        "k",
    )
    assert {k: (r["strict"], r["signed"]) for k, r in found.items()} == {
        "ok": (3, 3), "hole": (None, None), "minus": (None, 2),
    }


def test_ratio_and_null_safe_exclusion(spark):
    df = spark.createDataFrame([(1, 2, True), (1, 0, None), (None, 3, False)], "a int, b int, c boolean")
    assert [row[0] for row in df.select(safe_ratio(F.col("a"), F.col("b"))).collect()] == [0.5, None, None]
    assert df.filter(is_not_true(F.col("c"))).count() == 2


def test_spines_and_grid(spark):
    months = [row[0] for row in month_spine(spark, dt.date(2020, 1, 31), dt.date(2020, 3, 1)).collect()]
    assert months == [dt.date(2020, 1, 1), dt.date(2020, 2, 1), dt.date(2020, 3, 1)]
    assert day_spine(spark, dt.date(2020, 2, 28), dt.date(2020, 3, 1)).count() == 3
    members = spark.createDataFrame([("n",), ("s",)], "state string")
    grid = dense_grid(
        members,
        {"m": month_sequence(dt.date(2020, 1, 1), dt.date(2020, 2, 1)), "x": F.array(F.lit(1), F.lit(2), F.lit(3))},
    )
    assert grid.distinct().count() == 12


def test_threshold_rank_skips_unqualified_rows(spark):
    df = spark.createDataFrame([("a", 9, True), ("b", 5, False), ("c", 7, True), ("d", 9, None)], "k string, v int, q boolean")
    order = [F.col("v").desc_nulls_last(), F.col("k").asc_nulls_last()]
    found = records(threshold_rank(df, F.col("q"), order, "r"), "k")
    assert {k: row["r"] for k, row in found.items()} == {"a": 1, "b": None, "c": 2, "d": None}


def test_shares_of_all_and_of_partition(spark):
    df = spark.createDataFrame([("a", "x", 1), ("b", "x", 3), ("c", None, 4)], "k string, p string, v int")
    found = records(contribution_share(contribution_share(df, "v", "whole"), "v", "part", "p"), "k")
    assert {k: (r["whole"], r["part"]) for k, r in found.items()} == {
        "a": (0.125, 0.25), "b": (0.375, 0.75), "c": (0.5, 1.0),
    }


def test_sample_counts_equal_expanded_rows(spark):
    rows = [(n % 3, None if n % 5 == 0 else n % 2 == 0, n % 4) for n in range(60)]
    df = spark.createDataFrame(rows, "k int, e boolean, s int")
    samples = {"all": F.lit(True), "late": is_not_true(F.col("e"))}
    fast = sample_counts(df, ["k"], samples, {"n": F.lit(True), "low": F.col("s") < 2})
    slow = sample_expand(df, samples).groupBy("k", "sample").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("s") < 2).alias("low")
    )
    assert records(fast, "k", "sample") == records(slow, "k", "sample")


def test_enrichment_keeps_rows_and_fills_unknown(spark):
    fact = spark.createDataFrame([(1, 10), (2, 99), (3, None)], "id int, p int")
    parts = spark.createDataFrame([(10, "bolt", 7)], "p_id int, name string, maker int")
    makers = spark.createDataFrame([(7, "acme")], "m_id int, brand string")
    wide = star_enrich(
        fact, [Lookup(parts, "p", "p_id", ("name", "maker")), Lookup(makers, "maker", "m_id", ("brand",))], ("name", "brand")
    )
    assert [(r["id"], r["name"], r["brand"]) for r in wide.orderBy("id").collect()] == [
        (1, "bolt", "acme"), (2, "UNKNOWN", "UNKNOWN"), (3, "UNKNOWN", "UNKNOWN"),
    ]


def test_checks_on_nulls_and_copies(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), (None, 3), (None, 4)], "k string, v int")
    conflicts = {(r["k"], r["rows"]) for r in key_conflicts(df, ["k"]).collect()}
    assert conflicts == {("a", 3), (None, 2)}
    assert duplicate_rows(df).first()[0] == 1
    parent = spark.createDataFrame([("b",)], "k string")
    assert fk_orphans(df, "k", parent, "k").first()[0] == 5
    assert fk_orphans(df, "k", df, "k").first()[0] == 2


def test_reconcile_reports_missing_sides(spark):
    left = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    right = spark.createDataFrame([("a", 1.005), ("c", 2.0)], "k string, v double")
    found = records(reconcile(left, right, ["k"], "v", 0.01), "k")
    assert {k: r["matches"] for k, r in found.items()} == {"a": True, "b": False, "c": False}


def test_fingerprint_ignores_order_and_sees_changes(spark):
    rows = [(n, str(n % 7)) for n in range(200)]
    frame = pd.DataFrame(rows, columns=["n", "s"])
    one = table_fingerprint(spark.createDataFrame(rows, "n int, s string")).first()
    two = table_fingerprint(spark.createDataFrame(rows[::-1], "n int, s string").repartition(5)).first()
    three = table_fingerprint(spark.createDataFrame(rows[1:] + [(0, "x")], "n int, s string")).first()
    assert one == two and one["rows"] == len(frame)
    assert one["checksum"] != three["checksum"]


def test_flags_read_back_from_text(spark):
    df = spark.createDataFrame([("true",), ("True",), ("1",), ("false",), ("",), (None,)], "t string")
    assert [row[0] for row in df.select(text_to_flag(F.col("t"))).collect()] == [True, True, True, False, False, False]
