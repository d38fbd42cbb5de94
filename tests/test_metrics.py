"""Measures, extract and reports against plain Python over seeded random rows."""

import datetime as dt
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartlens.plans import metrics as M
from cartlens.plans.analyses import ANALYSES, with_cells
from cartlens.plans.extract import (
    LABEL_LATE, LABEL_NO_DATE, LABEL_ON_TIME, PRIVATE_COLUMNS, WHITELIST, PrivacyError,
    ReconciliationError, extract_tables, require_public, require_reconciled,
)
from cartlens.plans.reports import (
    overview, partial_cohorts, purchase_profile, row_profile, sensitivity_summary, top_states,
)
from cartlens.plans.staging import stage_all
from plain import item_facts, measures, order_facts
from sample import CONFIG, build, changed, item, journeys, raw_tables, records, tidy


ROWS = tidy()


def in_window(config=CONFIG):
    return [f for f in order_facts(ROWS).values() if config.analysis_start <= f["purchase_date"] <= config.analysis_end]


def orders(spark, extra=()):
    return build(spark, ROWS).orders(M.fact_columns(M.ALL_ORDER_METRICS, extra), CONFIG)


def same(row, facts, min_orders=M.MIN_INVESTIGATION_ORDERS):
    """All measures of one row against the counts, ratios and quantiles of its orders."""
    counts = measures(facts)
    assert {name: row[name] for name in counts if name in row} == {name: n for name, n in counts.items() if name in row}
    for name, (top, bottom) in M.RATIOS.items():
        if name in row:
            want = float(counts[top]) / counts[bottom] if counts[bottom] else None
            assert row[name] == (pytest.approx(want) if want is not None else None), name
    days = [f["delivery_days"] for f in facts if f["order_status"] == "delivered" and f["delivery_days"] is not None]
    for name, q in M.QUANTILES.items():
        assert row[name] == (pytest.approx(np.quantile(days, q)) if days else None), name
    for name, source in M.MASKED.items():
        if name in row:
            assert row[name] == (row[source] if counts["delivered_orders"] >= min_orders else None), name


def test_every_measure_over_the_window(spark):
    for least in (5, 10_000):
        same(records(M.metrics(orders(spark), names=M.ALL_ORDER_METRICS, min_orders=least))[0], in_window(), least)


def test_empty_input_gives_zero_counts_and_null_ratios(spark):
    same(records(M.metrics(orders(spark).filter(F.lit(False)), names=M.ALL_ORDER_METRICS))[0], [])


def test_groups_and_masks(spark):
    by_state = M.metrics(orders(spark, ["customer_state"]), ["customer_state"], M.ALL_ORDER_METRICS, min_orders=9)
    found, facts = records(by_state, "customer_state"), in_window()
    assert set(found) == {f["customer_state"] for f in facts}
    for state, row in found.items():
        same(row, [f for f in facts if f["customer_state"] == state], 9)
    assert {row["state_investigation_orders"] is None for row in found.values()} == {True, False}


def test_contexts_overlap_and_stay_when_empty(spark):
    first = dt.date(2020, 2, 1)
    rules = {
        "all": (F.lit(True), lambda f: True),
        "early": (F.col("purchase_date") < F.lit(first), lambda f: f["purchase_date"] < first),
        "coast": (F.col("customer_state") == "Coast", lambda f: f["customer_state"] == "Coast"),
        "none": (F.col("customer_state") == "Moon", lambda f: False),
        "unknown": (F.lit(None).cast("boolean"), lambda f: False),
    }
    contexts = {name: column for name, (column, _) in rules.items()}
    found = records(M.metrics_by_context(orders(spark, ["purchase_date", "customer_state"]), contexts), "context")
    assert set(found) == set(rules)
    for name, (_, holds) in rules.items():
        same(found[name], [f for f in in_window() if holds(f)])


def test_filters_reach_the_right_fact(spark):
    model, facts = build(spark, ROWS), order_facts(ROWS).values()
    first, last, states = dt.date(2020, 1, 1), dt.date(2020, 2, 20), ("Coast", "Hills")
    where = M.Filters(first, last, states)
    assert where.on_orders(model.orders()).count() == sum(first <= f["purchase_date"] <= last and f["customer_state"] in states for f in facts)
    kinds = ("sort 3", "sorte 01")
    sold = [i for i in item_facts(ROWS).values() if i["category"] in kinds and i["order_status"] == "delivered"]
    chosen = M.Filters(categories=kinds)
    amounts = records(M.item_gmv(chosen.on_items(model.items()), ["category"]), "category")
    assert {kind: amounts[kind]["item_gmv"] for kind in kinds} == {kind: sum(i["price"] for i in sold if i["category"] == kind) for kind in kinds}
    with pytest.raises(ValueError, match="category"):
        chosen.on_orders(model.orders())


def test_item_amount_is_null_where_nothing_was_delivered(spark):
    unsold = next(o["order_id"] for o in ROWS["orders"] if o["order_status"] == "canceled")
    rows = dict(ROWS, items=[*ROWS["items"], item(unsold, 90, "odd", "9.00")], products=[*ROWS["products"], {"product_id": "odd", "product_category_name": "sonst"}])
    amounts = records(M.item_gmv(build(spark, rows).items(), ["category"]), "category")
    assert amounts["sonst"]["item_gmv"] is None


def test_extract_is_whitelisted_and_grouped(spark):
    tables = extract_tables(build(spark, ROWS), CONFIG)
    require_reconciled(tables)
    for name, df in tables.items():
        assert tuple(df.columns) == WHITELIST[name]
        assert not PRIVATE_COLUMNS.intersection(df.columns)
    label = lambda f: LABEL_NO_DATE if not f["delivery_eligible"] else LABEL_LATE if f["is_late"] else LABEL_ON_TIME
    assert Counter(row["delay_group"] for row in tables["fact_orders"].collect()) == Counter(map(label, in_window()))
    days = records(tables["dim_date"], "month_label")
    assert set(days) == {"2020-01", "2020-02", "2020-03", "2020-04"}
    totals = Counter()
    for line in item_facts(ROWS).values():
        if line["order_status"] == "delivered" and CONFIG.analysis_start <= line["purchase_month"] <= CONFIG.analysis_end:
            totals[line["category"]] += line["price"]
    top = {kind for kind, _ in sorted(totals.items(), key=lambda x: (-x[1], x[0]))[:10]}
    groups = {row["category"]: row["category_group"] for row in tables["dim_category"].collect()}
    assert {kind for kind, group in groups.items() if group == kind} == top and len(groups) > 10


def test_extract_window_and_reconciliation_gate(spark):
    config = changed(CONFIG, analysis_start="2020-02-10")
    tables = extract_tables(build(spark, ROWS), config)
    assert tables["fact_orders"].count() == len(in_window(config))
    sold = tables["fact_order_items"].filter("order_status = 'delivered'")
    broken = dict(tables, fact_order_items=sold.limit(1))
    with pytest.raises(ReconciliationError):
        require_reconciled(broken)


def test_private_columns_are_refused(spark):
    with pytest.raises(PrivacyError, match="customer_unique_id"):
        require_public(build(spark, ROWS).orders(["customer_unique_id"]))


def test_sensitivity_sums_counts_instead_of_averaging(spark):
    columns = (
        "sample string, joint_eligible_orders long, on_time_orders long, late_orders long, "
        "on_time_low_score_orders long, late_low_score_orders long, answer_timestamp_orders long, "
        "early_answer_orders long"
    )
    rows = [
        ("ALL_JOINT", 150, 100, 50, 10, 25, 140, 9),
        ("ALL_JOINT", 200, 80, 120, 40, 24, 180, 4),
        ("ALL_JOINT", 5, 4, 1, 1, 1, 5, 0),
        ("EXCLUDE_EARLY_ANSWERS", 20, 20, 0, 5, 0, 10, 0),
    ]
    seen = records(sensitivity_summary(spark.createDataFrame(rows, columns), 30), "sample")
    every = seen["ALL_JOINT"]
    assert every["on_time_low_score_share"] == pytest.approx(51 / 184)
    assert every["late_low_score_share"] == pytest.approx(50 / 171)
    assert every["low_score_share_gap"] == pytest.approx(50 / 171 - 51 / 184)
    assert (every["populated_strata"], every["qualified_strata"]) == (3, 2)
    assert (every["positive_gap_strata"], every["negative_gap_strata"], every["equal_gap_strata"]) == (1, 1, 0)
    assert every["qualified_joint_coverage"] == pytest.approx(350 / 355)
    reduced = seen["EXCLUDE_EARLY_ANSWERS"]
    assert (reduced["late_low_score_share"], reduced["low_score_share_gap"], reduced["qualified_strata"]) == (None, None, 0)


def test_overview_equals_its_parts(spark):
    model, config = build(spark, ROWS), changed(CONFIG, min_state_orders=2)
    found = {name: question() for name, question in with_cells(model, config).items()}
    row, counts = records(overview(found))[0], measures(in_window())
    assert (row["merchandise_value"], row["delivered_orders"], row["all_orders"]) == (counts["gmv"], counts["delivered_orders"], counts["all_orders"])
    assert row["average_order_value"] == pytest.approx(float(counts["gmv"]) / counts["delivered_orders"])
    assert (row["late_orders"], row["joint_eligible_orders"]) == (counts["late_orders"], counts["joint_orders"])
    parts = ("merchandise_change", "order_count_contribution", "average_order_value_contribution")
    changes = [r for r in records(found["q02_monthly_change_decomposition"]) if None not in [r[name] for name in parts]]
    largest = max(changes, key=lambda r: abs(r["merchandise_change"]))
    assert (row["largest_change_month"], row["largest_change"]) == (largest["purchase_month"], largest["merchandise_change"])
    ranked = [r["customer_state"] for r in sorted((r for r in records(found["q04_state_investigation"]) if r["investigation_rank"]), key=lambda r: r["investigation_rank"])]
    assert [row[f"investigation_state_{n}"] for n in (1, 2, 3)] == (ranked + [None] * 3)[:3]
    assert [r["customer_state"] for r in top_states(found["q04_state_investigation"]).collect()] == ranked[:3]
    assert row["partial_cohorts"] == partial_cohorts(found["q10_repeat_cohort_30d"]).count()


def test_rolled_up_questions_equal_those_that_stand_alone(spark):
    model = build(spark, ROWS)
    for name, question in with_cells(model, CONFIG).items():
        left, right = question(), ANALYSES[name](model, CONFIG)
        assert left.dtypes == right.dtypes, name
        assert sorted(left.collect(), key=str) == sorted(right.collect(), key=str), name


def test_partial_cohorts(spark):
    cohorts = ANALYSES["q10_repeat_cohort_30d"](build(spark, journeys()), CONFIG)
    assert [row["cohort_month"].month for row in partial_cohorts(cohorts).orderBy("cohort_month").collect()] == [3, 4]


def test_profiles(spark):
    rows = dict(ROWS, items=[*ROWS["items"], dict(ROWS["items"][0])])
    raw = raw_tables(spark, rows)
    tables = stage_all(raw)
    counts = records(row_profile(raw, tables), "table_name")
    assert (counts["items"]["raw_rows"], counts["items"]["staged_rows"]) == (len(rows["items"]), len(ROWS["items"]))
    months = records(purchase_profile(tables), "month", "status")
    facts = order_facts(ROWS).values()
    for (month, status), row in months.items():
        own = [f["purchase_date"] for f in facts if (f["purchase_month"], f["order_status"]) == (month, status)]
        assert (row["orders"], row["purchase_days"]) == (len(own), len(set(own)))
    assert sum(row["orders"] for row in months.values()) == len(facts)
