"""The 72 checks on seeded random rows: what is broken on purpose is counted, and nothing else."""

import random
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cartlens.plans.analyses import ANALYSES
from cartlens.plans.model import StagedModel
from cartlens.plans.quality import (
    QualityError, analysis_checks, model_checks, quality_report, require_passed, staging_checks, summarize,
)
from cartlens.plans.staging import stage_all
from plain import item_facts, order_facts
from sample import CONFIG, build, changed, item, order, raw_tables, records, review, tidy

FIRST_THREE = [name for name in ANALYSES if name[:3] in ("q01", "q02", "q03")]
Q01, Q02, Q03 = FIRST_THREE
SEEDS = [1, 2, 3]


def values(checks):
    return {name: row["value"] for name, row in records(checks, "check").items()}


def staging_values(spark, rows):
    raw = raw_tables(spark, rows)
    return values(staging_checks(raw, stage_all(raw)))


@pytest.fixture(scope="module")
def model(spark):
    return build(spark, tidy())


@pytest.fixture(scope="module")
def found(spark, model):
    """The three results as small local tables, so that a test only changes cells."""
    return {name: stored(spark, ANALYSES[name](model, CONFIG)) for name in FIRST_THREE}


def stored(spark, df):
    return spark.createDataFrame(df.collect(), df.schema)


def with_cells(spark, df, change):
    """The table with each row passed through a function; None drops the row."""
    rows = [change(row.asDict()) for row in df.collect()]
    return spark.createDataFrame([tuple(r[c] for c in df.columns) for r in rows if r is not None], df.schema)


def checked(found, model, config=CONFIG, **replaced):
    return values(analysis_checks(found | replaced, model, config))


def test_check_counts_severities_and_warnings(spark, model, found):
    rows = tidy()
    raw = raw_tables(spark, rows)
    checks = [staging_checks(raw, model.staged), model_checks(model.staged, model), analysis_checks(found, model, CONFIG)]
    assert [frame.count() for frame in checks] == [45, 17, 10]
    every = [row for frame in checks for row in records(frame)]
    assert len({row["check"] for row in every}) == 72
    assert sum(row["severity"] == "error" for row in every) == 47
    facts = order_facts(rows).values()
    done = [f for f in facts if f["order_status"] == "delivered"]
    gaps = [f["payment_value"] - f["merchandise_value"] - f["freight_value"] for f in facts if f["payment_value"] is not None]
    per_order = defaultdict(int)
    for r in rows["reviews"]:
        per_order[r["order_id"]] += 1
    expected = {
        "reviews.invalid_score": sum(not 1 <= int(r["review_score"]) <= 5 for r in rows["reviews"]),
        "products.missing_category": sum(not p["product_category_name"] for p in rows["products"]),
        "products.untranslated_category": len({p["product_category_name"] for p in rows["products"]} - {""}) - len(rows["category_translation"]),
        "delivery.missing_or_invalid": sum(not f["delivery_eligible"] for f in done),
        "delivery.invalid_sequence": sum(f["delivered_timestamp"] is not None and f["delivered_timestamp"] < f["purchase_timestamp"] for f in done),
        "delivered.missing_payment": sum(f["payment_value"] is None for f in done),
        "payment.reconciliation_difference": sum(g != 0 for g in gaps),
        "payment.reconciliation_difference_gt_cent": sum(abs(g) > Decimal("0.01") for g in gaps),
        "reviews.multiple_orders": sum(n > 1 for n in per_order.values()),
        "reviews.missing_or_invalid": sum(not f["review_eligible"] for f in done),
        "reviews.before_delivery": sum(bool(f["delivery_eligible"] and f["review_eligible"] and f["review_before_delivery"]) for f in facts),
    }
    assert all(expected.values())
    assert {row["check"]: row["value"] for row in every if row["value"]} == expected
    assert {row["check"] for row in every if not row["passed"]} == set(expected)


def broken_rows(rng):
    """A tidy market with rows added for each staging rule, and how many of them break it."""
    rows, expected = tidy(), defaultdict(int)

    def often(*names):
        n = rng.randint(1, 4)
        for name in names:
            expected[name] += n
        return range(n)

    known = [o["order_id"] for o in rows["orders"]]
    for n in often("orders.key_conflicts"):
        rows["orders"].append(dict(rows["orders"][n], order_approved_at="2020-01-01"))
    for n in often("orders.missing_key", "orders.invalid_status", "orders.customer_id.unmatched", "orders.invalid_purchase_timestamp"):
        rows["orders"].append(order(" ", f"stranger{n}", rng.choice(["lost", ""]), "at noon"))
    expected["orders.key_conflicts"] += expected["orders.missing_key"] > 1  # several without a key share none
    for n in often("orders.order_approved_at.invalid_timestamp"):
        rows["orders"].append(order(f"late{n}", "c1", "shipped", "2020-01-01") | {"order_approved_at": f"2020-13-{n + 1}"})
    for n in often("items.exact_duplicate_rows"):
        rows["items"].append(dict(rows["items"][5 * n]))
    for n in often("items.price.invalid_amount", "items.freight_value.invalid_amount"):
        rows["items"].append(item(known[0], 50 + n, "g1", rng.choice(["-3", "1.005", "1e2", "?"]), rng.choice(["", "-0.01", "1.001"])))
    for n in often("items.order_item_id.invalid_key"):
        rows["items"].append(item(known[n], ["0", "-7", "-1", "+5"][n], "g1", "2.00"))
    for n in often("items.order_item_id.invalid_key", "items.missing_key"):
        rows["items"].append(item(known[n], "none", "g1", f"{n}.00"))
    for n in often("items.order_id.unmatched", "items.product_id.unmatched"):
        rows["items"].append(item(f"ghost{n}", 1, "gone", "1.00"))
    for n in often("items.shipping_limit_date.invalid_timestamp"):
        rows["items"].append(item(known[n], 70, "g1", "1.00") | {"shipping_limit_date": "tomorrow"})
    for n in often("reviews.key_conflicts", "reviews.ambiguous_selection"):
        rows["reviews"] += [review(f"twice{n}", known[n], score, "2020-02-01", "2020-02-03") for score in ("2", "4")]
    for n in often("reviews.invalid_score", "reviews.review_creation_date.invalid_timestamp", "reviews.review_answer_timestamp.invalid_timestamp"):
        rows["reviews"].append(review(f"odd{n}", known[n], rng.choice(["9", "0", "four"]), "2020-02-30", "later"))
    for n in often("payments.payment_value.invalid_amount", "payments.payment_sequential.invalid_key", "payments.order_id.unmatched"):
        rows["payments"].append({"order_id": f"ghost{n}", "payment_sequential": "0", "payment_type": "card", "payment_value": "1.234"})
    for n in often("products.missing_category"):
        rows["products"].append({"product_id": f"plain{n}", "product_category_name": " "})
    for n in often("products.untranslated_category"):
        rows["products"].append({"product_id": f"odd{n}", "product_category_name": f"ohne wort {n}"})
    for n in often("customers.missing_unique_identifier"):
        rows["customers"].append({"customer_id": f"nobody{n}", "customer_unique_id": " ", "customer_state": "Coast"})
    return rows, expected


@pytest.mark.parametrize("seed", SEEDS)
def test_staging_rules_count_broken_rows(spark, seed):
    rows, expected = broken_rows(random.Random(seed))
    before, after = staging_values(spark, tidy()), staging_values(spark, rows)
    assert {name: after[name] - before[name] for name in after if after[name] != before[name]} == dict(expected)


def test_copies_are_counted_over_all_loaded_columns(spark):
    rows = tidy()
    raw = raw_tables(spark, rows)
    raw["items"] = raw["items"].withColumn("load_no", F.monotonically_increasing_id())
    same = raw["items"].drop("load_no").withColumn("load_no", F.lit("1"))
    raw_same = dict(raw, items=same.unionByName(same))
    assert values(staging_checks(raw, stage_all(raw)))["items.exact_duplicate_rows"] == 0
    assert values(staging_checks(raw_same, stage_all(raw_same)))["items.exact_duplicate_rows"] == len(rows["items"])


@pytest.mark.parametrize("numbers", [1, 2])
def test_repeated_item_keys_block_a_run(spark, model, numbers):
    class Renumbered(StagedModel):
        def items(self, *args, **kwargs):
            return super().items(*args, **kwargs).withColumn("order_item_id", F.col("order_item_id") % numbers)

    lines = item_facts(tidy())
    kept = {(key, number % numbers) for key, number in lines}
    seen = records(model_checks(model.staged, Renumbered(model.staged)), "check")
    assert seen["fact_order_items.key_unique"]["value"] == len(lines) - len(kept) > 0
    assert {name for name, row in seen.items() if not row["passed"] and row["severity"] == "error"} == {"fact_order_items.key_unique"}
    checks = model_checks(model.staged, Renumbered(model.staged))
    assert summarize(checks).first()["status"] == "failed"
    with pytest.raises(QualityError) as error:
        require_passed(checks)
    assert error.value.checks == ["fact_order_items.key_unique"]


@pytest.mark.parametrize("seed", SEEDS)
def test_shifted_month_amounts_are_found(spark, model, found, seed):
    rng = random.Random(seed)
    shifts = defaultdict(Decimal)

    def shift(row):
        by = Decimal(rng.choice([0, 1, -250, 333])) / 100
        shifts[row["purchase_month"]] = by
        return row | {"merchandise_value": row["merchandise_value"] + by}

    seen = checked(found, model, **{Q01: with_cells(spark, found[Q01], shift)})
    assert seen["analysis.q01.window_merchandise"] == abs(sum(shifts.values()))
    assert seen["analysis.q01.month_merchandise"] == sum(by != 0 for by in shifts.values())
    assert seen["analysis.q03.window_merchandise"] == seen["analysis.q03.month_merchandise"] == 0


@pytest.mark.parametrize("seed", SEEDS)
def test_lost_category_cells_are_found_by_month(spark, model, found, seed):
    rng = random.Random(seed)
    lost = defaultdict(Decimal)

    def drop(row):
        if row["period"] == "WINDOW" or rng.random() > 0.2:
            return row
        lost[row["purchase_month"]] += row["merchandise_value"]
        return None

    seen = checked(found, model, **{Q03: with_cells(spark, found[Q03], drop)})
    assert seen["analysis.q03.month_merchandise"] == sum(amount != 0 for amount in lost.values())
    assert seen["analysis.q03.window_merchandise"] == 0


@pytest.mark.parametrize("seed", SEEDS)
def test_months_outside_and_twice_are_found(spark, model, found, seed):
    rng = random.Random(seed)
    months = [row["purchase_month"] for row in found[Q01].orderBy("purchase_month").collect()]
    moved = rng.sample(months, rng.randint(1, 3))
    away = with_cells(spark, found[Q01], lambda r: r | {"purchase_month": r["purchase_month"].replace(year=2031)} if r["purchase_month"] in moved else r)
    seen = checked(found, model, **{Q01: away})
    # a month that is absent and one that is not expected both differ
    assert seen["analysis.q01.month_merchandise"] == 2 * len(moved)
    assert seen["analysis.q01.month_boundary_flags"] == len(moved)
    again = found[Q01].filter(F.col("purchase_month").isin(moved))
    seen = checked(found, model, **{Q01: found[Q01].unionByName(again).unionByName(again)})
    assert seen["analysis.q01.month_unique"] == 2 * len(moved)


def test_an_unknown_amount_fails_the_total(spark, model, found):
    holes = with_cells(spark, found[Q01], lambda r: r | {"merchandise_value": None} if r["all_orders"] else r)
    row = records(analysis_checks(found | {Q01: holes}, model, CONFIG), "check")["analysis.q01.window_merchandise"]
    assert (row["value"], row["passed"]) == (None, False)


@pytest.mark.parametrize("seed", SEEDS)
def test_residuals_are_recomputed_to_the_cent(spark, model, found, seed):
    rng, expected = random.Random(seed), []

    def bend(row):
        part, by = rng.choice(["order_count_contribution", "average_order_value_contribution"]), rng.choice([0, 0.004, 0.02, -0.5, None])
        if row["average_order_value"] is None or row["previous_average_order_value"] is None:
            return row
        expected.append(by is None or abs(by) > 0.01)
        return row | {part: None if by is None else row[part] + by}

    seen = checked(found, model, **{Q02: with_cells(spark, found[Q02], bend)})
    assert seen["analysis.q02.decomposition_residual"] == sum(expected) and expected


@pytest.mark.parametrize("seed", SEEDS)
def test_wrong_boundary_flags_are_counted(spark, model, seed):
    rng = random.Random(seed)
    config = changed(CONFIG, analysis_start="2020-01-09", analysis_end="2020-04-21")
    own = {name: stored(spark, ANALYSES[name](model, config)) for name in FIRST_THREE}
    assert all(row["passed"] for row in records(analysis_checks(own, model, config)))
    assert sorted(row["complete_calendar_month"] for row in own[Q01].collect()) == [False, False, True, True]
    flips = [rng.random() < 0.6 for _ in range(4)]
    turned = iter(flips)
    wrong = with_cells(spark, own[Q01], lambda r: r | {"complete_calendar_month": r["complete_calendar_month"] != next(turned)})
    assert checked(own, model, config, **{Q01: wrong})["analysis.q01.month_boundary_flags"] == sum(flips)


def test_absent_and_doubled_results_are_reported(spark, model, found):
    gone = {name: df for name, df in found.items() if name != Q03}
    seen = checked(gone, model)
    assert seen["analysis.q03.result_count"] == 1
    assert seen["analysis.q03.window_merchandise"] == sum(row["merchandise_value"] for row in found[Q01].collect())
    seen = checked(found, model, q02_again=found[Q02], q02_and_again=found[Q02])
    assert seen["analysis.q02.result_count"] == 2


def test_report_lists_failed_warnings_first(model):
    rows = records(quality_report(model_checks(model.staged, model)))
    sections = [row["section"] for row in rows]
    assert sections == sorted(sections, reverse=True)
    assert sections.count("all") == 17
    assert all(row["severity"] == "warning" and row["value"] for row in rows if row["section"] == "warnings")
