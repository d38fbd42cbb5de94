"""Staging and facts against plain Python over seeded random rows, rule by rule."""

import random

import pytest

from cartlens.plans.model import ORDER_COLUMNS
from cartlens.plans.staging import stage_all
from plain import chosen_review, guarded, item_facts, money, order_facts
from sample import CONFIG, build, item, market, order, raw_tables, records, review, staged, tidy


def close(found, expected):
    assert set(found) == set(expected)
    for key, want in expected.items():
        got = {name: found[key][name] for name in want}
        days = "delivery_days"
        if want.get(days) is not None:
            assert got.pop(days) == pytest.approx(want[days])
            want = {name: value for name, value in want.items() if name != days}
        assert got == want, key


@pytest.mark.parametrize("rows", [market(), tidy()], ids=["market", "tidy"])
def test_order_fact_equals_a_plain_calculation(spark, rows):
    expected = order_facts(rows)
    assert set(ORDER_COLUMNS) == set(next(iter(expected.values())))
    assert {f["is_late"] for f in expected.values()} == {True, False, None}
    close(records(build(spark, rows).orders(), "order_id"), expected)


def test_item_fact_equals_a_plain_calculation(spark):
    rows = market()
    rows["items"] += [item("nobody", 1, "g0", "7.00"), item("n1", 9, "no product", "3.00")]
    close(records(build(spark, rows).items(), "order_id", "order_item_id"), item_facts(rows))


@pytest.mark.parametrize("seed", range(3))
def test_one_review_is_chosen_per_order(spark, seed):
    """Few different times, ids and scores, so that every step of the order has ties."""
    rng = random.Random(seed)
    rows = {"orders": [order(f"o{n}", "k", "delivered", "2020-01-01") for n in range(40)], "reviews": []}
    for n in range(40):
        for _ in range(rng.randint(0, 6)):
            created, answered = (rng.choice([None, "2020-01-05", "2020-01-06"]) for _ in range(2))
            rows["reviews"].append(review(rng.choice("abc"), f"o{n}", str(rng.randint(1, 5)), created, answered))
    found = records(build(spark, rows).orders(["order_id", "review_score", "review_creation_date"]), "order_id")
    close(found, {key: {name: f[name] for name in ("review_score", "review_creation_date")} for key, f in order_facts(rows).items()})
    assert chosen_review([]) is None


def test_amounts_are_known_only_if_every_line_is(spark):
    """All combinations of up to two lines, with copies of whole rows thrown in."""
    texts = ["5", "0.10", "?", "-1", "", "1e1"]
    pairs = [()] + [(a,) for a in texts] + [(a, b) for a in texts for b in texts]
    rows = {"orders": [order(f"o{n}", "k", "delivered", "2020-01-01") for n in range(len(pairs))], "items": []}
    for n, prices in enumerate(pairs):
        rows["items"] += [item(f"o{n}", number + 1, "p", text) for number, text in enumerate(prices)]
    rows["items"] += [dict(rows["items"][i]) for i in range(0, len(rows["items"]), 3)]
    found = records(build(spark, rows).orders(["order_id", "item_count", "merchandise_value"]), "order_id")
    for n, prices in enumerate(pairs):
        want = (len(prices), guarded([money(text) for text in prices]))
        assert (found[f"o{n}"]["item_count"], found[f"o{n}"]["merchandise_value"]) == want, prices
    kept = {row["price_raw"]: row["price"] for row in records(staged(spark, rows)["items"])}
    assert kept == {text: money(text) for text in texts}


def test_delivery_flags_around_each_border(spark):
    """Arrival and promise just before, at and after the purchase, the day and each other."""
    moments = [None, "2020-01-05 09:59:59", "2020-01-05 10:00:00", "2020-01-05 23:59:59", "2020-01-06 00:00:00", "soon"]
    kinds = [(s, a, p) for s in ("delivered", "shipped") for a in moments for p in moments]
    rows = {"orders": [order(f"o{n}", "k", s, "2020-01-05 10:00:00", a, p) for n, (s, a, p) in enumerate(kinds)]}
    read = {"orders": [dict(o) for o in rows["orders"]]}
    for o in read["orders"]:
        for name in ("order_delivered_customer_date", "order_estimated_delivery_date"):
            o[name] = None if o[name] == "soon" else o[name]
    names = ["order_id", "delivery_days", "delivery_eligible", "is_late"]
    expected = {key: {name: f[name] for name in names} for key, f in order_facts(read).items()}
    close(records(build(spark, rows).orders(names), "order_id"), expected)


@pytest.mark.parametrize("text", ["1.5", "6", "+3", "-1", "03", "x", "", " 4 ", "5\n", "0"])
def test_a_score_is_a_whole_number_from_one_to_five(spark, text):
    rows = {"orders": [order("o", "k", "delivered", "2020-01-01")], "reviews": [review("r", "o", text, "2020-01-02")]}
    plain = text.strip(" ")
    score = int(plain) if plain.lstrip("+-").isdigit() and plain == plain.strip() else None
    found = records(build(spark, rows).orders())[0]
    assert (found["review_score"], found["review_eligible"]) == (score, score is not None and 1 <= score <= 5)


def test_dimensions_hold_all_members_and_days(spark):
    rows, model = market(), build(spark, market())
    facts = order_facts(rows).values()
    assert {r["customer_state"] for r in model.states().collect()} == {f["customer_state"] for f in facts} | {"UNKNOWN"}
    assert {r["category"] for r in model.categories().collect()} == {f["category"] for f in item_facts(rows).values()} | {"UNKNOWN"}
    first = min([f["purchase_date"] for f in facts] + [CONFIG.analysis_start])
    last = max([f["purchase_date"] for f in facts] + [CONFIG.analysis_end])
    days = records(model.dates(CONFIG), "date")
    assert (min(days), max(days), len(days)) == (first, last, (last - first).days + 1)


def test_narrow_fact_equals_wide_fact(spark):
    model = build(spark, market())
    columns = ["order_id", "merchandise_value", "is_late"]
    narrow = records(model.orders(columns), "order_id")
    wide = records(model.orders(), "order_id")
    assert narrow == {key: {name: row[name] for name in columns} for key, row in wide.items()}


def test_tolerant_casts(spark):
    rows = {
        "orders": [order(" o1 ", "", "delivered", t) for t in ("2020", "2020-01", "2020-02-30", " 2020-01-05 ")],
        "products": [
            {"product_id": "p", "product_photos_qty": q, "product_weight_g": w}
            for q, w in (("1.5", "2.5"), ("2.5", "x"), ("1e2", ""), ("y", None), ("1_000", "12d"))
        ],
    }
    tables = staged(spark, rows)
    seen = {r["order_purchase_timestamp_raw"]: r for r in records(tables["orders"])}
    assert {r["order_id"] for r in seen.values()} == {"o1"}
    assert {r["customer_id"] for r in seen.values()} == {None}
    assert [seen[t]["order_purchase_timestamp"] is None for t in ("2020", "2020-01", "2020-02-30", " 2020-01-05 ")] == [
        True, True, True, False,
    ]
    numbers = {r["product_photos_qty_raw"]: r for r in records(tables["products"])}
    assert [numbers[q]["product_photos_qty"] for q in ("1.5", "2.5", "1e2", "y", "1_000")] == [2, 3, 100, None, 1000]
    assert [numbers[q]["product_weight_g"] for q in ("1.5", "2.5", "1e2", "y", "1_000")] == [2.5, None, None, None, None]


def test_extra_source_columns_are_ignored_by_staging(spark):
    rows = market()
    raw = raw_tables(spark, rows)
    raw["items"] = raw["items"].selectExpr("*", "uuid() AS load_id")
    assert stage_all(raw)["items"].count() == len(rows["items"])
