"""The ten questions on seeded random rows, compared with plain calculations over the same rows."""

import datetime as dt
from collections import defaultdict
from decimal import Decimal

import numpy as np
import pytest

from cartlens.plans.analyses import ANALYSES
from sample import CONFIG, CONFIG_END, build, changed, journeys, market, records

MONTHS = [dt.date(2020, m, 1) for m in (1, 2, 3, 4)]
DAY = dt.timedelta(days=1)


def when(text):
    return text and dt.datetime.fromisoformat(text)


def ratio(a, b):
    return None if a is None or not b else float(a) / float(b)


def price(text):
    return Decimal(text) if text != "?" else None


@pytest.fixture(scope="module")
def rows():
    return market()


@pytest.fixture(scope="module")
def facts(rows):
    """One dictionary per order of the window."""
    people = {c["customer_id"]: c for c in rows["customers"]}
    found = []
    for o in rows["orders"]:
        at, arrived, promised = (when(o[n]) for n in ("order_purchase_timestamp", "order_delivered_customer_date", "order_estimated_delivery_date"))
        prices = [price(i["price"]) for i in rows["items"] if i["order_id"] == o["order_id"]]
        reviews = [r for r in rows["reviews"] if r["order_id"] == o["order_id"]]
        # answered ones before others, the latest answer first
        best = max(reviews, key=lambda r: (r["review_answer_timestamp"] or "", r["review_creation_date"]), default=None)
        score = int(best["review_score"]) if best else None
        answered = when(best["review_answer_timestamp"]) if best else None
        done = o["order_status"] == "delivered"
        came = done and arrived is not None and arrived >= at
        due = came and promised is not None and promised >= at
        found.append({
            "month": at.date().replace(day=1), "state": people[o["customer_id"]]["customer_state"] or "UNKNOWN",
            "status": o["order_status"], "done": done, "id": o["order_id"],
            "amount": sum(prices) if prices and None not in prices else None,
            "days": (arrived - at) / DAY if came else None, "due": due,
            "late": due and arrived.date() > promised.date(), "scored": score is not None and 1 <= score <= 5, "score": score,
            "answered": answered is not None, "early": answered is not None and arrived is not None and answered < arrived,
        })
    return [f for f in found if f["month"] in MONTHS]


def grouped(facts, *names):
    groups = defaultdict(list)
    for f in facts:
        groups[tuple(f[n] for n in names) if len(names) > 1 else f[names[0]]].append(f)
    return groups


def states(rows):
    return sorted({c["customer_state"] or "UNKNOWN" for c in rows["customers"]} | {"UNKNOWN"})


def amount(group):
    return None if any(f["amount"] is None for f in group) else sum((f["amount"] for f in group), Decimal(0))


def ask(spark, number, rows, config=CONFIG, key=()):
    name = next(name for name in ANALYSES if name.startswith(f"q{number:02d}_"))
    return records(ANALYSES[name](build(spark, rows), config), *key)


def same(found, expected):
    assert set(found) == set(expected)
    for key, want in expected.items():
        close = {n: pytest.approx(v) if isinstance(v, float) else v for n, v in want.items()}
        assert {n: found[key][n] for n in want} == close, key


def test_months_have_amounts_counts_and_shares(spark, rows, facts):
    expected, by_month = {}, grouped(facts, "month")
    for m in MONTHS:
        done, every = [f for f in by_month[m] if f["done"]], by_month[m]
        lost = sum(f["status"] == "canceled" for f in every)
        expected[m] = {
            "all_orders": len(every), "delivered_orders": len(done), "canceled_orders": lost,
            "valid_merchandise_orders": sum(f["amount"] is not None for f in done), "merchandise_value": amount(done),
            "average_order_value": ratio(amount(done), len(done)), "canceled_order_share": ratio(lost, len(every)),
            "complete_calendar_month": True,
        }
    assert expected[MONTHS[2]]["all_orders"] == 0 and expected[MONTHS[3]]["merchandise_value"] is None
    same(ask(spark, 1, rows, key=["purchase_month"]), expected)


@pytest.mark.parametrize("first, last, whole", [("2020-01-03", "2020-04-30", [0, 1, 1, 1]), ("2020-01-01", "2020-04-28", [1, 1, 1, 0])])
def test_cut_months_are_marked(spark, rows, first, last, whole):
    found = ask(spark, 1, rows, changed(CONFIG, analysis_start=first, analysis_end=last), ["purchase_month"])
    assert [found[m]["complete_calendar_month"] for m in MONTHS] == [bool(w) for w in whole]


def test_changes_split_into_count_and_value(spark, rows, facts):
    by_month, expected, before = grouped([f for f in facts if f["done"]], "month"), {}, None
    for m in MONTHS:
        value, n = amount(by_month[m]), len(by_month[m])
        average = ratio(value, n)
        want = {"merchandise_value": value, "delivered_orders": n, "average_order_value": average}
        if before is not None:
            old, old_n, old_average = before
            want |= {
                "merchandise_change": None if None in (value, old) else value - old,
                "order_count_contribution": None if old_average is None else (n - old_n) * old_average,
                "average_order_value_contribution": None if None in (average, old_average) else n * (average - old_average),
            }
        expected[m], before = want, (value, n, average)
    same(ask(spark, 2, rows, key=["purchase_month"]), expected)


def test_categories_beyond_the_top_are_one_rest(spark, rows, facts):
    english = {t["product_category_name"]: t["product_category_name_english"] for t in rows["category_translation"]}
    kinds = {p["product_id"]: english.get(p["product_category_name"], p["product_category_name"]) or "UNKNOWN" for p in rows["products"]}
    months = {f["id"]: f["month"] for f in facts if f["done"]}
    sold = [(kinds[i["product_id"]], i["order_id"], price(i["price"]) or 0) for i in rows["items"] if i["order_id"] in months]
    totals = defaultdict(Decimal)
    for kind, _, paid in sold:
        totals[kind] += paid
    ranks = {kind: n for n, kind in enumerate(sorted(totals, key=lambda k: (-totals[k], k))[:10], 1)}
    values, holders = defaultdict(Decimal), defaultdict(set)
    for kind, order_id, paid in sold:
        rank = ranks.get(kind, 11)
        for at in ((rank, None), (rank, months[order_id])):
            values[at] += paid
            holders[at].add(order_id)
    expected = {}
    for rank in range(1, 12):
        for m in (None, *MONTHS):
            whole = sum(v for (_, other), v in values.items() if other == m)
            expected[rank, m] = {
                "category": "OTHER" if rank == 11 else next(k for k, r in ranks.items() if r == rank),
                "merchandise_value": values[rank, m], "containing_category_orders": len(holders[rank, m]),
                "merchandise_share": ratio(values[rank, m], whole), "period": "MONTH" if m else "WINDOW",
            }
    same(ask(spark, 3, rows, key=["category_rank", "purchase_month"]), expected)


@pytest.mark.parametrize("least", [1, 14, 1000])
def test_states_are_ranked_if_large_enough(spark, rows, facts, least):
    by_state, expected = grouped([f for f in facts if f["done"]], "state"), {}
    for s, group in by_state.items():
        due, scored = [f for f in group if f["due"]], [f for f in group if f["scored"]]
        joint = [f for f in due if f["scored"]]
        late = sum(f["late"] for f in due)
        expected[s] = {
            "delivered_orders": len(group), "merchandise_value": amount(group), "delivery_eligible_orders": len(due), "late_orders": late,
            "review_eligible_orders": len(scored), "low_score_orders": sum(f["score"] <= 2 for f in scored),
            "joint_eligible_orders": len(joint), "joint_low_score_orders": sum(f["score"] <= 2 for f in joint),
            "late_share": ratio(late, len(due)), "joint_coverage": ratio(len(joint), len(group)),
            "meets_state_threshold": len(group) >= least and len(due) > 0, "investigation_rank": None,
        }
    able = [s for s in expected if expected[s]["meets_state_threshold"]]
    able.sort(key=lambda s: (-expected[s]["late_share"], -expected[s]["late_orders"], -expected[s]["delivered_orders"], s))
    for n, s in enumerate(able, 1):
        expected[s]["investigation_rank"] = n
    same(ask(spark, 4, rows, changed(CONFIG, min_state_orders=least), ["customer_state"]), expected)


def test_delivery_days_have_exact_quantiles(spark, rows, facts):
    done = [f for f in facts if f["done"]]
    by_month, by_state = grouped(done, "month"), grouped(done, "state")
    groups = {("WINDOW", None, None): done} | {("MONTH", m, None): by_month[m] for m in MONTHS} | {("STATE", None, s): by_state[s] for s in states(rows)}
    expected = {}
    for key, group in groups.items():
        days = [f["days"] for f in group if f["days"] is not None]
        middle, high = map(float, np.quantile(days, [0.5, 0.9])) if days else (None, None)
        expected[key] = {
            "delivered_orders": len(group), "duration_eligible_orders": len(days), "duration_coverage": ratio(len(days), len(group)),
            "median_delivery_days": middle, "p90_delivery_days": high,
            "min_delivery_days": min(days, default=None), "max_delivery_days": max(days, default=None),
        }
    same(ask(spark, 5, rows, key=["scope", "purchase_month", "customer_state"]), expected)


def test_every_month_and_state_has_a_cell(spark, rows, facts):
    cells, expected = grouped([f for f in facts if f["done"]], "month", "state"), {}
    for key in [(m, s) for m in MONTHS for s in states(rows)]:
        group = cells[key]
        due = [f for f in group if f["due"]]
        late = sum(f["late"] for f in due)
        expected[key] = {
            "delivered_orders": len(group), "delivery_eligible_orders": len(due), "late_orders": late, "late_share": ratio(late, len(due)),
            "missing_or_invalid_delivery_orders": len(group) - len(due), "joint_eligible_orders": sum(f["scored"] for f in due),
        }
    same(ask(spark, 6, rows, key=["purchase_month", "customer_state"]), expected)


def test_scores_of_late_and_punctual_orders(spark, rows, facts):
    joint, expected = [f for f in facts if f["due"] and f["scored"]], {}
    for name, late in (("LATE", True), ("ON_TIME", False)):
        group = [f for f in joint if f["late"] == late]
        low = sum(f["score"] <= 2 for f in group)
        expected[name] = {
            "joint_eligible_orders": len(group), "low_score_orders": low, "low_score_share": ratio(low, len(group)),
            "answer_timestamp_orders": sum(f["answered"] for f in group), "early_answer_orders": sum(f["early"] for f in group),
        } | {f"score_{n}_orders": sum(f["score"] == n for f in group) for n in range(1, 6)}
    same(ask(spark, 7, rows, key=["delivery_group"]), expected)
    none = ask(spark, 7, {"orders": []}, key=["delivery_group"])
    assert all(row["joint_eligible_orders"] == 0 and row["low_score_share"] is None for row in none.values()) and len(none) == 2


@pytest.mark.parametrize("least", [1, 3])
def test_gaps_with_and_without_early_answers(spark, rows, facts, least):
    cells, expected = grouped([f for f in facts if f["due"] and f["scored"]], "month", "state"), {}
    for m, s in [(m, s) for m in MONTHS for s in states(rows)]:
        for sample in ("ALL_JOINT", "EXCLUDE_EARLY_ANSWERS"):
            early = sum(f["early"] for f in cells[m, s])
            group = [f for f in cells[m, s] if sample == "ALL_JOINT" or not f["early"]]
            late, punctual = [f for f in group if f["late"]], [f for f in group if not f["late"]]
            shares = [ratio(sum(f["score"] <= 2 for f in part), len(part)) for part in (punctual, late)]
            expected[m, s, sample] = {
                "joint_eligible_orders": len(group), "late_orders": len(late), "on_time_orders": len(punctual),
                "low_score_share_gap": None if None in shares else shares[1] - shares[0],
                "excluded_early_answer_orders": 0 if sample == "ALL_JOINT" else early,
                "meets_group_threshold": min(len(late), len(punctual)) >= least,
            }
    found = ask(spark, 8, rows, changed(CONFIG, min_group_orders=least), ["purchase_month", "customer_state", "sample"])
    same(found, expected)


@pytest.fixture(scope="module")
def firsts():
    """First and next purchase of each person up to the observation end."""
    rows, found = journeys(), {}
    names = {c["customer_id"]: c["customer_unique_id"] for c in rows["customers"]}
    bought = defaultdict(list)
    for o in rows["orders"]:
        at = when(o["order_purchase_timestamp"])
        if o["order_status"] == "delivered" and at <= CONFIG_END:
            bought[names[o["customer_id"]]].append((at, o["order_id"]))
    for who, events in bought.items():
        start, first = min(events)
        later = min((e for e in events if e[0] > start), default=(None, None))
        found[who] = {
            "first_order_id": first, "first_purchase_timestamp": start, "delivered_orders_observed": len(events),
            "simultaneous_additional_orders": sum(at == start for at, _ in events) - 1,
            "next_order_id": later[1], "next_purchase_timestamp": later[0],
            "days_to_next_purchase": (later[0] - start) / DAY if later[0] else None, "has_30_day_observation": start + 30 * DAY <= CONFIG_END,
        }
    return found


def test_first_and_next_purchases(spark, firsts):
    gaps = {f["days_to_next_purchase"] for f in firsts.values()}
    assert 30.0 in gaps and len({f["has_30_day_observation"] for f in firsts.values()}) == 2
    same(ask(spark, 9, journeys(), key=["customer_unique_id"]), firsts)


def test_cohorts_repeat_and_mature(spark, firsts):
    expected = {}
    for m in MONTHS:
        group = [f for f in firsts.values() if f["first_purchase_timestamp"].date().replace(day=1) == m]
        ripe = [f for f in group if f["has_30_day_observation"]]
        repeats = sum(f["days_to_next_purchase"] is not None and f["days_to_next_purchase"] <= 30 for f in ripe)
        status = "EMPTY" if not group else "IMMATURE" if not ripe else "PARTIALLY_MATURE" if len(ripe) < len(group) else "ALL_OBSERVED_CUSTOMERS_MATURE"
        expected[m] = {
            "total_customers": len(group), "eligible_customers": len(ripe), "immature_customers": len(group) - len(ripe),
            "repeat_customers_30d": repeats, "repeat_share_30d": ratio(repeats, len(ripe)),
            "observation_coverage": ratio(len(ripe), len(group)), "maturity_status": status,
            "simultaneous_additional_orders": sum(f["simultaneous_additional_orders"] for f in group),
        }
    same(ask(spark, 10, journeys(), key=["cohort_month"]), expected)


def test_window_does_not_clip_first_purchases(spark, firsts):
    late = changed(CONFIG, analysis_start="2020-03-01")
    same(ask(spark, 9, journeys(), late, ["customer_unique_id"]), firsts)
