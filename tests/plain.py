"""The facts as plain Python over source rows, for tests that compare with them."""

import datetime as dt
from collections import Counter, defaultdict
from decimal import Decimal, InvalidOperation

DAY = dt.timedelta(days=1)


def when(text):
    return dt.datetime.fromisoformat(text) if text else None


def money(text):
    try:
        return Decimal(text)
    except (InvalidOperation, TypeError):
        return None


def guarded(amounts):
    """The sum, unless there is no amount or one is unknown or negative."""
    return sum(amounts) if amounts and all(a is not None and a >= 0 for a in amounts) else None


def chosen_review(reviews):
    """Latest answer, then latest creation, then the smallest id, then the smallest score; the unknown comes last."""
    late = lambda text: (text is None, -when(text).timestamp() if text else 0)
    order = lambda r: (late(r["review_answer_timestamp"]), late(r["review_creation_date"]), r["review_id"], int(r["review_score"]))
    return min(reviews, key=order, default=None)


def _by(rows, name):
    found = defaultdict(list)
    for row in rows:
        found[row[name]].append(row)
    return found


def order_facts(rows):
    """order_id: the columns of the order fact."""
    people = {c["customer_id"]: c for c in rows.get("customers", [])}
    items, payments, reviews = (_by(rows.get(t, []), "order_id") for t in ("items", "payments", "reviews"))
    out = {}
    for o in rows["orders"]:
        key, who = o["order_id"], people.get(o["customer_id"], {})
        at, arrived, promised = (when(o[f"order_{n}"]) for n in ("purchase_timestamp", "delivered_customer_date", "estimated_delivery_date"))
        best = chosen_review(reviews[key])
        score = int(best["review_score"]) if best else None
        answered = when(best["review_answer_timestamp"]) if best else None
        came = o["order_status"] == "delivered" and arrived is not None and arrived >= at
        due = came and promised is not None and promised >= at
        out[key] = {
            "order_id": key, "order_status": o["order_status"], "customer_unique_id": who.get("customer_unique_id"),
            "customer_state": (who.get("customer_state") or "").strip() or "UNKNOWN",
            "purchase_timestamp": at, "purchase_date": at.date(), "purchase_month": at.date().replace(day=1),
            "item_count": len(items[key]), "merchandise_value": guarded([money(i["price"]) for i in items[key]]),
            "freight_value": guarded([money(i["freight_value"]) for i in items[key]]),
            "payment_value": guarded([money(p["payment_value"]) for p in payments[key]]),
            "delivered_timestamp": arrived, "estimated_delivery_timestamp": promised,
            "review_score": score, "review_answer_timestamp": answered,
            "review_creation_date": when(best["review_creation_date"]) if best else None,
            "delivery_days": (arrived - at) / DAY if came else None, "delivery_eligible": due,
            "review_eligible": score is not None and 1 <= score <= 5,
            "review_before_delivery": answered < arrived if answered and arrived else None,
            "is_late": arrived.date() > promised.date() if due else None,
        }
    return out


def item_facts(rows):
    """(order_id, order_item_id): category, state, status, month and amounts of every line."""
    orders = order_facts(rows)
    kinds = {p["product_id"]: p["product_category_name"] for p in rows["products"]}
    words = {t["product_category_name"]: t["product_category_name_english"] for t in rows["category_translation"]}
    out = {}
    for i in rows["items"]:
        kind, o = kinds.get(i["product_id"]) or None, orders.get(i["order_id"], {})
        out[i["order_id"], int(i["order_item_id"])] = {
            "category": words.get(kind, kind) or "UNKNOWN", "customer_state": o.get("customer_state", "UNKNOWN"),
            "order_status": o.get("order_status"), "purchase_month": o.get("purchase_month"),
            "price": money(i["price"]), "freight_value": money(i["freight_value"]),
        }
    return out


def measures(facts):
    """Counts and the amount of some order facts."""
    done = [f for f in facts if f["order_status"] == "delivered"]
    due, scored = [f for f in done if f["delivery_eligible"]], [f for f in done if f["review_eligible"]]
    joint = [f for f in due if f["review_eligible"]]
    low = lambda group: sum(f["review_score"] <= 2 for f in group)
    return {
        "gmv": sum((f["merchandise_value"] for f in done if f["merchandise_value"] is not None), Decimal(0)),
        "all_orders": len(facts), "delivered_orders": len(done), "canceled_orders": Counter(f["order_status"] for f in facts)["canceled"],
        "delivery_orders": len(due), "late_orders": sum(f["is_late"] for f in due), "review_orders": len(scored), "low_score_orders": low(scored),
        "joint_orders": len(joint), "group_orders": len(joint), "group_low_orders": low(joint),
        "duration_orders": sum(f["delivery_days"] is not None for f in done),
    }
