"""Source rows for tests: seeded random markets and journeys, and one clean order."""

from __future__ import annotations

import csv
import datetime as dt
import json
import random

import pandas as pd

from cartlens.config import AnalysisConfig
from cartlens.plans.model import StagedModel
from cartlens.plans.staging import COLUMNS, stage_all

CONFIG = AnalysisConfig.from_mapping(
    {
        "analysis_start": "2020-01-01",
        "analysis_end": "2020-04-30",
        "observation_end": "2020-04-30 23:59:59",
        "min_state_orders": 100,
        "min_group_orders": 30,
    }
)

CONFIG_END = dt.datetime(2020, 4, 30, 23, 59, 59)


def changed(config, **values):
    return AnalysisConfig.from_mapping(config.as_dict() | values)


def order(order_id, customer, status, bought, arrived=None, promised=None):
    return {
        "order_id": order_id,
        "customer_id": customer,
        "order_status": status,
        "order_purchase_timestamp": bought,
        "order_delivered_customer_date": arrived,
        "order_estimated_delivery_date": promised,
    }


def item(order_id, number, product, price, freight="1.00"):
    return {
        "order_id": order_id,
        "order_item_id": str(number),
        "product_id": product,
        "price": price,
        "freight_value": freight,
    }


def review(review_id, order_id, score, created, answered=None):
    return {
        "review_id": review_id,
        "order_id": order_id,
        "review_score": score,
        "review_creation_date": created,
        "review_answer_timestamp": answered,
    }


def market(seed: int = 4, count: int = 90) -> dict[str, list[dict]]:
    """Seeded random orders from December to April without March; gaps, odd dates and odd scores included.

    Only April has orders without items and prices that are no number.
    """
    rng = random.Random(seed)
    rows = {name: [] for name in COLUMNS}
    kinds = [f"sorte {n:02d}" for n in range(14)] + ["OTHER", ""]
    for n, kind in enumerate(kinds):
        rows["products"].append({"product_id": f"g{n}", "product_category_name": kind})
        if n % 3 == 0 and kind:
            rows["category_translation"].append(
                {"product_category_name": kind, "product_category_name_english": f"sort {n}"}
            )
    for n in range(count):
        bought = dt.datetime(*rng.choice([(2019, 12), (2020, 1), (2020, 2), (2020, 4)]), rng.randint(1, 28), rng.randint(0, 23))
        arrived = rng.choice([None, *[bought + dt.timedelta(hours=h) for h in (-30, 30, 77, 140, 201, 333)]])
        promised = rng.choice([None, *[bought.date() + dt.timedelta(days=d) for d in (-2, 3, 6, 9, 12)]])
        status = rng.choice(["delivered"] * 6 + ["canceled", "shipped"])
        rows["orders"].append(order(f"n{n}", f"c{n}", status, str(bought), arrived and str(arrived), promised and str(promised)))
        rows["customers"].append(
            {"customer_id": f"c{n}", "customer_unique_id": f"who{n % 40}", "customer_state": rng.choice(["Coast", "Hills", "Plain", ""])}
        )
        april = bought.month == 4
        for number in range(rng.randint(0 if april else 1, 3)):
            price = "?" if april and rng.random() < 0.2 else f"{rng.randint(100, 90_000) / 100:.2f}"
            rows["items"].append(item(f"n{n}", number + 1, f"g{rng.randrange(len(kinds))}", price))
        for number in range(rng.randint(0, 2)):
            created = bought.date() + dt.timedelta(days=rng.randint(1, 9))
            answered = rng.choice([None, dt.datetime.combine(created, dt.time(number, n % 60)) + dt.timedelta(days=rng.randint(0, 4))])
            rows["reviews"].append(review(f"v{n}.{number}", f"n{n}", str(rng.randint(1, 6)), str(created), answered and str(answered)))
    return rows


def tidy(seed: int = 12, count: int = 70) -> dict[str, list[dict]]:
    """A market that passes every blocking check: each order has lines with plain prices, and most are paid."""
    rng = random.Random(seed)
    rows = market(seed, count)
    for line in rows["items"]:
        line["price"] = f"{rng.randint(100, 9_000) / 100:.2f}"
    lines = {o["order_id"]: [i for i in rows["items"] if i["order_id"] == o["order_id"]] for o in rows["orders"]}
    for key, own in lines.items():
        if not own:
            own.append(item(key, 1, "g1", "12.50"))
            rows["items"] += own
        total = sum(round(100 * (float(i["price"]) + float(i["freight_value"]))) for i in own)
        if rng.random() < 0.8:
            paid = (total + rng.choice([0, 0, 0, 1, -250])) / 100
            rows["payments"].append(
                {"order_id": key, "payment_sequential": "1", "payment_type": "card", "payment_value": f"{paid:.2f}"}
            )
    return rows


def journeys(seed: int = 8) -> dict[str, list[dict]]:
    """Seeded random purchases of 30 people; gaps around the horizon, starts around the last full horizon."""
    rng = random.Random(seed)
    day, end = dt.timedelta(days=1), CONFIG_END
    starts = [dt.datetime(2019, 11, 20, 7) + rng.randint(0, 170) * day for _ in range(26)]
    starts += [end - 30 * day + late * dt.timedelta(seconds=1) for late in (-1, 0, 1, 2)]
    bought = []
    for n, start in enumerate(starts):
        bought.append((n, start))
        if start < dt.datetime(2020, 2, 1) and n % 2:
            bought.append((n, start))
        for _ in range(rng.randint(0, 2)):
            bought.append((n, start + rng.choice([30 * day, 30 * day + dt.timedelta(seconds=1), 11 * day, 52 * day])))
    return {
        "orders": [
            order(f"b{n}", f"c{n}", "delivered" if n % 9 else "shipped", str(at)) for n, (_, at) in enumerate(bought)
        ],
        "customers": [
            {"customer_id": f"c{n}", "customer_unique_id": f"who{who}", "customer_state": "Coast"}
            for n, (who, _) in enumerate(bought)
        ],
    }


def raw_tables(spark, rows: dict[str, list[dict]]) -> dict:
    tables = {}
    for table, spec in COLUMNS.items():
        schema = ", ".join(f"{name} string" for name in spec)
        values = [tuple(row.get(name) for name in spec) for row in rows.get(table, [])]
        # Through Arrow the rows become a local relation, which keeps small tests quick.
        frame = pd.DataFrame(values, columns=list(spec), dtype=object)
        tables[table] = spark.createDataFrame(frame, schema)
    return tables


def staged(spark, rows):
    return stage_all(raw_tables(spark, rows))


_BUILT = {}


def build(spark, rows) -> StagedModel:
    """Model of the rows; the same rows share one set of lazy staging plans."""
    key = json.dumps(rows, sort_keys=True)
    if key not in _BUILT:
        _BUILT[key] = StagedModel(staged(spark, rows))
    return _BUILT[key]


def records(df, *key):
    """Rows as dictionaries, keyed by one or several columns."""
    rows = [row.asDict() for row in df.collect()]
    if not key:
        return rows
    if len(key) == 1:
        return {row[key[0]]: row for row in rows}
    return {tuple(row[name] for name in key): row for row in rows}


FILES = {
    "orders": "shop_orders_dataset.csv",
    "items": "shop_order_items_dataset.csv",
    "payments": "shop_order_payments_dataset.csv",
    "customers": "shop_customers_dataset.csv",
    "products": "shop_products_dataset.csv",
    "reviews": "shop_order_reviews_dataset.csv",
    "category_translation": "product_category_name_translation.csv",
}


def write_csv(directory, rows):
    directory.mkdir(parents=True)
    for table, spec in COLUMNS.items():
        with (directory / FILES[table]).open("w", encoding="utf-8-sig", newline="") as stream:
            writer = csv.DictWriter(stream, fieldnames=list(spec))
            writer.writeheader()
            writer.writerows([{name: row.get(name) for name in spec} for row in rows.get(table, [])])
    return directory


def one_order() -> dict[str, list[dict]]:
    """One clean row per source."""
    return {
        "orders": [order("B1", "k1", "delivered", "2020-02-05 10:00:00", "2020-02-10 18:00:00", "2020-02-10")],
        "items": [item("B1", 1, "toy", "90.00", "9.00")],
        "payments": [{"order_id": "B1", "payment_sequential": "1", "payment_type": "card", "payment_value": "99.00"}],
        "customers": [{"customer_id": "k1", "customer_unique_id": "person1", "customer_state": "NORTH"}],
        "products": [{"product_id": "toy", "product_category_name": "spielzeug"}],
        "reviews": [
            review("r1", "B1", "2", "2020-02-11", "2020-02-12 10:00:00")
            | {"review_comment_message": 'two lines\nand a "quote", too'}
        ],
        "category_translation": [
            {"product_category_name": "spielzeug", "product_category_name_english": "toys"}
        ],
    }
