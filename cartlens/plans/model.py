"""Order fact, item fact and shared dimensions.

Children are aggregated per order before they are joined, so amounts never
multiply. The builders take the wanted columns and join only the children those
columns come from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.config import AnalysisConfig
from cartlens.functions.casts import UNKNOWN, unknown_member
from cartlens.functions.measures import guarded_sum, is_true
from cartlens.functions.time import (
    day_of,
    days_from_micros,
    first_of_month,
    micros_between,
    month_of,
)
from cartlens.operators.calendar import with_calendar_parts
from cartlens.operators.filters import within_days
from cartlens.operators.ranking import latest_row

MONEY = "decimal(18,2)"
DELIVERED, CANCELED = "delivered", "canceled"

# Declared layout of the written tables; nothing is inferred on reading.
ORDER_SCHEMA = {
    "order_id": "string",
    "customer_unique_id": "string",
    "customer_state": "string",
    "order_status": "string",
    "purchase_timestamp": "timestamp_ntz",
    "purchase_date": "date",
    "purchase_month": "date",
    "item_count": "bigint",
    "merchandise_value": MONEY,
    "freight_value": MONEY,
    "payment_value": MONEY,
    "delivered_timestamp": "timestamp_ntz",
    "estimated_delivery_timestamp": "timestamp_ntz",
    "review_score": "int",
    "review_answer_timestamp": "timestamp_ntz",
    "review_creation_date": "timestamp_ntz",
    "delivery_days": "double",
    "delivery_eligible": "boolean",
    "review_eligible": "boolean",
    "review_before_delivery": "boolean",
    "is_late": "boolean",
}
ITEM_SCHEMA = {
    "order_id": "string",
    "order_item_id": "int",
    "product_id": "string",
    "category": "string",
    "customer_state": "string",
    "order_status": "string",
    "purchase_timestamp": "timestamp_ntz",
    "purchase_date": "date",
    "purchase_month": "date",
    "price": MONEY,
    "freight_value": MONEY,
}
TABLE_SCHEMAS = {
    "fact_orders": ORDER_SCHEMA,
    "fact_order_items": ITEM_SCHEMA,
    "dim_date": {
        "date": "date", "month_start": "date", "year": "bigint", "quarter": "bigint", "month": "bigint",
    },
    "dim_customer_state": {"customer_state": "string"},
    "dim_category": {"category": "string"},
}
ORDER_COLUMNS, ITEM_COLUMNS = tuple(ORDER_SCHEMA), tuple(ITEM_SCHEMA)
# Exact microseconds behind delivery_days; used for quantiles, not part of the written fact.
DELIVERY_MICROS = "delivery_micros"

_FROM_ITEMS = {"item_count", "merchandise_value", "freight_value"}
_FROM_PAYMENTS = {"payment_value"}
_FROM_CUSTOMERS = {"customer_unique_id", "customer_state"}
_FROM_REVIEWS = {
    "review_score",
    "review_answer_timestamp",
    "review_creation_date",
    "review_eligible",
    "review_before_delivery",
}


def selected_reviews(reviews: DataFrame) -> DataFrame:
    """One review per order: latest answer, then latest creation, then smallest id and score."""
    order = [
        F.col("review_answer_timestamp").desc_nulls_last(),
        F.col("review_creation_date").desc_nulls_last(),
        F.col("review_id").asc_nulls_last(),
        F.col("review_score").asc_nulls_last(),
    ]
    slim = reviews.select(
        "order_id",
        "review_id",
        "review_score",
        "review_answer_timestamp",
        "review_creation_date",
    )
    return latest_row(slim, ["order_id"], order).drop("review_id")


def item_totals(items: DataFrame) -> DataFrame:
    return items.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("item_count"),
        guarded_sum(F.col("price")).cast(MONEY).alias("merchandise_value"),
        guarded_sum(F.col("freight_value")).cast(MONEY).alias("freight_value"),
    )


def payment_totals(payments: DataFrame) -> DataFrame:
    return payments.groupBy("order_id").agg(
        guarded_sum(F.col("payment_value")).cast(MONEY).alias("payment_value")
    )


def build_orders(staged: dict[str, DataFrame], columns, orders: DataFrame | None = None) -> DataFrame:
    """Order fact restricted to the given columns. ``orders`` may be a filtered staging table."""
    wanted = set(columns)
    purchase = F.col("order_purchase_timestamp")
    fact = (orders if orders is not None else staged["orders"]).select(
        "order_id",
        "customer_id",
        "order_status",
        purchase.alias("purchase_timestamp"),
        day_of(purchase).alias("purchase_date"),
        month_of(purchase).alias("purchase_month"),
        F.col("order_delivered_customer_date").alias("delivered_timestamp"),
        F.col("order_estimated_delivery_date").alias("estimated_delivery_timestamp"),
    )
    if wanted & _FROM_ITEMS:
        fact = fact.join(item_totals(staged["items"]), "order_id", "left").withColumn(
            "item_count", F.coalesce(F.col("item_count"), F.lit(0))
        )
    if wanted & _FROM_PAYMENTS:
        fact = fact.join(payment_totals(staged["payments"]), "order_id", "left")
    if wanted & _FROM_REVIEWS:
        fact = fact.join(selected_reviews(staged["reviews"]), "order_id", "left")
    if wanted & _FROM_CUSTOMERS:
        people = staged["customers"].select("customer_id", "customer_unique_id", "customer_state")
        fact = fact.join(people, "customer_id", "left").withColumn(
            "customer_state", unknown_member(F.col("customer_state"))
        )
    return _with_flags(fact, wanted).select(*columns)


def _with_flags(fact: DataFrame, wanted: set[str]) -> DataFrame:
    purchase, delivered = F.col("purchase_timestamp"), F.col("delivered_timestamp")
    estimate = F.col("estimated_delivery_timestamp")
    sequence = (F.col("order_status") == DELIVERED) & purchase.isNotNull() & (delivered >= purchase)
    micros = F.when(sequence, micros_between(purchase, delivered))
    eligible = is_true(sequence & (estimate >= purchase))
    flags = {
        DELIVERY_MICROS: micros,
        "delivery_days": days_from_micros(micros),
        "delivery_eligible": eligible,
        "is_late": F.when(eligible, day_of(delivered) > day_of(estimate)),
    }
    if wanted & _FROM_REVIEWS:
        answer = F.col("review_answer_timestamp")
        flags["review_eligible"] = is_true(F.col("review_score").between(1, 5))
        flags["review_before_delivery"] = F.when(
            answer.isNotNull() & delivered.isNotNull(), answer < delivered
        )
    return fact.withColumns(flags)


def product_categories(staged: dict[str, DataFrame]) -> DataFrame:
    """Category per product: translated name, else original name, else NULL."""
    translated = staged["category_translation"].select(
        "product_category_name", "product_category_name_english"
    )
    products = staged["products"].select("product_id", "product_category_name")
    return products.join(translated, "product_category_name", "left").select(
        "product_id",
        F.coalesce("product_category_name_english", "product_category_name").alias("category"),
    )


def build_items(staged: dict[str, DataFrame], columns, orders: DataFrame | None = None) -> DataFrame:
    """Item fact restricted to the given columns; one row per staged item.

    Order attributes are prepared at order grain and products at product grain, so
    the item rows are shuffled twice (order key, product key) and no more.
    """
    wanted = set(columns)
    purchase = F.col("order_purchase_timestamp")
    context = (orders if orders is not None else staged["orders"]).select(
        "order_id",
        "customer_id",
        "order_status",
        purchase.alias("purchase_timestamp"),
        day_of(purchase).alias("purchase_date"),
        month_of(purchase).alias("purchase_month"),
    )
    if "customer_state" in wanted:
        people = staged["customers"].select("customer_id", "customer_state")
        context = context.join(people, "customer_id", "left")
    lines = staged["items"].select(
        "order_id", "order_item_id", "product_id", "price", "freight_value"
    )
    # A filtered order relation restricts the items; the whole one keeps orphans.
    fact = lines.join(context, "order_id", "left" if orders is None else "inner")
    if "category" in wanted:
        fact = fact.join(product_categories(staged), "product_id", "left").withColumn(
            "category", unknown_member(F.col("category"))
        )
    if "customer_state" in wanted:
        fact = fact.withColumn("customer_state", unknown_member(F.col("customer_state")))
    return fact.select(*columns)


def _with_unknown(members: DataFrame, name: str) -> DataFrame:
    unknown = members.sparkSession.range(1).select(F.lit(UNKNOWN).alias(name))
    return members.unionByName(unknown).distinct()


class StagedModel:
    """The model as lazy plans over staging tables."""

    def __init__(self, staged: dict[str, DataFrame]):
        self.staged = staged

    @property
    def spark(self) -> SparkSession:
        return self.staged["orders"].sparkSession

    def _chosen(self, window: AnalysisConfig | None, status: str | None) -> DataFrame | None:
        orders = self.staged["orders"]
        if window is not None:
            orders = orders.filter(
                within_days(
                    F.col("order_purchase_timestamp"), window.analysis_start, window.analysis_end
                )
            )
        if status is not None:
            orders = orders.filter(F.col("order_status") == status)
        return None if window is None and status is None else orders

    def orders(self, columns=ORDER_COLUMNS, window=None, status=None) -> DataFrame:
        return build_orders(self.staged, columns, self._chosen(window, status))

    def items(self, columns=ITEM_COLUMNS, window=None, status=None) -> DataFrame:
        return build_items(self.staged, columns, self._chosen(window, status))

    def states(self) -> DataFrame:
        """States of any order, plus UNKNOWN.

        An item takes its state from its order or is UNKNOWN, so the items add nothing.
        """
        buyers = self.staged["orders"].select("customer_id").distinct()
        people = self.staged["customers"].select("customer_id", "customer_state")
        seen = people.join(buyers, "customer_id", "left_semi").select("customer_state").distinct()
        return _with_unknown(seen, "customer_state")

    def categories(self) -> DataFrame:
        sold = self.staged["items"].select("product_id").distinct()
        seen = product_categories(self.staged).join(sold, "product_id", "left_semi")
        return _with_unknown(seen.select(unknown_member(F.col("category")).alias("category")), "category")

    def dates(self, config: AnalysisConfig) -> DataFrame:
        return build_dates(self.orders(["purchase_date"]), config)


class StoredModel:
    """The model read back from written Parquet tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, table: str) -> DataFrame:
        schema = ", ".join(f"{name} {kind}" for name, kind in TABLE_SCHEMAS[table].items())
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}")

    def _chosen(self, table, columns, window, status) -> DataFrame:
        fact = self._read(table)
        if window is not None:
            start, end = window.analysis_start, window.analysis_end
            fact = fact.filter(
                F.col("purchase_month").between(
                    F.lit(first_of_month(start)), F.lit(first_of_month(end))
                )
                & F.col("purchase_date").between(F.lit(start), F.lit(end))
            )
        if status is not None:
            fact = fact.filter(F.col("order_status") == status)
        if DELIVERY_MICROS in columns:
            days = F.col("delivery_days")
            micros = micros_between(F.col("purchase_timestamp"), F.col("delivered_timestamp"))
            fact = fact.withColumn(DELIVERY_MICROS, F.when(days.isNotNull(), micros))
        return fact.select(*columns)

    def orders(self, columns=ORDER_COLUMNS, window=None, status=None) -> DataFrame:
        return self._chosen("fact_orders", columns, window, status)

    def items(self, columns=ITEM_COLUMNS, window=None, status=None) -> DataFrame:
        return self._chosen("fact_order_items", columns, window, status)

    def dimension(self, name: str) -> DataFrame:
        return self._read(name)

    def states(self) -> DataFrame:
        return self._read("dim_customer_state")

    def categories(self) -> DataFrame:
        return self._read("dim_category")

    def dates(self, config: AnalysisConfig) -> DataFrame:
        return self._read("dim_date")


def build_dates(orders: DataFrame, config: AnalysisConfig) -> DataFrame:
    """Every day from the first to the last purchase, and at least the whole window."""
    bounds = orders.agg(
        F.least(F.min("purchase_date"), F.lit(config.analysis_start)).alias("first_date"),
        F.greatest(F.max("purchase_date"), F.lit(config.analysis_end)).alias("last_date"),
    )
    days = F.sequence("first_date", "last_date", F.expr("interval 1 day"))
    return with_calendar_parts(bounds.select(F.explode(days).alias("date")))
