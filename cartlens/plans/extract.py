"""Anonymised extract: whitelisted columns of the window, with fixed display groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlens.config import AnalysisConfig
from cartlens.functions.measures import is_true
from cartlens.operators.calendar import day_spine, with_calendar_parts
from cartlens.operators.ranking import top_groups
from cartlens.plans.model import DELIVERED

# Published columns of each table.
WHITELIST = {
    "fact_orders": (
        "customer_state",
        "order_status",
        "purchase_date",
        "merchandise_value",
        "delivery_days",
        "delivery_eligible",
        "is_late",
        "review_score",
        "review_eligible",
        "review_before_delivery",
        "delay_group",
    ),
    "fact_order_items": ("category", "customer_state", "order_status", "purchase_date", "price"),
    "dim_date": ("date", "month_start", "year", "quarter", "month", "month_label"),
    "dim_customer_state": ("customer_state",),
    "dim_category": ("category", "category_group"),
}
# Columns that no published result may contain.
PRIVATE_COLUMNS = frozenset(
    {
        "order_id",
        "customer_id",
        "customer_unique_id",
        "first_order_id",
        "next_order_id",
        "review_id",
        "review_comment_title",
        "review_comment_message",
        "seller_id",
        "product_id",
    }
)
# Display labels.
LABEL_ON_TIME, LABEL_LATE, LABEL_NO_DATE, LABEL_OTHER = "准时", "延迟", "无有效日期", "其他"
TOP_CATEGORIES = 10


class PrivacyError(ValueError):
    """A result that is to be published carries an identifier or free text."""


class ReconciliationError(ValueError):
    """Order and item amounts of the extract disagree."""


def require_public(df: DataFrame, name: str = "result") -> DataFrame:
    private = sorted(PRIVATE_COLUMNS.intersection(df.columns))
    if private:
        raise PrivacyError(f"{name} must not be published with: {', '.join(private)}")
    return df


def delay_group() -> Column:
    late = F.when(is_true(F.col("is_late")), LABEL_LATE).otherwise(LABEL_ON_TIME)
    return F.when(is_true(F.col("delivery_eligible")), late).otherwise(LABEL_NO_DATE)


def with_month_label(df: DataFrame, date: str) -> DataFrame:
    return df.withColumn("month_label", F.date_format(date, "yyyy-MM"))


def category_groups(items: DataFrame, categories: DataFrame) -> DataFrame:
    """Fixed top categories of the delivered items; all others share one label."""
    sold = items.filter(F.col("order_status") == DELIVERED)
    top = top_groups(sold, "category", "price", TOP_CATEGORIES)
    # At most ten rows, so broadcasting is safe.
    joined = categories.join(F.broadcast(top), "category", "left")
    group = F.when(F.col("_rank").isNotNull(), F.col("category")).otherwise(LABEL_OTHER)
    return joined.select("category", group.alias("category_group"))


def extract_tables(model, config: AnalysisConfig) -> dict[str, DataFrame]:
    items = model.items([*WHITELIST["fact_order_items"]], config)
    orders = model.orders([c for c in WHITELIST["fact_orders"] if c != "delay_group"], config)
    days = day_spine(model.spark, config.analysis_start, config.analysis_end)
    tables = {
        "fact_orders": orders.withColumn("delay_group", delay_group()),
        "fact_order_items": items,
        "dim_date": with_month_label(with_calendar_parts(days), "date"),
        "dim_customer_state": model.states(),
        "dim_category": category_groups(items, model.categories()),
    }
    return {
        name: require_public(df.select(*WHITELIST[name]), name) for name, df in tables.items()
    }


def require_reconciled(tables: dict[str, DataFrame]) -> None:
    """Delivered order and item totals must be equal before anything is written."""

    def total(df, amount):
        return df.filter(F.col("order_status") == DELIVERED).select(
            F.coalesce(F.sum(amount), F.lit(0)).cast("decimal(38,2)")
        )

    left = total(tables["fact_orders"], "merchandise_value").first()[0]
    right = total(tables["fact_order_items"], "price").first()[0]
    if left != right:
        raise ReconciliationError(f"delivered amounts differ: orders {left}, items {right}")
