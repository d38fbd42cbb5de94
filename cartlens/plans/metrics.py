"""Reusable measures that are recomputed from counts under any grouping and filter."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlens.functions.measures import safe_ratio
from cartlens.functions.time import days_from_micros
from cartlens.operators.distributions import counted_distribution, scoped_distribution, value_counts
from cartlens.plans.model import CANCELED, DELIVERED, DELIVERY_MICROS

MIN_INVESTIGATION_ORDERS = 100

_COLUMNS = {
    "goods": ("merchandise_value",),
    "delivery": ("delivery_eligible", "is_late"),
    "review": ("review_eligible", "review_score"),
    "duration": (DELIVERY_MICROS,),
}


def _predicates() -> dict[str, Column]:
    delivered = F.col("order_status") == DELIVERED
    on_dates = delivered & F.col("delivery_eligible")
    reviewed = delivered & F.col("review_eligible")
    joint = on_dates & F.col("review_eligible")
    low = F.col("review_score").isin(1, 2)
    return {
        "all_orders": F.lit(True),
        "delivered_orders": delivered,
        "canceled_orders": F.col("order_status") == CANCELED,
        "delivery_orders": on_dates,
        "late_orders": on_dates & F.col("is_late"),
        "review_orders": reviewed,
        "low_score_orders": reviewed & low,
        "joint_orders": joint,
        "duration_orders": delivered & F.col(DELIVERY_MICROS).isNotNull(),
        "group_orders": joint,
        "group_low_orders": joint & low,
    }


RATIOS = {
    "aov": ("gmv", "delivered_orders"),
    "cancel_rate": ("canceled_orders", "all_orders"),
    "late_rate": ("late_orders", "delivery_orders"),
    "low_score_rate": ("low_score_orders", "review_orders"),
    "delivery_coverage": ("delivery_orders", "delivered_orders"),
    "review_coverage": ("review_orders", "delivered_orders"),
    "joint_coverage": ("joint_orders", "delivered_orders"),
    "duration_coverage": ("duration_orders", "delivered_orders"),
    "group_low_rate": ("group_low_orders", "group_orders"),
}
# Masked copies: shown only where enough delivered orders exist.
MASKED = {
    "state_investigation_orders": "delivered_orders",
    "state_investigation_late_rate": "late_rate",
    "state_investigation_late_orders": "late_orders",
}
QUANTILES = {"p50_days": 0.5, "p90_days": 0.9}
_GROUPS = {
    "goods": {"gmv"},
    "delivery": {
        "delivery_orders", "late_orders", "joint_orders", "group_orders", "group_low_orders",
    },
    "review": {
        "review_orders", "low_score_orders", "joint_orders", "group_orders", "group_low_orders",
    },
    "duration": {"duration_orders", *QUANTILES},
}

# The 20 measures of a reconciliation context.
RECONCILED = (
    "gmv", "delivered_orders", "aov", "all_orders", "canceled_orders", "cancel_rate",
    "delivery_orders", "late_orders", "late_rate", "review_orders", "low_score_orders",
    "low_score_rate", "joint_orders", "delivery_coverage", "review_coverage", "joint_coverage",
    "p50_days", "p90_days", "duration_orders", "duration_coverage",
)
ALL_ORDER_METRICS = (
    *RECONCILED, "group_orders", "group_low_orders", "group_low_rate", *MASKED,
)


def _closure(names) -> set[str]:
    """The requested measures with the counts they are computed from."""
    wanted = set(names)
    for masked, source in MASKED.items():
        if masked in wanted:
            wanted |= {source, "delivered_orders"}
    for ratio, pair in RATIOS.items():
        if ratio in wanted:
            wanted |= set(pair)
    return wanted


def fact_columns(names, extra=()) -> list[str]:
    """Order-fact columns that the given measures read."""
    wanted = _closure(names)
    columns = ["order_status"]
    for group, members in _GROUPS.items():
        if wanted & members:
            columns += _COLUMNS[group]
    return list(dict.fromkeys([*columns, *extra]))


@dataclass(frozen=True)
class Filters:
    """Filter context. Dates and states reach both facts; categories reach items only."""

    date_from: dt.date | None = None
    date_to: dt.date | None = None
    states: tuple[str, ...] | None = None
    categories: tuple[str, ...] | None = None

    def _shared(self, df: DataFrame) -> DataFrame:
        if self.date_from is not None:
            df = df.filter(F.col("purchase_date") >= F.lit(self.date_from))
        if self.date_to is not None:
            df = df.filter(F.col("purchase_date") <= F.lit(self.date_to))
        if self.states is not None:
            df = df.filter(F.col("customer_state").isin(*self.states))
        return df

    def on_orders(self, df: DataFrame) -> DataFrame:
        if self.categories is not None:
            raise ValueError("a category filter applies to order items, not to orders")
        return self._shared(df)

    def on_items(self, df: DataFrame) -> DataFrame:
        df = self._shared(df)
        if self.categories is not None:
            df = df.filter(F.col("category").isin(*self.categories))
        return df


def _counters(wanted: set[str], chosen: Column | None = None) -> list[Column]:
    """The counts behind the wanted measures, of all rows or of those for which a condition holds."""
    rules = {name: rule for name, rule in _predicates().items() if name in wanted}
    counters = [F.count_if(rule if chosen is None else chosen & rule).alias(name) for name, rule in rules.items()]
    if "gmv" in wanted:
        sold = F.col("order_status") == DELIVERED
        goods = F.sum(F.when(sold if chosen is None else chosen & sold, F.col("merchandise_value")))
        counters.append(F.coalesce(goods, F.lit(0)).cast("decimal(38,2)").alias("gmv"))
    return counters


def _derived(counts: DataFrame, wanted: set[str], min_orders: int) -> DataFrame:
    """Ratios and masked measures from counts."""
    for name, (top, bottom) in RATIOS.items():
        if name in wanted:
            counts = counts.withColumn(name, safe_ratio(F.col(top), F.col(bottom)))
    for name, source in MASKED.items():
        if name in wanted:
            shown = F.col("delivered_orders") >= min_orders
            counts = counts.withColumn(name, F.when(shown, F.col(source)))
    return counts


def _with_quantiles(result: DataFrame, spread: DataFrame, by: list[str]) -> DataFrame:
    spread = spread.select(
        *[F.col(name).alias("_" + name) for name in by],
        *[days_from_micros(F.col(name)).alias(name) for name in QUANTILES],
    )
    if not by:
        packed = spread.select(F.struct(*QUANTILES)).scalar()
        return result.withColumn("_spread", packed).select("*", "_spread.*")
    match = reduce(lambda a, b: a & b, [F.col(name).eqNullSafe(F.col("_" + name)) for name in by])
    return result.join(spread, match, "left")


def metrics(
    orders: DataFrame,
    by: list[str] | None = None,
    names=RECONCILED,
    min_orders: int = MIN_INVESTIGATION_ORDERS,
) -> DataFrame:
    """One row per group with the named measures.

    Counts and the amount are zero for an empty input; ratios and quantiles are NULL.
    """
    by = list(by or [])
    wanted = _closure(names)
    counters = _counters(wanted)
    result = _derived(orders.groupBy(*by).agg(*counters) if by else orders.agg(*counters), wanted, min_orders)
    if wanted & set(QUANTILES):
        sold = orders.filter(F.col("order_status") == DELIVERED)
        spread = scoped_distribution(sold, {"all": by}, F.col(DELIVERY_MICROS), QUANTILES)
        result = _with_quantiles(result, spread.drop("scope"), by)
    return result.select(*by, *names)


def metrics_by_context(
    orders: DataFrame,
    contexts: dict[str, Column],
    names=RECONCILED,
    min_orders: int = MIN_INVESTIGATION_ORDERS,
) -> DataFrame:
    """The measures for several named, possibly overlapping filter contexts.

    Every context appears, also when no row belongs to it. A row carries its contexts as
    the bits of a mask, so it is read once for all of them: the counts of all contexts
    are conditional counters of one aggregate, and delivery times are counted per mask
    and value before a count is added to each of its contexts.
    """
    wanted = _closure(names)
    bits = {label: 1 << i for i, label in enumerate(contexts)}
    mask = reduce(
        lambda a, b: a.bitwiseOR(b),
        [F.when(rule, bits[label]).otherwise(0).cast("bigint") for label, rule in contexts.items()],
    )
    masked = orders.withColumn("_mask", mask).where(F.col("_mask") != 0)
    within = {label: F.col("_mask").bitwiseAND(bit) != 0 for label, bit in bits.items()}
    packs = [F.struct(*_counters(wanted, rule)).alias(f"_pack{bits[label]}") for label, rule in within.items()]
    rows = F.array(*[F.struct(F.lit(label).alias("context"), F.col(f"_pack{bit}").alias("_pack")) for label, bit in bits.items()])
    counts = masked.agg(*packs).select(F.explode(rows).alias("_row")).select("_row.context", "_row._pack.*")
    result = _derived(counts, wanted, min_orders)
    if wanted & set(QUANTILES):
        sold = value_counts(masked.filter(F.col("order_status") == DELIVERED), ["_mask"], F.col(DELIVERY_MICROS))
        members = F.filter(F.array(*[F.when(rule, F.lit(label)) for label, rule in within.items()]), lambda x: x.isNotNull())
        spread = counted_distribution(sold.select(F.explode(members).alias("context"), "_ticks", "_n"), ["context"], QUANTILES)
        result = _with_quantiles(result, spread, ["context"])
    return result.select("context", *names)


def reconciliation_contexts(orders: DataFrame, config) -> dict[str, Column]:
    """The whole window, its last month, and the state with most delivered orders (the first by name of equal ones)."""
    sold = orders.filter(F.col("order_status") == DELIVERED)
    largest = sold.groupBy("customer_state").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "customer_state").first()
    month = F.trunc(F.lit(config.analysis_end), "MM")
    state = largest["customer_state"] if largest else None
    return {
        "WINDOW": F.lit(True),
        "MONTH": F.col("purchase_month") == month,
        "STATE": F.coalesce(F.col("customer_state") == F.lit(state), F.lit(False)),
    }


def item_gmv(items: DataFrame, by: list[str]) -> DataFrame:
    """Delivered item amount; NULL, not zero, where nothing was delivered."""
    delivered = F.when(F.col("order_status") == DELIVERED, F.col("price"))
    return items.groupBy(*by).agg(F.sum(delivered).cast("decimal(38,2)").alias("item_gmv"))
