"""One table of order counts and amounts per cell, from which several questions are rolled up.

A cell holds sums that can be added again: rows, known amounts, their sum, and the counts of the fulfilment samples. An
amount is guarded after adding up: it is known only if as many amounts as orders are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlens.config import AnalysisConfig
from cartlens.plans.model import DELIVERED

SUM_TYPE = "decimal(38,2)"
CELL = ("purchase_month", "customer_state", "order_status")


def low_score() -> Column:
    return F.col("review_score") <= 2


def joint_sample() -> Column:
    return F.col("delivery_eligible") & F.col("review_eligible")


def _fulfilment() -> dict[str, Column]:
    reviewed, joint = F.col("review_eligible"), joint_sample()
    rules = (F.col("delivery_eligible"), F.col("is_late"), reviewed, reviewed & low_score(), joint, joint & low_score())
    return dict(zip(FULFILMENT, rules, strict=True))


FULFILMENT = (
    "delivery_eligible_orders", "late_orders", "review_eligible_orders", "low_score_orders", "joint_eligible_orders",
    "joint_low_score_orders",
)
_FULFILMENT_COLUMNS = ("delivery_eligible", "is_late", "review_eligible", "review_score")


def order_cells(
    model, config: AnalysisConfig, dims=CELL, goods: bool = True, fulfilment: bool = True, status: str | None = None
) -> DataFrame:
    """Cells of the orders in the window; a question that stands alone asks for its own dimensions and measures."""
    columns = list(dict.fromkeys([*dims, *(["merchandise_value"] if goods else []), *(_FULFILMENT_COLUMNS if fulfilment else ())]))
    measures = [F.count(F.lit(1)).alias("orders")]
    if goods:
        measures += [F.count("merchandise_value").alias("known"), F.sum("merchandise_value").alias("goods")]
    if fulfilment:
        measures += [F.count_if(rule).alias(name) for name, rule in _fulfilment().items()]
    return model.orders(columns, config, status).groupBy(*dims).agg(*measures)


def delivered_cells(cells: DataFrame) -> DataFrame:
    return cells.filter(F.col("order_status") == DELIVERED) if "order_status" in cells.columns else cells


def added(*names: str) -> list[Column]:
    return [F.sum(name).alias(name) for name in names]


def guarded_goods() -> Column:
    """The amount of all orders of the cells, NULL unless every one is known."""
    return F.when(F.sum("known") == F.sum("orders"), F.sum("goods")).cast(SUM_TYPE)
