"""The ten business questions. Each takes a model and a configuration and returns a DataFrame.

Every question filters to the inclusive purchase window and delivered orders unless
its docstring says otherwise, aggregates first, and joins spines and grids afterwards
at group size.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlens.config import AnalysisConfig
from cartlens.functions.measures import is_not_true, safe_ratio
from cartlens.functions.time import (
    covers_whole_month,
    days_from_micros,
    fractional_days,
    month_of,
    month_sequence,
)
from cartlens.operators.calendar import dense_grid, fill_spine, month_spine
from cartlens.operators.distributions import scoped_distribution
from cartlens.operators.events import cohort_maturity, first_and_next_event
from cartlens.operators.filters import observed_until
from cartlens.operators.ranking import label_top_groups, threshold_rank
from cartlens.operators.samples import sample_counts, with_group_gap
from cartlens.operators.shares import sequential_decomposition
from cartlens.plans.cells import (
    FULFILMENT,
    SUM_TYPE,
    added,
    delivered_cells,
    guarded_goods,
    joint_sample,
    low_score,
    order_cells,
)
from cartlens.plans.model import CANCELED, DELIVERED, DELIVERY_MICROS
from cartlens.sources.scratch import landed

TOP_CATEGORIES = 10
REPEAT_DAYS = 30

# Sample and group labels.
ALL_JOINT, EXCLUDE_EARLY = "ALL_JOINT", "EXCLUDE_EARLY_ANSWERS"
ON_TIME, LATE = "ON_TIME", "LATE"


def _zero() -> Column:
    return F.lit(0).cast(SUM_TYPE)


def _months(model, config: AnalysisConfig) -> DataFrame:
    return month_spine(model.spark, config.analysis_start, config.analysis_end)


def _month_array(config: AnalysisConfig) -> Column:
    return month_sequence(config.analysis_start, config.analysis_end)


def _delivered(model, config, *columns) -> DataFrame:
    return model.orders(columns, config, DELIVERED)


def monthly_commerce(model, config: AnalysisConfig, cells: DataFrame | None = None) -> DataFrame:
    """Q01: orders of any status, delivered amount, average value and canceled share per month."""
    if cells is None:
        cells = order_cells(model, config, ("purchase_month", "order_status"), fulfilment=False)
    delivered = F.col("order_status") == DELIVERED

    def count(name, chosen):
        return F.coalesce(F.sum(F.when(chosen, F.col(name))), F.lit(0))

    goods = F.coalesce(F.sum(F.when(delivered, F.col("goods"))), _zero())
    known, sold = count("known", delivered), count("orders", delivered)
    grouped = cells.groupBy("purchase_month").agg(
        F.sum("orders").alias("all_orders"),
        sold.alias("delivered_orders"),
        count("orders", F.col("order_status") == CANCELED).alias("canceled_orders"),
        known.alias("valid_merchandise_orders"),
        F.when(known == sold, goods).cast(SUM_TYPE).alias("merchandise_value"),
    )
    counters = ["all_orders", "delivered_orders", "canceled_orders", "valid_merchandise_orders"]
    filled = _months(model, config).join(grouped, "purchase_month", "left")
    empty = F.col("all_orders").isNull()
    filled = filled.withColumns(
        {
            "merchandise_value": F.when(empty, _zero()).otherwise(F.col("merchandise_value")),
            **{name: F.coalesce(F.col(name), F.lit(0)) for name in counters},
        }
    )
    return filled.withColumns(
        {
            "average_order_value": safe_ratio(F.col("merchandise_value"), F.col("delivered_orders")),
            "canceled_order_share": safe_ratio(F.col("canceled_orders"), F.col("all_orders")),
            "complete_calendar_month": covers_whole_month(
                F.col("purchase_month"), config.analysis_start, config.analysis_end
            ),
        }
    )


def monthly_change(model, config: AnalysisConfig, cells: DataFrame | None = None) -> DataFrame:
    """Q02: month-on-month change split into order-count and order-value parts."""
    if cells is None:
        cells = order_cells(model, config, ("purchase_month",), fulfilment=False, status=DELIVERED)
    grouped = delivered_cells(cells).groupBy("purchase_month").agg(
        F.sum("orders").alias("delivered_orders"), guarded_goods().alias("merchandise_value")
    )
    empty = F.col("delivered_orders").isNull()
    periods = (
        _months(model, config)
        .join(grouped, "purchase_month", "left")
        .withColumn("merchandise_value", F.when(empty, _zero()).otherwise(F.col("merchandise_value")))
        .withColumn("delivered_orders", F.coalesce(F.col("delivered_orders"), F.lit(0)))
        .withColumn(
            "average_order_value", safe_ratio(F.col("merchandise_value"), F.col("delivered_orders"))
        )
    )
    return sequential_decomposition(
        periods,
        "purchase_month",
        "delivered_orders",
        "merchandise_value",
        "average_order_value",
        "merchandise_change",
        {
            "previous_amount": "previous_merchandise_value",
            "previous_count": "previous_delivered_orders",
            "previous_average": "previous_average_order_value",
            "rate": "merchandise_change_rate",
            "count_part": "order_count_contribution",
            "average_part": "average_order_value_contribution",
            "residual": "decomposition_residual",
        },
    )


def category_contribution(model, config: AnalysisConfig, scratch: str | None = None) -> DataFrame:
    """Q03: item amounts per top category or OTHER, for the window and for each month.

    The ranking is fixed over the whole window. Distinct orders are counted again
    inside OTHER and do not add up across categories.

    The joined items are landed as one row per order and category. With the groups known, they
    become one row per order and group, which is the only distinct step: an order has one
    month, so its rows are counted per month and the months add up to the window.
    """
    items = model.items(["category", "order_id", "purchase_month", "price"], config, DELIVERED)
    slim = items.groupBy("category", "order_id", "purchase_month").agg(F.sum("price").alias("amount"))
    slim = landed(slim, "order-categories", scratch)
    labelled = (
        label_top_groups(slim, "category", "amount", TOP_CATEGORIES, "_group", "category_rank")
        .drop("category")
        .withColumnRenamed("_group", "category")
    )
    group = ["category", "category_rank"]
    sets = labelled.groupBy("order_id", "purchase_month", *group).agg(F.sum("amount").alias("amount"))
    monthly = sets.groupBy("purchase_month", *group).agg(
        F.sum("amount").cast(SUM_TYPE).alias("merchandise_value"),
        F.count(F.lit(1)).alias("containing_category_orders"),
    )
    monthly = landed(monthly, "month-groups", scratch)
    totals = monthly.groupBy(*group).agg(
        F.sum("merchandise_value").cast(SUM_TYPE).alias("merchandise_value"), *added("containing_category_orders")
    )

    value, change = F.col("merchandise_value"), F.col("merchandise_change")
    whole = totals.select(
        F.lit("WINDOW").alias("period"),
        F.lit(None).cast("date").alias("purchase_month"),
        *group,
        "merchandise_value",
        "containing_category_orders",
        safe_ratio(value, F.sum(value).over(Window.partitionBy())).alias("merchandise_share"),
        F.lit(None).cast(SUM_TYPE).alias("previous_merchandise_value"),
        F.lit(None).cast(SUM_TYPE).alias("merchandise_change"),
        F.lit(None).cast("double").alias("change_contribution_share"),
    )
    grid = dense_grid(totals.select(*group), {"purchase_month": _month_array(config)})
    filled = fill_spine(
        grid, monthly, ["purchase_month", *group], ["merchandise_value", "containing_category_orders"]
    ).withColumn("merchandise_value", value.cast(SUM_TYPE))
    steps = Window.partitionBy(*group).orderBy("purchase_month")
    month = Window.partitionBy("purchase_month")
    changes = filled.withColumn(
        "previous_merchandise_value", F.lag("merchandise_value").over(steps)
    ).withColumn(
        "merchandise_change", (value - F.col("previous_merchandise_value")).cast(SUM_TYPE)
    )
    by_month = changes.select(
        F.lit("MONTH").alias("period"),
        "purchase_month",
        *group,
        "merchandise_value",
        "containing_category_orders",
        safe_ratio(value, F.sum(value).over(month)).alias("merchandise_share"),
        "previous_merchandise_value",
        "merchandise_change",
        safe_ratio(change, F.sum(change).over(month)).alias("change_contribution_share"),
    )
    return whole.unionByName(by_month)


def state_investigation(model, config: AnalysisConfig, cells: DataFrame | None = None) -> DataFrame:
    """Q04: amount and fulfilment per customer state; small samples stay unranked."""
    if cells is None:
        cells = order_cells(model, config, ("customer_state",), status=DELIVERED)
    states = delivered_cells(cells).groupBy("customer_state").agg(
        F.sum("orders").alias("delivered_orders"), guarded_goods().alias("merchandise_value"), *added(*FULFILMENT)
    )
    everything = Window.partitionBy()
    amount_order = Window.orderBy(
        F.col("merchandise_value").desc_nulls_last(), F.col("customer_state").asc_nulls_last()
    )
    value, delivered = F.col("merchandise_value"), F.col("delivered_orders")
    eligible, reviewed = F.col("delivery_eligible_orders"), F.col("review_eligible_orders")
    joint = F.col("joint_eligible_orders")
    rates = states.withColumns(
        {
            "merchandise_share": safe_ratio(value, F.sum(value).over(everything)),
            "merchandise_rank": F.row_number().over(amount_order).cast("bigint"),
            "delivery_coverage": safe_ratio(eligible, delivered),
            "review_coverage": safe_ratio(reviewed, delivered),
            "joint_coverage": safe_ratio(joint, delivered),
            "late_share": safe_ratio(F.col("late_orders"), eligible),
            "low_score_share": safe_ratio(F.col("low_score_orders"), reviewed),
            "joint_low_score_share": safe_ratio(F.col("joint_low_score_orders"), joint),
            "meets_state_threshold": (delivered >= config.min_state_orders) & (eligible > 0),
        }
    )
    order = [
        F.col("late_share").desc_nulls_last(),
        F.col("late_orders").desc_nulls_last(),
        F.col("delivered_orders").desc_nulls_last(),
        F.col("customer_state").asc_nulls_last(),
    ]
    return threshold_rank(
        rates, F.col("meets_state_threshold"), order, "investigation_rank"
    ).withColumn("min_state_orders", F.lit(config.min_state_orders))


def delivery_duration(model, config: AnalysisConfig, scratch: str | None = None) -> DataFrame:
    """Q05: delivery days for the window, every month and every state.

    An estimate is not needed to enter this sample. The quantiles are exact.
    """
    orders = _delivered(model, config, "purchase_month", "customer_state", DELIVERY_MICROS)
    found = scoped_distribution(
        orders,
        {"WINDOW": [], "MONTH": ["purchase_month"], "STATE": ["customer_state"]},
        F.col(DELIVERY_MICROS),
        {"median": 0.5, "p90": 0.9},
        scratch,
    )
    no_month = F.lit(None).cast("date").alias("purchase_month")
    no_state = F.lit(None).cast("string").alias("customer_state")
    spine = (
        model.spark.range(1)
        .select(F.lit("WINDOW").alias("scope"), no_month, no_state)
        .unionByName(
            _months(model, config).select(F.lit("MONTH").alias("scope"), "purchase_month", no_state)
        )
        .unionByName(
            model.states().select(F.lit("STATE").alias("scope"), no_month, "customer_state")
        )
    )
    keys = ["scope", "purchase_month", "customer_state"]
    marks = found.select(*[F.col(name).alias("_" + name) for name in keys], *found.columns[3:])
    match = F.lit(True)
    for name in keys:
        match = match & F.col(name).eqNullSafe(F.col("_" + name))
    delivered = F.coalesce(F.col("rows"), F.lit(0))
    counted = F.coalesce(F.col("values"), F.lit(0))
    return spine.join(marks, match, "left").select(
        *keys,
        delivered.alias("delivered_orders"),
        counted.alias("duration_eligible_orders"),
        safe_ratio(counted, delivered).alias("duration_coverage"),
        days_from_micros(F.col("median")).alias("median_delivery_days"),
        days_from_micros(F.col("p90")).alias("p90_delivery_days"),
        days_from_micros(F.col("min_ticks")).alias("min_delivery_days"),
        days_from_micros(F.col("max_ticks")).alias("max_delivery_days"),
    )


def month_state_delivery(model, config: AnalysisConfig, cells: DataFrame | None = None) -> DataFrame:
    """Q06: delivery and review coverage for every month and state, empty cells included."""
    cell = ["purchase_month", "customer_state"]
    if cells is None:
        cells = order_cells(model, config, cell, goods=False, status=DELIVERED)
    wanted = [name for name in FULFILMENT if name != "low_score_orders"]
    grouped = delivered_cells(cells).groupBy(*cell).agg(F.sum("orders").alias("delivered_orders"), *added(*wanted))
    grid = dense_grid(model.states(), {"purchase_month": _month_array(config)})
    filled = fill_spine(grid.select(*cell), grouped, cell, grouped.columns[2:])
    delivered, eligible = F.col("delivered_orders"), F.col("delivery_eligible_orders")
    joint = F.col("joint_eligible_orders")
    return filled.withColumns(
        {
            "missing_or_invalid_delivery_orders": delivered - eligible,
            "late_share": safe_ratio(F.col("late_orders"), eligible),
            "delivery_coverage": safe_ratio(eligible, delivered),
            "review_coverage": safe_ratio(F.col("review_eligible_orders"), delivered),
            "joint_coverage": safe_ratio(joint, delivered),
            "joint_low_score_share": safe_ratio(F.col("joint_low_score_orders"), joint),
        }
    )


def score_distribution(model, config: AnalysisConfig) -> DataFrame:
    """Q07: review scores of on-time and late orders within the joint sample."""
    orders = _delivered(
        model,
        config,
        "delivery_eligible",
        "review_eligible",
        "is_late",
        "review_score",
        "review_answer_timestamp",
        "review_before_delivery",
    ).filter(joint_sample())
    scores = {f"score_{n}": F.col("review_score") == n for n in range(1, 6)}
    grouped = (
        orders.filter(F.col("is_late").isNotNull())
        .groupBy(F.when(F.col("is_late"), LATE).otherwise(ON_TIME).alias("delivery_group"))
        .agg(
            F.count(F.lit(1)).alias("joint_eligible_orders"),
            F.count_if(low_score()).alias("low_score_orders"),
            *[F.count_if(hit).alias(f"{name}_orders") for name, hit in scores.items()],
            F.count("review_answer_timestamp").alias("answer_timestamp_orders"),
            F.count_if("review_before_delivery").alias("early_answer_orders"),
        )
    )
    groups = model.spark.range(1).select(
        F.explode(F.array(F.lit(ON_TIME), F.lit(LATE))).alias("delivery_group")
    )
    filled = fill_spine(groups, grouped, ["delivery_group"], grouped.columns[1:])
    joint = F.col("joint_eligible_orders")
    return filled.withColumns(
        {
            "low_score_share": safe_ratio(F.col("low_score_orders"), joint),
            **{f"{name}_share": safe_ratio(F.col(f"{name}_orders"), joint) for name in scores},
            "answer_timestamp_coverage": safe_ratio(F.col("answer_timestamp_orders"), joint),
        }
    )


def stratified_sensitivity(model, config: AnalysisConfig) -> DataFrame:
    """Q08: low-score gap per month and state, with and without early answers.

    Answers of unknown time stay in the reduced sample.
    """
    orders = _delivered(
        model,
        config,
        "purchase_month",
        "customer_state",
        "delivery_eligible",
        "review_eligible",
        "is_late",
        "review_score",
        "review_answer_timestamp",
        "review_before_delivery",
    ).filter(joint_sample())
    cell = ["purchase_month", "customer_state"]
    late, early = F.col("is_late"), F.col("review_before_delivery")
    everyone = F.lit(True)
    samples = {ALL_JOINT: everyone, EXCLUDE_EARLY: is_not_true(early)}
    counts = sample_counts(
        orders,
        cell,
        samples,
        {
            "joint_eligible_orders": everyone,
            "on_time_orders": ~late,
            "late_orders": late,
            "on_time_low_score_orders": ~late & low_score(),
            "late_low_score_orders": late & low_score(),
            "answer_timestamp_orders": F.col("review_answer_timestamp").isNotNull(),
            "early_answer_orders": early,
        },
    )
    whole = Window.partitionBy(*cell)
    removed = F.max(
        F.when(F.col("sample") == ALL_JOINT, F.col("early_answer_orders"))
    ).over(whole)
    counts = counts.withColumn(
        "excluded_early_answer_orders",
        F.when(F.col("sample") == EXCLUDE_EARLY, removed).otherwise(F.lit(0)),
    )
    axes = {
        "purchase_month": _month_array(config),
        "sample": F.array(*[F.lit(label) for label in samples]),
    }
    keys = [*cell, "sample"]
    measures = [name for name in counts.columns if name not in keys]
    filled = fill_spine(dense_grid(model.states(), axes).select(*keys), counts, keys, measures)
    rated = with_group_gap(
        filled,
        ("on_time_orders", "on_time_low_score_orders"),
        ("late_orders", "late_low_score_orders"),
        config.min_group_orders,
        {
            "base_share": "on_time_low_score_share",
            "other_share": "late_low_score_share",
            "gap": "low_score_share_gap",
            "threshold": "meets_group_threshold",
        },
    )
    return rated.withColumns(
        {
            "answer_timestamp_coverage": safe_ratio(
                F.col("answer_timestamp_orders"), F.col("joint_eligible_orders")
            ),
            "min_group_orders": F.lit(config.min_group_orders),
        }
    )


def _observed_purchases(model, config: AnalysisConfig) -> DataFrame:
    """Delivered orders of the full history up to the observation end."""
    orders = model.orders(
        ["order_id", "customer_unique_id", "purchase_timestamp"], None, DELIVERED
    )
    return observed_until(orders, "purchase_timestamp", "customer_unique_id", config.observation_end)


def _first_purchases(model, config: AnalysisConfig, with_totals: bool) -> DataFrame:
    return first_and_next_event(
        _observed_purchases(model, config),
        "customer_unique_id",
        "purchase_timestamp",
        "order_id",
        REPEAT_DAYS,
        config.observation_end,
        with_totals,
    )


def customer_sequence(model, config: AnalysisConfig) -> DataFrame:
    """Q09: first observed purchase per customer and the next strictly later one.

    The report window does not clip the history. Customer-level result: never published.
    """
    return _first_purchases(model, config, True).select(
        "customer_unique_id",
        F.col("first_id").alias("first_order_id"),
        F.col("first_ts").alias("first_purchase_timestamp"),
        month_of(F.col("first_ts")).alias("cohort_month"),
        F.col("total_rows").alias("delivered_orders_observed"),
        F.col("simultaneous_rows").alias("simultaneous_additional_orders"),
        F.col("next_id").alias("next_order_id"),
        F.col("next_ts").alias("next_purchase_timestamp"),
        fractional_days(F.col("first_ts"), F.col("next_ts")).alias("days_to_next_purchase"),
        F.col("has_full_horizon").alias("has_30_day_observation"),
        F.col("repeated").alias("repeat_within_30_days"),
    )


def repeat_cohorts(model, config: AnalysisConfig) -> DataFrame:
    """Q10: 30-day repeat share per monthly cohort of first purchases."""
    cohorts = cohort_maturity(
        _first_purchases(model, config, False),
        config.analysis_start,
        config.analysis_end,
        config.observation_end,
        REPEAT_DAYS,
    )
    return cohorts.select(
        "cohort_month",
        F.col("total").alias("total_customers"),
        F.col("eligible").alias("eligible_customers"),
        F.col("immature").alias("immature_customers"),
        F.col("repeats").alias("repeat_customers_30d"),
        F.col("with_simultaneous").alias("customers_with_simultaneous_orders"),
        F.col("simultaneous").alias("simultaneous_additional_orders"),
        F.col("repeat_share").alias("repeat_share_30d"),
        F.col("coverage").alias("observation_coverage"),
        "maturity_status",
        F.col("fully_observed").alias("fully_observed_calendar_cohort"),
        "observation_end",
    )


ANALYSES = {
    "q01_monthly_commerce": monthly_commerce,
    "q02_monthly_change_decomposition": monthly_change,
    "q03_category_contribution": category_contribution,
    "q04_state_investigation": state_investigation,
    "q05_delivery_duration": delivery_duration,
    "q06_month_state_delivery": month_state_delivery,
    "q07_delivery_review_distribution": score_distribution,
    "q08_stratified_review_sensitivity": stratified_sensitivity,
    "q09_customer_observed_sequence": customer_sequence,
    "q10_repeat_cohort_30d": repeat_cohorts,
}

CUSTOMER_LEVEL = frozenset({"q09_customer_observed_sequence"})


def result_order(name: str) -> list[Column]:
    """Documented row order of each result, with explicit NULL placement."""
    asc, first = (lambda c: F.col(c).asc_nulls_last()), (lambda c: F.col(c).asc_nulls_first())
    orders = {
        "q03": [F.col("period").desc(), first("purchase_month"), asc("category_rank"), asc("category")],
        "q04": [asc("investigation_rank"), asc("merchandise_rank")],
        "q05": [F.col("scope").desc(), asc("purchase_month"), asc("customer_state")],
        "q06": [asc("purchase_month"), asc("customer_state")],
        "q07": [asc("delivery_group")],
        "q08": [asc("purchase_month"), asc("customer_state"), asc("sample")],
        "q09": [asc("first_purchase_timestamp"), asc("customer_unique_id")],
        "q10": [asc("cohort_month")],
    }
    return orders.get(name[:3], [asc("purchase_month")])


# The questions that the cells of the orders answer, and those that land tables of their own.
ROLLED_UP = frozenset(
    {"q01_monthly_commerce", "q02_monthly_change_decomposition", "q04_state_investigation", "q06_month_state_delivery"}
)
LANDING = frozenset({"q03_category_contribution", "q05_delivery_duration"})


def with_cells(model, config: AnalysisConfig, scratch: str | None = None) -> dict:
    """All questions by name; those that can be are rolled up from one landed table of cells."""
    cells = landed(order_cells(model, config), "order-cells", scratch)

    def prepared(name, question):
        if name in ROLLED_UP:
            return partial(question, model, config, cells)
        if name in LANDING and scratch is not None:
            return partial(question, model, config, f"{scratch}/{name}")
        return partial(question, model, config)

    return {name: prepared(name, question) for name, question in ANALYSES.items()}
