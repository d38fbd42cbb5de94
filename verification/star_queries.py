"""Every library operator and question as a query over the order/line star tables.

Each query takes (spark, directory) and reads whole tables. Results are rendered in
plain types: money as double, dates and timestamps as ISO text, integers as bigint.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.functions import casts
from cartlens.functions.measures import guarded_sum, is_not_true, is_true, safe_ratio
from cartlens.functions.time import days_from_micros, fractional_days, month_of, month_sequence
from cartlens.operators.calendar import dense_grid, fill_spine, month_spine
from cartlens.operators.checks import (
    duplicate_rows,
    fk_orphans,
    key_conflicts,
    reconcile,
    table_fingerprint,
)
from cartlens.operators.distributions import scoped_distribution
from cartlens.operators.enrich import Lookup, star_enrich
from cartlens.operators.events import cohort_maturity, first_and_next_event
from cartlens.operators.filters import observed_until, window_filter
from cartlens.operators.ranking import latest_row, threshold_rank, top_n_other
from cartlens.operators.samples import sample_expand, stratified_gap
from cartlens.operators.shares import contribution_share, sequential_decomposition
from cartlens.plans import metrics as M
from cartlens.plans.analyses import ANALYSES, monthly_change, monthly_commerce, state_investigation, with_cells
from cartlens.plans.extract import (
    category_groups,
    delay_group,
    extract_tables,
    with_month_label,
)
from cartlens.plans.model import StagedModel, item_totals, payment_totals, selected_reviews
from cartlens.plans.quality import (
    analysis_checks,
    model_checks,
    quality_report,
    staging_checks,
    summarize,
)
from cartlens.plans.reports import (
    overview,
    partial_cohorts,
    purchase_profile,
    row_profile,
    sensitivity_summary,
    top_states,
)
from cartlens.plans.staging import COLUMNS, stage_all, stage_table
from cartlens.sources.csv_source import content_hashes, read_source, source_manifest
from cartlens.sources.order_star import STAR_CONFIG, read_star, star_tables, star_text_tables
from cartlens.sources.results import export_csv, read_export
from cartlens.sources.scratch import scratch_path
from verification.dirt import DIRT

# Cut-off and horizon of the event-table sequence.
EVENT_CUTOFF = dt.datetime(2024, 1, 28)
EVENT_HORIZON_DAYS = 1


def plain(df: DataFrame, rounded: tuple[str, ...] = ()) -> DataFrame:
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, (T.DateType, T.TimestampNTZType)):
            column = column.cast("string")
        elif isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            column = column.cast("bigint")
        if field.name in rounded:
            column = F.round(column, 6)
        columns.append(column.alias(field.name))
    return df.select(*columns)


def model(spark: SparkSession, path: str, strict: bool = False) -> StagedModel:
    return StagedModel(star_tables(spark, path, strict))


_ROUNDED = {
    "q05_delivery_duration": ("median_delivery_days", "p90_delivery_days"),
}


# Questions over every delivered order of the source, also those without lines.
_WHOLE = ("q02_monthly_change_decomposition", "q04_state_investigation", "q06_month_state_delivery", "q10_repeat_cohort_30d")


def _analysis(name):
    return lambda spark, path: plain(
        ANALYSES[name](model(spark, path, name in _WHOLE), STAR_CONFIG), _ROUNDED.get(name, ())
    )


def _results(spark, path, *names) -> dict[str, DataFrame]:
    shared = model(spark, path)
    return {
        name: ANALYSES[name](shared, STAR_CONFIG) for name in ANALYSES if name[:3] in names
    }


# --- model -------------------------------------------------------------------------


def fact_orders(spark, path):
    return plain(model(spark, path).orders())


def fact_order_items(spark, path):
    return plain(model(spark, path).items())


def dim_date(spark, path):
    return plain(model(spark, path).dates(STAR_CONFIG))


def dim_customer_state(spark, path):
    return model(spark, path).states()


def dim_category(spark, path):
    return model(spark, path).categories()


def latest_review(spark, path):
    return plain(selected_reviews(star_tables(spark, path)["reviews"]))


def order_item_totals(spark, path):
    return plain(item_totals(star_tables(spark, path)["items"]))


def order_payment_totals(spark, path):
    return plain(payment_totals(star_tables(spark, path)["payments"]))


# --- staging -----------------------------------------------------------------------


def _staging(table):
    return lambda spark, path: plain(stage_table(star_text_tables(spark, path)[table], table))


def staging_casts(spark, path):
    """Clean and dirty renderings of real line values through every tolerant cast."""
    lines = read_star(spark, path, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_shipdate").cast("date").cast("string").alias("day"),
        (F.col("l_quantity").cast("int") % 8).alias("kind"),
    )
    price, kind = F.col("price").cast("string"), F.col("kind")
    amount = (
        F.when(kind == 0, F.concat(F.lit("  "), price, F.lit(" ")))
        .when(kind == 1, F.concat(price, F.lit("5")))
        .when(kind == 2, F.concat(F.lit("x"), price))
        .when(kind == 3, F.lit("   "))
        .when(kind == 4, F.concat(F.lit("-"), price))
        .when(kind == 5, F.lit(None).cast("string"))
        .when(kind == 6, F.concat(F.lit("+"), price))
        .otherwise(price)
    )
    number = F.col("quantity").cast("string")
    whole = (
        F.when(kind == 0, F.concat(number, F.lit(".5")))
        .when(kind == 1, F.concat(number, F.lit(".4")))
        .when(kind == 2, F.concat(F.lit(" "), number))
        .when(kind == 3, F.lit(""))
        .when(kind == 4, F.concat(F.lit("-"), number))
        .when(kind == 5, F.concat(number, F.lit("a")))
        .otherwise(number)
    )
    moment = (
        F.when(kind == 0, F.concat(F.col("day"), F.lit(" 10:11:12")))
        .when(kind == 1, F.substring("day", 1, 7))
        .when(kind == 2, F.substring("day", 1, 4))
        .when(kind == 3, F.lit(" "))
        .when(kind == 4, F.concat(F.col("day"), F.lit(" 25:00:00")))
        .when(kind == 5, F.concat(F.substring("day", 1, 5), F.lit("13-40")))
        .when(kind == 6, F.concat(F.lit(" "), F.col("day"), F.lit(" 00:00:01.5")))
        .otherwise(F.col("day"))
    )
    text = lines.select(
        "l_orderkey",
        "l_linenumber",
        amount.alias("amount_text"),
        whole.alias("whole_text"),
        moment.alias("moment_text"),
    )
    return plain(
        text.select(
            "l_orderkey",
            "l_linenumber",
            casts.blank_to_null(F.col("amount_text")).alias("trimmed"),
            casts.text_to_money(F.col("amount_text")).alias("money"),
            casts.text_to_double(F.col("whole_text")).alias("decimal_number"),
            casts.text_to_integer(F.col("whole_text")).alias("rounded_integer"),
            casts.text_to_score(F.col("whole_text")).alias("score"),
            casts.text_to_timestamp(F.col("moment_text")).alias("moment"),
            casts.unknown_member(casts.blank_to_null(F.col("moment_text"))).alias("member"),
        )
    )


def staging_removes_copies(spark, path):
    """Doubled source rows come back once per distinct row."""
    items = star_text_tables(spark, path)["items"]
    doubled = items.unionByName(items)
    staged = stage_table(doubled, "items")
    return plain(
        staged.groupBy("order_id").agg(
            F.count(F.lit(1)).alias("staged_rows"), F.sum("price").alias("price")
        )
    )


# --- questions ---------------------------------------------------------------------


def q01_strict_guarded_sum(spark, path):
    """Orders without lines stay delivered, so their months lose the amount."""
    return plain(monthly_commerce(model(spark, path, strict=True), STAR_CONFIG))


def q02_strict_undefined_parts(spark, path):
    return plain(monthly_change(model(spark, path, strict=True), STAR_CONFIG))


def q04_strict_unknown_amounts(spark, path):
    return plain(state_investigation(model(spark, path, strict=True), STAR_CONFIG))


# --- quality -----------------------------------------------------------------------


def quality_staging(spark, path):
    raw = star_text_tables(spark, path)
    return plain(staging_checks(raw, stage_all(raw)))


def _dirty(raw: DataFrame, table: str) -> DataFrame:
    key, changes, copies = DIRT[table]
    numbered = raw.withColumn("_n", F.regexp_extract(key, "([0-9]+)$", 1).try_cast("bigint"))

    def text(name):
        column = F.col(name)
        for modulus, changed, value in changes:
            if changed == name:
                column = F.when(F.col("_n") % modulus == 0, F.lit(value).cast("string")).otherwise(column)
        return column.alias(name)

    columns = [text(name) for name in COLUMNS[table]]
    found = numbered.select(*columns)
    for modulus, changed, value in copies:
        copy = numbered.filter(F.col("_n") % modulus == 0).select(*columns)
        found = found.unionByName(copy if changed is None else copy.withColumn(changed, F.lit(value)))
    return found


def quality_staging_dirty(spark, path):
    """The checks on source texts with broken, missing, repeated and orphaned rows of every kind."""
    raw = {table: _dirty(df, table) for table, df in star_text_tables(spark, path).items()}
    return plain(staging_checks(raw, stage_all(raw)))


def quality_models(spark, path):
    """The checks see delivered orders without lines as the source has them."""
    shared = model(spark, path, strict=True)
    return plain(model_checks(shared.staged, shared))


def _analysis_checks(spark, path):
    shared = model(spark, path, strict=True)
    names = [name for name in ANALYSES if name[:3] in ("q01", "q02", "q03")]
    results = {name: ANALYSES[name](shared, STAR_CONFIG) for name in names}
    return analysis_checks(results, shared, STAR_CONFIG)


def quality_analyses_broken(spark, path):
    """The reconciliation of changed results: amounts, flags, copies, residuals and cells; then one result twice and one absent."""
    shared = model(spark, path)
    first, second, third = (name for name in ANALYSES if name[:3] in ("q01", "q02", "q03"))
    results = {name: ANALYSES[name](shared, STAR_CONFIG) for name in (first, second, third)}
    number = F.month("purchase_month")
    shifted = results[first].withColumns(
        {
            "merchandise_value": F.col("merchandise_value") + F.when(number % 2 == 0, 1).otherwise(0),
            "complete_calendar_month": F.when(number % 3 == 0, ~F.col("complete_calendar_month")).otherwise(F.col("complete_calendar_month")),
        }
    )
    bent = F.col("order_count_contribution") + F.when(number % 5 == 0, 0.02).otherwise(0)
    lost = (F.col("period") == "MONTH") & (number % 4 == 0) & (F.col("category") == "OTHER")
    changed = {
        first: shifted.unionByName(shifted.filter(number == 5)),
        second: results[second].withColumn("order_count_contribution", bent),
        third: results[third].filter(~lost),
    }
    doubled = {first: results[first], second: results[second], f"{second}_again": results[second]}
    scenarios = [
        analysis_checks(found, shared, STAR_CONFIG).withColumn("scenario", F.lit(label))
        for label, found in (("changed", changed), ("doubled", doubled))
    ]
    return plain(scenarios[0].unionByName(scenarios[1]))


def quality_analyses(spark, path):
    return plain(_analysis_checks(spark, path))


def quality_summary(spark, path):
    shared = model(spark, path, strict=True)
    return plain(summarize(model_checks(shared.staged, shared)))


def quality_report_rows(spark, path):
    shared = model(spark, path, strict=True)
    return plain(quality_report(model_checks(shared.staged, shared)))


# --- metrics and extract -----------------------------------------------------------

_DAYS = ("p50_days", "p90_days")


def _metric_orders(spark, path, names, *extra, strict=False):
    return model(spark, path, strict).orders(M.fact_columns(names, extra), STAR_CONFIG)


def metrics_all(spark, path):
    names = M.ALL_ORDER_METRICS
    return plain(M.metrics(_metric_orders(spark, path, names), names=names), _DAYS)


def metrics_by_month(spark, path):
    names = ("gmv", "delivered_orders", "aov", "late_rate")
    orders = _metric_orders(spark, path, names, "purchase_date")
    return plain(M.metrics(with_month_label(orders, "purchase_date"), ["month_label"], names))


def metrics_by_state(spark, path):
    names = ("gmv",)
    return plain(
        M.metrics(_metric_orders(spark, path, names, "customer_state"), ["customer_state"], names)
    )


def metrics_state_scatter(spark, path):
    names = (
        "state_investigation_orders", "state_investigation_late_rate",
        "state_investigation_late_orders", "delivery_orders", "late_orders", "low_score_rate",
        "joint_coverage",
    )
    orders = _metric_orders(spark, path, names, "customer_state")
    return plain(M.metrics(orders, ["customer_state"], names, STAR_CONFIG.min_state_orders))


def metrics_by_delay_group(spark, path):
    names = ("group_low_rate", "group_orders", "group_low_orders")
    orders = _metric_orders(spark, path, names).withColumn("delay_group", delay_group())
    return plain(M.metrics(orders, ["delay_group"], names))


def metrics_days_by_state(spark, path):
    names = ("duration_orders", "duration_coverage", *_DAYS)
    orders = _metric_orders(spark, path, names, "customer_state", strict=True)
    return plain(M.metrics(orders, ["customer_state"], names), _DAYS)


_CONTEXT_MONTH = (dt.date(1996, 2, 1), dt.date(1996, 2, 29))
_CONTEXT_STATE = "NATION_3"


def metrics_contexts(spark, path):
    orders = _metric_orders(spark, path, M.RECONCILED, "purchase_date", "customer_state")
    contexts = {
        "all": F.lit(True),
        "first_month": F.col("purchase_date").between(*[F.lit(day) for day in _CONTEXT_MONTH]),
        "one_state": F.col("customer_state") == _CONTEXT_STATE,
        "no_rows": F.col("customer_state") == "NOWHERE",
    }
    return plain(M.metrics_by_context(orders, contexts), _DAYS)


_FILTERS = M.Filters(dt.date(1996, 6, 1), dt.date(1997, 3, 31), ("NATION_3", "NATION_7"))


def metrics_filtered_orders(spark, path):
    names = ("gmv", "all_orders", "late_rate")
    orders = _metric_orders(spark, path, names, "purchase_date", "customer_state")
    return plain(M.metrics(_FILTERS.on_orders(orders), names=names))


def metrics_filtered_items(spark, path):
    columns = ["category", "customer_state", "order_status", "purchase_date", "price"]
    chosen = M.Filters(
        _FILTERS.date_from, _FILTERS.date_to, _FILTERS.states, ("brand_1", "Brand#2")
    )
    items = chosen.on_items(model(spark, path).items(columns, STAR_CONFIG))
    return plain(M.item_gmv(items, ["category"]))


def category_group_amount(spark, path):
    shared = model(spark, path)
    items = shared.items(["category", "order_status", "price"], STAR_CONFIG)
    groups = category_groups(items, shared.categories())
    # One row per category before the join with the group labels.
    return plain(
        M.item_gmv(items, ["category"])
        .join(groups, "category")
        .groupBy("category_group")
        .agg(F.sum("item_gmv").alias("item_gmv"))
    )


def _extract(table):
    return lambda spark, path: plain(extract_tables(model(spark, path), STAR_CONFIG)[table])


# --- reports -----------------------------------------------------------------------


def sensitivity_totals(spark, path):
    strata = ANALYSES["q08_stratified_review_sensitivity"](model(spark, path), STAR_CONFIG)
    return plain(sensitivity_summary(strata, STAR_CONFIG.min_group_orders))


def overview_row(spark, path):
    questions = with_cells(model(spark, path), STAR_CONFIG)
    results = {name: questions[name]() for name in questions if name[:3] in ("q01", "q02", "q04", "q05", "q06", "q10")}
    return plain(overview(results), ("median_delivery_days", "p90_delivery_days"))


def partial_cohort_rows(spark, path):
    cohorts = ANALYSES["q10_repeat_cohort_30d"](model(spark, path), STAR_CONFIG)
    return plain(partial_cohorts(cohorts))


def data_profile_rows(spark, path):
    raw = star_text_tables(spark, path)
    return plain(row_profile(raw, stage_all(raw)))


def data_profile_months(spark, path):
    return plain(purchase_profile(star_tables(spark, path)))


# --- single operators --------------------------------------------------------------


def month_spine_counts(spark, path):
    """Months of the first half of 1995 to 2003; months after the data stay with zero."""
    orders = read_star(spark, path, "orders")
    counts = orders.groupBy(month_of(F.col("o_orderdate")).alias("month")).agg(
        F.count(F.lit(1)).alias("orders")
    )
    spine = month_spine(spark, dt.date(1995, 1, 15), dt.date(2003, 6, 1), "month")
    return plain(fill_spine(spine, counts, ["month"], ["orders"]))


def guarded_sum_by_customer(spark, path):
    """Canceled orders count as unknown amounts, so their customers have no total."""
    amount = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice").cast("decimal(18,2)"))
    orders = read_star(spark, path, "orders").select("o_custkey", amount.alias("amount"))
    return plain(
        orders.groupBy("o_custkey").agg(
            guarded_sum(F.col("amount")).alias("complete_amount"),
            F.count("amount").alias("known_rows"),
        )
    )


def safe_ratio_by_brand(spark, path):
    lines = read_star(spark, path, "lineitem")
    parts = read_star(spark, path, "part").select("p_partkey", "p_brand")
    per_part = lines.groupBy("l_partkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("returned"),
        F.count_if(F.col("l_returnflag") == "X").alias("unused"),
        F.count(F.lit(1)).alias("lines"),
    )
    brands = (
        per_part.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("p_brand")
        .agg(*[F.sum(name).alias(name) for name in ("returned", "unused", "lines")])
    )
    return brands.withColumns(
        {
            "returned_share": safe_ratio(F.col("returned"), F.col("lines")),
            "undefined_share": safe_ratio(F.col("returned"), F.col("unused")),
        }
    )


def window_filter_counts(spark, path):
    orders = read_star(spark, path, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    kept = window_filter(orders, "day", STAR_CONFIG.analysis_start, STAR_CONFIG.analysis_end)
    return kept.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("orders"), F.min("day").cast("string").alias("first_day"),
        F.max("day").cast("string").alias("last_day"),
    )


def observation_cutoff(spark, path):
    events = read_star(spark, path, "events")
    kept = observed_until(events, "ts", "user_id", EVENT_CUTOFF)
    return kept.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.countDistinct("user_id").alias("users")
    )


def latest_line_per_order(spark, path):
    lines = read_star(spark, path, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice"
    )
    order = [
        F.col("l_shipdate").desc_nulls_last(),
        F.col("l_linenumber").asc_nulls_last(),
        F.col("l_partkey").asc_nulls_last(),
        F.col("l_extendedprice").asc_nulls_last(),
    ]
    return plain(latest_row(lines, ["l_orderkey"], order))


def star_enrich_totals(spark, path):
    lines = read_star(spark, path, "lineitem").select(
        "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("price")
    )
    slim = lines.groupBy("l_partkey", "l_suppkey").agg(
        F.sum("price").alias("price"), F.count(F.lit(1)).alias("lines")
    )
    wide = star_enrich(
        slim,
        [
            Lookup(read_star(spark, path, "part"), "l_partkey", "p_partkey", ("p_brand",)),
            Lookup(read_star(spark, path, "supplier"), "l_suppkey", "s_suppkey", ("s_nationkey",)),
            Lookup(read_star(spark, path, "nation"), "s_nationkey", "n_nationkey", ("n_name",)),
        ],
        ("p_brand", "n_name"),
    )
    return plain(
        wide.groupBy("p_brand", "n_name").agg(
            F.sum("price").alias("price"), F.sum("lines").alias("lines")
        )
    )


def decomposition_by_month(spark, path):
    orders = read_star(spark, path, "orders")
    periods = (
        orders.groupBy(month_of(F.col("o_orderdate")).alias("month"))
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("amount"),
        )
        .withColumn("average", safe_ratio(F.col("amount"), F.col("orders")))
    )
    names = {
        "previous_amount": "previous_amount",
        "previous_count": "previous_orders",
        "previous_average": "previous_average",
        "rate": "change_rate",
        "count_part": "order_part",
        "average_part": "average_part",
        "residual": "residual",
    }
    return plain(
        sequential_decomposition(periods, "month", "orders", "amount", "average", "change", names)
    )


def _brand_lines(spark, path):
    """Line amounts per brand and order, reduced before the lookup join."""
    lines = read_star(spark, path, "lineitem")
    parts = read_star(spark, path, "part").select("p_partkey", "p_brand")
    return lines.select(
        "l_partkey", "l_orderkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("price")
    ).join(parts, F.col("l_partkey") == F.col("p_partkey"))


def top_n_other_brands(spark, path):
    return plain(top_n_other(_brand_lines(spark, path), "p_brand", "price", 10, "l_orderkey"))


def dense_grid_month_nation(spark, path):
    orders = read_star(spark, path, "orders").select(
        "o_custkey", month_of(F.col("o_orderdate")).alias("month")
    )
    customers = read_star(spark, path, "customer").select("c_custkey", "c_nationkey")
    nations = read_star(spark, path, "nation").select("n_nationkey", "n_name")
    cells = (
        orders.groupBy("o_custkey", "month")
        .agg(F.count(F.lit(1)).alias("orders"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", "month")
        .agg(F.sum("orders").alias("orders"))
        .withColumnRenamed("c_nationkey", "n_nationkey")
    )
    grid = dense_grid(nations, {"month": month_sequence(dt.date(1995, 1, 1), dt.date(2002, 12, 1))})
    filled = fill_spine(grid, cells, ["n_nationkey", "month"], ["orders"])
    return plain(filled.select("n_name", "month", "orders"))


def scoped_percentiles(spark, path):
    """Exact price quantiles of all lines, per ship month and per return flag."""
    cents = (F.col("l_extendedprice").cast("decimal(18,2)") * 100).cast("bigint")
    lines = read_star(spark, path, "lineitem").select(
        month_of(F.col("l_shipdate")).alias("month"), "l_returnflag", cents.alias("cents")
    )
    found = scoped_distribution(
        lines,
        {"ALL": [], "MONTH": ["month"], "FLAG": ["l_returnflag"]},
        F.col("cents"),
        {"p50": 0.5, "p90": 0.9},
    )
    return plain(found, ("p50", "p90"))


def threshold_rank_nations(spark, path):
    orders = read_star(spark, path, "orders")
    customers = read_star(spark, path, "customer").select("c_custkey", "c_nationkey")
    per_customer = orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("orders"), F.count_if(F.col("o_orderstatus") == "P").alias("hits")
    )
    nations = (
        per_customer.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey")
        .agg(F.sum("orders").alias("orders"), F.sum("hits").alias("hits"))
        .withColumn("share", safe_ratio(F.col("hits"), F.col("orders")))
    )
    mean = nations.select(F.sum("orders") / F.count(F.lit(1))).scalar()
    order = [
        F.col("share").desc_nulls_last(),
        F.col("hits").desc_nulls_last(),
        F.col("c_nationkey").asc_nulls_last(),
    ]
    return plain(threshold_rank(nations, F.col("orders") >= mean, order, "position"))


def share_of_region(spark, path):
    orders = read_star(spark, path, "orders").groupBy("o_custkey").agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("amount")
    )
    customers = read_star(spark, path, "customer").select("c_custkey", "c_nationkey")
    nations = read_star(spark, path, "nation").select("n_nationkey", "n_name", "n_regionkey")
    totals = (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey")
        .agg(F.sum("amount").alias("amount"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("n_name", "n_regionkey", "amount")
    )
    shared = contribution_share(totals, "amount", "share_of_all")
    return plain(contribution_share(shared, "amount", "share_of_region", "n_regionkey"))


def _line_flags(spark, path):
    """Lines with ship month and return flag; 'early' is unknown for the flag N."""
    return read_star(spark, path, "lineitem").select(
        month_of(F.col("l_shipdate")).alias("month"),
        "l_returnflag",
        F.when(F.col("l_returnflag") != "N", F.col("l_linestatus") == "F").alias("early"),
        (F.col("l_tax") > 0.04).alias("late"),
        (F.col("l_quantity") <= 20).alias("low"),
    )


def sample_expand_counts(spark, path):
    samples = {"all": F.lit(True), "without_early": is_not_true(F.col("early"))}
    rows = sample_expand(_line_flags(spark, path), samples)
    return rows.groupBy("sample", "l_returnflag").agg(
        F.count(F.lit(1)).alias("lines"), F.count("early").alias("known"),
        F.count_if("early").alias("early_lines"),
    )


def stratified_gap_lines(spark, path):
    samples = {"all": F.lit(True), "without_early": is_not_true(F.col("early"))}
    return plain(
        stratified_gap(
            _line_flags(spark, path),
            ["month", "l_returnflag"],
            F.col("late"),
            F.col("low"),
            samples,
            STAR_CONFIG.min_state_orders,
        )
    )


def _event_firsts(spark, path, with_totals=True):
    purchases = read_star(spark, path, "events").filter(F.col("event_type") == "purchase")
    kept = observed_until(purchases, "ts", "user_id", EVENT_CUTOFF)
    return first_and_next_event(
        kept, "user_id", "ts", "event_id", EVENT_HORIZON_DAYS, EVENT_CUTOFF, with_totals
    )


def event_sequence(spark, path):
    firsts = _event_firsts(spark, path)
    days = fractional_days(F.col("first_ts"), F.col("next_ts"))
    return plain(firsts.withColumn("days_to_next", days), ("days_to_next",))


def event_cohorts(spark, path):
    return plain(
        cohort_maturity(
            _event_firsts(spark, path, False),
            dt.date(2023, 12, 1),
            dt.date(2024, 2, 15),
            EVENT_CUTOFF,
            EVENT_HORIZON_DAYS,
        )
    )


def delivery_flags(spark, path):
    """Two-valued and three-valued flags side by side, counted by value."""
    orders = star_tables(spark, path, strict=True)["orders"]
    bought, arrived = F.col("order_purchase_timestamp"), F.col("order_delivered_customer_date")
    flags = orders.select(
        "order_status",
        is_true(arrived >= bought).alias("usable"),
        F.when(F.col("order_status") == "delivered", arrived > bought).alias("after"),
    )
    return flags.groupBy("order_status", "usable", "after").agg(F.count(F.lit(1)).alias("orders"))


def line_key_conflicts(spark, path):
    return plain(key_conflicts(read_star(spark, path, "lineitem"), ["l_orderkey", "l_linenumber"]))


def order_fk_orphans(spark, path):
    """Orders without any line, seen as children without a parent."""
    return plain(
        fk_orphans(
            read_star(spark, path, "orders"), "o_orderkey",
            read_star(spark, path, "lineitem"), "l_orderkey",
        )
    )


def line_duplicate_rows(spark, path):
    lines = read_star(spark, path, "lineitem").select("l_partkey", "l_quantity", "l_returnflag")
    return plain(duplicate_rows(lines))


def reconcile_months(spark, path):
    """Order totals against line totals per order month; they differ on purpose."""
    orders = read_star(spark, path, "orders").select(
        "o_orderkey",
        month_of(F.col("o_orderdate")).alias("month"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
    )
    lines = read_star(spark, path, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("amount")
    )
    left = orders.groupBy("month").agg(F.sum("amount").alias("amount"))
    right = (
        lines.join(orders.drop("amount"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("month")
        .agg(F.sum("amount").alias("amount"))
    )
    return plain(reconcile(left, right, ["month"], "amount", 1_000_000.0))


def overview_state_rows(spark, path):
    """The states to look at first, with all their figures."""
    return plain(top_states(_results(spark, path, "q04")["q04_state_investigation"]))


# --- files -------------------------------------------------------------------------


def _line_text(spark, path) -> DataFrame:
    """All lines as text, in the columns that the file queries write."""
    lines = read_star(spark, path, "lineitem")
    whole = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    cents = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return lines.select(
        *[F.col(name).cast("string").alias(name) for name in whole],
        *[F.col(name).cast("decimal(18,2)").cast("string").alias(name) for name in cents],
        "l_returnflag",
        "l_linestatus",
        F.col("l_shipdate").cast("string").alias("l_shipdate"),
    )


def lineitem_fingerprint(spark, path):
    """Row count and order-independent checksum of a table."""
    return table_fingerprint(_line_text(spark, path))


def source_manifest_rows(spark, path):
    """Rows, columns and checksum of every source table."""
    manifest = source_manifest(star_text_tables(spark, path))
    return plain(manifest.withColumn("columns", F.array_join("columns", ",")))


def csv_round_trip(spark, path):
    """Reviews with quotes, commas and line breaks in their messages, written as CSV and read back by byte ranges."""
    lines = read_star(spark, path, "lineitem")
    kind = F.col("l_linenumber") % 4
    message = (
        F.when(kind == 0, F.concat(F.lit("plain "), "l_returnflag"))
        .when(kind == 1, F.concat(F.lit("two\nlines, "), "l_returnflag"))
        .when(kind == 2, F.concat(F.lit('"'), "l_linestatus", F.lit('" first\r\n\n""last')))
    )
    rows = {
        "review_id": F.concat_ws("-", "l_partkey", "l_linenumber"),
        "order_id": F.col("l_orderkey").cast("string"),
        "review_score": F.col("l_quantity").cast("int").cast("string"),
        "review_comment_message": message,
    }
    written = [rows.get(name, F.lit(None).cast("string")).alias(name) for name in COLUMNS["reviews"]]
    folder = scratch_path(spark, "csv-round-trip")
    lines.select(*written).write.option("header", True).option("escape", '"').csv(folder)
    back = read_source(spark, "", "reviews", {"reviews": folder})
    return back.select(*rows)


def export_round_trip(spark, path):
    """All lines exported in a total order and read back: rows, amount and hash of every part, and the file's hash tree."""
    lines = _line_text(spark, path).select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    folder = scratch_path(spark, "export-round-trip")
    described = export_csv(lines, folder)
    back = read_export(spark, folder, lines.schema)
    found = back.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("price"))
    parts = spark.read.parquet(f"{folder}/parts").select(F.col("no").alias("part"), F.col("digest").alias("part_hash"))
    files = content_hashes(spark, [f"{folder}/data"])
    part_of = F.regexp_extract("file", "part=([0-9]+)/", 1).cast("bigint")
    files = files.select(part_of.alias("part"), F.col("root").alias("file_hash"))
    return plain(
        found.join(parts, "part").join(files, "part").withColumn("root", F.lit(described["hash"])).withColumn("all_rows", F.lit(described["rows"]))
    )


def delivery_days_of_orders(spark, path):
    """Fractional days between purchase and delivery, from exact microseconds."""
    columns = ["order_id", "delivery_micros", "delivery_days"]
    orders = model(spark, path, strict=True).orders(columns, STAR_CONFIG, "delivered")
    same = F.col("delivery_days") == days_from_micros(F.col("delivery_micros"))
    return orders.select("order_id", "delivery_days", same.alias("consistent"))


def registry() -> dict:
    entries = {name: _analysis(name) for name in ANALYSES}
    entries |= {f"staging_{table}": _staging(table) for table in COLUMNS}
    entries |= {
        "bi_extract_orders": _extract("fact_orders"),
        "bi_extract_items": _extract("fact_order_items"),
        "bi_extract_dates": _extract("dim_date"),
        "bi_extract_states": _extract("dim_customer_state"),
        "bi_extract_categories": _extract("dim_category"),
    }
    functions = [
        fact_orders, fact_order_items, dim_date, dim_customer_state, dim_category, latest_review,
        order_item_totals, order_payment_totals, staging_casts, staging_removes_copies,
        q01_strict_guarded_sum, q02_strict_undefined_parts, q04_strict_unknown_amounts,
        quality_staging, quality_staging_dirty, quality_models, quality_analyses, quality_analyses_broken, quality_summary, quality_report_rows,
        metrics_all, metrics_by_month, metrics_by_state, metrics_state_scatter,
        metrics_by_delay_group, metrics_days_by_state, metrics_contexts, metrics_filtered_orders,
        metrics_filtered_items, category_group_amount, sensitivity_totals, overview_row,
        partial_cohort_rows, data_profile_rows, data_profile_months, month_spine_counts,
        guarded_sum_by_customer, safe_ratio_by_brand, window_filter_counts, observation_cutoff,
        latest_line_per_order, star_enrich_totals, decomposition_by_month, top_n_other_brands,
        dense_grid_month_nation, scoped_percentiles, threshold_rank_nations, share_of_region,
        sample_expand_counts, stratified_gap_lines, event_sequence, event_cohorts, delivery_flags,
        line_key_conflicts, order_fk_orphans, line_duplicate_rows, reconcile_months,
        lineitem_fingerprint, delivery_days_of_orders, source_manifest_rows, csv_round_trip,
        export_round_trip, overview_state_rows,
    ]
    return entries | {function.__name__: function for function in functions}
