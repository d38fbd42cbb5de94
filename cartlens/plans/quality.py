"""Quality checks as one small DataFrame: check, value, severity, passed, note.

A check passes when its value is zero. A failed ``error`` blocks publishing. All
counters of a table come from one aggregate over that table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlens.config import AnalysisConfig
from cartlens.functions.casts import CENT_AMOUNT, PLAIN_DIGITS, blank_to_null
from cartlens.functions.time import covers_whole_month
from cartlens.operators.calendar import month_spine
from cartlens.operators.checks import duplicate_rows, fk_orphans, key_conflicts
from cartlens.plans.model import DELIVERED
from cartlens.plans.staging import COLUMNS, KEYS, TIME, raw_name

ERROR, WARNING = "error", "warning"
VALUE_TYPE = "decimal(38,2)"

# Allowed order states.
ORDER_STATUSES = (
    "created",
    "approved",
    "invoiced",
    "processing",
    "shipped",
    "delivered",
    "unavailable",
    "canceled",
)
# Amount, integer-key and foreign-key columns under check.
AMOUNTS = {"items": ["price", "freight_value"], "payments": ["payment_value"]}
INTEGER_KEYS = {"items": ["order_item_id"], "payments": ["payment_sequential"]}
FOREIGN_KEYS = [
    ("orders", "customer_id", "customers"),
    ("items", "order_id", "orders"),
    ("items", "product_id", "products"),
    ("payments", "order_id", "orders"),
    ("reviews", "order_id", "orders"),
]


class QualityError(RuntimeError):
    """At least one blocking check failed; `checks` are their names."""

    def __init__(self, message: str, checks: list[str] = ()):
        super().__init__(message)
        self.checks = list(checks)


@dataclass(frozen=True)
class Check:
    name: str
    value: Column
    severity: str = ERROR
    note: str = ""


def _records(one_row: DataFrame, checks: list[Check]) -> DataFrame:
    """Turn the columns of a one-row relation into check records."""
    rows = [
        F.struct(
            F.lit(check.name).alias("check"),
            check.value.cast(VALUE_TYPE).alias("value"),
            F.lit(check.severity).alias("severity"),
            F.lit(check.note).alias("note"),
        )
        for check in checks
    ]
    exploded = one_row.select(F.explode(F.array(*rows)).alias("_check")).select("_check.*")
    passed = F.coalesce(F.col("value") == 0, F.lit(False))
    return exploded.select("check", "value", "severity", passed.alias("passed"), "note")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _not_full_match(column: str, pattern: str) -> Column:
    return ~F.trim(F.col(raw_name(column))).rlike(pattern)


def _row_checks(table: str) -> list[tuple[str, Column, str, str]]:
    """Row conditions of one staging table: name, violation, severity, note."""
    rules = [
        (
            f"{table}.missing_key",
            reduce(lambda a, b: a | b, [F.col(key).isNull() for key in KEYS[table]]),
            ERROR,
            "",
        )
    ]
    for column in AMOUNTS.get(table, []):
        value = F.col(column)
        broken = value.isNull() | (value < 0) | _not_full_match(column, CENT_AMOUNT)
        note = "Amounts must be zero or more, with two decimals at most."
        rules.append((f"{table}.{column}.invalid_amount", broken, ERROR, note))
    for column in INTEGER_KEYS.get(table, []):
        value = F.col(column)
        broken = value.isNull() | (value <= 0) | _not_full_match(column, PLAIN_DIGITS)
        rules.append((f"{table}.{column}.invalid_key", broken, ERROR, ""))
    if table == "orders":
        status = F.col("order_status")
        rules += [
            (
                "orders.invalid_purchase_timestamp",
                F.col("order_purchase_timestamp").isNull(),
                ERROR,
                "",
            ),
            ("orders.invalid_status", status.isNull() | ~status.isin(*ORDER_STATUSES), ERROR, ""),
        ]
    if table == "customers":
        missing = F.col("customer_unique_id").isNull()
        rules.append(("customers.missing_unique_identifier", missing, ERROR, ""))
    if table == "reviews":
        score = F.col("review_score")
        broken = score.isNull() | ~score.between(1, 5)
        rules.append(("reviews.invalid_score", broken, WARNING, "Left out of every rating ratio."))
    if table == "products":
        missing = F.col("product_category_name").isNull()
        rules.append(("products.missing_category", missing, WARNING, "Counted under UNKNOWN."))
    for column, kind in COLUMNS[table].items():
        if kind == TIME and column != "order_purchase_timestamp":
            unread = F.col(column).isNull() & blank_to_null(F.col(raw_name(column))).isNotNull()
            rules.append((f"{table}.{column}.invalid_timestamp", unread, WARNING, ""))
    return rules


def _table_checks(
    table: str, raw: DataFrame, staged: DataFrame, raw_rows: int | None
) -> DataFrame:
    """Key conflicts, row rules and exact duplicates of one table in one aggregate.

    Grouping by the key gives the conflicts; the row counters ride along as partial
    sums. Staging holds each distinct source row once, so with no extra source
    columns the duplicates are the difference of two row counts. A known source row
    count saves another read of the source.
    """
    rules = _row_checks(table)
    broken = [F.count_if(rule).alias(f"_c{i}") for i, (_, rule, _, _) in enumerate(rules)]
    per_key = staged.groupBy(*KEYS[table]).agg(F.count(F.lit(1)).alias("_n"), *broken)
    one = per_key.agg(
        F.count_if(F.col("_n") > 1).alias("_conflicts"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("_rows"),
        *[F.coalesce(F.sum(f"_c{i}"), F.lit(0)).alias(f"_c{i}") for i in range(len(rules))],
    )
    if set(raw.columns) == set(COLUMNS[table]):
        loaded = raw.select(F.count(F.lit(1))).scalar() if raw_rows is None else F.lit(raw_rows)
        copies = loaded - F.col("_rows")
    else:
        copies = duplicate_rows(raw).scalar()
    one = one.withColumn("_copies", copies)
    checks = [Check(f"{table}.key_conflicts", F.col("_conflicts"))]
    checks += [
        Check(name, F.col(f"_c{i}"), severity, note)
        for i, (name, _, severity, note) in enumerate(rules)
    ]
    note = "Exact copies are removed on load; conflicting keys are kept."
    checks.append(Check(f"{table}.exact_duplicate_rows", F.col("_copies"), WARNING, note))
    return _records(one, checks)


def staging_checks(
    raw: dict[str, DataFrame],
    staged: dict[str, DataFrame],
    raw_rows: dict[str, int] | None = None,
) -> DataFrame:
    """The 45 checks on the source and staging tables."""
    known = raw_rows or {}
    frames = [
        _table_checks(table, raw[table], staged[table], known.get(table)) for table in COLUMNS
    ]
    for child, key, parent in FOREIGN_KEYS:
        orphans = fk_orphans(staged[child], key, staged[parent], key)
        frames.append(_records(orphans, [Check(f"{child}.{key}.unmatched", F.col("orphans"))]))
    category = "product_category_name"
    named = staged["products"].filter(F.col(category).isNotNull())
    untranslated = fk_orphans(named, category, staged["category_translation"], category)
    frames.append(
        _records(
            untranslated,
            [
                Check(
                    "products.untranslated_category",
                    F.col("orphans"),
                    WARNING,
                    "The original category name is kept.",
                )
            ],
        )
    )
    # Differing scores among candidates that the selection order cannot separate.
    ties = (
        staged["reviews"]
        .groupBy("order_id", "review_answer_timestamp", "review_creation_date", "review_id")
        .agg(F.min("review_score").alias("_low"), F.max("review_score").alias("_high"))
        .agg(F.count_if(F.col("_low") < F.col("_high")).alias("ambiguous"))
    )
    frames.append(_records(ties, [Check("reviews.ambiguous_selection", F.col("ambiguous"))]))
    return _union(frames)


def _total(amount: str, condition: Column | None = None) -> Column:
    chosen = F.col(amount) if condition is None else F.when(condition, F.col(amount))
    return F.coalesce(F.sum(chosen), F.lit(0).cast(VALUE_TYPE))


def model_checks(staged: dict[str, DataFrame], model) -> DataFrame:
    """The 17 checks on the facts, from one pass per fact."""
    delivered = F.col("order_status") == DELIVERED
    paid, goods, freight = (
        F.col(name) for name in ("payment_value", "merchandise_value", "freight_value")
    )
    both = F.col("delivery_eligible") & F.col("review_eligible")
    gap = paid - goods - freight
    rules = {
        "no_goods": delivered & ((F.col("item_count") == 0) | goods.isNull()),
        "bad_flag": F.col("is_late").isNotNull() & ~F.col("delivery_eligible"),
        "no_delivery": delivered & ~F.col("delivery_eligible"),
        "bad_sequence": delivered & (F.col("delivered_timestamp") < F.col("purchase_timestamp")),
        "no_payment": delivered & paid.isNull(),
        "gap": paid != goods + freight,
        "gap_cent": F.abs(gap) > F.lit("0.01").cast("decimal(18,2)"),
        "no_review": delivered & ~F.col("review_eligible"),
        "early": both & F.col("review_before_delivery"),
    }
    orders = (
        model.orders()
        .groupBy("order_id")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum("merchandise_value").alias("_goods"),
            F.sum(F.when(delivered, goods)).alias("_delivered"),
            *[F.count_if(rule).alias(name) for name, rule in rules.items()],
        )
        .agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("order_rows"),
            F.count("order_id").alias("order_keys"),
            _total("_goods").alias("order_goods"),
            _total("_delivered").alias("order_delivered"),
            *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in rules],
        )
    )
    items = (
        model.items(["order_id", "order_item_id", "order_status", "price"])
        # one key of both columns: a grouping by the order's own partitioning would keep all lines
        # of a hot order in one task, and its join could not be split
        .groupBy(F.struct("order_id", "order_item_id").alias("_key"))
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum("price").alias("_goods"),
            F.sum(F.when(delivered, F.col("price"))).alias("_delivered"),
        )
        .agg(
            F.struct(
                F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
                F.count(F.lit(1)).alias("keys"),
                _total("_goods").alias("goods"),
                _total("_delivered").alias("delivered"),
            )
        )
        .scalar()
    )
    source_items = (
        staged["items"]
        .agg(F.struct(F.count(F.lit(1)).alias("rows"), _total("price").alias("goods")))
        .scalar()
    )
    source_orders = staged["orders"].select(F.count(F.lit(1))).scalar()
    several = key_conflicts(staged["reviews"], ["order_id"]).select(F.count(F.lit(1))).scalar()
    one = orders.withColumns(
        {
            "items": items,
            "source_items": source_items,
            "source_orders": source_orders,
            "several_reviews": several,
        }
    )
    col = F.col
    return _records(
        one,
        [
            Check("fact_orders.row_count", col("order_rows") - col("source_orders")),
            Check("fact_orders.key_unique", col("order_rows") - col("order_keys")),
            Check("fact_order_items.row_count", col("items.rows") - col("source_items.rows")),
            Check("fact_order_items.key_unique", col("items.rows") - col("items.keys")),
            Check("delivered.merchandise_missing", col("no_goods")),
            Check("merchandise.items_to_orders", col("source_items.goods") - col("order_goods")),
            Check(
                "merchandise.items_to_enriched_items",
                col("source_items.goods") - col("items.goods"),
            ),
            Check("merchandise.delivered_grain", col("items.delivered") - col("order_delivered")),
            Check("delivery.invalid_flag", col("bad_flag")),
            Check("delivery.missing_or_invalid", col("no_delivery"), WARNING),
            Check("delivery.invalid_sequence", col("bad_sequence"), WARNING),
            Check("delivered.missing_payment", col("no_payment"), WARNING),
            Check("payment.reconciliation_difference", col("gap"), WARNING),
            Check("payment.reconciliation_difference_gt_cent", col("gap_cent"), WARNING),
            Check("reviews.multiple_orders", col("several_reviews"), WARNING),
            Check("reviews.missing_or_invalid", col("no_review"), WARNING),
            Check("reviews.before_delivery", col("early"), WARNING),
        ],
    )


# Columns of the first three results that the reconciliation reads.
_RESULT_COLUMNS = {
    "q01": {
        "purchase_month": "date",
        "merchandise_value": VALUE_TYPE,
        "complete_calendar_month": "boolean",
    },
    "q02": {
        "merchandise_change": VALUE_TYPE,
        "average_order_value": "double",
        "previous_average_order_value": "double",
        "order_count_contribution": "double",
        "average_order_value_contribution": "double",
    },
    "q03": {"period": "string", "purchase_month": "date", "merchandise_value": VALUE_TYPE},
}


def _strict_total(amount: Column) -> Column:
    """Sum that a single NULL cell turns into NULL; no rows give zero."""
    holes = F.count_if(amount.isNull()) > 0
    return F.when(~holes, F.coalesce(F.sum(amount), F.lit(0).cast(VALUE_TYPE)))


def analysis_checks(results: dict[str, DataFrame], model, config: AnalysisConfig) -> DataFrame:
    """The 10 checks that reconcile finished results with independent fact totals."""
    spark = model.spark
    found, counts = {}, []
    for query, columns in _RESULT_COLUMNS.items():
        named = [df for name, df in results.items() if name.startswith(query + "_")]
        counts.append(Check(f"analysis.{query}.result_count", F.lit(abs(len(named) - 1))))
        if len(named) == 1:
            found[query] = named[0].select(*columns)
        else:
            found[query] = spark.range(0).select(
                *[F.lit(None).cast(kind).alias(name) for name, kind in columns.items()]
            )

    month, amount = F.col("purchase_month"), F.col("merchandise_value")
    start, end = config.analysis_start, config.analysis_end
    facts = model.orders(["purchase_month", "merchandise_value"], config, DELIVERED)
    by_month = facts.groupBy("purchase_month").agg(F.sum(amount).alias("_sum"))
    expected = (
        month_spine(spark, start, end)
        .join(by_month, "purchase_month", "left")
        .select(
            month.alias("_month"),
            F.coalesce(F.col("_sum"), F.lit(0)).cast(VALUE_TYPE).alias("_expected"),
            covers_whole_month(month, start, end).alias("_complete"),
        )
    )
    expected_total = expected.select(F.sum("_expected")).scalar()
    window_rows = found["q03"].filter(F.col("period") == "WINDOW")
    month_rows = found["q03"].filter(F.col("period") == "MONTH")

    def window_gap(rows):
        return F.abs(rows.select(_strict_total(amount)).scalar() - expected_total)

    def month_gaps(rows, when_absent):
        actual = rows.groupBy(month).agg(
            _strict_total(amount).alias("_actual"), F.lit(True).alias("_present")
        )
        both = expected.join(actual, F.col("_month").eqNullSafe(month), "full_outer")
        value = F.when(F.col("_present"), F.col("_actual")).otherwise(when_absent)
        return both.select(F.count_if(~value.eqNullSafe(F.col("_expected")))).scalar()

    unique = found["q01"].groupBy(month).agg(F.count(F.lit(1)).alias("_n"))
    repeated = unique.select(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0))).scalar()
    flags = found["q01"].join(expected, month == F.col("_month"), "left")
    wrong_flag = F.col("_month").isNull() | ~F.col("complete_calendar_month").eqNullSafe(
        F.col("_complete")
    )
    parts = [
        F.col(name).cast("double")
        for name in (
            "merchandise_change",
            "order_count_contribution",
            "average_order_value_contribution",
        )
    ]
    defined = F.col("average_order_value").isNotNull() & F.col(
        "previous_average_order_value"
    ).isNotNull()
    residual = F.bround(parts[0] - parts[1] - parts[2], 6)
    bad_residual = defined & F.coalesce(F.abs(residual) > 0.01, F.lit(True))
    no_amount = F.lit(None).cast(VALUE_TYPE)
    one = spark.range(1).select(
        window_gap(found["q01"]).alias("window1"),
        window_gap(window_rows).alias("window3"),
        month_gaps(found["q01"], no_amount).alias("months1"),
        month_gaps(month_rows, F.lit(0).cast(VALUE_TYPE)).alias("months3"),
        repeated.alias("repeated"),
        flags.select(F.count_if(wrong_flag)).scalar().alias("flags"),
        found["q02"].select(F.count_if(bad_residual)).scalar().alias("residuals"),
    )
    return _records(
        one,
        [
            *counts,
            Check("analysis.q01.window_merchandise", F.col("window1")),
            Check("analysis.q03.window_merchandise", F.col("window3")),
            Check("analysis.q01.month_merchandise", F.col("months1")),
            Check("analysis.q01.month_unique", F.col("repeated")),
            Check("analysis.q03.month_merchandise", F.col("months3")),
            Check(
                "analysis.q01.month_boundary_flags",
                F.col("flags"),
                note="Partial months are allowed when they are labelled as partial.",
            ),
            Check(
                "analysis.q02.decomposition_residual",
                F.col("residuals"),
                note="Recomputed from the parts; months without an average are skipped.",
            ),
        ],
    )


def summarize(checks: DataFrame) -> DataFrame:
    """Overall status, blocking failures and non-zero warnings."""
    failed = ~F.col("passed")
    one = checks.agg(
        F.count_if(failed & (F.col("severity") == ERROR)).alias("blocking_failures"),
        F.count_if(failed & (F.col("severity") == WARNING)).alias("warnings"),
        F.count(F.lit(1)).alias("checks"),
    )
    status = F.when(F.col("blocking_failures") > 0, "failed").otherwise("passed")
    return one.select(status.alias("status"), "blocking_failures", "warnings", "checks")


def require_passed(checks: DataFrame) -> None:
    """Raise when a blocking check failed. At most 72 short rows reach the driver."""
    blocking = checks.filter(~F.col("passed") & (F.col("severity") == ERROR))
    names = [row["check"] for row in blocking.select("check").collect()]
    if names:
        raise QualityError("blocking quality checks failed: " + ", ".join(names), names)


def quality_report(checks: DataFrame) -> DataFrame:
    """Non-zero warnings first, then every check."""
    warnings = checks.filter((F.col("severity") == WARNING) & ~F.col("passed"))
    sections = warnings.select(F.lit("warnings").alias("section"), *checks.columns)
    everything = checks.select(F.lit("all").alias("section"), *checks.columns)
    return sections.unionByName(everything).orderBy(F.col("section").desc(), "check")
