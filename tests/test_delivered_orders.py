"""Queries over delivered orders count every order that the source calls delivered, also those without lines."""

import duckdb
import pytest

from verification.star_queries import registry

DIRECTORY = "/root/testdata/sf0.01"
DELIVERED = f"SELECT o.* FROM '{DIRECTORY}/orders.parquet' o WHERE o_orderstatus = 'F'"
WINDOW = f"SELECT count(*) FROM ({DELIVERED}) WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-02-01' AND DATE '1997-07-31'"
EMPTY = f"SELECT count(*) FROM ({DELIVERED}) WHERE o_orderkey NOT IN (SELECT l_orderkey FROM '{DIRECTORY}/lineitem.parquet')"

FIRSTS = f"""
SELECT sum(12 * year(first) + month(first)) FROM (SELECT min(o_orderdate) AS first FROM ({DELIVERED}) WHERE o_orderdate <= TIMESTAMP '1997-07-31 23:59:59' GROUP BY o_custkey)
WHERE CAST(first AS DATE) BETWEEN DATE '1996-02-01' AND DATE '1997-07-31'"""

MONTHS = f"""
SELECT count(DISTINCT month(o_orderdate) + 12 * year(o_orderdate)) FROM ({DELIVERED})
WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-02-01' AND DATE '1997-07-31'
  AND o_orderkey NOT IN (SELECT l_orderkey FROM '{DIRECTORY}/lineitem.parquet')"""


def _total(column):
    return lambda rows: sum(row[column] for row in rows)


def _months_of_cohorts(rows):
    return sum(row["total_customers"] * (12 * int(row["cohort_month"][:4]) + int(row["cohort_month"][5:7])) for row in rows)


def _covered(rows):
    return sum(row["duration_orders"] / row["duration_coverage"] for row in rows if row["duration_coverage"])


def _delivered(rows):
    return sum(row["orders"] for row in rows if row["order_status"] == "delivered")


def _check(name):
    return lambda rows: next(row["value"] for row in rows if row["check"] == name)


# query: its figure, and that of the source
FIGURES = {
    "q02_monthly_change_decomposition": (_total("delivered_orders"), WINDOW),
    "q04_state_investigation": (_total("delivered_orders"), WINDOW),
    "q06_month_state_delivery": (_total("delivered_orders"), WINDOW),
    "q10_repeat_cohort_30d": (_months_of_cohorts, FIRSTS),
    "quality_models": (_check("delivered.merchandise_missing"), EMPTY),
    "quality_analyses": (_check("analysis.q01.month_merchandise"), MONTHS),
    "quality_report_rows": (_check("delivered.merchandise_missing"), EMPTY),
    "metrics_days_by_state": (_covered, WINDOW),
    "delivery_flags": (_delivered, f"SELECT count(*) FROM ({DELIVERED})"),
    "delivery_days_of_orders": (len, WINDOW),
}


def _source(sql):
    return duckdb.connect().execute(sql).fetchone()[0]


@pytest.mark.parametrize("name", FIGURES)
def test_delivered_orders_without_lines_stay(spark, name):
    figure, source = FIGURES[name]
    assert _source(EMPTY) > 0
    assert figure(registry()[name](spark, DIRECTORY).collect()) == pytest.approx(_source(source))


def test_summary_counts_the_checks_on_all_delivered_orders(spark):
    checks = registry()["quality_models"](spark, DIRECTORY).collect()
    assert any(check["check"] == "delivered.merchandise_missing" and not check["passed"] for check in checks)
    failed = sum(check["severity"] == "error" and not check["passed"] for check in checks)
    assert registry()["quality_summary"](spark, DIRECTORY).first()["blocking_failures"] == failed
