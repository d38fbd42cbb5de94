"""Plan shapes that must hold at scale."""

import os
import re

import pytest

import __spark_entry__ as entry_module
from cartlens.operators.enrich import Lookup, star_enrich
from cartlens.plans.analyses import ANALYSES
from cartlens.plans.model import StoredModel
from cartlens.plans.publish import build_model
from sample import CONFIG, build, tidy

DIRECTORY = "/root/testdata/sf0.001"
QUERIES = entry_module.queries()

needs_star = pytest.mark.skipif(not os.path.isdir(DIRECTORY), reason="star tables are absent")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@needs_star
@pytest.mark.parametrize("name", ["latest_review", "latest_line_per_order", "q09_customer_observed_sequence", "event_sequence"])
def test_rank_filters_are_applied_before_the_shuffle(spark, name):
    text = plan(QUERIES[name](spark, DIRECTORY))
    assert re.search(r"WindowGroupLimit .*Partial", text)


@needs_star
def test_hot_customers_are_merged_once(spark):
    df = QUERIES["q09_customer_observed_sequence"](spark, DIRECTORY)
    df.collect()
    final = plan(df).split("Initial Plan")[0]
    assert final.count("ReusedExchange") >= 1
    assert len(re.findall(r"FileScan parquet \[o_", final)) == 1


@needs_star
def test_only_needed_children_are_joined(spark):
    text = plan(QUERIES["q01_monthly_commerce"](spark, DIRECTORY))
    assert "o_totalprice" not in text and "c_custkey" not in text and "l_linestatus" not in text


def test_stored_facts_are_pruned_by_month_and_column(spark, tmp_path):
    model = build_model(build(spark, tidy()).staged, CONFIG, str(tmp_path / "model"))
    assert isinstance(model, StoredModel)
    text = plan(ANALYSES["q01_monthly_commerce"](model, CONFIG))
    assert re.search(r"PartitionFilters: \[[^]]*purchase_month", text)
    assert re.search(r"PushedFilters: \[[^]]*purchase_date", text)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert set(re.findall(r"(\w+):", schema)) == {"order_status", "purchase_date", "merchandise_value"}


def test_stored_model_gives_the_same_answers(spark, tmp_path):
    lazy = build(spark, tidy())
    model = build_model(lazy.staged, CONFIG, str(tmp_path / "model"))
    for name, question in ANALYSES.items():
        left, right = question(lazy, CONFIG), question(model, CONFIG)
        assert left.dtypes == right.dtypes, name
        assert sorted(left.collect(), key=str) == sorted(right.collect(), key=str), name


def test_skewed_join_keys_are_split(spark):
    """A key with a third of the rows is divided over several tasks."""
    lowered = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {name: spark.conf.get(name) for name in lowered}
    try:
        for name, value in lowered.items():
            spark.conf.set(name, value)
        lines = spark.range(0, 60_000, 1, 12).selectExpr(
            "if(id % 3 = 0, -1, id) AS part", "cast(id AS decimal(18,2)) AS price", "uuid() AS pad"
        )
        parts = spark.range(-1, 60_000, 1, 4).selectExpr("id AS part_id", "concat('b', id % 7) AS brand")
        wide = star_enrich(lines, [Lookup(parts, "part", "part_id", ("brand",))], ("brand",))
        assert len(wide.collect()) == 60_000
        final = wide._jdf.queryExecution().executedPlan().executedPlan().toString()
        assert "skew=true" in final
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
