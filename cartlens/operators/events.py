"""First and next events per entity, and cohorts of first events with a maturity rule."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartlens.functions.measures import is_true, safe_ratio
from cartlens.functions.time import day_of, month_of, ntz_literal, plus_days
from cartlens.operators.calendar import fill_spine, month_spine


def merge_simultaneous(df: DataFrame, entity: str, ts: str, event_id: str) -> DataFrame:
    """One row per entity and instant: smallest id and number of merged rows."""
    return df.groupBy(entity, ts).agg(
        F.min(event_id).alias("event_id"), F.count(F.lit(1)).alias("event_rows")
    )


def first_and_next_event(
    df: DataFrame,
    entity: str,
    ts: str,
    event_id: str,
    horizon_days: int,
    cutoff: dt.datetime,
    with_totals: bool = True,
) -> DataFrame:
    """First event per entity, the next strictly later one, and the repeat flag.

    ``with_totals`` adds the id of the first event and the number of all events.

    Equal instants are merged first. The rank filter keeps two rows per entity and
    task before the shuffle, and the total is a partial aggregate, so an entity
    with a large part of all events costs no more than any other. Both sides end
    up hash-partitioned by the entity and join without another shuffle. Both also
    read the same columns of the merged events, so Spark computes those once and
    reuses the exchange.
    """
    events = merge_simultaneous(df, entity, ts, event_id)
    ordered = Window.partitionBy(entity).orderBy(ts)
    leading = events.withColumn("_rank", F.row_number().over(ordered)).filter("_rank <= 2")
    pairs = leading.withColumns(
        {"next_ts": F.lead(ts).over(ordered), "next_id": F.lead("event_id").over(ordered)}
    ).filter("_rank = 1")
    limit = plus_days(F.col(ts), horizon_days)
    firsts = pairs.select(
        entity,
        F.col(ts).alias("first_ts"),
        (F.col("event_rows") - 1).alias("simultaneous_rows"),
        "next_id",
        "next_ts",
        (limit <= ntz_literal(cutoff)).alias("has_full_horizon"),
        is_true((F.col("next_ts") > F.col(ts)) & (F.col("next_ts") <= limit)).alias("repeated"),
    )
    if not with_totals:
        return firsts
    totals = events.groupBy(entity).agg(
        F.min_by("event_id", ts).alias("first_id"), F.sum("event_rows").alias("total_rows")
    )
    return firsts.join(totals, entity)


def cohort_maturity(
    firsts: DataFrame,
    start: dt.date,
    end: dt.date,
    cutoff: dt.datetime,
    horizon_days: int,
) -> DataFrame:
    """Monthly cohorts of first events, with immature members kept out of the ratio.

    ``firsts`` comes from the full history; only afterwards are the first events
    restricted to the window.
    """
    month = "cohort_month"
    members = firsts.filter(day_of(F.col("first_ts")).between(F.lit(start), F.lit(end)))
    mature, repeated = F.col("has_full_horizon"), F.col("repeated")
    grouped = members.groupBy(month_of(F.col("first_ts")).alias(month)).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(mature).alias("eligible"),
        F.count_if(~mature).alias("immature"),
        F.count_if(mature & repeated).alias("repeats"),
        F.count_if(F.col("simultaneous_rows") > 0).alias("with_simultaneous"),
        F.sum("simultaneous_rows").alias("simultaneous"),
    )
    counters = [
        "total", "eligible", "immature", "repeats", "with_simultaneous", "simultaneous",
    ]
    spine = month_spine(firsts.sparkSession, start, end, month)
    total, eligible = F.col("total"), F.col("eligible")
    next_month = F.add_months(F.col(month), 1).cast("timestamp_ntz")
    complete_at = plus_days(next_month, horizon_days) - F.expr("interval '0.000001' second")
    return fill_spine(spine, grouped, [month], counters).withColumns(
        {
            "repeat_share": safe_ratio(F.col("repeats"), eligible),
            "coverage": safe_ratio(eligible, total),
            "maturity_status": F.when(total == 0, "EMPTY")
            .when(eligible == total, "ALL_OBSERVED_CUSTOMERS_MATURE")
            .when(eligible == 0, "IMMATURE")
            .otherwise("PARTIALLY_MATURE"),
            "fully_observed": complete_at <= ntz_literal(cutoff),
            "observation_end": ntz_literal(cutoff),
        }
    )
