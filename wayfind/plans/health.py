"""Pipeline health: intake, lag, eligibility, gate, reconcile age and table depth in one report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.functions.scoring import seconds_between
from wayfind.sources.events import lag_histogram

STALE_S = 48 * 3600


def table_depth(tables: dict[str, DataFrame]) -> DataFrame:
    """table, rows."""
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in sorted(tables.items())]
    return reduce(DataFrame.unionByName, counts)


def reconcile_age(inbox: DataFrame, as_of: Column) -> DataFrame:
    """age_s since the last end of a reconcile run (inbox: type, received_at), -1 if there was none; stale."""
    age = inbox.filter("type = 'reconcile.end'").agg(F.max("received_at").alias("last")).select(F.coalesce(seconds_between(as_of, "last"), F.lit(-1.0)).alias("age_s"))
    return age.withColumn("stale", (F.col("age_s") < 0) | (F.col("age_s") > STALE_S))


def pipeline_health(docs: DataFrame, outcomes: DataFrame, lags: DataFrame, rejections: DataFrame, inbox: DataFrame, tables: dict[str, DataFrame], as_of: Column) -> DataFrame:
    """metric, label, value."""
    row = lambda df, metric, label, value: df.select(F.lit(metric).alias("metric"), label.cast("string").alias("label"), value.cast("double").alias("value"))
    parts = [
        row(docs.groupBy("eligible").agg(F.count(F.lit(1)).alias("n")), "documents", F.col("eligible"), F.col("n")),
        row(outcomes, "events", F.concat_ws("/", "type", "outcome"), F.col("n")),
        row(lag_histogram(lags), "event_lag", F.col("le"), F.col("n")),
        row(rejections, "gate_rejections", F.concat_ws("/", "domain", "reason"), F.col("n")),
        row(reconcile_age(inbox, as_of), "reconcile_age_s", F.col("stale"), F.col("age_s")),
        row(table_depth(tables), "table_rows", F.col("table"), F.col("rows")),
    ]
    return reduce(DataFrame.unionByName, parts)
