"""Streaming intake: envelopes to ledger, rollups folded batch by batch onto snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wayfind.functions.text import normalize
from wayfind.sources.events import decode, read_events, with_horizon


def ledger_rows(ok: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Ledger columns of decoded events, and the columns to keep; the query is normalised once, here, and the payload kept whole."""
    p = lambda c: F.col(f"p.{c}").alias(c)
    return ok.select(
        "event_id", "type", p("user_id"), p("session_id"), F.nullif(normalize(F.col("p.query")), F.lit("")).alias("normalized_query"), F.trim("p.query").alias("display_query"), p("video_id"), p("position"),
        p("position_seconds"), p("duration_seconds"), F.coalesce("p.allow_history", F.lit(False)).alias("allow_history"), "occurred_at", F.to_date("occurred_at").alias("day"), F.col("payload").alias("props"), *keep,
    )


def unique_events(spark: SparkSession, path: str, horizon: str = "7 days", ingested_at: Column | None = None) -> DataFrame:
    """The stream of decoded events, each id once within the horizon. Events that fail aren't remembered, so a corrected one passes.

    ingested_at is the time of events without one: the batch's own if not given.
    """
    ok, _ = decode(read_events(spark, path, streaming=True), F.current_timestamp() if ingested_at is None else ingested_at)
    return with_horizon(ledger_rows(ok), horizon).dropDuplicatesWithinWatermark(["event_id"])


def run_intake(spark: SparkSession, path: str, ledger: str, checkpoint: str, horizon: str = "7 days", ingested_at: Column | None = None) -> StreamingQuery:
    """Appends the stream to a ledger partitioned by day, so retention and range scans prune files."""
    rows = unique_events(spark, path, horizon, ingested_at)
    return rows.writeStream.partitionBy("day").format("parquet").option("path", ledger).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_failures(spark: SparkSession, path: str, failures: str, checkpoint: str, ingested_at: Column | None = None) -> StreamingQuery:
    _, failed = decode(read_events(spark, path, streaming=True), F.current_timestamp() if ingested_at is None else ingested_at)
    return failed.writeStream.format("parquet").option("path", failures).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def run_fold(rows: DataFrame, empty: DataFrame, fold: Callable[[DataFrame, DataFrame], DataFrame], snapshots: str, checkpoint: str) -> StreamingQuery:
    """Folds each micro-batch onto the last snapshot: batch n reads snapshot n-1 and writes snapshot n, so a batch run again writes the same one. Snapshots before n-1 go."""
    spark = rows.sparkSession

    def each(batch: DataFrame, n: int) -> None:
        old = empty if n == 0 else spark.read.schema(empty.schema).parquet(f"{snapshots}/{n - 1}")
        fold(old, batch).select(*empty.columns).write.mode("overwrite").parquet(f"{snapshots}/{n}")
        if n >= 2:
            remove(spark, f"{snapshots}/{n - 2}")

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_totals(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """day, type, n per UTC day, for append output: a day comes once the watermark has passed it."""
    return events.withWatermark("occurred_at", watermark).groupBy(F.window("occurred_at", "1 day").alias("w"), "type").agg(F.count(F.lit(1)).alias("n")).select(F.to_date("w.start").alias("day"), "type", "n")
