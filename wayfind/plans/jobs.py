"""Rollup jobs: state and events in, new state out. Callers write the result as a new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.operators import covis, rollups, trending
from wayfind.operators.predicates import retain


def aggregates_rollup(aggregates: DataFrame, log: DataFrame, low: int, high: int, as_of: Column, days: int = 90, **options: float) -> DataFrame:
    return rollups.fold_query_aggregates(aggregates, rollups.scan_range(log, low, high), log, as_of - F.make_dt_interval(F.lit(days)), **options)


def engagement_rollup(engagement: DataFrame, events: DataFrame, low: int, high: int) -> DataFrame:
    return rollups.fold_engagement(engagement, rollups.scan_range(events, low, high))


def sessionizer(log: DataFrame, events: DataFrame, as_of: Column, low: int = 0, gap_s: float = 60.0, abandon_s: float = 300.0) -> DataFrame:
    """Over searches after the cursor whose abandonment window has closed."""
    settled = log.filter(F.col("submitted_at") <= as_of - F.make_dt_interval(secs=F.lit(abandon_s)))
    return rollups.sessionize(settled, events, gap_s, abandon_s).filter(F.col("source_id") > low)


def covis_rollup(co_watch: DataFrame, co_search: DataFrame, events: DataFrame, low: int, high: int, window_s: float = 3600.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New counts of both kinds, and the neighbours rebuilt from them."""
    new, all_ = rollups.scan_range(events, low, high), events.filter(F.col("id") <= high)
    watch = covis.merge_counts(co_watch, covis.co_watch_pairs(new, all_, window_s))
    search = covis.merge_counts(co_search, covis.co_search_pairs(new, all_, window_s))
    return watch, search, covis.top_neighbors(covis.blend_edges(watch, search))


def trending_sweeper(events: DataFrame, as_of: Column, k: int = 50, days: int = 2, cap_s: float = 3600.0, half_life_s: float = 21600.0) -> DataFrame:
    rows = trending.bumps(events)
    scores = trending.trend_scores(trending.capped(rows, cap_s), as_of, half_life_s)
    return trending.trend_top(trending.trend_gate(scores, trending.trend_distinct(rows, as_of, days), trending.trend_total(rows, as_of, days)), k)


def retention(log: DataFrame, events: DataFrame, inbox: DataFrame, projection: DataFrame, as_of: Column, days: int = 90, inbox_days: int = 7) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return retain(log, "submitted_at", as_of, days), retain(events, "occurred_at", as_of, days), retain(inbox, "received_at", as_of, inbox_days), rollups.prune_projection(projection, as_of)
