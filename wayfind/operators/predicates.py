"""Eligibility, visibility and classification rules, and filters against id tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Event types
DOMAIN_TYPES = (
    "video.upsert", "video.suppress", "video.stats", "channel.upsert", "channel.delete", "user.suppress",
    "user.history_deleted", "search.config_updated", "reconcile.begin", "reconcile.page", "reconcile.end",
)
BEHAVIOUR_TYPES = (
    "search.submitted", "search.result_clicked", "video.impression", "video.play_started", "video.watch_progress",
    "video.completed", "search.suggestion_shown", "search.suggestion_selected",
)
HISTORY_TYPES = ("search.submitted", "video.play_started", "video.completed")


def eligibility(privacy: Column, state: Column) -> tuple[Column, Column]:
    """(eligible, reason): public and published, or why not; the reason is null where eligible."""
    named = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))
    public, out = F.coalesce(privacy, F.lit("")) == "public", F.coalesce(state, F.lit("")) == "published"
    reason = F.when(~public, F.concat(F.lit("privacy_"), named(privacy))).when(~out, F.concat(F.lit("state_"), named(state)))
    return public & out, reason


def visible(hide: Column, sensitive: Column) -> Column:
    return ~hide | ~sensitive


def facet_filter(tag: Column, category: Column, language: Column) -> Column:
    """Of a request's optional facets against a document's tags, category and language; a null facet is no filter."""
    return (tag.isNull() | F.array_contains("tags", tag)) & (category.isNull() | (F.col("category") == category)) & (language.isNull() | (F.col("language") == language))


def include_ids(df: DataFrame, ids: DataFrame | None, on: str = "video_id") -> DataFrame:
    return df if ids is None else df.join(ids.select(on).distinct(), on, "left_semi")


def exclude_ids(df: DataFrame, ids: DataFrame | None, on: str | list[str] = "video_id") -> DataFrame:
    return df if ids is None else df.join(ids, on, "left_anti")


def lookup(docs: DataFrame, ids: DataFrame, eligible_only: bool = False) -> DataFrame:
    """The documents of an id table."""
    return include_ids(docs.filter("eligible") if eligible_only else docs, ids)


def prefix_match(text: Column, prefix: Column) -> Column:
    return F.startswith(text, prefix)


def exact_flags(title: Column, channel: Column, tags: Column, query: Column) -> Column:
    flag = lambda c, v: F.when(c, v).otherwise(0.0)
    return flag(F.lower(title) == query, 1.0) + flag(F.lower(F.coalesce(channel, F.lit(""))) == query, 0.5) + flag(F.exists(tags, lambda t: F.lower(t) == query), 0.5)


def is_meaningful(position: Column, duration: Column, seconds: float = 30, percent: float = 30) -> Column:
    at = F.coalesce(position, F.lit(0.0))
    return (at >= seconds) | F.coalesce((duration > 0) & (at >= percent / 100.0 * duration), F.lit(False))


def same_session(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def collects_history(type_: Column, allow: Column, user: Column) -> Column:
    return type_.isin(*HISTORY_TYPES) & F.coalesce(allow, F.lit(False)) & user.isNotNull()


def classify(type_: Column) -> Column:
    """What intake does with an event: domain events are accepted, behaviour counted, others ignored."""
    return F.when(type_.isin(*DOMAIN_TYPES), "accepted").when(type_.isin(*BEHAVIOUR_TYPES), "counted").otherwise("ignored")


def known_type(type_: Column) -> Column:
    return F.when(type_.isin(*DOMAIN_TYPES, *BEHAVIOUR_TYPES), type_).otherwise("unknown")


def retain(df: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    return df.filter(F.col(ts) >= as_of - F.make_dt_interval(F.lit(days)))


def orphans(docs: DataFrame, run_id: Column) -> DataFrame:
    return docs.filter((F.col("kind") == "local") & F.col("eligible") & ~F.col("reconcile_run_id").eqNullSafe(run_id))
