"""Trending: capped, decayed bumps of queries and videos, gated by distinct users and the Wilson bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.functions.hashing import subject
from wayfind.functions.scoring import decay_factor, seconds_between, wilson_lower_bound
from wayfind.operators.windows import greedy_cap


def bumps(events: DataFrame) -> DataFrame:
    """domain, item, subject, occurred_at: submitted queries (q) and started videos (v)."""
    who = subject(F.col("user_id"), F.col("session_id"), "anon").alias("subject")
    q = events.filter("type = 'search.submitted' AND normalized_query <> ''").select(F.lit("q").alias("domain"), F.lower("normalized_query").alias("item"), who, "occurred_at")
    v = events.filter("type = 'video.play_started' AND video_id IS NOT NULL").select(F.lit("v").alias("domain"), F.col("video_id").cast("string").alias("item"), who, "occurred_at")
    return q.unionByName(v)


def capped(rows: DataFrame, cap_s: float = 3600.0) -> DataFrame:
    """A subject bumps an item again only after `cap_s`."""
    return greedy_cap(rows, ["domain", "item", "subject"], "occurred_at", cap_s)


def trend_scores(rows: DataFrame, as_of: Column, half_life_s: float = 21600.0, floor: float = 0.01) -> DataFrame:
    """domain, item, score over capped bumps; scores under the floor are left out of the result only."""
    total = rows.filter(F.col("occurred_at") <= as_of).groupBy("domain", "item").agg(F.sum(decay_factor(seconds_between(as_of, "occurred_at"), half_life_s)).alias("score"))
    return total.filter(F.col("score") >= floor)


def _trailing(rows: DataFrame, as_of: Column, days: int) -> DataFrame:
    day = F.to_date("occurred_at")
    return rows.filter((F.col("occurred_at") <= as_of) & (day > F.date_sub(F.to_date(as_of), days)))


def trend_distinct(rows: DataFrame, as_of: Column, days: int = 2, exact: bool = False) -> DataFrame:
    """domain, item, distinct_users over trailing UTC days; daily sketches that merge, or an exact count."""
    rows = _trailing(rows, as_of, days)
    if exact:
        return rows.groupBy("domain", "item").agg(F.count_distinct("subject").alias("distinct_users"))
    daily = rows.groupBy("domain", "item", F.to_date("occurred_at").alias("day")).agg(F.hll_sketch_agg("subject", F.lit(12)).alias("sketch"))
    return daily.groupBy("domain", "item").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_users"))


def trend_total(rows: DataFrame, as_of: Column, days: int = 2) -> DataFrame:
    """domain, item, total over trailing UTC days, from daily counts of all bumps."""
    daily = _trailing(rows, as_of, days).groupBy("domain", "item", F.to_date("occurred_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return daily.groupBy("domain", "item").agg(F.sum("n").alias("total"))


def accept_bumps(accepted: DataFrame, new: DataFrame, cap_s: float = 3600.0) -> DataFrame:
    """Those of the new bumps that count beside the ones accepted before: `cap_s` or more from each of these, before or after, and from one another."""
    keys, columns = ["domain", "item", "subject"], ["domain", "item", "subject", "occurred_at"]
    both = accepted.select(*columns, F.lit(0).alias("_new")).unionByName(new.select(*columns, F.lit(1).alias("_new")))
    at, fixed = F.unix_micros("occurred_at"), F.when(F.col("_new") == 0, F.unix_micros("occurred_at"))
    before = F.last(fixed, ignorenulls=True).over(Window.partitionBy(*keys).orderBy("occurred_at", "_new").rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(fixed, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.col("occurred_at").desc(), "_new").rowsBetween(Window.unboundedPreceding, 0))
    cap = int(cap_s * 1e6)
    free = both.withColumns({"_before": before, "_after": after}).filter((F.col("_new") == 1) & F.coalesce(at - F.col("_before") >= cap, F.lit(True)) & F.coalesce(F.col("_after") - at >= cap, F.lit(True)))
    return greedy_cap(free.select(*columns), keys, "occurred_at", cap_s)


def daily_sketches(rows: DataFrame) -> DataFrame:
    """domain, item, day, total, sketch (of the subjects) of bumps."""
    return rows.groupBy("domain", "item", F.to_date("occurred_at").alias("day")).agg(F.count(F.lit(1)).alias("total"), F.hll_sketch_agg("subject", F.lit(12)).alias("sketch"))


def fold_days(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """Daily totals and sketches after more bumps: totals add up, sketches are united, so batches may be cut anywhere."""
    both = existing.select("domain", "item", "day", "total", "sketch").unionByName(daily_sketches(rows))
    return both.groupBy("domain", "item", "day").agg(F.sum("total").alias("total"), F.hll_union_agg("sketch").alias("sketch"))


def fold_scores(existing: DataFrame, accepted: DataFrame, half_life_s: float = 21600.0) -> DataFrame:
    """domain, item, score, scored_at: one decayed score an item, as of its last bump, after more accepted bumps."""
    new = accepted.select("domain", "item", F.lit(1.0).alias("score"), F.col("occurred_at").alias("scored_at"))
    both = existing.select("domain", "item", "score", "scored_at").unionByName(new).withColumn("_t", F.max("scored_at").over(Window.partitionBy("domain", "item")))
    return both.groupBy("domain", "item").agg(F.sum(F.col("score") * decay_factor(seconds_between("_t", "scored_at"), half_life_s)).alias("score"), F.max("_t").alias("scored_at"))


def scores_at(state: DataFrame, as_of: Column, half_life_s: float = 21600.0, floor: float = 0.01) -> DataFrame:
    """The scores of a folded state, decayed to as_of, which is not before the last bump."""
    return state.select("domain", "item", (F.col("score") * decay_factor(seconds_between(as_of, "scored_at"), half_life_s)).alias("score")).filter(F.col("score") >= floor)


def days_at(state: DataFrame, as_of: Column, days: int = 2) -> DataFrame:
    """domain, item, distinct_users (estimated), total over the trailing UTC days of a folded state."""
    rows = state.filter((F.col("day") <= F.to_date(as_of)) & (F.col("day") > F.date_sub(F.to_date(as_of), days)))
    return rows.groupBy("domain", "item").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_users"), F.sum("total").alias("total"))


def trend_gate(scores: DataFrame, distinct: DataFrame, total: DataFrame, min_users: int = 3, floor: float = 0.10) -> DataFrame:
    """Scores with verdict: ok, distinct_users or wilson."""
    rows = scores.join(distinct, ["domain", "item"], "left").join(total, ["domain", "item"], "left").fillna(0, ["distinct_users", "total"])
    bound = wilson_lower_bound("distinct_users", "total")
    return rows.withColumns({"wilson": bound, "verdict": F.when(F.col("distinct_users") < min_users, "distinct_users").when(bound < floor, "wilson").otherwise("ok")})


def trend_top(gated: DataFrame, k: int = 50) -> DataFrame:
    """The best k of each domain that passed; ties go to the greater item."""
    over = Window.partitionBy("domain").orderBy(F.round("score", 9).desc(), F.col("item").desc())
    return gated.filter("verdict = 'ok'").withColumn("rank", F.row_number().over(over)).filter(F.col("rank") <= k)


def gate_rejections(gated: DataFrame) -> DataFrame:
    return gated.filter("verdict <> 'ok'").groupBy("domain", F.col("verdict").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def flag_trending(candidates: DataFrame, trending: DataFrame, key: str = "key") -> DataFrame:
    """trending: whether the candidate's normalised text is among the trending items."""
    items = trending.filter("domain = 'q'").select(F.col("item").alias(key)).distinct().withColumn("trending", F.lit(True))
    return candidates.join(items, key, "left").withColumn("trending", F.coalesce("trending", F.lit(False)))


def snapshot(trending: DataFrame, as_of: Column, ttl_s: int = 300) -> DataFrame:
    """The list with the time until which it holds."""
    return trending.withColumn("valid_until", as_of + F.make_dt_interval(secs=F.lit(ttl_s)))


def publish(trending: DataFrame, path: str, as_of: Column, ttl_s: int = 300) -> None:
    snapshot(trending, as_of, ttl_s).write.mode("overwrite").parquet(path)


def published(trending: DataFrame, as_of: Column) -> DataFrame:
    """What of a published list still holds."""
    return trending.filter(F.col("valid_until") >= as_of).drop("valid_until")
