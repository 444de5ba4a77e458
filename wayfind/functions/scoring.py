"""Ranking and trend arithmetic as column expressions. Weights are fixed values of the ranking model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
SIMPLE_WEIGHTS = {"text_rank": 0.5, "trgm_sim": 0.2, "exact_flags": 0.1, "views": 0.1, "freshness": 0.1}
ADVANCED_WEIGHTS = {"ctr": 0.30, "meaningful_rate": 0.20, "affinity": 0.50, "channel": 0.30, "session": 0.25, "language": 0.10}
CREATOR_PENALTY = 0.15
CTR_ALPHA, CTR_BETA, MEANINGFUL_BETA = 1.0, 9.0, 5.0
WATCH_WEIGHT, SEARCH_WEIGHT, SHRINK = 0.7, 0.3, 10.0
SUGGEST_WEIGHTS = {"pop": 1.0, "prefix": 0.6, "personal": 0.8, "doc": 0.4, "trend": 0.15, "length": 0.1}
PLAY_WEIGHT, MEANINGFUL_WEIGHT, COMPLETED_WEIGHT = 0.3, 1.0, 1.5
FRESH_HALF_LIFE_DAYS = 30.0


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def seconds_between(later: Column | str, earlier: Column | str) -> Column:
    return (F.unix_micros(_c(later)) - F.unix_micros(_c(earlier))) / F.lit(1e6)


def age_days(as_of: Column, published: Column | str, updated: Column | str) -> Column:
    """From publication, or the last update where unpublished; never negative."""
    return F.greatest(seconds_between(as_of, F.coalesce(_c(published), _c(updated))) / 86400.0, F.lit(0.0))


def freshness(days: Column, half_life: float = FRESH_HALF_LIFE_DAYS) -> Column:
    return F.exp(-F.log(F.lit(2.0)) * _c(days) / half_life)


def log_views(views: Column | str) -> Column:
    return F.log1p(_c(views).cast("double"))


def gravity(views: Column | str, published: Column | str, updated: Column | str, as_of: Column) -> Column:
    """Views over (hours + 2)^1.5; dates in the future count as now."""
    hours = F.greatest(seconds_between(as_of, F.coalesce(_c(published), _c(updated))) / 3600.0, F.lit(0.0))
    return _c(views) / F.pow(hours + 2, F.lit(1.5))


def decay_factor(elapsed: Column, half_life: float) -> Column:
    """2^(-elapsed / half-life); 1 where either is not positive."""
    return F.lit(1.0) if half_life <= 0 else F.pow(F.lit(2.0), -F.greatest(_c(elapsed), F.lit(0.0)) / half_life)


def wilson_lower_bound(positive: Column | str, n: Column | str, z: float = 1.96) -> Column:
    """Of the positive share; counts over n count as n, so sketches that overshoot give no NaN."""
    n = _c(n).cast("double")
    p = F.least(_c(positive).cast("double"), n) / n
    bound = (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)
    return F.when((n <= 0) | (_c(positive) <= 0), 0.0).otherwise(F.greatest(bound, F.lit(0.0)))


def smoothed_ctr(clicks: Column | str, impressions: Column | str) -> Column:
    return (_c(clicks) + CTR_ALPHA) / (_c(impressions) + CTR_ALPHA + CTR_BETA)


def meaningful_rate(meaningful: Column | str, clicks: Column | str) -> Column:
    return F.when(_c(meaningful) > 0, _c(meaningful) / (_c(clicks) + MEANINGFUL_BETA)).otherwise(0.0)


def simple_score(text_rank: Column | str, trgm_sim: Column | str, exact_flags: Column | str, views: Column | str, days: Column | str) -> Column:
    w = SIMPLE_WEIGHTS
    return w["text_rank"] * _c(text_rank) + w["trgm_sim"] * _c(trgm_sim) + w["exact_flags"] * _c(exact_flags) + w["views"] * (log_views(views) / 20.0) + w["freshness"] * freshness(_c(days))


def advanced_score(affinity: Column | str = "affinity", channel: Column | str = "channel_affinity", session: Column | str = "session_intent") -> Column:
    """Over the feature columns of a recalled document; the three personal features are normalised beforehand."""
    w = ADVANCED_WEIGHTS
    prior = CTR_ALPHA / (CTR_ALPHA + CTR_BETA)
    return (
        simple_score("text_rank", "trgm_sim", "exact_flags", "views", "age_days")
        + w["ctr"] * (smoothed_ctr("clicks", "impressions") - prior)
        + w["meaningful_rate"] * meaningful_rate("meaningful_watches", "clicks")
        + w["affinity"] * _c(affinity)
        + w["channel"] * _c(channel)
        + w["session"] * _c(session)
        + w["language"] * F.when(F.col("language_match"), 1.0).otherwise(0.0)
    )


def shrunk_cosine(together: Column | str, total_i: Column | str, total_j: Column | str, shrink: float = SHRINK) -> Column:
    c, i, j = (_c(x).cast("double") for x in (together, total_i, total_j))
    return F.when((c > 0) & (i > 0) & (j > 0), c / F.sqrt(i * j) * (c / (c + shrink))).otherwise(0.0)


def covis_blend(watch: Column, search: Column) -> Column:
    return WATCH_WEIGHT * watch + SEARCH_WEIGHT * search


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.try_divide(both, F.size(F.array_union(a, b))))


def overlap_score(tags: Column, category: Column, language: Column, seed_tags: Column, seed_category: Column, seed_language: Column) -> Column:
    same = lambda a, b: F.when(a == b, 1).otherwise(0)
    return same(category, seed_category) + same(language, seed_language) + F.size(F.array_intersect(tags, seed_tags))


def mmr_tokens(tags: Column, category: Column) -> Column:
    own = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.concat(F.lit("tag:"), t))
    return F.array_union(own, F.when(F.coalesce(category, F.lit("")) != "", F.array(F.concat(F.lit("cat:"), category))).otherwise(F.array().cast("array<string>")))


def round4(v: Column) -> Column:
    """To four places by adding a half and cutting, so negatives go toward zero."""
    return (v * 1e4 + 0.5).cast("long") / 1e4


def graded_label(meaningful: Column, clicked: Column) -> Column:
    return F.when(meaningful, 2).when(clicked, 1).otherwise(0)


def dcg_term(relevance: Column | str, rank: Column | str) -> Column:
    """rank from 1."""
    return (F.pow(F.lit(2.0), _c(relevance).cast("double")) - 1) / F.log2(_c(rank).cast("double") + 1)


def suggestion_score(source: Column, text: Column, popularity: Column, top: Column, exact_prefix: Column, personal: Column, trending: Column) -> Column:
    """top: the source's greatest popularity among the request's candidates."""
    w = SUGGEST_WEIGHTS
    share = F.when(top > 0, popularity / top).otherwise(0.0)
    flag = lambda c, yes, no=0.0: F.when(c, yes).otherwise(no)
    return (
        w["pop"] * flag(source == "query", share)
        + w["prefix"] * flag(exact_prefix, 1.0, 0.5)
        + w["personal"] * flag(personal, 1.0)
        + w["doc"] * flag(source == "doc", share)
        + w["trend"] * flag(trending, 1.0)
        - w["length"] * F.least(F.length(text) / 50.0, F.lit(1.0))
    )
