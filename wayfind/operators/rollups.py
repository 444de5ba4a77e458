"""Incremental rollups of the query log and the behaviour ledger, and what is derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.functions.hashing import subject, utc_day_stamp, uuid_v5
from wayfind.functions.scoring import COMPLETED_WEIGHT, MEANINGFUL_WEIGHT, PLAY_WEIGHT, decay_factor, seconds_between
from wayfind.operators.predicates import collects_history, is_meaningful
from wayfind.operators.windows import clamp_limit, first_per_key, page

DERIVED_NAMESPACE = "6ba7b814-9dad-11d1-80b4-00c04fd430c8"  # fixed value


def scan_range(df: DataFrame, low: int | Column, high: int | Column) -> DataFrame:
    """Ledger rows after the cursor up to the high-water mark."""
    return df.filter((F.col("id") > low) & (F.col("id") <= high))


def high_water(df: DataFrame) -> DataFrame:
    return df.agg(F.coalesce(F.max("id"), F.lit(0)).alias("maxid"))


def settled_high_water(df: DataFrame, as_of: Column, abandon_s: float = 300.0) -> DataFrame:
    """The highest id whose abandonment window has closed."""
    return high_water(df.filter(F.col("submitted_at") <= as_of - F.make_dt_interval(secs=F.lit(abandon_s))))


def query_log(events: DataFrame) -> DataFrame:
    """One row a submitted search with a query: id, normalized_query, display_query, user_id, session_id, submitted_at."""
    rows = events.filter("type = 'search.submitted' AND normalized_query <> ''")
    shown = F.trim("display_query") if "display_query" in events.columns else F.trim("normalized_query")
    return rows.select("id", "event_id", F.lower("normalized_query").alias("normalized_query"), shown.alias("display_query"), "user_id", "session_id", F.col("occurred_at").alias("submitted_at"))


def append_ledger(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New rows whose event_id is neither in the ledger nor earlier in the batch (lowest id wins)."""
    return first_per_key(new, ["event_id"], [F.col("id")]).join(existing.select("event_id"), "event_id", "left_anti")


def batch_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("normalized_query").agg(F.count(F.lit(1)).alias("delta"), F.min("submitted_at").alias("batch_first_seen"), F.max("submitted_at").alias("batch_last_seen"))


def distinct_users(log: DataFrame, queries: DataFrame, window_start: Column) -> DataFrame:
    """Exact distinct users of each query in the window, plus sessions of rows without user."""
    rows = log.filter(F.col("submitted_at") >= window_start).join(queries.select("normalized_query"), "normalized_query", "left_semi")
    return rows.groupBy("normalized_query").agg((F.count_distinct("user_id") + F.count_distinct(F.when(F.col("user_id").isNull(), F.col("session_id")))).cast("int").alias("distinct_users"))


def latest_display(log: DataFrame) -> DataFrame:
    return first_per_key(log, ["normalized_query"], [F.col("submitted_at").desc(), F.col("id").desc()]).select("normalized_query", "display_query")


def fold_query_aggregates(existing: DataFrame, batch: DataFrame, log: DataFrame, window_start: Column, half_life_s: float = 604800.0, min_users: int = 3) -> DataFrame:
    """The aggregates of the batch's queries after it: decay to the batch's last time, then add. Others in `existing` stay as they are and are returned too.

    A whole batch is added undecayed, so the decayed frequency depends on how the log is cut; exact_frequency doesn't.
    """
    counts = batch_counts(batch)
    users = distinct_users(log, counts, window_start)
    shown = latest_display(log.join(counts.select("normalized_query"), "normalized_query", "left_semi"))
    old = existing.select("normalized_query", F.col("total_count").alias("o_total"), F.col("decayed_freq").alias("o_freq"), F.col("first_seen").alias("o_first"), F.col("last_seen").alias("o_last"), F.col("banned").alias("o_banned"))
    rows = counts.join(users, "normalized_query").join(shown, "normalized_query").join(old, "normalized_query", "left")
    banned = F.coalesce("o_banned", F.lit(False))
    decay = decay_factor(F.coalesce(seconds_between("batch_last_seen", "o_last"), F.lit(0.0)), half_life_s)
    new = rows.select(
        "normalized_query",
        "display_query",
        (F.coalesce("o_total", F.lit(0)) + F.col("delta")).alias("total_count"),
        "distinct_users",
        (F.coalesce("o_freq", F.lit(0.0)) * decay + F.col("delta")).alias("decayed_freq"),
        F.least("o_first", "batch_first_seen").alias("first_seen"),
        F.greatest("o_last", "batch_last_seen").alias("last_seen"),
        ((F.col("distinct_users") >= min_users) & ~banned).alias("suggestible"),
        banned.alias("banned"),
    )
    return new.unionByName(existing.join(counts, "normalized_query", "left_anti").select(*new.columns))


def exact_frequency(log: DataFrame, as_of: Column, half_life_s: float = 604800.0) -> DataFrame:
    """The decayed frequency as it would be if every search were added at its own time."""
    return log.groupBy("normalized_query").agg(F.sum(decay_factor(seconds_between(as_of, "submitted_at"), half_life_s)).alias("decayed_freq"))


def engagement_counts(events: DataFrame) -> DataFrame:
    rows = events.filter("normalized_query IS NOT NULL AND video_id IS NOT NULL AND type IN ('video.impression', 'search.result_clicked', 'video.meaningful_watch')")
    is_ = lambda t: F.count_if(F.col("type") == t)
    return rows.groupBy("normalized_query", "video_id").agg(
        is_("video.impression").alias("impressions"), is_("search.result_clicked").alias("clicks"), is_("video.meaningful_watch").alias("meaningful_watches"), F.max("occurred_at").alias("updated_at")
    )


def fold_engagement(existing: DataFrame, events: DataFrame) -> DataFrame:
    """Additive: counts of the events onto those at hand."""
    both = existing.unionByName(engagement_counts(events))
    return both.groupBy("normalized_query", "video_id").agg(*[F.sum(c).alias(c) for c in ("impressions", "clicks", "meaningful_watches")], F.max("updated_at").alias("updated_at"))


def attribute_query(watches: DataFrame, events: DataFrame) -> DataFrame:
    """Each watch (id, session_id, video_id, occurred_at) with query: that of the latest click or play on the video in its session no later than the watch; ties to the highest id."""
    sources = events.filter("type IN ('search.result_clicked', 'video.play_started') AND normalized_query IS NOT NULL")
    sources = sources.select("session_id", "video_id", "occurred_at", F.col("id").alias("_n"), F.lit(0).alias("_watch"), F.col("normalized_query").alias("_query"))
    rows = watches.withColumns({"_n": F.col("id"), "_watch": F.lit(1)}).unionByName(sources, allowMissingColumns=True)
    # a watch comes after the sources of its instant; null sessions are one
    before = Window.partitionBy("session_id", "video_id").orderBy("occurred_at", "_watch", "_n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("query", F.last("_query", ignorenulls=True).over(before))
    return rows.filter("_watch = 1").select(*watches.columns, "query")


def derive_meaningful_watch(events: DataFrame, existing: DataFrame | None = None, seconds: float = 30, percent: float = 30, sources: DataFrame | None = None) -> DataFrame:
    """Meaningful watches of the progress events: one a subject, video and UTC day, under an id made from the three; those in `existing` are left out.

    The query comes from clicks and plays among `sources`, the events themselves if not given.
    """
    watch = events.filter("type = 'video.watch_progress' AND video_id IS NOT NULL").filter(is_meaningful(F.col("position_seconds"), F.col("duration_seconds"), seconds, percent))
    name = F.concat_ws("|", F.lit("mw"), subject(F.col("user_id"), F.col("session_id"), "anon"), F.col("video_id").cast("string"), utc_day_stamp(F.col("occurred_at")))
    once = first_per_key(watch.withColumn("event_uuid", uuid_v5(DERIVED_NAMESPACE, name)), ["event_uuid"], [F.col("id")])
    if existing is not None:
        once = once.join(existing.select("event_uuid"), "event_uuid", "left_anti")
    found = attribute_query(once, events if sources is None else sources)
    return found.select("event_uuid", "id", F.lit("video.meaningful_watch").alias("type"), "user_id", "session_id", F.col("query").alias("normalized_query"), "video_id", "occurred_at", F.coalesce("allow_history", F.lit(False)).alias("allow_history"))


def consented_watches(events: DataFrame) -> DataFrame:
    """Plays, meaningful watches and completions of consenting signed-in users, with their weight."""
    weights = {"video.play_started": PLAY_WEIGHT, "video.meaningful_watch": MEANINGFUL_WEIGHT, "video.completed": COMPLETED_WEIGHT}
    weight = F.lit(None).cast("double")
    for t, w in weights.items():
        weight = F.when(F.col("type") == t, w).otherwise(weight)
    gate = collects_history(F.col("type"), F.col("allow_history"), F.col("user_id")) | ((F.col("type") == "video.meaningful_watch") & F.col("allow_history") & F.col("user_id").isNotNull())
    return events.filter(gate & weight.isNotNull() & F.col("video_id").isNotNull()).withColumn("weight", weight)


def watch_projection(events: DataFrame, as_of: Column, half_life_h: float = 720.0) -> DataFrame:
    """user_id, video_id, weight, last_watched_at: consented watches, decayed from their own time."""
    rows = consented_watches(events)
    return rows.groupBy("user_id", "video_id").agg(F.sum(F.col("weight") * decay_factor(seconds_between(as_of, "occurred_at"), half_life_h * 3600)).alias("weight"), F.max("occurred_at").alias("last_watched_at"))


def fold_projection(existing: DataFrame, events: DataFrame, half_life_h: float = 720.0) -> DataFrame:
    """Watch weights after more events. A weight holds at the pair's last watch: both sides are decayed to the later of theirs, then added."""
    rows = consented_watches(events).select("user_id", "video_id", "weight", F.col("occurred_at").alias("last_watched_at"))
    rows = existing.select("user_id", "video_id", "weight", "last_watched_at").unionByName(rows)
    rows = rows.withColumn("_t", F.max("last_watched_at").over(Window.partitionBy("user_id", "video_id")))
    return rows.groupBy("user_id", "video_id").agg(F.sum(F.col("weight") * decay_factor(seconds_between("_t", "last_watched_at"), half_life_h * 3600)).alias("weight"), F.max("_t").alias("last_watched_at"))


def prune_projection(projection: DataFrame, as_of: Column, half_life_h: float = 720.0, floor: float = 0.05) -> DataFrame:
    return projection.filter(F.col("weight") * decay_factor(seconds_between(as_of, "last_watched_at"), half_life_h * 3600) >= floor)


def search_history(events: DataFrame) -> DataFrame:
    """user_id, normalized_query, display_query (of the last id), use_count, last_used_at, hidden (false): consented searches of signed-in users."""
    log = query_log(events.filter(collects_history(F.col("type"), F.col("allow_history"), F.col("user_id"))))
    return log.groupBy("user_id", "normalized_query").agg(
        F.max_by("display_query", "id").alias("display_query"), F.count(F.lit(1)).alias("use_count"), F.max("submitted_at").alias("last_used_at"), F.lit(False).alias("hidden")
    )


def fold_history(existing: DataFrame, events: DataFrame) -> DataFrame:
    """The history after more events: counts add up, the display of the newer search wins, and a search that was hidden is shown again once it is repeated."""
    new = search_history(events)
    key = ["user_id", "normalized_query"]
    both = existing.select(*key, "display_query", "use_count", "last_used_at", "hidden", F.lit(0).alias("_new")).unionByName(new.select(*key, "display_query", "use_count", "last_used_at", "hidden", F.lit(1).alias("_new")))
    return both.groupBy(*key).agg(
        F.max_by("display_query", "_new").alias("display_query"), F.sum("use_count").alias("use_count"), F.max("last_used_at").alias("last_used_at"), F.max_by("hidden", "_new").alias("hidden")
    )


def hide_history(history: DataFrame, keys: DataFrame) -> DataFrame:
    """Marks the entries (user_id, normalized_query) hidden."""
    gone = keys.select("user_id", "normalized_query").distinct().withColumn("_gone", F.lit(True))
    return history.join(gone, ["user_id", "normalized_query"], "left").withColumn("hidden", F.col("hidden") | F.coalesce("_gone", F.lit(False))).drop("_gone")


def history_list(history: DataFrame, requests: DataFrame, default: int = 20, highest: int = 100) -> DataFrame:
    """user_id, normalized_query, display_query, use_count, last_used_at, rank of each request (user_id, limit, offset): entries not hidden, newest first."""
    rows = history.filter("NOT hidden").join(requests.select("user_id", "limit", "offset"), "user_id")
    order = [F.col("last_used_at").desc(), F.col("normalized_query")]
    found = page(rows, ["user_id"], order, clamp_limit(F.col("limit"), default, highest), F.greatest(F.coalesce("offset", F.lit(0)), F.lit(0)))
    return found.select("user_id", "normalized_query", "display_query", "use_count", "last_used_at", "rank")


def privacy_purge(tables: dict[str, DataFrame], requests: DataFrame) -> dict[str, DataFrame]:
    """The tables after deletion requests (user_id, scope): histories and projections lose the users' rows, logs and ledgers only their ids."""
    scopes = {"history": ("search", "all"), "projection": ("watch", "all"), "log": ("search", "all"), "ledger": ("watch", "all")}
    return {name: purge_users(table, requests, scopes[name], anonymise=name in ("log", "ledger")) if name in scopes else table for name, table in tables.items()}


def reformulations(log: DataFrame, gap_s: float = 60.0) -> DataFrame:
    """id, session_id, from_query, to_query: a search whose predecessor in the session differs and is at most `gap_s` older."""
    over = Window.partitionBy("session_id").orderBy("submitted_at", "id")
    before = log.filter("session_id IS NOT NULL").withColumns({"from_query": F.lag("normalized_query").over(over), "_t": F.lag("submitted_at").over(over)})
    near = seconds_between("submitted_at", "_t")
    return before.filter((F.col("from_query") != F.col("normalized_query")) & (near >= 0) & (near <= gap_s)).select("id", "user_id", "session_id", "from_query", F.col("normalized_query").alias("to_query"), "submitted_at")


def abandoned(log: DataFrame, events: DataFrame, window_s: float = 300.0) -> DataFrame:
    """Searches without a click on their query, or a play without query, in their session within the window, both ends included."""
    signals = events.filter("type IN ('search.result_clicked', 'video.play_started') AND session_id IS NOT NULL")
    signals = signals.select(F.col("session_id").alias("s"), F.coalesce("normalized_query", F.lit("")).alias("q"), F.unix_micros("occurred_at").alias("t"))
    log = log.filter("session_id IS NOT NULL")
    t0 = F.unix_micros("submitted_at")
    met = (F.col("session_id") == F.col("s")) & ((F.col("q") == "") | (F.col("q") == F.col("normalized_query"))) & F.col("t").between(t0, t0 + int(window_s * 1e6))
    return log.join(signals, met, "left_anti")


def sessionize(log: DataFrame, events: DataFrame, gap_s: float = 60.0, abandon_s: float = 300.0) -> DataFrame:
    """event_uuid, source_id, type, user_id, session_id, normalized_query, occurred_at: reformulated and abandoned searches under repeatable ids."""
    again = reformulations(log, gap_s).select(F.col("id").alias("source_id"), F.lit("search.reformulated").alias("type"), "user_id", "session_id", F.col("to_query").alias("normalized_query"), F.col("submitted_at").alias("occurred_at"))
    left = abandoned(log, events, abandon_s).select(F.col("id").alias("source_id"), F.lit("search.abandoned").alias("type"), "user_id", "session_id", "normalized_query", F.col("submitted_at").alias("occurred_at"))
    both = again.unionByName(left)
    return both.withColumn("event_uuid", uuid_v5(DERIVED_NAMESPACE, F.concat_ws("|", F.col("type"), F.col("source_id").cast("string"))))


def label_impressions(events: DataFrame, watches: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    """Impressions of the last days with clicked and meaningful: whether such an event of the session and video (and query) came no earlier. The latest event of a key decides, so this is no range join."""
    imps = events.filter("type = 'video.impression' AND normalized_query IS NOT NULL AND video_id IS NOT NULL").filter(F.col("occurred_at") >= as_of - F.make_dt_interval(F.lit(days)))
    session = F.coalesce(F.concat(F.lit("s"), F.col("session_id")), F.lit("")).alias("_s")  # null sessions are equal
    clicks = events.filter("type = 'search.result_clicked'").groupBy(session, "normalized_query", "video_id").agg(F.max("occurred_at").alias("_click"))
    seen = watches.groupBy(session, "video_id").agg(F.max("occurred_at").alias("_watch"))
    rows = imps.withColumn("_s", session).join(clicks, ["_s", "normalized_query", "video_id"], "left").join(seen, ["_s", "video_id"], "left")
    late = lambda c: F.coalesce(F.col(c) >= F.col("occurred_at"), F.lit(False))
    return rows.select("id", "session_id", "normalized_query", "video_id", F.coalesce("position", F.lit(0)).alias("position"), "occurred_at", late("_click").alias("clicked"), late("_watch").alias("meaningful"))


def session_recent(events: DataFrame, as_of: Column, item: str, k: int = 20, ttl_s: float = 7200.0) -> DataFrame:
    """session_id, item, rank: a session's last k items, newest first, unless nothing was pushed for `ttl_s`."""
    rows = events.filter(F.col("session_id").isNotNull() & (F.col("session_id") != "") & F.col(item).isNotNull() & (F.col("occurred_at") <= as_of))
    last = F.max("occurred_at").over(Window.partitionBy("session_id"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("occurred_at").desc(), F.col("id").desc()))
    live = rows.withColumns({"_last": last, "rank": place}).filter((seconds_between(as_of, "_last") <= ttl_s) & (F.col("rank") <= k))
    return live.select("session_id", F.col(item), "rank")


def purge_users(table: DataFrame, requests: DataFrame, scopes: tuple[str, ...], anonymise: bool = False) -> DataFrame:
    """Without the rows of users who asked for deletion in one of the scopes, or with their user_id set null."""
    users = requests.filter(F.col("scope").isin(*scopes)).select("user_id").distinct()
    if not anonymise:
        return table.join(users, "user_id", "left_anti")
    gone = table.join(users.withColumn("_gone", F.lit(True)), "user_id", "left")
    return gone.withColumn("user_id", F.when(F.col("_gone"), None).otherwise(F.col("user_id"))).select(*table.columns)


def delete_history_entry(history: DataFrame, keys: DataFrame) -> DataFrame:
    return history.join(keys.select("user_id", "normalized_query"), ["user_id", "normalized_query"], "left_anti")
