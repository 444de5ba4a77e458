"""Suggestions for a table of prefixes: streams of titles, channels, tags, popular queries, history and session, blended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.functions.scoring import suggestion_score
from wayfind.functions.text import normalize
from wayfind.operators.completions import complete, completion_table
from wayfind.operators.predicates import prefix_match, visible
from wayfind.operators.recall import prefix_join, trigram_join
from wayfind.operators.trending import flag_trending
from wayfind.operators.windows import clamp_suggest_limit, first_per_key, top_k
from wayfind.sources.scratch import materialised

STREAM_LIMIT = 15
FUZZY_SIMILARITY = 0.35


def display_text(display: Column, normalized: Column) -> Column:
    return F.coalesce(F.nullif(display, F.lit("")), normalized)


def _shown(rows: DataFrame) -> DataFrame:
    return rows.filter(visible(F.col("hide_sensitive"), F.col("is_sensitive")))


def title_prefix(prefixes: DataFrame, docs: DataFrame, k: int = STREAM_LIMIT, cut: str = "alphabet") -> DataFrame:
    """query_id, text, popularity: distinct titles (most viewed form) with the prefix. The first k by alphabet; cut="views" takes the most viewed instead."""
    rows = _shown(prefix_join(prefixes, docs.filter("eligible").select(F.lower("title").alias("key"), "title", "views", "is_sensitive", "video_id")))
    once = first_per_key(rows, ["query_id", "key"], [F.col("views").desc(), F.col("video_id")])
    order = [F.col("key")] if cut == "alphabet" else [F.col("views").desc(), F.col("key")]
    return top_k(once, ["query_id"], order, k).select("query_id", F.col("title").alias("text"), F.col("views").alias("popularity"))


def title_items(docs: DataFrame) -> DataFrame:
    """hide, key, text, popularity: the distinct titles (most viewed form) that requests with and without sensitive items hidden can get."""
    rows = docs.filter("eligible").select(F.lower("title").alias("key"), "title", "views", "video_id", "is_sensitive")
    rows = rows.withColumn("hide", F.lit(False)).unionByName(rows.filter("NOT is_sensitive").withColumn("hide", F.lit(True)))
    once = first_per_key(rows, ["hide", "key"], [F.col("views").desc(), F.col("video_id")])
    return once.select("hide", "key", F.col("title").alias("text"), F.col("views").alias("popularity"))


def title_completions(docs: DataFrame, k: int = STREAM_LIMIT) -> DataFrame:
    """The table that title_lists reads: the first k titles by alphabet of every prefix."""
    return completion_table(title_items(docs), ["hide"], [F.col("key")], k)


def title_lists(prefixes: DataFrame, table: DataFrame, k: int = STREAM_LIMIT) -> DataFrame:
    """The rows of title_prefix from a completion table; reads what the requests ask for."""
    return complete(prefixes, table, {"hide_sensitive": "hide"}, k).select("query_id", "text", "popularity")


def suggest_channels(prefixes: DataFrame, docs: DataFrame, k: int = STREAM_LIMIT) -> DataFrame:
    """query_id, text, channel_handle, popularity (greatest views)."""
    rows = _shown(prefix_join(prefixes, docs.filter("eligible AND channel_name IS NOT NULL").select(F.lower("channel_name").alias("key"), "channel_name", "channel_handle", "views", "is_sensitive")))
    best = rows.groupBy("query_id", F.col("channel_name").alias("text")).agg(F.min("channel_handle").alias("channel_handle"), F.max("views").alias("popularity"))
    return top_k(best, ["query_id"], [F.col("popularity").desc(), F.col("text")], k)


def explode_tags(docs: DataFrame) -> DataFrame:
    return docs.select("video_id", "is_sensitive", "eligible", F.explode("tags").alias("tag"))


def suggest_tags(prefixes: DataFrame, docs: DataFrame, k: int = STREAM_LIMIT) -> DataFrame:
    """query_id, text, popularity (how many documents have the tag)."""
    # counted before the join, so a common tag is one row
    counts = explode_tags(docs).filter("eligible").groupBy("tag").agg(F.count(F.lit(1)).alias("all_"), F.count_if(~F.col("is_sensitive")).alias("shown"))
    rows = prefix_join(prefixes, counts.withColumn("key", F.lower("tag")))
    rows = rows.select("query_id", F.col("tag").alias("text"), F.when(F.col("hide_sensitive"), F.col("shown")).otherwise(F.col("all_")).alias("popularity")).filter("popularity > 0")
    return top_k(rows, ["query_id"], [F.col("popularity").desc(), F.col("text")], k)


def aggregate_prefix(prefixes: DataFrame, aggregates: DataFrame, k: int = STREAM_LIMIT) -> DataFrame:
    """query_id, text, popularity (decayed frequency) of suggestible queries."""
    rows = prefix_join(prefixes, aggregates.filter("suggestible AND NOT banned").withColumn("key", F.col("normalized_query")))
    best = top_k(rows, ["query_id"], [F.round("decayed_freq", 9).desc(), F.col("key")], k)
    return best.select("query_id", display_text(F.col("display_query"), F.col("normalized_query")).alias("text"), F.col("decayed_freq").alias("popularity"))


def history_prefix(requests: DataFrame, history: DataFrame, k: int = STREAM_LIMIT) -> DataFrame:
    """query_id, text, popularity (use count): the user's own searches that aren't hidden, newest first."""
    rows = requests.filter("user_id IS NOT NULL").join(history.filter("NOT hidden"), "user_id").filter(prefix_match(F.col("normalized_query"), F.col("query")))
    best = top_k(rows, ["query_id"], [F.col("last_used_at").desc(), F.col("normalized_query")], k)
    return best.select("query_id", display_text(F.col("display_query"), F.col("normalized_query")).alias("text"), F.col("use_count").cast("double").alias("popularity"))


def session_prefix(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """query_id, text, popularity (0): the session's recent queries (session_id, normalized_query)."""
    rows = requests.filter("session_id <> ''").join(sessions, "session_id").filter(prefix_match(F.col("normalized_query"), F.col("query")))
    return rows.select("query_id", F.col("normalized_query").alias("text"), F.lit(0.0).alias("popularity")).distinct()


def title_fuzzy(prefixes: DataFrame, docs: DataFrame, threshold: float = FUZZY_SIMILARITY, k: int = STREAM_LIMIT) -> DataFrame:
    """query_id, text, sim, popularity: similar titles, the first k by alphabet."""
    titles = docs.filter("eligible").select(F.lower("title").alias("key"), "title", "views", "is_sensitive", "video_id")
    rows = trigram_join(prefixes, titles, threshold).join(titles, "key").join(prefixes.select("query_id", "hide_sensitive"), "query_id")
    once = first_per_key(_shown(rows), ["query_id", "key"], [F.col("views").desc(), F.col("video_id")])
    return top_k(once, ["query_id"], [F.col("key")], k).select("query_id", F.col("title").alias("text"), F.col("trgm_sim").alias("sim"), F.col("views").alias("popularity"))


COLUMNS = ("query_id", "text", "kind", "source", "channel_handle", "personal", "exact_prefix", "popularity", "stream")


def _stream(rows: DataFrame, kind: str, source: str, number: int, exact: bool = True) -> DataFrame:
    handle = F.col("channel_handle") if "channel_handle" in rows.columns else F.lit(None).cast("string")
    return rows.select("query_id", "text", F.lit(kind).alias("kind"), F.lit(source).alias("source"), handle.alias("channel_handle"), F.lit(source == "history").alias("personal"), F.lit(exact).alias("exact_prefix"), F.col("popularity").cast("double").alias("popularity"), F.lit(number).alias("stream"))


def blend(candidates: DataFrame) -> DataFrame:
    """Scored candidates, one per request and normalised text: exact before fuzzy, then by score, then text; a duplicate's personal flag is kept; adds rank."""
    top = F.max("popularity").over(Window.partitionBy("query_id", "source"))
    rows = candidates.withColumn("score", suggestion_score(F.col("source"), F.col("text"), F.col("popularity"), top, F.col("exact_prefix"), F.col("personal"), F.col("trending")))
    rows = rows.filter("key <> ''")
    order = [F.col("exact_prefix").desc(), F.round("score", 9).desc(), F.lower("text"), F.col("stream"), F.col("text")]
    same = Window.partitionBy("query_id", "key")
    rows = rows.withColumns({"_n": F.row_number().over(same.orderBy(*order)), "personal": F.max("personal").over(same)}).filter("_n = 1").drop("_n")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def reserve_slots(ranked: DataFrame, limit: Column) -> DataFrame:
    """The first `limit`, with a place kept for history, then for documents, if there are such candidates.

    A missing class's best candidate takes the place of the weakest one of another class. The second step may so put out
    what the first one put in, which sits last.
    """
    rows = ranked.withColumn("_limit", limit)
    for source in ("history", "doc"):
        inside = F.col("_in")
        if source == "history":
            rows = rows.withColumns({"_in": F.col("rank") <= F.col("_limit"), "_slot": F.col("rank")})
        request = Window.partitionBy("query_id")
        of = F.col("source") == source
        have = F.max((inside & of).cast("int")).over(request) == 1
        crowded = F.max("rank").over(request) > F.col("_limit")
        best = F.min(F.when(~inside & of & (F.col("rank") > F.col("_limit")), F.col("rank"))).over(request)
        weakest = F.max(F.when(inside & ~of, F.col("_slot"))).over(request)
        swap = ~have & crowded & best.isNotNull() & weakest.isNotNull()
        rows = rows.withColumns({"_swap": swap, "_best": best, "_weakest": weakest})
        out = F.col("_swap") & inside & (F.col("_slot") == F.col("_weakest"))
        into = F.col("_swap") & (F.col("rank") == F.col("_best"))
        rows = rows.withColumns({"_slot": F.when(into, F.col("_weakest")).otherwise(F.col("_slot")), "_in": F.when(into, True).when(out, False).otherwise(inside)})
    kept = rows.filter("_in").drop("_in", "_slot", "_swap", "_best", "_weakest", "_limit")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def suggest(prefixes: DataFrame, docs: DataFrame, aggregates: DataFrame, history: DataFrame | None = None, sessions: DataFrame | None = None, trending: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """query_id, rank, text, kind, channel_handle, personal, score. Prefixes: query_id, query (normalised), and optionally hide_sensitive, limit, user_id, session_id, include_history."""
    have = set(prefixes.columns)
    defaults = {"hide_sensitive": F.lit(False), "limit": F.lit(limit)}
    prefixes = prefixes.withColumns({k: v for k, v in defaults.items() if k not in have}).filter("query <> ''")
    streams = [
        _stream(title_prefix(prefixes, docs), "query", "doc", 0),
        _stream(suggest_channels(prefixes, docs), "channel", "doc", 1),
        _stream(suggest_tags(prefixes, docs), "tag", "doc", 2),
        _stream(aggregate_prefix(prefixes, aggregates), "query", "query", 3),
    ]
    own = prefixes.filter("include_history") if "include_history" in have else prefixes
    if history is not None and "user_id" in have:
        streams.append(_stream(history_prefix(own, history), "history", "history", 4))
    if sessions is not None and "session_id" in have:
        streams.append(_stream(session_prefix(own, sessions), "history", "history", 5))
    found = streams[0]
    for s in streams[1:]:
        found = found.unionByName(s)
    found = found.withColumn("key", normalize(F.col("text")))
    found = flag_trending(found, trending) if trending is not None else found.withColumn("trending", F.lit(False))
    found = materialised(found, "suggest-streams")  # read for the number of exact ones, then whole
    room = prefixes.select("query_id", clamp_suggest_limit(F.col("limit")).alias("_room"))
    exact = found.groupBy("query_id").agg(F.count_if("exact_prefix").alias("_exact"))
    short = prefixes.join(room.join(exact, "query_id", "left").filter(F.coalesce("_exact", F.lit(0)) < F.col("_room")), "query_id", "left_semi")  # similar titles are only sought for these
    fuzzy = _stream(title_fuzzy(short, docs), "query", "doc", 6, exact=False).withColumns({"key": normalize(F.col("text")), "trending": F.lit(False)})
    found = found.unionByName(fuzzy).join(room, "query_id")
    best = reserve_slots(blend(found), F.col("_room"))
    return best.select("query_id", "rank", "text", "kind", "channel_handle", "personal", "score")
