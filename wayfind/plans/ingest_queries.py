"""Queries for intake: envelopes, configuration, catalogue projection, health. Envelopes are derived from the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.operators import projection
from wayfind.plans import behaviour_queries as b
from wayfind.plans import health
from wayfind.plans.registry import query, r6
from wayfind.sources import adapters as src
from wayfind.sources import events as ev
from wayfind.sources.scratch import materialised, new_path

NOW = b.NOW


def _uuid(n):
    return F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(n.cast("string"), 12, "0"))


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The behaviour events as JSON envelopes: every 97th payload is cut off, every 89th has a bad video id, every 50th comes twice."""
    e = src.behaviour(spark, sf_dir)
    video = F.when(F.col("id") % 89 == 0, "no-uuid").otherwise(_uuid(F.col("video_id")))
    body = F.to_json(F.struct(video.alias("video_id"), _uuid(F.col("user_id")).alias("user_id"), "session_id", F.col("normalized_query").alias("query"), "position", "position_seconds", "duration_seconds", "allow_history"))
    payload = F.when(F.col("id") % 97 == 0, F.substring(body, 1, 20)).otherwise(body)
    rows = e.select(F.col("id").alias("seq"), _uuid(F.col("id")).alias("event_id"), "type", "occurred_at", F.lit(1).alias("schema_version"), payload.alias("payload"), "id")
    return rows.unionByName(rows.filter("id % 50 = 0").withColumn("seq", F.col("seq") + 10**9))


FAILS = "CASE WHEN id % 97 = 0 THEN 'bad json' WHEN id % 89 = 0 AND type <> 'search.submitted' THEN 'bad id' END"
E = src.views("behaviour")


@query(f"{E}\nSELECT id, {FAILS} AS message FROM behaviour WHERE {FAILS} IS NOT NULL")
def decode_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, failed = ev.decode(envelopes(spark, sf_dir).filter("seq < 1000000000"), b._now())
    return failed.select(F.substring("event_id", 25, 12).cast("long").alias("id"), "message")


@query(f"{E}\nSELECT id, type, session_id, normalized_query AS query, allow_history FROM behaviour WHERE {FAILS} IS NULL AND id % 3 <> 0")
def idempotent_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded, first of each event, without every third one, which was seen before."""
    rows = envelopes(spark, sf_dir)
    ok, _ = ev.decode(rows, b._now())
    seen = rows.filter("id % 3 = 0").select("event_id").distinct()
    return ev.dedupe(ok, seen).select("id", "type", "p.session_id", "p.query", "p.allow_history")


@query(f"{E}\nSELECT CASE WHEN f IS NOT NULL THEN 'failed' WHEN copy > 1 THEN 'duplicate' ELSE 'counted' END AS outcome, count(*) AS n FROM (SELECT {FAILS} AS f, 1 AS copy FROM behaviour UNION ALL SELECT {FAILS}, 2 FROM behaviour WHERE id % 50 = 0) GROUP BY 1")
def intake_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = envelopes(spark, sf_dir)
    ok, failed = ev.decode(rows, b._now())
    first = ev.dedupe(ok)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("outcome"), "n")
    again = ok.join(first.select("seq"), "seq", "left_anti")
    return n(first, "counted").unionByName(n(again, "duplicate")).unionByName(n(failed, "failed"))


@query("SELECT event_type AS key, CASE WHEN arg_max(event_id % 4, event_id) = 0 THEN '' WHEN arg_max(event_id % 4, event_id) = 1 THEN 'true' WHEN arg_max(event_id % 4, event_id) = 2 THEN (max(event_id) % 1000)::VARCHAR ELSE (max(event_id) % 1000)::VARCHAR || '.5' END AS value FROM events GROUP BY 1")
def config_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.table(spark, sf_dir, "events")
    k, n = F.col("event_id") % 4, (F.col("event_id") % 1000).cast("string")
    raw = F.when(k == 0, "null").when(k == 1, "true").when(k == 2, F.concat(n, F.lit(".0"))).otherwise(F.concat(n, F.lit(".5")))
    payload = F.concat(F.lit('{"settings": {"'), F.col("event_type"), F.lit('": '), raw, F.lit("}}"))
    rows = e.select(F.col("event_id").alias("seq"), F.from_json(payload, "settings map<string,string>")["settings"].alias("settings"))
    return ev.project_config(rows)


LE = ", ".join(f"({x})" for x in ev.LAG_BUCKETS)


@query(f"WITH b(x) AS (VALUES {LE}) SELECT x::DOUBLE::VARCHAR AS le, (SELECT count(*) FROM events WHERE value - 1 >= 0 AND value - 1 <= x) AS n FROM b UNION ALL SELECT 'inf', (SELECT count(*) FROM events WHERE value - 1 >= 0)")
def lag_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.lag_histogram(src.table(spark, sf_dir, "events").select((F.col("value") - 1).alias("lag_s")))


@query("SELECT * FROM (SELECT 'customer' AS \"table\", count(*) AS rows FROM customer UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'orders', count(*) FROM orders)")
def table_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.table_depth({n: src.table(spark, sf_dir, n) for n in ("customer", "events", "orders")})


@query(f"SELECT round((epoch_us({NOW}) - epoch_us(max(ts))) / 1e6, 6) AS age_s, (epoch_us({NOW}) - epoch_us(max(ts))) / 1e6 > 172800 AS stale FROM events WHERE event_type = 'error'")
def reconcile_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    inbox = src.table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", "reconcile.end").otherwise("other").alias("type"), F.col("ts").cast("timestamp").alias("received_at"))
    return health.reconcile_age(inbox, b._now()).select(r6("age_s"), "stale")


DOCS = f"{src.VIEWS['catalogue']}"
HEALTH = f"""{b.TREND},
{DOCS}
SELECT 'documents' AS metric, eligible::VARCHAR AS label, count(*)::DOUBLE AS value FROM catalogue GROUP BY 1, 2
UNION ALL SELECT 'events', type || '/' || CASE WHEN type = 'x' THEN '' ELSE 'counted' END, count(*) FROM behaviour GROUP BY 1, 2
UNION ALL SELECT 'event_lag', x::DOUBLE::VARCHAR, (SELECT count(*) FROM events WHERE value - 1 >= 0 AND value - 1 <= x) FROM (VALUES {LE}) b(x)
UNION ALL SELECT 'event_lag', 'inf', count(*) FROM events WHERE value - 1 >= 0
UNION ALL SELECT 'gate_rejections', domain || '/' || verdict, count(*) FROM verdicts WHERE verdict <> 'ok' GROUP BY 1, 2
UNION ALL SELECT 'reconcile_age_s', 'true', -1
UNION ALL SELECT 'table_rows', 'catalogue', count(*) FROM catalogue UNION ALL SELECT 'table_rows', 'ledger', count(*) FROM behaviour"""


@query(HEALTH)
def pipeline_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, d = src.behaviour(spark, sf_dir), src.catalogue(spark, sf_dir)
    lags = src.table(spark, sf_dir, "events").select((F.col("value") - 1).alias("lag_s"))
    inbox = e.select("type", F.col("occurred_at").alias("received_at"))
    return health.pipeline_health(d, b.intake_outcomes(spark, sf_dir), lags, b.gate_rejections(spark, sf_dir), inbox, {"catalogue": d, "ledger": e}, b._now())


@query(f"{E}\nSELECT id, type, session_id, lower(trim(query)) AS normalized_query FROM (SELECT id, type, session_id, normalized_query AS query FROM behaviour WHERE {FAILS} IS NULL)")
def ingest_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the router puts into an empty ledger, without the watches it derives."""
    from wayfind.plans import ingest

    state = ingest.ingest(envelopes(spark, sf_dir).drop("id"), ingest.empty_state(spark), b._now())
    rows = state["ledger"].filter("type <> 'video.meaningful_watch'")
    return rows.select("id", "type", "session_id", "normalized_query")


@query(f"""{E}, ok AS (SELECT *, lower(trim(normalized_query)) AS q FROM behaviour WHERE {FAILS} IS NULL),
bumps AS (SELECT 'q' AS domain, q AS item, occurred_at FROM ok WHERE type = 'search.submitted' AND q <> '' UNION ALL SELECT 'v', video_id::VARCHAR, occurred_at FROM ok WHERE type = 'video.play_started' AND video_id IS NOT NULL)
SELECT 'ledger' AS part, type AS key, count(*) AS n FROM ok GROUP BY ALL
UNION ALL SELECT 'history', user_id || '/' || q, count(*) FROM ok WHERE type = 'search.submitted' AND allow_history AND user_id IS NOT NULL AND q <> '' GROUP BY ALL
UNION ALL SELECT 'trend', domain || '/' || item || '/' || occurred_at::DATE, count(*) FROM bumps WHERE occurred_at::DATE >= ({NOW})::DATE - 7 GROUP BY ALL
UNION ALL SELECT 'failures', {FAILS}, count(*) FROM behaviour WHERE {FAILS} IS NOT NULL GROUP BY ALL""")
def ingest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stream's tables hold after the envelopes came in three batches."""
    from wayfind.plans import ingest

    judged = materialised(ev.judge(envelopes(spark, sf_dir).withColumn("received_at", b._now()), F.col("received_at")), "judged")
    rows = ev.dedupe(judged.filter("_why IS NULL")).unionByName(judged.filter("_why IS NOT NULL AND seq < 1000000000")).withColumnRenamed("seq", "line")  # a failure counts as often as it is sent anew; the copies are the same
    third = (src.table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0) // 3 + 1
    root = new_path(spark, "ingest-state")
    store = ingest.tables_at(spark, root, 16)
    for n in range(3):
        ingest.advance(store, n, rows.filter((F.col("id") >= n * third) & (F.col("id") < (n + 1) * third)), ["line"])
    state = ingest.read_state(spark, root, 16)
    number = lambda c: F.substring(c, 25, 12).cast("long").cast("string")
    of = lambda df, part, key, n: df.select(F.lit(part).alias("part"), key.alias("key"), n.cast("long").alias("n"))
    count = F.count(F.lit(1)).alias("n")
    item = F.when(F.col("domain") == "v", number("item")).otherwise(F.col("item"))
    return (
        of(state["ledger"].filter("type <> 'video.meaningful_watch'").groupBy("type").agg(count), "ledger", F.col("type"), F.col("n"))
        .unionByName(of(state["history"], "history", F.concat_ws("/", number("user_id"), "normalized_query"), F.col("use_count")))
        .unionByName(of(state["trend_days"], "trend", F.concat_ws("/", "domain", item, F.col("day").cast("string")), F.col("total")))
        .unionByName(of(state["failures"].groupBy("message").agg(count), "failures", F.col("message"), F.col("n")))
    )


def domain_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue events derived from the event table, in order of event_id: upserts, suppressions, statistics, channels, owners, reconcile runs."""
    e = src.table(spark, sf_dir, "events")
    n, u = F.col("event_id"), F.col("user_id")
    channel, owner = F.floor(u / 8), F.floor(u / 16)  # a user is a video; some eight share a channel, some sixteen an owner
    kind = F.pmod(F.xxhash64(n), F.lit(16))
    type_ = (
        F.when(kind < 6, "video.upsert").when(kind == 6, "reconcile.page").when(kind < 9, "video.suppress").when(kind < 11, "video.stats").when(kind == 11, "channel.upsert").when(kind == 12, "channel.delete").otherwise("user.suppress")
    )
    type_ = F.when(n % 251 == 250, "reconcile.end").otherwise(type_)
    run = F.concat(F.lit("run"), F.floor(n / 251).cast("string"))
    named = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    doc = F.struct(
        F.when(n % 9 == 0, "remote").otherwise("").alias("kind"), named("c", channel + n % 3).alias("channel_id"), named("h", n % 7).alias("channel_handle"), named("n", n % 7).alias("channel_name"), named("o", owner + n % 2).alias("owner_id"),
        F.concat(F.lit("t"), n.cast("string")).alias("title"), F.lit("cat").alias("category"), F.lit("en").alias("language"), (n % 4 == 0).alias("is_sensitive"), F.col("ts").cast("timestamp").alias("published_at"),
        F.when(n % 5 == 0, "private").otherwise("public").alias("privacy"), F.when(n % 8 == 1, "draft").otherwise("published").alias("state"), n.alias("views"), (n % 100).cast("int").alias("likes"),
    )
    upsert = type_.isin("video.upsert", "reconcile.page")
    only = lambda t, c: F.when(type_.isin(*t), c)
    video = ("video.upsert", "reconcile.page", "video.suppress", "video.stats")
    return e.select(
        n.alias("seq"), type_.alias("type"), only(video, named("v", u)).alias("video_id"), F.when(upsert, doc).alias("doc"), only(("video.suppress",), F.lit("blocked")).alias("reason"), only(("video.stats",), n * 2).alias("views"),
        only(("video.stats",), (n % 50).cast("int")).alias("likes"), only(("channel.upsert", "channel.delete"), named("c", channel + n % 2)).alias("channel_id"), only(("channel.upsert",), named("H", n % 11)).alias("handle"),
        only(("channel.upsert",), named("N", n % 11)).alias("name"), only(("channel.upsert",), named("o", owner + n % 3)).alias("owner"), only(("user.suppress",), named("o", owner + n % 2)).alias("user_id"), only(("user.suppress",), n % 2 == 0).alias("unlisted"),
        only(("reconcile.page", "reconcile.end"), run).alias("run_id"),
    )


DOC_DDL = "video_id string, kind string, channel_id string, channel_handle string, channel_name string, owner_id string, title string, category string, language string, is_sensitive boolean, published_at timestamp, views long, likes int, eligible boolean, suppressed_reason string, reconcile_run_id string"


@query()
def catalogue_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequential fold, which SQL cannot say; a test holds it against a plain interpreter."""
    done = projection.project_catalogue(spark.createDataFrame([], DOC_DDL), domain_events(spark, sf_dir))
    return done.withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


@query("SELECT 'v' || user_id AS video_id, arg_max('t' || event_id, event_id) AS title, max(event_id) AS views FROM events GROUP BY 1")
def last_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The projection of upserts alone is each video's last one."""
    e = src.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("v"))
    kept = domain_events(spark, sf_dir).withColumn("type", F.lit("video.upsert"))
    n = F.col("seq")
    doc = F.struct(
        *[F.lit("").alias(c) for c in ("kind", "channel_id", "channel_handle", "channel_name", "owner_id")], F.concat(F.lit("t"), n.cast("string")).alias("title"), F.lit("").alias("category"), F.lit("").alias("language"), F.lit(False).alias("is_sensitive"),
        F.lit(None).cast("timestamp").alias("published_at"), F.lit("public").alias("privacy"), F.lit("published").alias("state"), n.alias("views"), F.lit(0).alias("likes"),
    )
    rows = kept.drop("video_id", "doc").join(e, e["event_id"] == n).withColumns({"video_id": F.concat(F.lit("v"), F.col("v").cast("string")), "doc": doc})
    return projection.project_catalogue(spark.createDataFrame([], DOC_DDL), rows.drop("event_id", "v")).select("video_id", "title", "views")
