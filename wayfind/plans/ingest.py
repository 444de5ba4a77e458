"""The ingest router: one decoded stream of envelopes to catalogue, ledger, query log, histories, projections, settings and trend bumps."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from wayfind.operators import projection, rollups, trending
from wayfind.operators.predicates import BEHAVIOUR_TYPES, classify
from wayfind.operators.windows import first_per_key
from wayfind.sources.events import decode, dedupe, failures, judge, read_events, stringify_config
from wayfind.sources.schemas import VIDEO
from wayfind.streaming.intake import ledger_rows
from wayfind.streaming.tables import KeyedTables, Versions

#: Columns of each part of the state; an ingest takes and gives all of them
STATE = {
    "inbox": "event_id string, type string, received_at timestamp",
    "failures": "event_id string, code string, message string",
    "documents": "video_id string, kind string, channel_id string, channel_handle string, channel_name string, owner_id string, title string, category string, language string, is_sensitive boolean, published_at timestamp, views long, likes int, eligible boolean, suppressed_reason string, reconcile_run_id string",
    "ledger": "event_id string, type string, user_id string, session_id string, normalized_query string, display_query string, video_id string, position int, position_seconds double, duration_seconds double, allow_history boolean, occurred_at timestamp, day date, props string, id long",
    "history": "user_id string, normalized_query string, display_query string, use_count long, last_used_at timestamp, hidden boolean",
    "projection": "user_id string, video_id string, weight double, last_watched_at timestamp",
    "bumps": "domain string, item string, subject string, occurred_at timestamp",
    "settings": "key string, value string, seq long",
}


def empty_state(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in STATE.items()}


def domain_rows(ok: DataFrame) -> DataFrame:
    """Decoded domain events as project_catalogue takes them: a page event has a row a video."""
    videos = F.when(F.col("type") == "reconcile.page", F.col("p.videos")).when(F.col("type") == "video.upsert", F.array("p.video"))
    rows = ok.withColumn("v", F.explode_outer(F.coalesce(videos, F.array(F.lit(None).cast(VIDEO))))).filter(F.col("v").isNotNull() | ~F.col("type").isin("reconcile.page", "video.upsert"))
    placed = ("kind", "channel_id", "channel_handle", "channel_name", "owner_id", "title", "category", "language", "is_sensitive", "published_at", "privacy", "state", "views", "likes")
    doc = F.when(F.col("v").isNotNull(), F.struct(*[F.coalesce(F.col(f"v.{c}"), F.lit(False)).alias(c) if c == "is_sensitive" else F.col(f"v.{c}").alias(c) for c in placed]))
    channel = F.col("p.channel")
    return rows.select(
        "seq", "type", F.coalesce("v.id", "p.video_id").alias("video_id"), doc.alias("doc"), F.col("p.reason").alias("reason"), F.col("p.views").alias("views"), F.col("p.likes").alias("likes"), F.coalesce(channel["id"], F.col("p.channel_id")).alias("channel_id"),
        channel["handle"].alias("handle"), channel["display_name"].alias("name"), channel["owner_id"].alias("owner"), F.col("p.user_id").alias("user_id"), F.col("p.unlisted").alias("unlisted"), F.col("p.run_id").alias("run_id"),
    )


def ingest(events: DataFrame, state: dict[str, DataFrame], as_of: Column) -> dict[str, DataFrame]:
    """The state after a batch of envelopes (event_id, type, occurred_at, schema_version, payload, seq: order of arrival, above all seen before).

    Events that fail are kept as failures and not as seen, so a corrected one passes. An event seen before changes nothing.
    Domain events are folded onto the catalogue in order of arrival; behaviour goes to the ledger under its order as id, and
    from there to query histories, watch weights and trend bumps; deletions of a user's history and settings are applied last.
    """
    ok, failed = decode(events, as_of)
    new = dedupe(ok, state["inbox"])
    inbox = state["inbox"].unionByName(new.select("event_id", "type", as_of.alias("received_at")))
    domain = new.filter(classify(F.col("type")) == "accepted")
    behaviour = new.filter(F.col("type").isin(*BEHAVIOUR_TYPES))
    rows = ledger_rows(behaviour.withColumn("id", F.col("seq")), ("id",))
    every = state["ledger"].select(*rows.columns).unionByName(rows)
    watches = rollups.derive_meaningful_watch(rows, state["ledger"].filter("type = 'video.meaningful_watch'").select(F.col("event_id").alias("event_uuid")), sources=every)
    watches = watches.select(F.col("event_uuid").alias("event_id"), "type", "user_id", "session_id", "normalized_query", "video_id", "allow_history", "occurred_at", F.to_date("occurred_at").alias("day"), "id")
    added = rows.unionByName(watches, allowMissingColumns=True)
    gone = domain.filter("type = 'user.history_deleted'").select(F.col("p.user_id").alias("user_id"), F.coalesce("p.scope", F.lit("all")).alias("scope"))
    tables = {"history": rollups.fold_history(state["history"], rows), "projection": rollups.fold_projection(state["projection"], added), "ledger": state["ledger"].unionByName(added.select(*state["ledger"].columns))}
    tables = rollups.privacy_purge(tables, gone)
    settings = domain.filter("type = 'search.config_updated'").select("seq", F.explode("p.settings").alias("key", "raw"))
    settings = settings.select("key", stringify_config(F.coalesce("raw", F.lit("null"))).alias("value"), "seq")
    settings = first_per_key(state["settings"].unionByName(settings), ["key"], [F.col("seq").desc()])
    done = projection.project_catalogue(state["documents"], domain_rows(domain.filter(F.col("type") != "user.history_deleted")))
    return {
        "inbox": inbox,
        "failures": state["failures"].unionByName(failed),
        "documents": done.select(*state["documents"].columns),
        "bumps": state["bumps"].unionByName(trending.bumps(rows)),
        "settings": settings,
        **tables,
    }


#: Tables of the stream: schema, and the columns whose hash is the bucket
KEYED = {
    "documents": (STATE["documents"], ("video_id",)),
    "placements": ("kind string, value string, video_id string", ("kind", "value")),
    "history": (STATE["history"], ("user_id",)),
    "projection": (STATE["projection"], ("user_id",)),
    "sources": ("session_id string, video_id string, type string, normalized_query string, occurred_at timestamp, id long", ("session_id", "video_id")),
    "watched": ("event_id string, occurred_at timestamp", ("event_id",)),
    "settings": (STATE["settings"], ("key",)),
    "accepted": (STATE["bumps"], ("domain", "item")),
    "trend_days": ("domain string, item string, day date, total long, sketch binary", ("domain", "item")),
    "trend_scores": ("domain string, item string, score double, scored_at timestamp", ("domain", "item")),
}
APPENDED = {"ledger": STATE["ledger"], "failures": STATE["failures"], "erasures": "user_id string, scope string"}
SOURCE_TYPES = ("search.result_clicked", "video.play_started")
SEQ_BITS = 40  # a batch has up to 2^40 events
SCORE_FLOOR = 1e-6  # a decayed score below is forgotten


def tables_at(spark: SparkSession, root: str, buckets: int = 64) -> KeyedTables:
    """The stream's tables in a folder; buckets must be what they were first."""
    return KeyedTables(spark, root, KEYED, buckets)


def numbered(rows: DataFrame, n: int, order: list[str], path: str) -> DataFrame:
    """Rows with seq, gapless in order and above all of earlier batches; written once, so that what follows neither decodes nor numbers again."""
    rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()).write.mode("overwrite").parquet(path)
    held = rows.sparkSession.read.parquet(path)
    part = F.shiftright("_at", 33)
    counts = held.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # a row a partition of the sort
    base = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    seq = F.lit(n << SEQ_BITS) + F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return held.withColumn("_part", part).join(F.broadcast(base), "_part").withColumn("seq", seq).drop("_part", "_at", "_base")


def _append(store: KeyedTables, table: str, n: int, rows: DataFrame, *by: str) -> None:
    """Adds the batch's rows as its own partitions; a batch run again overwrites these alone."""
    rows = rows.withColumn("batch", F.lit(n))
    rows.repartition(*by, "batch").write.partitionBy(*by, "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{store.root}/{table}")


def _distinct(rows: DataFrame, value: Column) -> set[int]:
    """Bucket numbers, so at most as many as there are buckets."""
    return {r[0] for r in rows.select(value.alias("b")).distinct().collect() if r[0] is not None}


def _catalogue(store: KeyedTables, n: int, old: Versions, domain: DataFrame) -> dict:
    """Folds domain events onto the documents they reach: those they name, those placed with a channel or owner they name, and all where a reconcile run ends."""
    rows = domain_rows(domain)
    named = rows.filter("type IN ('channel.upsert', 'channel.delete') AND channel_id IS NOT NULL").select(F.lit("channel").alias("kind"), F.col("channel_id").alias("value"))
    named = named.unionByName(rows.filter("type = 'user.suppress' AND user_id IS NOT NULL").select(F.lit("owner").alias("kind"), F.col("user_id").alias("value"))).distinct()
    placed = store.read("placements", old, _distinct(named, store.bucket("placements")))
    reached = placed.join(named, ["kind", "value"], "left_semi").select("video_id").unionByName(rows.filter("video_id IS NOT NULL").select("video_id"))
    ends = bool(rows.filter("type = 'reconcile.end'").head(1))
    touched = set(range(store.buckets)) if ends else _distinct(reached, store.bucket("documents"))
    before = store.read("documents", old, touched)
    written = store.write("documents", n, projection.project_catalogue(before, rows, reconciled=ends), touched)
    after = store.read("documents", {"documents": written})
    where = lambda docs: docs.select("video_id", F.explode(F.array(F.struct(F.lit("channel").alias("kind"), F.col("channel_id").alias("value")), F.struct(F.lit("owner").alias("kind"), F.col("owner_id").alias("value")))).alias("p")).filter("p.value IS NOT NULL").select("p.kind", "p.value", "video_id")
    key = ["kind", "value", "video_id"]
    gone, new = where(before).join(where(after), key, "left_anti"), where(after).join(where(before), key, "left_anti")
    moved = _distinct(gone.unionByName(new), store.bucket("placements"))
    placements = store.read("placements", old, moved).join(gone, key, "left_anti").unionByName(new)
    return {"documents": (touched, written), "placements": (moved, store.write("placements", n, placements, moved))}


def _users(store: KeyedTables, n: int, old: Versions, rows: DataFrame, watches: DataFrame, gone: DataFrame) -> dict:
    """Query histories and watch weights of the batch's users, deletions applied last."""
    touched = _distinct(rows.select("user_id").unionByName(watches.select("user_id")).unionByName(gone.select("user_id")).filter("user_id IS NOT NULL"), store.bucket("history"))
    added = rows.unionByName(watches, allowMissingColumns=True)
    tables = {"history": rollups.fold_history(store.read("history", old, touched), rows), "projection": rollups.fold_projection(store.read("projection", old, touched), added)}
    return {name: (touched, store.write(name, n, table, touched)) for name, table in rollups.privacy_purge(tables, gone).items()}


def _watches(store: KeyedTables, n: int, old: Versions, rows: DataFrame, since: Column) -> tuple[DataFrame, dict]:
    """The batch's meaningful watches that were not derived before, as ledger rows, with the tables that say so; what lies before `since` is forgotten."""
    own = rows.filter(F.col("type").isin(*SOURCE_TYPES) & F.col("normalized_query").isNotNull() & F.col("video_id").isNotNull()).select("session_id", "video_id", "type", "normalized_query", "occurred_at", "id")
    progress = rows.filter("type = 'video.watch_progress'").select("session_id", "video_id")
    asked = _distinct(own.select("session_id", "video_id").unionByName(progress), store.bucket("sources"))
    sources = store.read("sources", old, asked).unionByName(own)
    found = rollups.derive_meaningful_watch(rows, sources=sources)
    found = found.select(F.col("event_uuid").alias("event_id"), "type", "user_id", "session_id", "normalized_query", "video_id", "allow_history", "occurred_at", F.to_date("occurred_at").alias("day"), "id")
    path = f"{store.root}/batches/{n}/watches"
    found.write.mode("overwrite").parquet(path)
    found = store.spark.read.schema(found.schema).parquet(path)
    touched = _distinct(found, store.bucket("watched"))
    known = store.read("watched", old, touched)
    new = found.join(known.select("event_id"), "event_id", "left_anti").select(*found.columns)
    fresh = _distinct(own, store.bucket("sources"))
    kept = store.read("sources", old, fresh).unionByName(own).filter(F.col("occurred_at") >= since)
    seen = known.unionByName(new.select("event_id", "occurred_at")).filter(F.col("occurred_at") >= since)
    return new, {"sources": (fresh, store.write("sources", n, kept, fresh)), "watched": (touched, store.write("watched", n, seen, touched))}


def _trends(store: KeyedTables, n: int, old: Versions, rows: DataFrame, now: Column, since: Column) -> dict:
    """Daily totals and sketches, decayed scores, and the bumps that count within the horizon, of the batch's items."""
    bumps = trending.bumps(rows)
    touched = _distinct(bumps, store.bucket("accepted"))
    before = store.read("accepted", old, touched)
    taken = trending.accept_bumps(before, bumps)
    days = trending.fold_days(store.read("trend_days", old, touched), bumps).filter(F.col("day") >= F.to_date(since))
    scores = trending.fold_scores(store.read("trend_scores", old, touched), taken)
    live = trending.scores_at(scores, F.greatest(now, F.col("scored_at")), floor=SCORE_FLOOR).select("domain", "item")
    return {
        "accepted": (touched, store.write("accepted", n, before.unionByName(taken).filter(F.col("occurred_at") >= since), touched)),
        "trend_days": (touched, store.write("trend_days", n, days, touched)),
        "trend_scores": (touched, store.write("trend_scores", n, scores.join(live, ["domain", "item"], "left_semi"), touched)),
    }


def advance(store: KeyedTables, n: int, judged: DataFrame, order: list[str], horizon_days: int = 7) -> None:
    """Applies batch n of judged envelopes (received_at, each event once) to the tables, as `ingest` does to its state.

    Costs what the batch touches: its keys' buckets are rewritten, the ledger is appended to. A batch committed before changes
    nothing; one that died is run again from the manifest before it. Clicks, plays and derived watches are remembered for
    horizon_days, as are bumps against which late ones are held.
    """
    last, _ = store.last()
    if n <= last:
        return
    _, old = store.last(before=n)
    batch = numbered(judged, n, order, f"{store.root}/batches/{n}/events")
    spark = store.spark
    kind = F.when(F.col("_why").isNull(), classify(F.col("type")))
    config = F.col("type") == "search.config_updated"
    facts = batch.agg(F.count(F.lit(1)), F.max("received_at"), F.count_if((kind == "accepted") & ~config & (F.col("type") != "user.history_deleted")), F.count_if((kind == "accepted") & config)).first()
    if not facts[0]:
        store.commit(n, old, {})
        return
    now = F.lit(facts[1])
    since = now - F.make_dt_interval(F.lit(horizon_days))
    ok = batch.filter("_why IS NULL")
    domain = ok.filter(classify(F.col("type")) == "accepted")
    rows_path = f"{store.root}/batches/{n}/rows"
    ledger_rows(ok.filter(F.col("type").isin(*BEHAVIOUR_TYPES)).withColumn("id", F.col("seq")), ("id",)).write.mode("overwrite").parquet(rows_path)
    rows = spark.read.parquet(rows_path)
    gone = domain.filter("type = 'user.history_deleted'").select(F.col("p.user_id").alias("user_id"), F.coalesce("p.scope", F.lit("all")).alias("scope")).distinct()
    watches, changed = _watches(store, n, old, rows, since)
    added = rows.unionByName(watches, allowMissingColumns=True).select(*[f.name for f in T._parse_datatype_string(STATE["ledger"]).fields])

    def settings() -> dict:
        new = domain.filter("type = 'search.config_updated'").select("seq", F.explode("p.settings").alias("key", "raw"))
        new = new.select("key", stringify_config(F.coalesce("raw", F.lit("null"))).alias("value"), "seq")
        touched = _distinct(new, store.bucket("settings"))
        return {"settings": (touched, store.write("settings", n, first_per_key(store.read("settings", old, touched).unionByName(new), ["key"], [F.col("seq").desc()]), touched))}

    def appended() -> dict:
        _append(store, "ledger", n, added, "day")
        _append(store, "failures", n, failures(batch))
        _append(store, "erasures", n, gone.filter("scope IN ('watch', 'all')"))
        return {}

    parts = [appended, lambda: _users(store, n, old, rows, watches, gone), lambda: _trends(store, n, old, rows, now, since)]
    parts += [lambda: _catalogue(store, n, old, domain.filter(~config & (F.col("type") != "user.history_deleted")))] if facts[2] else []
    parts += [settings] if facts[3] else []
    with ThreadPoolExecutor(len(parts)) as pool:  # tables do not depend on one another
        for done in pool.map(lambda part: part(), parts):
            changed |= done
    store.commit(n, old, changed)
    store.files.remove(f"{store.root}/batches/{n}")


def _held(store: KeyedTables, table: str, last: int) -> DataFrame:
    schema = f"{APPENDED[table]}, batch int"
    if not store.files.names(f"{store.root}/{table}"):
        return store.spark.createDataFrame([], schema)
    return store.spark.read.schema(schema).parquet(f"{store.root}/{table}").filter(F.col("batch") <= last)


def read_state(spark: SparkSession, root: str, buckets: int = 64) -> dict[str, DataFrame]:
    """The tables as of the last committed batch. Ledger rows of users who asked for deletion, up to the batch of the request, have no user."""
    store = tables_at(spark, root, buckets)
    last, versions = store.last()
    tables = {t: store.read(t, versions) for t in KEYED}
    asked = _held(store, "erasures", last).groupBy("user_id").agg(F.max("batch").alias("_until"))
    ledger = _held(store, "ledger", last).join(asked, "user_id", "left").withColumn("user_id", F.when(F.coalesce(F.col("batch") <= F.col("_until"), F.lit(False)), None).otherwise(F.col("user_id")))
    names = [f.name for f in T._parse_datatype_string(STATE["ledger"]).fields]
    return tables | {"ledger": ledger.select(*names), "failures": _held(store, "failures", last).drop("batch")}


def erase(spark: SparkSession, root: str, buckets: int = 64) -> int:
    """Takes the ids of users who asked for it out of the ledger's files; rewrites the day and batch partitions that hold any and gives their number. Run between batches."""
    store = tables_at(spark, root, buckets)
    last, _ = store.last()
    asked = _held(store, "erasures", last).groupBy("user_id").agg(F.max("batch").alias("_until"))
    ledger = _held(store, "ledger", last)
    hit = ledger.join(asked, "user_id").filter("batch <= _until").select("day", "batch").distinct()
    beside = f"{store.root}/erasing"
    rows = ledger.join(hit, ["day", "batch"], "left_semi").join(asked, "user_id", "left")
    rows = rows.withColumn("user_id", F.when(F.coalesce(F.col("batch") <= F.col("_until"), F.lit(False)), None).otherwise(F.col("user_id"))).drop("_until").select(*ledger.columns)
    rows.write.mode("overwrite").parquet(beside)  # first beside: a partition is not read and replaced at once
    clean = spark.read.schema(rows.schema).parquet(beside)
    n = clean.select("day", "batch").distinct().count()
    clean.repartition("day", "batch").write.partitionBy("day", "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{store.root}/ledger")
    store.files.remove(beside)
    return n


def with_lines(rows: DataFrame) -> DataFrame:
    """Rows with _line, their number within the task that reads them, so in order within a block of a file. Streams have no expression for that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            yield batch.append_column("_line", pa.array(range(n, n + batch.num_rows), pa.int64()))
            n += batch.num_rows

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("_line", T.LongType())]))


def unique_judged(spark: SparkSession, path: str, as_of: Column | None = None, files: int = 1000, horizon: str = "7 days") -> DataFrame:
    """The stream of judged envelopes, each event once within the horizon of its intake.

    Ids are remembered in the stream's state store, which forgets them after the horizon, so it does not grow with history. Of
    copies in one batch any stays. Events that fail are known by their content too, so a corrected one passes.
    """
    place = {"_file_time": "file_modification_time", "_file": "file_path", "_block": "file_block_start"}
    rows = with_lines(read_events(spark, path, streaming=True, files=files).select("*", *[F.col(f"_metadata.{c}").alias(name) for name, c in place.items()]))
    rows = rows.withColumn("received_at", F.current_timestamp() if as_of is None else as_of)
    rows = judge(rows, F.col("received_at"))
    once = F.when(F.col("_why").isNull(), F.col("event_id")).otherwise(F.concat_ws("|", F.lit("failed"), "event_id", "type", F.sha1(F.coalesce("payload", F.lit("")))))
    return rows.withColumn("_once", once).withWatermark("received_at", horizon).dropDuplicatesWithinWatermark(["_once"])


def run_ingest(spark: SparkSession, path: str, root: str, checkpoint: str, as_of: Column | None = None, files: int = 1000, buckets: int = 64, horizon_days: int = 7) -> StreamingQuery:
    """Ingests a stream of envelope files batch by batch into the tables of a folder, from which read_state reads. A batch takes `files` files at most.

    Needs the RocksDB state store for many ids (spark.sql.streaming.stateStore.providerClass). as_of is the time of intake, the batch's own if not given.
    """
    store = tables_at(spark, root, buckets)

    def each(batch: DataFrame, n: int) -> None:
        advance(store, n, batch, ["_file_time", "_file", "_block", "_line"], horizon_days)

    return unique_judged(spark, path, as_of, files, f"{horizon_days} days").writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
