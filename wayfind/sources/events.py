"""Event envelopes: reading, decoding, intake, and projections of configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfind.operators.predicates import known_type
from wayfind.sources.schemas import ENVELOPE, PAYLOAD

UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
#: which id a type cannot do without
NEEDS = {
    "video.upsert": "p.video.id", "video.suppress": "p.video_id", "video.stats": "p.video_id", "channel.upsert": "p.channel.id", "channel.delete": "p.channel_id", "user.suppress": "p.user_id",
    "user.history_deleted": "p.user_id", "reconcile.page": "p.run_id", "reconcile.end": "p.run_id", "search.result_clicked": "p.video_id", "video.impression": "p.video_id",
    "video.play_started": "p.video_id", "video.watch_progress": "p.video_id", "video.completed": "p.video_id",
}
LAG_BUCKETS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 300.0)  # fixed values


def read_events(spark: SparkSession, path: str, streaming: bool = False, files: int = 1000) -> DataFrame:
    """Envelopes from a folder of JSON lines; a stream takes `files` files a batch at most."""
    reader = spark.readStream.option("maxFilesPerTrigger", files) if streaming else spark.read
    return reader.schema(ENVELOPE).json(path)


def judge(events: DataFrame, ingested_at: Column) -> DataFrame:
    """The envelopes with payload columns p and _why, null where the event can be applied.

    Payloads that aren't JSON, and ids that aren't UUIDs where the type needs one, fail. Unknown types pass. An event
    without time has the time of intake.
    """
    known = known_type(F.col("type")) != "unknown"

    def judged(p: Column) -> Column:
        need = F.lit(None).cast("string")
        for t, path in NEEDS.items():
            field = p
            for name in path.split(".")[1:]:
                field = field[name]
            need = F.when(F.col("type") == t, F.coalesce(field, F.lit(""))).otherwise(need)
        bad_user = p["user_id"].isNotNull() & ~p["user_id"].rlike(UUID)
        why = F.when(F.col("payload").isNull() | p["_corrupt"].isNotNull(), "bad json").when(known & need.isNotNull() & ~need.rlike(UUID), "bad id").when(known & bad_user, "bad user id")
        return F.struct(p.alias("p"), why.alias("why"))

    payload = F.from_json("payload", PAYLOAD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    one = F.transform(F.array(payload), judged)[0]  # as a lambda's argument the payload is parsed once; as a column it would be for every field named
    rows = events.withColumn("_j", one)
    return rows.withColumns({"p": F.col("_j.p"), "_why": F.col("_j.why"), "occurred_at": F.coalesce("occurred_at", ingested_at)}).drop("_j")


def decode(events: DataFrame, ingested_at: Column) -> tuple[DataFrame, DataFrame]:
    """(ok, failed). ok: the envelope with payload columns p; failed: event_id, code, message."""
    rows = judge(events, ingested_at)
    return rows.filter("_why IS NULL").drop("_why"), failures(rows)


def failures(judged: DataFrame) -> DataFrame:
    return judged.filter("_why IS NOT NULL").select("event_id", F.lit("apply_failed").alias("code"), F.col("_why").alias("message"))


def dedupe(events: DataFrame, seen: DataFrame | None = None, order: str = "seq") -> DataFrame:
    """The first of each event_id, without those seen before. Decode first: events that fail aren't seen, so they can be sent again."""
    first = events.withColumn("_n", F.row_number().over(Window.partitionBy("event_id").orderBy(order))).filter("_n = 1").drop("_n")
    return first if seen is None else first.join(seen.select("event_id"), "event_id", "left_anti")


def with_horizon(events: DataFrame, horizon: str = "7 days") -> DataFrame:
    """For streams: events later than the horizon are dropped by Spark, where an inbox that forgets would apply them again."""
    return events.withWatermark("occurred_at", horizon)


def stringify_config(raw: Column) -> Column:
    """A JSON value's text: whole numbers without fraction, null as empty, all else as it is."""
    whole = raw.rlike(r"^-?\d+\.0+$")
    return F.when(raw.isNull() | (raw == "null"), "").when(whole, F.regexp_replace(raw, r"\.0+$", "")).otherwise(raw)


def project_config(events: DataFrame, order: str = "seq") -> DataFrame:
    """key, value: each setting's last value. events: order column, settings (map)."""
    each = events.select(order, F.explode("settings").alias("key", "raw"))
    return each.groupBy("key").agg(F.max_by(F.coalesce("raw", F.lit("null")), order).alias("raw")).select("key", stringify_config(F.col("raw")).alias("value"))


def lag_histogram(lags: DataFrame, lag: str = "lag_s") -> DataFrame:
    """le, n: how many lags are at most each bound; negative lags are left out. The last bound is infinite."""
    rows = lags.filter(F.col(lag) >= 0)
    counts = rows.agg(*[F.count_if(F.col(lag) <= b).alias(f"b{k}") for k, b in enumerate(LAG_BUCKETS)], F.count(F.lit(1)).alias("rest"))
    names = [*[str(b) for b in LAG_BUCKETS], "inf"]
    cells = [F.struct(F.lit(n).alias("le"), F.col(c).alias("n")) for n, c in zip(names, counts.columns, strict=True)]
    return counts.select(F.explode(F.array(*cells)).alias("c")).select("c.le", "c.n")


def synthetic_corpus(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """n documents with titles of adjective, topic and noun, topics from 8000 words, and views that fall off like a power law."""
    adjectives, nouns = ("quick", "deep", "simple", "modern", "daily"), ("guide", "review", "tour", "lesson", "story")
    pick = lambda words, h: F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(h, F.lit(len(words))) + 1).cast("int"))
    topic = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(8000)).cast("int")
    letters = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.char(F.lit(97) + F.pmod(F.floor(topic * 7919 / F.pow(F.lit(26.0), k)), F.lit(26)).cast("int"))), "")
    rows = spark.range(n).withColumn("topic", letters)
    return rows.select(
        F.col("id").alias("video_id"),
        F.concat_ws(" ", pick(adjectives, F.xxhash64("id", F.lit(seed + 1))), "topic", pick(nouns, F.xxhash64("id", F.lit(seed + 2)))).alias("title"),
        F.floor(F.pow(F.rand(seed) + 1e-6, F.lit(-0.7)) * 10).cast("long").alias("views"),
    )
