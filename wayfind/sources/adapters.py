"""Views over the star-schema tables: a video catalogue, behaviour events, baskets, texts and queries.

Timestamps come without a zone and are read as UTC, so sessions should run with spark.sql.session.timeZone UTC.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: when catalogue and behaviour queries are asked
CATALOGUE_AS_OF = "2002-01-01 00:00:00"
BEHAVIOUR_AS_OF = "2024-01-31 00:00:00"


#: how much larger rows are than their compressed files, at least: a column of keys is one or two bytes a row there, and over 40 in a broadcast table
COMPRESSION = "spark.sql.sources.fileCompressionFactor"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder.

    Spark takes the size of files for that of rows, and so sends tables of millions of rows through the driver to be broadcast. Where
    the session has no factor of its own for that, it is set to 10; adaptive execution still broadcasts what turns out to be small.
    """
    if float(spark.conf.get(COMPRESSION, "1.0")) == 1.0:
        spark.conf.set(COMPRESSION, "10.0")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of(text: str):
    return F.lit(text).cast("timestamp")


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a part: title, channel, tags, privacy, state, views and dates from its orders. Ids are longs."""
    sold = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("views"), F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("likes"), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship")
    )
    key = F.col("p_partkey")
    out = table(spark, sf_dir, "part").join(sold, F.col("p_partkey") == F.col("l_partkey"), "left")
    return out.select(
        key.alias("video_id"),
        F.lit("local").alias("kind"),
        F.col("p_brand").alias("channel_id"),
        F.col("p_brand").alias("channel_name"),
        F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("channel_handle"),
        (key % 7).alias("owner_id"),
        F.col("p_name").alias("title"),
        F.lit("").alias("description"),
        F.col("p_type").alias("category"),
        F.array(F.lower("p_type"), F.split_part("p_name", F.lit(" "), F.lit(2))).alias("tags"),
        F.when(key % 4 == 0, "en").when(key % 4 == 1, "es").when(key % 4 == 2, "fr").otherwise("de").alias("language"),
        (F.col("p_size") * 10).cast("int").alias("duration_seconds"),
        (F.col("p_size") >= 46).alias("is_sensitive"),
        F.when(key % 17 == 0, "private").otherwise("public").alias("privacy"),
        F.when(key % 13 == 0, "draft").otherwise("published").alias("state"),
        F.coalesce("views", F.lit(0)).cast("long").alias("views"),
        F.coalesce("likes", F.lit(0)).cast("long").alias("likes"),
        F.when(key % 50 == 0, None).otherwise(F.col("first_ship")).cast("timestamp").alias("published_at"),
        F.coalesce(F.col("last_ship").cast("timestamp"), as_of("1995-01-01 00:00:00")).alias("source_updated_at"),
    ).withColumn("eligible", (F.col("privacy") == "public") & (F.col("state") == "published"))


def behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an event, as a search or watch event; a session is a user's day, and a tenth of the users are anonymous."""
    kinds = {"view": "video.impression", "click": "search.result_clicked", "purchase": "video.play_started", "error": "video.watch_progress"}
    name = F.lit("search.submitted")
    for k, v in kinds.items():
        name = F.when(F.col("event_type") == k, v).otherwise(name)
    words = table(spark, sf_dir, "part").filter("p_partkey < 8").select(F.col("p_partkey").alias("k"), "p_name")
    events = table(spark, sf_dir, "events").join(F.broadcast(words), F.col("k") == F.col("user_id") % 8)  # eight rows
    return events.select(
        F.col("event_id").alias("id"),
        "event_id",
        name.alias("type"),
        F.when(F.col("user_id") % 10 == 0, None).otherwise(F.col("user_id")).alias("user_id"),
        F.concat(F.lit("s"), F.col("user_id").cast("string"), F.lit("-"), F.col("ts").cast("date").cast("string")).alias("session_id"),
        F.when(F.col("event_type") == "error", None).otherwise(F.col("p_name")).alias("normalized_query"),
        F.when(F.col("event_type") == "signup", None).otherwise(F.regexp_extract("props", "([0-9]+)", 1).try_cast("long")).alias("video_id"),
        (F.col("event_id") % 10).cast("int").alias("position"),
        F.col("value").alias("position_seconds"),
        (F.lit(100.0) + F.col("user_id")).alias("duration_seconds"),
        (F.col("user_id") % 3 == 0).alias("allow_history"),
        F.col("ts").cast("timestamp").alias("occurred_at"),
    )


def basket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sessions, parts as videos; dealt by session, which is how most readers want it."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_partkey").alias("video_id"))
    return lines.repartition("session_id").distinct().select("session_id", F.col("video_id").alias("id"), "video_id")


def text_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a catalogue: the first six words are the title, the text is the body."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("video_id"),
        F.array_join(F.slice(F.split("text", " "), 1, 6), " ").alias("title"),
        F.col("text").alias("body"),
        F.array().cast("array<string>").alias("tags"),
        F.col("lang").alias("language"),
        F.col("source").alias("channel_id"),
        F.col("source").alias("channel_name"),
        F.lit(None).cast("string").alias("category"),
        F.lit(False).alias("is_sensitive"),
        F.lit(True).alias("eligible"),
        F.col("n_chars").alias("views"),
        (as_of("2020-01-01 00:00:00") + F.make_dt_interval(F.col("doc_id").cast("int"))).alias("published_at"),
        as_of("2020-01-01 00:00:00").alias("source_updated_at"),
    )


def text_queries(spark: SparkSession, sf_dir: str, words: int = 1) -> DataFrame:
    """A query a benchmark item: its second word, or second and third, letters only, lower-case."""
    w = F.split("text", " ")
    parts = [F.regexp_replace(F.lower(F.try_element_at(w, F.lit(k + 2))), r"[^\p{L}]", "") for k in range(words)]
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat_ws(" ", *parts).alias("query")).filter("query <> ''")


def title_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search requests over the catalogue: a part's first title word, alternately with sensitive items hidden."""
    p = table(spark, sf_dir, "part")
    return p.groupBy(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("query")).agg(F.min("p_partkey").alias("query_id")).withColumn("hide_sensitive", F.col("query_id") % 2 == 0)


#: DuckDB forms of the same views, as common table expressions
VIEWS = {
    "catalogue": """catalogue AS (
  SELECT p.p_partkey AS video_id, 'local' AS kind, p.p_brand AS channel_id, p.p_brand AS channel_name,
         lower(replace(p.p_brand, '#', '-')) AS channel_handle, p.p_partkey % 7 AS owner_id, p.p_name AS title, '' AS description, p.p_type AS category,
         [lower(p.p_type), split_part(p.p_name, ' ', 2)] AS tags,
         CASE p.p_partkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'es' WHEN 2 THEN 'fr' ELSE 'de' END AS language,
         p.p_size * 10 AS duration_seconds, p.p_size >= 46 AS is_sensitive,
         CASE WHEN p.p_partkey % 17 = 0 THEN 'private' ELSE 'public' END AS privacy,
         CASE WHEN p.p_partkey % 13 = 0 THEN 'draft' ELSE 'published' END AS state,
         coalesce(l.views, 0) AS views, coalesce(l.likes, 0)::BIGINT AS likes,
         CASE WHEN p.p_partkey % 50 = 0 THEN NULL ELSE l.first_ship END AS published_at,
         coalesce(l.last_ship, TIMESTAMP '1995-01-01 00:00:00') AS source_updated_at,
         p.p_partkey % 17 <> 0 AND p.p_partkey % 13 <> 0 AS eligible
  FROM part p LEFT JOIN (SELECT l_partkey, count(*) AS views, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS likes,
                                min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_partkey) l ON l.l_partkey = p.p_partkey)""",
    "behaviour": """behaviour AS (
  SELECT e.event_id AS id, e.event_id AS event_id,
         CASE e.event_type WHEN 'view' THEN 'video.impression' WHEN 'click' THEN 'search.result_clicked'
              WHEN 'purchase' THEN 'video.play_started' WHEN 'error' THEN 'video.watch_progress' ELSE 'search.submitted' END AS type,
         CASE WHEN e.user_id % 10 = 0 THEN NULL ELSE e.user_id END AS user_id,
         concat('s', cast(e.user_id AS varchar), '-', cast(cast(e.ts AS date) AS varchar)) AS session_id,
         CASE WHEN e.event_type = 'error' THEN NULL ELSE q.p_name END AS normalized_query,
         CASE WHEN e.event_type = 'signup' THEN NULL ELSE try_cast(regexp_extract(e.props, '([0-9]+)', 1) AS bigint) END AS video_id,
         cast(e.event_id % 10 AS int) AS position, e.value AS position_seconds,
         100.0::DOUBLE + e.user_id AS duration_seconds, e.user_id % 3 = 0 AS allow_history, e.ts AS occurred_at
  FROM events e JOIN part q ON q.p_partkey = e.user_id % 8)""",
    "basket": """basket AS (SELECT DISTINCT l_orderkey AS session_id, l_partkey AS id, l_partkey AS video_id FROM lineitem)""",
    "text_docs": r"""text_docs AS (
  SELECT doc_id AS video_id, array_to_string(list_slice(string_split(text, ' '), 1, 6), ' ') AS title, text AS body,
         lang AS language, source AS channel_name, n_chars AS views, TIMESTAMP '2020-01-01' + to_days(doc_id::INT) AS published_at FROM documents)""",
    "text_queries": r"""text_queries AS (
  SELECT * FROM (SELECT item_id AS query_id, regexp_replace(lower(string_split(text, ' ')[2]), '[^\p{L}]', '', 'g') AS query FROM benchmark) WHERE query <> '')""",
    "title_queries": """title_queries AS (
  SELECT split_part(p_name, ' ', 1) AS query, min(p_partkey) AS query_id, min(p_partkey) % 2 = 0 AS hide_sensitive FROM part GROUP BY 1)""",
}


def views(*names: str) -> str:
    """The opening of a DuckDB statement over these views."""
    return "WITH RECURSIVE " + ",\n".join(VIEWS[n] for n in names)
