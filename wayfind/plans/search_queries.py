"""Queries for search, suggestions, evaluation and experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.functions import text
from wayfind.operators import recall, trending, windows
from wayfind.plans import evaluate, experiment, listwise, search, suggest
from wayfind.plans import behaviour_queries as b
from wayfind.plans.catalogue_queries import bucket_sql
from wayfind.plans.registry import query, r6
from wayfind.sources import adapters as src
from wayfind.sources.scratch import materialised

NOW = f"TIMESTAMP '{src.CATALOGUE_AS_OF}'"
C = src.views("catalogue")
Q = src.views("catalogue", "title_queries")
WORDS = r"[^\p{L}\p{N}]+"


def _now():
    return src.as_of(src.CATALOGUE_AS_OF)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.catalogue(spark, sf_dir)


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-word requests: the first title words of the catalogue."""
    return src.title_queries(spark, sf_dir)


def _words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({expr}), '{WORDS}'), lambda t: t <> '')"


POSTINGS = f"""fields AS (SELECT video_id, {_words("title")} AS t, {_words("array_to_string(tags, ' ')")} AS g, {_words("channel_name")} AS c FROM catalogue),
postings AS (SELECT video_id, unnest(list_concat(list_concat(t, g), c)) AS term, unnest(list_concat(list_concat(list_transform(t, lambda x: 1.0::DOUBLE), list_transform(g, lambda x: 0.4::DOUBLE)), list_transform(c, lambda x: 0.4::DOUBLE))) AS weight, generate_subscripts(list_concat(list_concat(t, g), c), 1) AS pos FROM fields)"""


def _grams(expr: str) -> str:
    return f"list_distinct(flatten(list_transform({_words(expr)}, lambda w: list_transform(range(1, length(w) + 2), lambda k: substr('  ' || w || ' ', k, 3)))))"


GRAMS = f"""tg AS (SELECT DISTINCT lower(title) AS key, {_grams("title")} AS g FROM catalogue),
qg AS (SELECT query_id, query, {_grams("query")} AS g FROM title_queries),
sims AS (SELECT query_id, query, key, len(list_intersect(qg.g, tg.g)) / (len(qg.g) + len(tg.g) - len(list_intersect(qg.g, tg.g))) AS sim FROM qg, tg)"""
RECALL = f"""{Q},
{POSTINGS},
{GRAMS},
ranks AS (SELECT query_id, video_id, sum(weight) AS text_rank FROM title_queries JOIN postings ON term = lower(query) GROUP BY 1, 2),
recall AS (SELECT query_id, video_id FROM ranks UNION SELECT query_id, video_id FROM sims JOIN catalogue ON lower(title) = key WHERE sim >= 0.3
  UNION SELECT query_id, video_id FROM title_queries JOIN catalogue ON list_contains(tags, query) UNION SELECT query_id, video_id FROM title_queries JOIN catalogue ON lower(channel_name) = query),
features AS (SELECT q.query_id, q.query, d.*, coalesce(text_rank, 0) AS text_rank, coalesce(sim, 0) AS trgm_sim,
    (CASE WHEN lower(d.title) = q.query THEN 1.0 ELSE 0 END + CASE WHEN lower(d.channel_name) = q.query THEN 0.5 ELSE 0 END + CASE WHEN list_contains(list_transform(d.tags, lambda x: lower(x)), q.query) THEN 0.5 ELSE 0 END)::DOUBLE AS exact_flags,
    greatest((epoch_us({NOW}) - epoch_us(coalesce(published_at, source_updated_at))) / 1e6 / 86400.0, 0) AS age_days
  FROM found r JOIN title_queries q ON q.query_id = r.query_id JOIN catalogue d ON d.video_id = r.video_id LEFT JOIN ranks k ON k.query_id = r.query_id AND k.video_id = r.video_id
  LEFT JOIN sims s ON s.query_id = r.query_id AND s.key = lower(d.title) WHERE eligible AND (NOT q.hide_sensitive OR NOT is_sensitive))"""
SIMPLE = "0.5 * text_rank + 0.2 * trgm_sim + 0.1 * exact_flags + 0.1 * (ln(1 + views) / 20) + 0.1 * exp(-ln(2) * age_days / 30)"


@query(f"{C},\n{POSTINGS}\nSELECT video_id, term, pos, weight FROM postings")
def weighted_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.postings(_docs(spark, sf_dir)).withColumn("pos", F.col("pos").cast("long"))


DOC_WORDS = f"SELECT query_id, t.doc_id AS video_id FROM text_queries JOIN (SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '{WORDS}'), lambda x: x <> '')) AS term FROM documents) t ON t.term = query"


@query(f"{src.views('text_queries')}\n{DOC_WORDS}")
def fts_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single words of the benchmark in whole documents."""
    return recall.fts_candidates(src.text_queries(spark, sf_dir), text.postings(src.text_docs(spark, sf_dir).withColumn("channel_name", F.lit(""))))


@query(f"{src.views('text_queries')}\nSELECT query_id, doc_id AS video_id, 0.2 * (len(list_filter(words, lambda x: x = query)) - len(list_filter(head, lambda x: x = query))) + 1.2 * len(list_filter(head, lambda x: x = query)) AS text_rank FROM text_queries JOIN (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '{WORDS}'), lambda x: x <> '') AS words, list_filter(regexp_split_to_array(lower(array_to_string(list_slice(string_split(text, ' '), 1, 6), ' ')), '{WORDS}'), lambda x: x <> '') AS head FROM documents) ON list_contains(list_concat(words, head), query)".replace("0.2 * (len(list_filter(words, lambda x: x = query)) - len(list_filter(head, lambda x: x = query))) + 1.2 * len(list_filter(head, lambda x: x = query)) AS text_rank", "round((0.2 * len(list_filter(words, lambda x: x = query)) + len(list_filter(head, lambda x: x = query)))::DOUBLE, 6) AS text_rank"))
def text_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recall.text_rank(src.text_queries(spark, sf_dir), text.postings(src.text_docs(spark, sf_dir).withColumn("channel_name", F.lit(""))))
    return found.select("query_id", "video_id", r6("text_rank"))


@query()
def text_rank_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cover density of two-word queries; a test holds it against a plain version."""
    found = recall.text_rank(src.text_queries(spark, sf_dir, words=2), text.postings(src.text_docs(spark, sf_dir)))
    return found.select("query_id", "video_id", r6("text_rank"))


def _first(items: str) -> str:
    """Without repeats, in order."""
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


PARSED = f"""asked AS (SELECT item_id, concat_ws(' ', '"' || w[1] || ' ' || w[2] || '"', w[3], 'or', w[4], '-' || w[5]) AS q FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)),
rest AS (SELECT item_id, q, regexp_replace(q, '-?"[^"]*"', ' ', 'g') AS r FROM asked),
plain AS (SELECT item_id, q, r, lower(regexp_replace(r, '(^|\\s)-\\S+', ' ', 'g')) AS p FROM rest),
parts AS (SELECT item_id, {_words("regexp_replace(p, '\\S+(?:\\s+or\\s+\\S+)+', ' ', 'g')")} AS must, flatten(list_transform(regexp_extract_all(r, '(^|\\s)-(\\S+)', 2), lambda m: {_words("m")})) AS must_not,
  list_filter(list_transform(regexp_extract_all(q, '(^|\\s)"([^"]*)"', 2), lambda t: {_words("t")}), lambda t: len(t) > 0) AS phrases,
  list_transform(regexp_extract_all(p, '(\\S+(?:\\s+or\\s+\\S+)+)', 1), lambda g: flatten(list_transform(regexp_split_to_array(g, '\\s+or\\s+'), lambda s: {_words("s")}))) AS any_of FROM plain)"""
JOINED = "array_to_string(list_transform({0}, lambda x: array_to_string(x, ' ')), '|')"


@query(f"WITH {PARSED}\nSELECT item_id, array_to_string({_first('must')}, ' ') AS must, array_to_string({_first('must_not')}, ' ') AS must_not, {JOINED.format('phrases')} AS phrases, {JOINED.format('any_of')} AS any_of FROM parts")
def parse_websearch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark openings as queries with a phrase, an alternative and an excluded word."""
    w = F.split("text", " ")
    asked = F.concat_ws(" ", F.concat(F.lit('"'), F.try_element_at(w, F.lit(1)), F.lit(" "), F.try_element_at(w, F.lit(2)), F.lit('"')), F.try_element_at(w, F.lit(3)), F.lit("or"), F.try_element_at(w, F.lit(4)), F.concat(F.lit("-"), F.try_element_at(w, F.lit(5))))
    p = text.parse_websearch(asked)
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.array_join(x, " ")), "|")
    return src.table(spark, sf_dir, "benchmark").select("item_id", F.array_join(p["must"], " ").alias("must"), F.array_join(p["must_not"], " ").alias("must_not"), joined(p["phrases"]).alias("phrases"), joined(p["any_of"]).alias("any_of"))


@query(f"{Q},\n{GRAMS}\nSELECT query_id, key, round(sim, 6) AS sim FROM sims WHERE sim >= 0.3")
def trigram_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = _docs(spark, sf_dir).select(F.lower("title").alias("key"))
    return recall.trigram_join(_queries(spark, sf_dir), titles).select("query_id", "key", r6("trgm_sim", "sim"))


@query(f"{C},\nt AS (SELECT DISTINCT lower(title) AS key, {_grams('title')} AS g FROM catalogue)\nSELECT a.key AS a, b.key AS b, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 6) AS sim FROM t a JOIN t b ON split_part(a.key, ' ', 1) = split_part(b.key, ' ', 1) AND a.key < b.key")
def trigram_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _docs(spark, sf_dir).select(F.lower("title").alias("key")).distinct().withColumn("w", F.split_part("key", F.lit(" "), F.lit(1)))
    both = t.alias("a").join(t.alias("b"), (F.col("a.w") == F.col("b.w")) & (F.col("a.key") < F.col("b.key")))
    return both.select(F.col("a.key").alias("a"), F.col("b.key").alias("b"), r6(text.trigram_similarity(F.col("a.key"), F.col("b.key")), "sim"))


@query(f"{RECALL.replace('features AS', 'found AS (SELECT * FROM recall), features AS').split('features AS')[0].rstrip().rstrip(',')}\nSELECT query_id, video_id FROM recall")
def hybrid_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return recall.recall(_queries(spark, sf_dir), d, text.postings(d))


FEATURES = RECALL.replace("features AS", "found AS (SELECT * FROM recall),\nfeatures AS")


@query(f"{FEATURES}\nSELECT query_id, video_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, published_at DESC NULLS LAST, video_id) AS rank FROM (SELECT *, {SIMPLE} AS score FROM features)) WHERE rank <= 20")
def search_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return search.search_simple(_queries(spark, sf_dir), d, text.postings(d), _now()).select("query_id", "video_id", r6("score"), "rank")


#: orders as engagement: a customer segment's first letter pairs each title word with parts bought by it
ENGAGED = "engagement AS (SELECT split_part(p_name, ' ', 1) AS normalized_query, l_partkey AS video_id, count(*) AS impressions, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS clicks, sum(CASE WHEN l_returnflag = 'R' AND l_quantity > 40 THEN 1 ELSE 0 END)::BIGINT AS meaningful_watches, max(l_shipdate) AS updated_at FROM lineitem JOIN part ON p_partkey = (l_partkey * 7 + l_suppkey) % 97 GROUP BY 1, 2)"


@query(f"{FEATURES}\nSELECT query_id, video_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, published_at DESC NULLS LAST, video_id) AS rank FROM (SELECT *, {SIMPLE} AS score FROM features)) WHERE rank <= 20")
def search_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """search_simple by blocks."""
    d = materialised(_docs(spark, sf_dir), "catalogue")
    return search.search_top(_queries(spark, sf_dir), d, text.postings(d), _now()).select("query_id", "video_id", r6("score"), "rank")


BY_TEXT = f"""{src.views('text_docs', 'text_queries')},
d AS (SELECT video_id, lower(title) AS key, {_words("title")} AS head, {_words("body")} AS words, {_grams("title")} AS g, views, published_at FROM text_docs),
q AS (SELECT query_id, query, {_grams("query")} AS g FROM text_queries),
pairs AS (SELECT query_id, query, video_id, key, views, published_at, len(list_filter(words, lambda x: x = query)) AS b, len(list_filter(head, lambda x: x = query)) AS h,
  coalesce(len(list_intersect(q.g, d.g)) / nullif(len(list_distinct(list_concat(q.g, d.g))), 0), 0) AS sim FROM q, d),
scored AS (SELECT query_id, video_id, published_at, 0.5 * (0.2 * b + h) + 0.2 * sim + CASE WHEN key = query THEN 0.1 ELSE 0 END + 0.1 * (ln(1 + views) / 20) + 0.1 * exp(-ln(2) * greatest(epoch_us({NOW}) - epoch_us(published_at), 0) / 1e6 / 86400 / 30) AS score FROM pairs WHERE b + h > 0 OR sim >= 0.3)"""


@query(f"{BY_TEXT}\nSELECT query_id, video_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, published_at DESC NULLS LAST, video_id) AS rank FROM scored) WHERE rank <= 20")
def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One word of each benchmark item in whole documents, by blocks."""
    d = src.text_docs(spark, sf_dir).withColumn("channel_name", F.lit(""))
    return search.search_top(src.text_queries(spark, sf_dir), d.drop("body"), text.postings(d), _now()).select("query_id", "video_id", r6("score"), "rank")


@query(f"{src.views('text_docs', 'text_queries')},\nd AS (SELECT DISTINCT lower(title) AS key, {_grams('title')} AS g FROM text_docs),\nq AS (SELECT query_id, {_grams('query')} AS g FROM text_queries)\nSELECT query_id, key, round(sim, 6) AS sim FROM (SELECT query_id, key, len(list_intersect(q.g, d.g)) / nullif(len(list_distinct(list_concat(q.g, d.g))), 0) AS sim FROM q, d) WHERE sim >= 0.2")
def similar_document_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One word of each benchmark item against the titles of all documents, by the prefix-filtered join."""
    titles = src.text_docs(spark, sf_dir).select(F.lower("title").alias("key"))
    return recall.trigram_join(src.text_queries(spark, sf_dir), titles, 0.2).select("query_id", "key", r6("trgm_sim", "sim"))


def _engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, words = src.table(spark, sf_dir, "lineitem"), src.table(spark, sf_dir, "part").filter("p_partkey < 97").select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("normalized_query"))
    rows = lines.join(words, F.col("p_partkey") == (F.col("l_partkey") * 7 + F.col("l_suppkey")) % 97)
    back = F.col("l_returnflag") == "R"
    return rows.groupBy("normalized_query", F.col("l_partkey").alias("video_id")).agg(F.count(F.lit(1)).alias("impressions"), F.count_if(back).alias("clicks"), F.count_if(back & (F.col("l_quantity") > 40)).alias("meaningful_watches"), F.max("l_shipdate").cast("timestamp").alias("updated_at"))


ADVANCED = f"""{RECALL.replace("features AS", ENGAGED + ", found AS (SELECT * FROM recall UNION SELECT query_id, video_id FROM engagement JOIN title_queries ON query = normalized_query WHERE clicks > 0), features AS")},
capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(text_rank, 9) DESC, views DESC, video_id) AS rn FROM features) WHERE rn <= 500),
engaged AS (SELECT f.*, coalesce(e.impressions, 0) AS impressions, coalesce(e.clicks, 0) AS clicks, coalesce(e.meaningful_watches, 0) AS mw FROM capped f LEFT JOIN engagement e ON e.normalized_query = f.query AND e.video_id = f.video_id),
scored AS (SELECT *, round({SIMPLE} + 0.3 * ((clicks + 1.0) / (impressions + 10.0) - 0.1) + 0.2 * CASE WHEN mw > 0 THEN mw / (clicks + 5.0) ELSE 0 END, 12) AS base FROM engaged),
penal AS (SELECT *, base - CASE WHEN n > 2 THEN 0.15 * (n - 2) ELSE 0 END AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, channel_id ORDER BY base DESC, video_id) AS n FROM scored))"""


@query(f"{ADVANCED}\nSELECT query_id, video_id, round(text_rank, 6) AS text_rank, round(trgm_sim, 6) AS trgm_sim, exact_flags, impressions, clicks, mw AS meaningful_watches FROM engaged")
def search_advanced_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    found = search.advanced_features(_queries(spark, sf_dir), d, text.postings(d), _engagement(spark, sf_dir), _now())
    return found.select("query_id", "video_id", r6("text_rank"), r6("trgm_sim"), "exact_flags", "impressions", "clicks", "meaningful_watches")


@query(f"{ADVANCED}\nSELECT query_id, video_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, video_id) AS rank FROM penal) WHERE rank <= 20")
def search_advanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return search.search_advanced(_queries(spark, sf_dir), d, text.postings(d), _engagement(spark, sf_dir), _now()).select("query_id", "video_id", r6("score"), "rank")


# suggestions


def _prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first one to three letters of title words and brands."""
    p = src.table(spark, sf_dir, "part")
    words = p.select(F.explode(F.split(F.lower("p_name"), " ")).alias("w")).unionByName(p.select(F.lower("p_brand").alias("w"))).distinct()
    cut = words.select(F.explode(F.array(*[F.substring("w", 1, k) for k in (1, 2, 3)])).alias("query")).distinct()
    return cut.select(F.col("query").alias("query_id"), "query", (F.length("query") == 2).alias("hide_sensitive"))


PREFIXES = "prefixes AS (SELECT DISTINCT query AS query_id, query, length(query) = 2 AS hide_sensitive FROM (SELECT substr(w, k, n) AS query FROM (SELECT DISTINCT unnest(list_append(string_split(lower(p_name), ' '), lower(p_brand))) AS w FROM part), (VALUES (1, 1), (1, 2), (1, 3)) v(k, n)))"
SHOWN = "eligible AND (NOT p.hide_sensitive OR NOT is_sensitive)"
TITLES = f"titles AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY key) AS n FROM (SELECT p.query_id, lower(title) AS key, arg_max(title, (views, -video_id)) AS text, max(views) AS popularity FROM prefixes p JOIN catalogue ON starts_with(lower(title), query) WHERE {SHOWN} GROUP BY 1, 2)) WHERE n <= 15)"


@query(f"{C},\n{PREFIXES},\n{TITLES}\nSELECT query_id, text, popularity FROM titles")
def title_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggest.title_prefix(_prefixes(spark, sf_dir), _docs(spark, sf_dir))


@query(f"{C},\n{PREFIXES},\n{TITLES}\nSELECT query_id, text, popularity FROM titles")
def title_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """title_prefix from the completion table."""
    return suggest.title_lists(_prefixes(spark, sf_dir), suggest.title_completions(_docs(spark, sf_dir)))


@query(f"""{src.views('text_docs')},
once AS (SELECT lower(title) AS key, arg_max(title, (views, -video_id)) AS text, max(views) AS popularity FROM text_docs GROUP BY 1),
cut AS (SELECT key, text, popularity, substr(key, 1, n) AS prefix FROM (SELECT key, text, popularity, unnest(range(1, length(key) + 1)) AS n FROM once))
SELECT prefix, rank, text, popularity FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY key) AS rank FROM cut) WHERE rank <= 15""")
def document_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first titles of every prefix of the documents' titles."""
    return suggest.title_completions(src.text_docs(spark, sf_dir)).filter("NOT hide").select("prefix", "rank", "text", "popularity")


@query(f"{C},\n{PREFIXES}\nSELECT query_id, text, channel_handle, popularity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY popularity DESC, text) AS n FROM (SELECT p.query_id, channel_name AS text, min(channel_handle) AS channel_handle, max(views) AS popularity FROM prefixes p JOIN catalogue ON starts_with(lower(channel_name), query) WHERE {SHOWN} GROUP BY 1, 2)) WHERE n <= 15")
def suggest_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggest.suggest_channels(_prefixes(spark, sf_dir), _docs(spark, sf_dir))


@query(f"{C},\n{PREFIXES}\nSELECT query_id, text, popularity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY popularity DESC, text) AS n FROM (SELECT p.query_id, tag AS text, count(*) AS popularity FROM prefixes p JOIN (SELECT *, unnest(tags) AS tag FROM catalogue) ON starts_with(lower(tag), query) WHERE {SHOWN} GROUP BY 1, 2)) WHERE n <= 15")
def suggest_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggest.suggest_tags(_prefixes(spark, sf_dir), _docs(spark, sf_dir))


@query(f"{C}\nSELECT video_id, unnest(tags) AS tag FROM catalogue")
def explode_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggest.explode_tags(_docs(spark, sf_dir)).select("video_id", "tag")


@query(f"{b.AGGREGATES},\n{PREFIXES}\nSELECT query_id, text, round(popularity, 6) AS popularity FROM (SELECT p.query_id, coalesce(nullif(display_query, ''), normalized_query) AS text, decayed_freq AS popularity, row_number() OVER (PARTITION BY p.query_id ORDER BY round(decayed_freq, 9) DESC, normalized_query) AS n FROM prefixes p JOIN aggregates ON starts_with(normalized_query, query) WHERE suggestible AND NOT banned) WHERE n <= 15")
def aggregate_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggest.aggregate_prefix(_prefixes(spark, sf_dir), b.aggregates(spark, sf_dir)).select("query_id", "text", r6("popularity"))


PERSONAL = "asked AS (SELECT user_id AS query_id, substr(any_value(normalized_query), 1, 1 + user_id::INT % 2) AS query, user_id FROM history GROUP BY user_id)"


def _personal(history: DataFrame) -> DataFrame:
    one = history.groupBy("user_id").agg(F.min("normalized_query").alias("q"))
    return one.select(F.col("user_id").alias("query_id"), F.substring(F.col("q"), F.lit(1), (F.col("user_id") % 2 + 1).cast("int")).alias("query"), "user_id")


@query(f"{src.views('behaviour')},\n{b.HISTORY},\n{PERSONAL.replace('any_value', 'min')}\nSELECT query_id, text, popularity FROM (SELECT a.query_id, coalesce(nullif(display_query, ''), normalized_query) AS text, use_count::DOUBLE AS popularity, row_number() OVER (PARTITION BY a.query_id ORDER BY last_used_at DESC, normalized_query) AS n FROM asked a JOIN history h ON h.user_id = a.user_id AND starts_with(h.normalized_query, a.query)) WHERE n <= 15")
def history_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = b.rollups.search_history(b._events(spark, sf_dir))
    return suggest.history_prefix(_personal(h), h)


@query(f"{b.LOG}\nSELECT DISTINCT session_id AS query_id, normalized_query AS text, 0.0::DOUBLE AS popularity FROM qlog WHERE starts_with(normalized_query, 'b')")
def session_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = b._log(spark, sf_dir).select("session_id", "normalized_query").distinct()
    asked = log.select(F.col("session_id").alias("query_id"), F.lit("b").alias("query"), "session_id").distinct()
    return suggest.session_prefix(asked, log)


@query(f"{Q},\n{GRAMS}\nSELECT query_id, text, round(sim, 6) AS sim, popularity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY key) AS n FROM (SELECT q.query_id, key, any_value(sim) AS sim, arg_max(title, (views, -video_id)) AS text, max(views) AS popularity FROM sims s JOIN title_queries q ON q.query_id = s.query_id JOIN catalogue ON lower(title) = key WHERE sim >= 0.35 AND eligible AND (NOT q.hide_sensitive OR NOT is_sensitive) GROUP BY 1, 2)) WHERE n <= 15")
def title_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggest.title_fuzzy(_queries(spark, sf_dir), _docs(spark, sf_dir)).select("query_id", "text", r6("sim"), "popularity")


@query(f"{C},\n{PREFIXES},\n{TITLES},\nexact AS (SELECT query_id, count(*) AS n FROM titles GROUP BY 1), rest AS (SELECT query_id, 'fuzzy' AS text FROM prefixes WHERE length(query) = 3)\nSELECT query_id, text FROM titles UNION ALL SELECT r.query_id, r.text FROM rest r LEFT JOIN exact e ON e.query_id = r.query_id WHERE coalesce(e.n, 0) < 5")
def fuzzy_if_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _prefixes(spark, sf_dir)
    exact = suggest.title_prefix(p, _docs(spark, sf_dir)).select("query_id", "text", F.lit(True).alias("exact_prefix"))
    fuzzy = p.filter("length(query) = 3").select("query_id", F.lit("fuzzy").alias("text"), F.lit(False).alias("exact_prefix"))
    return windows.fuzzy_if_short(exact, fuzzy, ["query_id"], 5).select("query_id", "text")


@query()
def suggest_blended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All streams but the personal ones, which have queries of their own, blended; a test holds slots and order against a plain version."""
    top = trending.trend_top(b._gated(spark, sf_dir))
    found = suggest.suggest(_prefixes(spark, sf_dir), _docs(spark, sf_dir), b.aggregates(spark, sf_dir), trending=top)
    return found.select("query_id", "rank", "text", "kind", "channel_handle", "personal", r6("score"))


# evaluation


LTR = f"""{src.views("catalogue")},
{ENGAGED},
{POSTINGS},
tg AS (SELECT DISTINCT lower(title) AS key, {_grams("title")} AS g FROM catalogue),
qg AS (SELECT DISTINCT normalized_query AS query, {_grams("normalized_query")} AS g FROM engagement),
ranks AS (SELECT query, video_id, sum(weight) AS text_rank FROM qg JOIN postings ON term = lower(query) GROUP BY 1, 2),
ltr AS (SELECT e.normalized_query AS query, d.video_id, coalesce(text_rank, 0) AS text_rank, len(list_intersect(qg.g, tg.g)) / (len(qg.g) + len(tg.g) - len(list_intersect(qg.g, tg.g))) AS trgm_sim,
    (CASE WHEN lower(d.title) = e.normalized_query THEN 1.0 ELSE 0 END + CASE WHEN lower(d.channel_name) = e.normalized_query THEN 0.5 ELSE 0 END + CASE WHEN list_contains(list_transform(d.tags, lambda x: lower(x)), e.normalized_query) THEN 0.5 ELSE 0 END)::DOUBLE AS exact_flags,
    ln(1 + views) AS log_views, greatest((epoch_us({NOW}) - epoch_us(coalesce(published_at, source_updated_at))) / 1e6 / 86400.0, 0) AS age_days, (clicks + 1.0) / (impressions + 10.0) AS smoothed_ctr,
    CASE WHEN meaningful_watches > 0 THEN meaningful_watches / (clicks + 5.0) ELSE 0 END AS meaningful_rate, CASE WHEN meaningful_watches > 0 THEN 2 WHEN clicks > 0 THEN 1 ELSE 0 END AS label, updated_at
  FROM engagement e JOIN catalogue d ON d.video_id = e.video_id AND eligible JOIN tg ON tg.key = lower(d.title) JOIN qg ON qg.query = e.normalized_query LEFT JOIN ranks r ON r.query = e.normalized_query AND r.video_id = d.video_id)"""


def _ltr(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return evaluate.ltr_dataset(_engagement(spark, sf_dir), d, text.postings(d), _now())


@query(f"{LTR}\nSELECT query, video_id, round(text_rank, 6) AS text_rank, round(trgm_sim, 6) AS trgm_sim, exact_flags, round(log_views, 6) AS log_views, round(age_days, 6) AS age_days, round(smoothed_ctr, 6) AS smoothed_ctr, round(meaningful_rate, 6) AS meaningful_rate, label FROM ltr")
def ltr_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = [r6(c) for c in ("text_rank", "trgm_sim")] + [F.col("exact_flags")] + [r6(c) for c in ("log_views", "age_days", "smoothed_ctr", "meaningful_rate")]
    return _ltr(spark, sf_dir).select("query", "video_id", *r, "label")


@query(f"{LTR}\nSELECT count(*) AS rows, count(DISTINCT query) AS queries, count(*) FILTER (label > 0) AS positives FROM ltr")
def ltr_sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ltr(spark, sf_dir).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("query").alias("queries"), F.count_if(F.col("label") > 0).alias("positives"))


@query(f"{LTR},\nplaces AS (SELECT *, row_number() OVER (ORDER BY updated_at, query, video_id) - 1 AS i, count(*) OVER () AS n FROM ltr),\ncut AS (SELECT min(i) AS c FROM (SELECT i, n, query, lag(query) OVER (ORDER BY i) AS p FROM places) WHERE i >= floor(n * 0.8) AND query IS DISTINCT FROM p)\nSELECT query, video_id, CASE WHEN i < (SELECT coalesce(c, n) FROM cut) THEN 'train' ELSE 'valid' END AS split FROM places")
def ltr_time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.time_split(_ltr(spark, sf_dir)).select("query", "video_id", "split")


@query()
def ranker_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained on the earlier rows, scores for the later ones."""
    rows = materialised(evaluate.time_split(materialised(_ltr(spark, sf_dir), "ltr")), "ltr-split")
    model = evaluate.train_ranker(rows.filter("split = 'train'").drop("split"), iterations=10)
    return evaluate.score_ranker(model, rows.filter("split = 'valid'")).select("query", "video_id", "label", r6("score"))


LAMBDAS = f"""{LTR},
placed AS (SELECT query, video_id, label, smoothed_ctr AS s, row_number() OVER (PARTITION BY query ORDER BY smoothed_ctr DESC, video_id) AS r, row_number() OVER (PARTITION BY query ORDER BY label DESC) AS i FROM ltr),
ideal AS (SELECT query, sum((2 ** label - 1) / log2(i + 1)) AS z FROM placed WHERE i <= 30 GROUP BY 1),
pairs AS (SELECT a.query, a.video_id, sign(a.label - b.label) AS sg, abs(2 ** a.label - 2 ** b.label) * abs(1 / log2(a.r + 1) - 1 / log2(b.r + 1)) / z AS w, 1 / (1 + exp(sign(a.label - b.label) * (a.s - b.s))) AS rho
  FROM placed a JOIN placed b ON a.query = b.query AND a.label <> b.label AND least(a.r, b.r) <= 30 JOIN ideal d ON d.query = a.query WHERE z > 0),
sums AS (SELECT query, video_id, sum(-sg * w * rho) AS g, sum(w * rho * (1 - rho)) AS h FROM pairs GROUP BY 1, 2)"""


@query(f"{LAMBDAS}\nSELECT p.query, p.video_id, round(coalesce(g, 0), 6) AS g, round(coalesce(h, 0), 6) AS h FROM placed p LEFT JOIN sums s ON s.query = p.query AND s.video_id = p.video_id")
def lambda_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all lists in the order of their click rate."""
    rows = listwise.lambda_gradients(_ltr(spark, sf_dir).withColumn("score", F.col("smoothed_ctr")))
    return rows.select("query", "video_id", (F.round("g", 6) + 0.0).alias("g"), r6("h"))


@query()
def ranker_listwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained on the earlier rows by lambda gradients, scores for the later ones."""
    rows = materialised(evaluate.time_split(materialised(_ltr(spark, sf_dir), "ltr")), "ltr-split")  # the cut takes several passes
    model = listwise.train_listwise(rows.filter("split = 'train'"), iterations=4)
    return model.score(rows.filter("split = 'valid'")).select("query", "video_id", "label", r6("score"))


@query()
def shadow_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as shown lists: lines by supplier, returned ones as clicks; the candidate ranks by views alone."""
    d = _docs(spark, sf_dir)
    features = search.advanced_features(_queries(spark, sf_dir), d, text.postings(d), _engagement(spark, sf_dir), _now())
    lines = src.table(spark, sf_dir, "lineitem")
    words = src.table(spark, sf_dir, "part").select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("normalized_query"))
    shown = lines.join(words, F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("l_orderkey").cast("string").alias("session_id"), "normalized_query", F.col("l_partkey").alias("video_id"), (F.col("l_suppkey") % 10).cast("int").alias("position"),
        (F.col("l_partkey") * 10 + F.col("l_suppkey")).alias("id"), (F.col("l_returnflag") == "R").alias("clicked"), ((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40)).alias("meaningful"),
    )
    return evaluate.shadow_eval(shown, features, F.log1p(F.col("views").cast("double")))


# experiments


@query(f"""WITH s AS (SELECT c_custkey AS id, c_custkey::VARCHAR AS subject FROM customer WHERE c_custkey % 10 <> 0),
b AS (SELECT id, subject, 'ranker' AS key, {bucket_sql("'s1'", "subject")} AS bucket FROM s UNION ALL SELECT id, subject, 'layout', {bucket_sql("'s2'", "subject")} FROM s)
SELECT id, subject, key, bucket, CASE WHEN key = 'layout' THEN 'all' WHEN bucket < 60 THEN 'control' ELSE 'candidate' END AS variant, CASE WHEN key = 'layout' THEN '' WHEN bucket < 60 THEN 'v1' ELSE 'v2' END AS model_version
FROM b WHERE key = 'layout' OR bucket < 90""")
def experiment_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers into two experiments; every tenth has no subject."""
    k = F.col("c_custkey")
    subjects = src.table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 10 == 0, "").otherwise(k.cast("string")).alias("subject"))
    return experiment.assign(subjects, experiment.definitions(spark, experiment.EXAMPLE))


BUCKETS = "buckets AS (SELECT c_custkey AS id, c_custkey % 100 AS bucket FROM customer)"


@query(f"WITH {BUCKETS}\nSELECT id, CASE WHEN bucket < 60 THEN 'control' WHEN bucket < 90 THEN 'candidate' END AS variant FROM buckets WHERE bucket < 90")
def experiment_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("ranker").alias("key"), (F.col("c_custkey") % 100).cast("int").alias("bucket"))
    return experiment.assign_variant(rows, experiment.definitions(spark, experiment.EXAMPLE)).select("id", "variant")
