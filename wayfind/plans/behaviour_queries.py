"""Queries over the behaviour ledger: co-visitation, rollups, derivations, sessions, trending, privacy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.operators import covis, rollups, trending
from wayfind.operators.predicates import BEHAVIOUR_TYPES, HISTORY_TYPES, classify, collects_history, is_meaningful, retain
from wayfind.operators.predicates import same_session as is_same_session
from wayfind.operators.windows import first_per_key, greedy_cap, page, run_groups
from wayfind.plans.registry import query, r6
from wayfind.sources import adapters as src

WINDOW_S = 21600.0
GAP_S = 14400.0
NOW = f"TIMESTAMP '{src.BEHAVIOUR_AS_OF}'"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.behaviour(spark, sf_dir)


def _now():
    return src.as_of(src.BEHAVIOUR_AS_OF)


def with_watches(events: DataFrame) -> DataFrame:
    """The ledger and the meaningful watches derived from it."""
    watches = rollups.derive_meaningful_watch(events)
    same = [c for c in events.columns if c in watches.columns]
    return events.select(*same).unionByName(watches.select(*same))


CO_WATCH = f"""watch AS (SELECT * FROM behaviour WHERE type = 'video.play_started' AND session_id IS NOT NULL AND video_id IS NOT NULL),
co_watch AS (SELECT least(n.video_id, p.video_id) AS video_a, greatest(n.video_id, p.video_id) AS video_b, count(*) AS count
  FROM watch n JOIN watch p ON p.session_id = n.session_id AND p.id < n.id AND p.video_id <> n.video_id AND abs(epoch_us(n.occurred_at) - epoch_us(p.occurred_at)) <= {WINDOW_S} * 1000000 GROUP BY 1, 2)"""
CO_SEARCH = f"""clk AS (SELECT * FROM behaviour WHERE type = 'search.result_clicked' AND session_id IS NOT NULL AND video_id IS NOT NULL AND normalized_query IS NOT NULL),
co_search AS (SELECT least(n.video_id, p.video_id) AS video_a, greatest(n.video_id, p.video_id) AS video_b, count(*) AS count
  FROM clk n JOIN clk p ON p.session_id = n.session_id AND p.normalized_query = n.normalized_query AND p.id < n.id AND p.video_id <> n.video_id
       AND abs(epoch_us(n.occurred_at) - epoch_us(p.occurred_at)) <= {WINDOW_S} * 1000000 GROUP BY 1, 2)"""
EDGES = """cw AS (SELECT video_a AS i, video_b AS j, count::DOUBLE AS c FROM co_watch UNION ALL SELECT video_b, video_a, count FROM co_watch),
cs AS (SELECT video_a AS i, video_b AS j, count::DOUBLE AS c FROM co_search UNION ALL SELECT video_b, video_a, count FROM co_search),
cwt AS (SELECT i, sum(c) AS t FROM cw GROUP BY i), cst AS (SELECT i, sum(c) AS t FROM cs GROUP BY i),
w AS (SELECT cw.i, cw.j, c / sqrt(a.t * b.t) * (c / (c + 10)) AS s FROM cw JOIN cwt a ON a.i = cw.i JOIN cwt b ON b.i = cw.j),
s AS (SELECT cs.i, cs.j, c / sqrt(a.t * b.t) * (c / (c + 10)) AS s FROM cs JOIN cst a ON a.i = cs.i JOIN cst b ON b.i = cs.j),
edges AS (SELECT coalesce(w.i, s.i) AS i, coalesce(w.j, s.j) AS j, 0.7 * coalesce(w.s, 0) + 0.3 * coalesce(s.s, 0) AS score FROM w FULL JOIN s ON w.i = s.i AND w.j = s.j),
neighbors AS (SELECT i AS video_id, j AS neighbor_id, score FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(score, 9) DESC, j) AS rn FROM edges WHERE score > 0) WHERE rn <= 100)"""
BASKET_EDGES = """pairs AS (SELECT a.video_id AS i, b.video_id AS j, count(*)::DOUBLE AS c FROM basket a JOIN basket b ON a.session_id = b.session_id AND a.video_id <> b.video_id GROUP BY 1, 2),
mass AS (SELECT i, sum(c) AS t FROM pairs GROUP BY i),
edges AS (SELECT pairs.i, pairs.j, 0.7 * (c / sqrt(a.t * b.t) * (c / (c + 10))) AS score FROM pairs JOIN mass a ON a.i = pairs.i JOIN mass b ON b.i = pairs.j),
neighbors AS (SELECT i AS video_id, j AS neighbor_id, score FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(score, 9) DESC, j) AS rn FROM edges WHERE score > 0) WHERE rn <= 100)"""
BEHAVIOUR_NEIGHBORS = f"{src.views('behaviour')},\n{CO_WATCH},\n{CO_SEARCH},\n{EDGES}"


@query(f"{BEHAVIOUR_NEIGHBORS}\nSELECT video_id, neighbor_id, round(score, 6) AS score, 'blend' AS source FROM neighbors")
def covis_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covis.covis_neighbors(_events(spark, sf_dir), WINDOW_S).select("video_id", "neighbor_id", r6("score"), "source")


@query(f"{src.views('basket')},\n{BASKET_EDGES}\nSELECT video_id, neighbor_id, round(score, 6) AS score FROM neighbors")
def covis_neighbors_basket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covis.basket_neighbors(src.basket(spark, sf_dir)).select("video_id", "neighbor_id", r6("score"))


@query(f"{src.views('behaviour')},\n{CO_WATCH}\nSELECT * FROM co_watch")
def co_watch_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted in two increments, which must give what one recount gives."""
    e = _events(spark, sf_dir)
    cut = e.agg((F.max("id") / 2).alias("cut")).first()["cut"]
    old, late = e.filter(F.col("id") <= cut), e.filter(F.col("id") > cut)
    return covis.merge_counts(covis.co_watch_pairs(old, old, WINDOW_S), covis.co_watch_pairs(late, e, WINDOW_S))


@query(f"{src.views('behaviour')},\n{CO_SEARCH}\nSELECT * FROM co_search")
def co_search_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return covis.co_search_pairs(e, e, WINDOW_S)


@query(f"{src.views('behaviour')},\n{CO_WATCH}\nSELECT i, sum(c)::DOUBLE AS t FROM (SELECT video_a AS i, count AS c FROM co_watch UNION ALL SELECT video_b, count FROM co_watch) GROUP BY i")
def node_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return covis.node_mass(covis.co_watch_pairs(e, e, WINDOW_S))


@query(f"{src.views('behaviour')},\n{CO_WATCH}\nSELECT video_a AS i, video_b AS j, count::DOUBLE AS c FROM co_watch UNION ALL SELECT video_b, video_a, count::DOUBLE FROM co_watch")
def symmetrise(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return covis.symmetrise(covis.co_watch_pairs(e, e, WINDOW_S))


@query(f"{BEHAVIOUR_NEIGHBORS}\nSELECT i, j, round(score, 6) AS score FROM edges")
def blend_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return covis.blend_edges(covis.co_watch_pairs(e, e, WINDOW_S), covis.co_search_pairs(e, e, WINDOW_S)).select("i", "j", r6("score"))


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sessions, what they ordered first as seeds."""
    o = src.table(spark, sf_dir, "orders").join(src.basket(spark, sf_dir), F.col("o_orderkey") == F.col("session_id"))
    return o.select(F.col("o_custkey").alias("seed_key"), "video_id").distinct()


SEEDS = f"{src.views('basket')},\n{BASKET_EDGES},\nseeds AS (SELECT DISTINCT o_custkey AS seed_key, video_id FROM orders JOIN basket ON o_orderkey = session_id)"


@query(f"{src.views('basket')},\n{BASKET_EDGES}\nSELECT video_id AS seed_id, neighbor_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY round(score, 9) DESC, neighbor_id) AS rn FROM neighbors) WHERE rn <= 10")
def neighbors_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = covis.basket_neighbors(src.basket(spark, sf_dir))
    seeds = n.select(F.col("video_id").alias("seed_id"), "video_id").distinct()
    return covis.neighbors_for(seeds, n, 10).select("seed_id", "neighbor_id", r6("score"))


@query(f"{SEEDS}\nSELECT seed_key, video_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY seed_key ORDER BY round(score, 9) DESC, video_id) AS rn FROM (SELECT seed_key, neighbor_id AS video_id, sum(score) AS score FROM seeds s JOIN neighbors n ON n.video_id = s.video_id WHERE NOT EXISTS (SELECT 1 FROM seeds x WHERE x.seed_key = s.seed_key AND x.video_id = n.neighbor_id) GROUP BY 1, 2)) WHERE rn <= 20")
def seed_set_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covis.seed_topk(_seeds(spark, sf_dir), covis.basket_neighbors(src.basket(spark, sf_dir)), 20).select("seed_key", "video_id", r6("score"))


WANTED = "wanted AS (SELECT DISTINCT s.seed_key, b.p_partkey AS video_id FROM seeds s JOIN part a ON a.p_partkey = s.video_id JOIN part b ON b.p_brand = a.p_brand AND b.p_size = a.p_size)"


@query(f"{SEEDS},\n{WANTED}\nSELECT seed_key, neighbor_id AS video_id, round(sum(score), 6) AS score FROM seeds s JOIN neighbors n ON n.video_id = s.video_id WHERE EXISTS (SELECT 1 FROM wanted w WHERE w.seed_key = s.seed_key AND w.video_id = n.neighbor_id) GROUP BY 1, 2")
def seed_set_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand and size that the customer has bought as candidates."""
    seeds, n = _seeds(spark, sf_dir), covis.basket_neighbors(src.basket(spark, sf_dir))
    brands = src.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("video_id"), "p_brand", "p_size")
    wanted = seeds.join(brands, "video_id").select("seed_key", "p_brand", "p_size").distinct().join(brands, ["p_brand", "p_size"]).select("seed_key", "video_id")
    return covis.seed_scores(seeds, wanted, n).select("seed_key", "video_id", r6("score"))


PROJECTION = f"{SEEDS},\nprojection AS (SELECT seed_key AS user_id, video_id, 1.0 / (1 + video_id % 4) AS weight FROM seeds)"


def _projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seeds(spark, sf_dir).select(F.col("seed_key").alias("user_id"), "video_id", (1.0 / (1 + F.col("video_id") % 4)).alias("weight"))


@query(f"{PROJECTION}\nSELECT user_id, video_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, video_id) AS rn FROM (SELECT user_id, neighbor_id AS video_id, sum(weight * score) AS score FROM projection p JOIN neighbors n ON n.video_id = p.video_id WHERE NOT EXISTS (SELECT 1 FROM projection x WHERE x.user_id = p.user_id AND x.video_id = n.neighbor_id) GROUP BY 1, 2)) WHERE rn <= 20")
def cf_user_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _projection(spark, sf_dir)
    return covis.user_cf_topk(p, p, covis.basket_neighbors(src.basket(spark, sf_dir)), 20).select("user_id", "video_id", r6("score"))


@query(f"{PROJECTION}\nSELECT user_id, neighbor_id AS video_id, round(sum(weight * score), 6) AS affinity FROM projection p JOIN neighbors n ON n.video_id = p.video_id WHERE EXISTS (SELECT 1 FROM projection x WHERE x.user_id = p.user_id AND x.video_id = n.neighbor_id) GROUP BY 1, 2")
def personal_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _projection(spark, sf_dir)
    return covis.personal_affinity(p, p, covis.basket_neighbors(src.basket(spark, sf_dir))).select("user_id", "video_id", r6("affinity"))


@query(f"{PROJECTION}\nSELECT user_id, p_brand AS channel_id, round(sum(weight), 6) AS weight FROM projection JOIN part ON p_partkey = video_id GROUP BY 1, 2")
def channel_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = src.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("video_id"), F.col("p_brand").alias("channel_id"))
    return covis.channel_affinity(_projection(spark, sf_dir), docs).select("user_id", "channel_id", r6("weight"))


# query log and aggregates

LOG = f"{src.views('behaviour')},\nqlog AS (SELECT id, event_id, lower(normalized_query) AS normalized_query, trim(normalized_query) AS display_query, user_id, session_id, occurred_at AS submitted_at FROM behaviour WHERE type = 'search.submitted' AND normalized_query <> '')"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.query_log(_events(spark, sf_dir))


@query(f"{LOG}\nSELECT id, normalized_query, display_query, user_id, session_id, submitted_at FROM qlog")
def query_log_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).select("id", "normalized_query", "display_query", "user_id", "session_id", F.col("submitted_at").cast("timestamp_ntz").alias("submitted_at"))


@query("SELECT event_id, min(event_type) AS event_type FROM (SELECT event_id, event_type FROM events UNION ALL SELECT event_id, event_type FROM events) WHERE event_id % 3 <> 0 GROUP BY 1")
def ledger_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch delivered twice onto a ledger that holds every third event."""
    e = src.table(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("id"), "event_type")
    return rollups.append_ledger(e.unionByName(e), e.filter("event_id % 3 = 0")).select("event_id", "event_type")


@query(f"{LOG}\nSELECT normalized_query, count(*) AS delta, min(submitted_at) AS first_seen, max(submitted_at) AS last_seen FROM qlog GROUP BY 1")
def batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ntz = lambda c, n: F.col(c).cast("timestamp_ntz").alias(n)
    return rollups.batch_counts(_log(spark, sf_dir)).select("normalized_query", "delta", ntz("batch_first_seen", "first_seen"), ntz("batch_last_seen", "last_seen"))


@query(f"{LOG}\nSELECT normalized_query, (count(DISTINCT user_id) + count(DISTINCT CASE WHEN user_id IS NULL THEN session_id END))::INT AS distinct_users FROM qlog WHERE submitted_at >= {NOW} - INTERVAL 20 DAY GROUP BY 1")
def distinct_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    return rollups.distinct_users(log, log.select("normalized_query").distinct(), _now() - F.make_dt_interval(F.lit(20)))


@query(f"{LOG}\nSELECT normalized_query, arg_max(display_query, (submitted_at, id)) AS display_query FROM qlog GROUP BY 1")
def latest_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.latest_display(_log(spark, sf_dir))


AGGREGATES = f"""{LOG},
c1 AS (SELECT normalized_query, count(*) AS d, min(submitted_at) AS f, max(submitted_at) AS l FROM qlog WHERE submitted_at < TIMESTAMP '2024-01-16' GROUP BY 1),
c2 AS (SELECT normalized_query, count(*) AS d, min(submitted_at) AS f, max(submitted_at) AS l FROM qlog WHERE submitted_at >= TIMESTAMP '2024-01-16' GROUP BY 1),
u1 AS (SELECT normalized_query, count(DISTINCT user_id) + count(DISTINCT CASE WHEN user_id IS NULL THEN session_id END) AS n FROM qlog WHERE submitted_at < TIMESTAMP '2024-01-16' GROUP BY 1),
u2 AS (SELECT normalized_query, count(DISTINCT user_id) + count(DISTINCT CASE WHEN user_id IS NULL THEN session_id END) AS n FROM qlog GROUP BY 1),
shown AS (SELECT normalized_query, arg_max(display_query, (submitted_at, id)) AS display_query FROM qlog GROUP BY 1),
shown1 AS (SELECT normalized_query, arg_max(display_query, (submitted_at, id)) AS display_query FROM qlog WHERE submitted_at < TIMESTAMP '2024-01-16' GROUP BY 1),
aggregates AS (
  SELECT coalesce(c2.normalized_query, c1.normalized_query) AS normalized_query, CASE WHEN c2.d IS NULL THEN shown1.display_query ELSE shown.display_query END AS display_query,
         coalesce(c1.d, 0) + coalesce(c2.d, 0) AS total_count, CASE WHEN c2.d IS NULL THEN u1.n ELSE u2.n END AS distinct_users,
         CASE WHEN c2.d IS NULL THEN c1.d ELSE coalesce(c1.d, 0) * CASE WHEN c1.l IS NULL THEN 1 ELSE pow(2, -greatest((epoch_us(c2.l) - epoch_us(c1.l)) / 1e6, 0) / 604800.0) END + c2.d END AS decayed_freq,
         least(c1.f, c2.f) AS first_seen, greatest(c1.l, c2.l) AS last_seen,
         CASE WHEN c2.d IS NULL THEN u1.n ELSE u2.n END >= 3 AS suggestible, false AS banned
  FROM c1 FULL JOIN c2 ON c1.normalized_query = c2.normalized_query
  LEFT JOIN u1 ON u1.normalized_query = c1.normalized_query LEFT JOIN u2 ON u2.normalized_query = c2.normalized_query
  LEFT JOIN shown ON shown.normalized_query = c2.normalized_query LEFT JOIN shown1 ON shown1.normalized_query = c1.normalized_query)"""
AGGREGATE_SCHEMA = "normalized_query string, display_query string, total_count long, distinct_users int, decayed_freq double, first_seen timestamp, last_seen timestamp, suggestible boolean, banned boolean"


def aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two folds: the first half of the month, then the rest."""
    log = _log(spark, sf_dir)
    start = F.lit("2023-01-01").cast("timestamp")
    early = log.filter(F.col("submitted_at") < F.lit("2024-01-16").cast("timestamp"))
    late = log.filter(F.col("submitted_at") >= F.lit("2024-01-16").cast("timestamp"))
    first = rollups.fold_query_aggregates(spark.createDataFrame([], AGGREGATE_SCHEMA), early, early, start)
    return rollups.fold_query_aggregates(first, late, log, start)


@query(f"{AGGREGATES}\nSELECT normalized_query, display_query, total_count, distinct_users::INT AS distinct_users, round(decayed_freq, 6) AS decayed_freq, suggestible, banned FROM aggregates")
def fold_query_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates(spark, sf_dir).select("normalized_query", "display_query", "total_count", "distinct_users", r6("decayed_freq"), "suggestible", "banned")


@query(f"{LOG}\nSELECT normalized_query, round(sum(pow(2, -greatest((epoch_us({NOW}) - epoch_us(submitted_at)) / 1e6, 0) / 604800.0)), 6) AS decayed_freq FROM qlog GROUP BY 1")
def exact_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.exact_frequency(_log(spark, sf_dir), _now()).select("normalized_query", r6("decayed_freq"))


@query(f"{LOG}\nSELECT id, normalized_query FROM qlog WHERE id > 1000 AND id <= (SELECT max(id) FROM qlog WHERE submitted_at <= {NOW} - INTERVAL 5 DAY)")
def settled_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    mark = rollups.settled_high_water(log, _now(), 5 * 86400.0)
    return rollups.scan_range(log.join(mark, F.col("id") <= F.col("maxid")), 1000, F.col("maxid")).select("id", "normalized_query")


@query(f"{src.views('behaviour')}\nSELECT max(id) AS maxid FROM behaviour")
def high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.high_water(_events(spark, sf_dir))


# watches and engagement

WATCHES = """mw AS (SELECT * FROM behaviour WHERE type = 'video.watch_progress' AND video_id IS NOT NULL AND (coalesce(position_seconds, 0) >= 30 OR (duration_seconds > 0 AND coalesce(position_seconds, 0) >= 0.3 * duration_seconds))),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(user_id::VARCHAR, session_id, 'anon'), video_id, occurred_at::DATE ORDER BY id) AS rn FROM mw) WHERE rn = 1),
watches AS (SELECT o.id, o.user_id, o.session_id, o.video_id, o.occurred_at, o.allow_history,
   (SELECT arg_max(b.normalized_query, (b.occurred_at, b.id)) FROM behaviour b WHERE b.session_id IS NOT DISTINCT FROM o.session_id AND b.video_id = o.video_id AND b.type IN ('search.result_clicked', 'video.play_started') AND b.normalized_query IS NOT NULL AND b.occurred_at <= o.occurred_at) AS normalized_query
   FROM once o)"""


@query(f"{src.views('behaviour')},\n{WATCHES}\nSELECT id, user_id, session_id, video_id, normalized_query, allow_history FROM watches")
def derive_meaningful_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.derive_meaningful_watch(_events(spark, sf_dir)).select("id", "user_id", "session_id", "video_id", "normalized_query", "allow_history")


@query(f"{src.views('behaviour')}\nSELECT id, (coalesce(position_seconds, 0) >= 30 OR (duration_seconds > 0 AND coalesce(position_seconds, 0) >= 0.3 * duration_seconds)) AS meaningful FROM behaviour WHERE type = 'video.watch_progress'")
def meaningful_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).filter("type = 'video.watch_progress'").select("id", is_meaningful(F.col("position_seconds"), F.col("duration_seconds")).alias("meaningful"))


ATTRIBUTION = "shows AS (SELECT id, session_id, video_id, occurred_at FROM behaviour WHERE type = 'video.impression')"


@query(f"{src.views('behaviour')},\n{ATTRIBUTION}\nSELECT s.id, (SELECT arg_max(b.normalized_query, (b.occurred_at, b.id)) FROM behaviour b WHERE b.session_id = s.session_id AND b.video_id = s.video_id AND b.type IN ('search.result_clicked', 'video.play_started') AND b.occurred_at <= s.occurred_at) AS query FROM shows s")
def mw_query_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return rollups.attribute_query(e.filter("type = 'video.impression'").select("id", "session_id", "video_id", "occurred_at"), e).select("id", "query")


ENGAGEMENT = """ledger AS (SELECT type, normalized_query, video_id, occurred_at FROM behaviour UNION ALL SELECT 'video.meaningful_watch', normalized_query, video_id, occurred_at FROM watches),
engagement AS (SELECT normalized_query, video_id, count(*) FILTER (type = 'video.impression') AS impressions, count(*) FILTER (type = 'search.result_clicked') AS clicks, count(*) FILTER (type = 'video.meaningful_watch') AS meaningful_watches, max(occurred_at) AS updated_at
  FROM ledger WHERE normalized_query IS NOT NULL AND video_id IS NOT NULL AND type IN ('video.impression', 'search.result_clicked', 'video.meaningful_watch') GROUP BY 1, 2)"""


def engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.engagement_counts(with_watches(_events(spark, sf_dir)))


@query(f"{src.views('behaviour')},\n{WATCHES},\n{ENGAGEMENT}\nSELECT normalized_query, video_id, impressions, clicks, meaningful_watches FROM engagement")
def fold_engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In two increments by time."""
    all_ = with_watches(_events(spark, sf_dir))
    cut = F.lit("2024-01-10").cast("timestamp")
    first = rollups.engagement_counts(all_.filter(F.col("occurred_at") < cut))
    return rollups.fold_engagement(first, all_.filter(F.col("occurred_at") >= cut)).select("normalized_query", "video_id", "impressions", "clicks", "meaningful_watches")


WATCH_PROJECTION = f"""projection AS (SELECT user_id, video_id, sum(w * pow(2, -greatest((epoch_us({NOW}) - epoch_us(occurred_at)) / 1e6, 0) / 2592000.0)) AS weight, max(occurred_at) AS last_watched_at
  FROM (SELECT user_id, video_id, occurred_at, 0.3 AS w FROM behaviour WHERE type = 'video.play_started' AND allow_history AND user_id IS NOT NULL AND video_id IS NOT NULL
        UNION ALL SELECT user_id, video_id, occurred_at, 1.0 FROM watches WHERE allow_history AND user_id IS NOT NULL) GROUP BY 1, 2)"""


def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.watch_projection(with_watches(_events(spark, sf_dir)), _now())


@query(f"{src.views('behaviour')},\n{WATCHES},\n{WATCH_PROJECTION}\nSELECT user_id, video_id, round(weight, 6) AS weight, last_watched_at FROM projection")
def watch_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection(spark, sf_dir).select("user_id", "video_id", r6("weight"), F.col("last_watched_at").cast("timestamp_ntz").alias("last_watched_at"))


WEIGHTS = """weights AS (SELECT user_id, video_id, occurred_at, 0.3 AS w FROM behaviour WHERE type = 'video.play_started' AND allow_history AND user_id IS NOT NULL AND video_id IS NOT NULL
  UNION ALL SELECT user_id, video_id, occurred_at, 1.0 FROM watches WHERE allow_history AND user_id IS NOT NULL),
latest AS (SELECT user_id, video_id, max(occurred_at) AS last FROM weights GROUP BY 1, 2)"""


@query(f"{src.views('behaviour')},\n{WATCHES},\n{WEIGHTS}\nSELECT w.user_id, w.video_id, round(sum(w.w * pow(2, -(epoch_us(l.last) - epoch_us(w.occurred_at)) / 1e6 / 2592000.0)), 6) AS weight FROM weights w JOIN latest l ON l.user_id = w.user_id AND l.video_id = w.video_id GROUP BY 1, 2")
def projection_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights as they hold at each pair's last watch, folded in two increments by time."""
    all_ = with_watches(_events(spark, sf_dir))
    cut = F.lit("2024-01-10").cast("timestamp")
    none = spark.createDataFrame([], "user_id long, video_id long, weight double, last_watched_at timestamp")
    first = rollups.fold_projection(none, all_.filter(F.col("occurred_at") < cut))
    return rollups.fold_projection(first, all_.filter(F.col("occurred_at") >= cut)).select("user_id", "video_id", r6("weight"))


@query(f"{src.views('behaviour')},\n{WATCHES},\n{WATCH_PROJECTION}\nSELECT user_id, video_id, round(weight, 6) AS weight FROM projection WHERE weight * pow(2, -(epoch_us({NOW}) - epoch_us(last_watched_at)) / 1e6 / 2592000.0) >= 0.2")
def prune_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.prune_projection(projection(spark, sf_dir), _now(), floor=0.2).select("user_id", "video_id", r6("weight"))


@query(f"{src.views('behaviour')},\n{WATCHES},\n{WATCH_PROJECTION}\nSELECT user_id, video_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_watched_at DESC, video_id) AS rn FROM projection) WHERE rn <= 5")
def recently_watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfind.plans.recommend import recently_watched as run

    return run(projection(spark, sf_dir), 5)


HISTORY = "history AS (SELECT user_id, lower(normalized_query) AS normalized_query, arg_max(trim(normalized_query), id) AS display_query, count(*) AS use_count, max(occurred_at) AS last_used_at FROM behaviour WHERE type = 'search.submitted' AND allow_history AND user_id IS NOT NULL AND normalized_query <> '' GROUP BY 1, 2)"


@query(f"{src.views('behaviour')},\n{HISTORY}\nSELECT user_id, normalized_query, display_query, use_count, last_used_at FROM history")
def search_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.search_history(_events(spark, sf_dir)).select("user_id", "normalized_query", "display_query", "use_count", F.col("last_used_at").cast("timestamp_ntz").alias("last_used_at"))


def _history_part(name: str, when: str) -> str:
    return HISTORY.replace("history AS", f"{name} AS").replace("WHERE type", f"WHERE occurred_at {when} TIMESTAMP '2024-01-16' AND type")


@query(f"{src.views('behaviour')},\n{_history_part('h1', '<')},\n{_history_part('h2', '>=')}\nSELECT coalesce(h2.user_id, h1.user_id) AS user_id, coalesce(h2.normalized_query, h1.normalized_query) AS normalized_query, coalesce(h2.display_query, h1.display_query) AS display_query, coalesce(h1.use_count, 0) + coalesce(h2.use_count, 0) AS use_count, h2.user_id IS NULL AND h1.user_id % 4 = 1 AS hidden FROM h1 FULL JOIN h2 ON h1.user_id = h2.user_id AND h1.normalized_query = h2.normalized_query")
def history_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of the month, then every fourth user hides all entries, then the rest: what is searched again is shown again."""
    e = _events(spark, sf_dir)
    cut = F.lit("2024-01-16").cast("timestamp")
    first = rollups.search_history(e.filter(F.col("occurred_at") < cut))
    hidden = rollups.hide_history(first, first.filter("user_id % 4 = 1"))
    return rollups.fold_history(hidden, e.filter(F.col("occurred_at") >= cut)).select("user_id", "normalized_query", "display_query", "use_count", "hidden")


@query(f"{src.views('behaviour')},\n{HISTORY},\nasked AS (SELECT DISTINCT user_id, user_id % 7 - 1 AS l, user_id % 3 AS o FROM history)\nSELECT user_id, normalized_query, use_count, rank FROM (SELECT h.*, a.l, a.o, row_number() OVER (PARTITION BY h.user_id ORDER BY last_used_at DESC, normalized_query) AS rank FROM history h JOIN asked a ON a.user_id = h.user_id WHERE NOT (h.user_id % 5 = 2 AND h.use_count = 1)) WHERE rank > o AND rank <= o + CASE WHEN l <= 0 THEN 20 ELSE l END")
def history_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's page; some users have hidden what they searched once."""
    h = rollups.search_history(_events(spark, sf_dir))
    h = rollups.hide_history(h, h.filter("user_id % 5 = 2 AND use_count = 1"))
    asked = h.select("user_id").distinct().select("user_id", (F.col("user_id") % 7 - 1).alias("limit"), (F.col("user_id") % 3).alias("offset"))
    return rollups.history_list(h, asked).select("user_id", "normalized_query", "use_count", "rank")


HISTORY_TOPICS = "topics AS (SELECT user_id, event_type || '-' || (event_id % 7) AS normalized_query, max(ts) AS last_used_at FROM events GROUP BY 1, 2)"


@query(f"WITH {HISTORY_TOPICS}\nSELECT user_id, normalized_query, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_used_at DESC, normalized_query) AS rank FROM topics) WHERE rank > 3 AND rank <= 8")
def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of each user's list, newest first."""
    e = src.table(spark, sf_dir, "events")
    h = e.groupBy("user_id", F.concat_ws("-", "event_type", (F.col("event_id") % 7).cast("string")).alias("normalized_query")).agg(F.max("ts").alias("last_used_at"))
    return page(h, ["user_id"], [F.col("last_used_at").desc(), F.col("normalized_query")], 5, 3).select("user_id", "normalized_query", "rank")


@query(f"{src.views('behaviour')},\n{HISTORY}\nSELECT user_id, normalized_query, use_count FROM history h WHERE NOT (user_id % 4 = 1)")
def delete_history_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = rollups.search_history(_events(spark, sf_dir))
    return rollups.delete_history_entry(h, h.filter("user_id % 4 = 1")).select("user_id", "normalized_query", "use_count")


@query(f"{src.views('behaviour')}\nSELECT id, CASE WHEN user_id % 5 IN (0, 1) THEN NULL ELSE user_id END AS user_id FROM behaviour")
def privacy_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth user asks for all, the next one for search history: their rows stay, without the user."""
    e = _events(spark, sf_dir)
    users = e.filter("user_id IS NOT NULL").select("user_id").distinct()
    requests = users.filter("user_id % 5 < 3").select("user_id", F.element_at(F.array(F.lit("all"), F.lit("search"), F.lit("watch")), (F.col("user_id") % 5 + 1).cast("int")).alias("scope"))
    return rollups.purge_users(e, requests, ("search", "all"), anonymise=True).select("id", "user_id")


@query(f"{src.views('behaviour')}\nSELECT id, type IN ({', '.join(repr(t) for t in HISTORY_TYPES)}) AND allow_history AND user_id IS NOT NULL AS collects FROM behaviour")
def history_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("id", collects_history(F.col("type"), F.col("allow_history"), F.col("user_id")).alias("collects"))


@query(f"{src.views('behaviour')}\nSELECT type, CASE WHEN type IN ({', '.join(repr(t) for t in BEHAVIOUR_TYPES)}) THEN 'counted' ELSE 'ignored' END AS outcome, count(*) AS n FROM behaviour GROUP BY 1, 2")
def intake_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("type", classify(F.col("type")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{src.views('behaviour')}\nSELECT id FROM behaviour WHERE occurred_at >= {NOW} - INTERVAL 12 DAY")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retain(_events(spark, sf_dir), "occurred_at", _now(), 12).select("id")


# sessions


@query(f"{LOG}\nSELECT id, session_id, from_query, normalized_query AS to_query FROM (SELECT *, lag(normalized_query) OVER s AS from_query, lag(submitted_at) OVER s AS t FROM (SELECT q.* REPLACE (normalized_query || id % 2 AS normalized_query) FROM qlog q) WINDOW s AS (PARTITION BY session_id ORDER BY submitted_at, id)) WHERE from_query <> normalized_query AND (epoch_us(submitted_at) - epoch_us(t)) <= {GAP_S} * 1000000")
def reformulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir).withColumn("normalized_query", F.concat("normalized_query", (F.col("id") % 2).cast("string")))
    return rollups.reformulations(log, GAP_S).select("id", "session_id", "from_query", "to_query")


ABANDONED = f"abandoned AS (SELECT q.* FROM qlog q WHERE NOT EXISTS (SELECT 1 FROM behaviour b WHERE b.type IN ('search.result_clicked', 'video.play_started') AND b.session_id = q.session_id AND (coalesce(b.normalized_query, '') = '' OR lower(b.normalized_query) = q.normalized_query) AND b.occurred_at BETWEEN q.submitted_at AND q.submitted_at + to_seconds({int(GAP_S)})))"


def _lowered(e: DataFrame) -> DataFrame:
    return e.withColumn("normalized_query", F.lower("normalized_query"))


@query(f"{LOG},\n{ABANDONED}\nSELECT id, session_id, normalized_query FROM abandoned")
def abandonment(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return rollups.abandoned(rollups.query_log(e), _lowered(e), GAP_S).select("id", "session_id", "normalized_query")


@query(f"{LOG},\n{ABANDONED}\nSELECT id AS source_id, 'search.abandoned' AS type, user_id, session_id, normalized_query FROM abandoned UNION ALL SELECT id, 'search.reformulated', user_id, session_id, normalized_query FROM (SELECT *, lag(normalized_query) OVER s AS p, lag(submitted_at) OVER s AS t FROM qlog WINDOW s AS (PARTITION BY session_id ORDER BY submitted_at, id)) WHERE p <> normalized_query AND epoch_us(submitted_at) - epoch_us(t) <= {GAP_S} * 1000000")
def sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return rollups.sessionize(rollups.query_log(e), _lowered(e), GAP_S, GAP_S).select("source_id", "type", "user_id", "session_id", "normalized_query")


@query(f"{src.views('behaviour')}\nSELECT session_id, video_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY occurred_at DESC, id DESC) AS rank, max(occurred_at) OVER (PARTITION BY session_id) AS l FROM behaviour WHERE type = 'video.play_started' AND video_id IS NOT NULL AND occurred_at <= {NOW}) WHERE rank <= 3 AND epoch_us({NOW}) - epoch_us(l) <= 20 * 86400 * 1000000::BIGINT")
def session_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.session_recent(_events(spark, sf_dir).filter("type = 'video.play_started'"), _now(), "video_id", 3, 20 * 86400.0)


@query(f"{src.views('behaviour')}\nSELECT id, sum(new) OVER (PARTITION BY session_id ORDER BY occurred_at, id) AS run FROM (SELECT *, CASE WHEN lag(type) OVER (PARTITION BY session_id ORDER BY occurred_at, id) IS NOT DISTINCT FROM type THEN 0 ELSE 1 END AS new FROM behaviour)")
def run_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_groups(_events(spark, sf_dir), ["session_id"], [F.col("occurred_at"), F.col("id")], "type").select("id", "run")


@query(f"{src.views('behaviour')}\nSELECT id, coalesce(CASE WHEN id % 5 = 0 THEN NULL ELSE session_id END IS NOT DISTINCT FROM p, true) AS same FROM (SELECT *, lag(CASE WHEN id % 5 = 0 THEN NULL ELSE session_id END) OVER (PARTITION BY video_id ORDER BY id) AS p FROM behaviour WHERE video_id IS NOT NULL)")
def same_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an event has the session of the event on the same video before it; every fifth has none, and none equals none."""
    from pyspark.sql import Window

    e = _events(spark, sf_dir).filter("video_id IS NOT NULL").withColumn("s", F.when(F.col("id") % 5 != 0, F.col("session_id")))
    return e.select("id", is_same_session(F.col("s"), F.lag("s").over(Window.partitionBy("video_id").orderBy("id"))).alias("same"))


# impressions


IMPRESSIONS = f"""imps AS (SELECT i.id, i.session_id, i.normalized_query, i.video_id, coalesce(i.position, 0) AS position,
   EXISTS (SELECT 1 FROM behaviour c WHERE c.type = 'search.result_clicked' AND c.session_id IS NOT DISTINCT FROM i.session_id AND c.normalized_query = i.normalized_query AND c.video_id = i.video_id AND c.occurred_at >= i.occurred_at) AS clicked,
   EXISTS (SELECT 1 FROM watches m WHERE m.session_id IS NOT DISTINCT FROM i.session_id AND m.video_id = i.video_id AND m.occurred_at >= i.occurred_at) AS meaningful
   FROM behaviour i WHERE i.type = 'video.impression' AND i.normalized_query IS NOT NULL AND i.video_id IS NOT NULL AND i.occurred_at >= {NOW} - INTERVAL 31 DAY),
labelled AS (SELECT *, CASE WHEN meaningful THEN 2 WHEN clicked THEN 1 ELSE 0 END AS rel, row_number() OVER (PARTITION BY session_id, normalized_query ORDER BY position, video_id, id) AS served FROM imps)"""


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return rollups.label_impressions(e, rollups.derive_meaningful_watch(e), _now(), 31)


@query(f"{src.views('behaviour')},\n{WATCHES},\n{IMPRESSIONS}\nSELECT id, session_id, video_id, position, clicked, meaningful FROM imps")
def impression_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impressions(spark, sf_dir).select("id", "session_id", "video_id", "position", "clicked", "meaningful")


#: purchases as positive labels, since few shown videos are clicked in the same session
GRADED = """graded AS (SELECT user_id, event_id % 10 AS position, event_id, CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS rel, ts::DATE AS day FROM events),
lists AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY position, event_id) AS rank, row_number() OVER (PARTITION BY user_id, day ORDER BY rel DESC) AS ideal, count(*) OVER (PARTITION BY user_id, day) AS n, max(rel) OVER (PARTITION BY user_id, day) AS top FROM graded)"""


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = src.table(spark, sf_dir, "events")
    rows = e.select("user_id", (F.col("event_id") % 10).alias("position"), "event_id", F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 1).otherwise(0).alias("rel"), F.to_date("ts").alias("day"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("user_id", "day").orderBy("position", "event_id")))


@query(f"WITH {GRADED}\nSELECT user_id, day, round(coalesce(sum(CASE WHEN rank <= 3 THEN (pow(2, rel) - 1) / log2(rank + 1) ELSE 0 END) / nullif(sum(CASE WHEN ideal <= 3 THEN (pow(2, rel) - 1) / log2(ideal + 1) ELSE 0 END), 0), 0), 6) AS ndcg FROM lists GROUP BY 1, 2")
def ndcg_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfind.plans.evaluate import ndcg

    return ndcg(_graded(spark, sf_dir), ["user_id", "day"], 3).select("user_id", "day", r6("ndcg"))


@query(f"WITH {GRADED}\nSELECT user_id, day, round(coalesce(1.0 / min(CASE WHEN rel >= 1 AND rank <= 3 THEN rank END), 0), 6) AS mrr FROM lists GROUP BY 1, 2")
def mrr_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfind.plans.evaluate import mrr

    return mrr(_graded(spark, sf_dir), ["user_id", "day"], 3).select("user_id", "day", r6("mrr"))


@query(f"WITH {GRADED}\nSELECT user_id, event_id, rel FROM lists WHERE n >= 2 AND top >= 1")
def usable_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfind.plans.evaluate import usable_groups as run

    rows = _graded(spark, sf_dir).withColumns({"session_id": F.col("user_id"), "normalized_query": F.col("day")})
    return run(rows).select("user_id", "event_id", "rel")


# trending

BUMPS = """bumps AS (SELECT 'q' AS domain, lower(normalized_query) AS item, coalesce(user_id::VARCHAR, nullif(session_id, ''), 'anon') AS subject, occurred_at FROM behaviour WHERE type = 'search.submitted' AND normalized_query <> ''
  UNION ALL SELECT 'v', video_id::VARCHAR, coalesce(user_id::VARCHAR, nullif(session_id, ''), 'anon'), occurred_at FROM behaviour WHERE type = 'video.play_started' AND video_id IS NOT NULL)"""
CAP_S = 43200
CAPPED = f"""places AS (SELECT *, row_number() OVER (PARTITION BY domain, item, subject ORDER BY occurred_at) AS n FROM bumps),
walk AS (SELECT domain, item, subject, occurred_at, n, occurred_at AS last, true AS kept FROM places WHERE n = 1
  UNION ALL SELECT p.domain, p.item, p.subject, p.occurred_at, p.n, CASE WHEN epoch_us(p.occurred_at) - epoch_us(w.last) >= {CAP_S} * 1000000::BIGINT THEN p.occurred_at ELSE w.last END, epoch_us(p.occurred_at) - epoch_us(w.last) >= {CAP_S} * 1000000::BIGINT
  FROM walk w JOIN places p ON p.domain = w.domain AND p.item = w.item AND p.subject = w.subject AND p.n = w.n + 1),
capped AS (SELECT domain, item, subject, occurred_at FROM walk WHERE kept),
scores AS (SELECT domain, item, sum(pow(2, -greatest((epoch_us({NOW}) - epoch_us(occurred_at)) / 1e6, 0) / 172800.0)) AS score FROM capped WHERE occurred_at <= {NOW} GROUP BY 1, 2),
trailing_ AS (SELECT domain, item, count(DISTINCT subject) AS distinct_users, count(*) AS total FROM bumps WHERE occurred_at <= {NOW} AND occurred_at::DATE > ({NOW})::DATE - 10 GROUP BY 1, 2),
gated AS (SELECT s.*, coalesce(distinct_users, 0) AS distinct_users, coalesce(total, 0) AS total FROM (SELECT * FROM scores WHERE score >= 0.01) s LEFT JOIN trailing_ t ON t.domain = s.domain AND t.item = s.item),
bound AS (SELECT *, CASE WHEN total <= 0 OR distinct_users <= 0 THEN 0 ELSE greatest((distinct_users / total + 1.96 * 1.96 / (2 * total) - 1.96 * sqrt((distinct_users / total * (1 - distinct_users / total) + 1.96 * 1.96 / (4 * total)) / total)) / (1 + 1.96 * 1.96 / total), 0) END AS wilson FROM gated),
verdicts AS (SELECT *, CASE WHEN distinct_users < 3 THEN 'distinct_users' WHEN wilson < 0.10 THEN 'wilson' ELSE 'ok' END AS verdict FROM bound)"""
TREND = f"{src.views('behaviour')},\n{BUMPS},\n{CAPPED}"


def _bumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trending.bumps(_events(spark, sf_dir))


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bumps(spark, sf_dir)
    scores = trending.trend_scores(trending.capped(rows, float(CAP_S)), _now(), 172800.0)
    return trending.trend_gate(scores, trending.trend_distinct(rows, _now(), 10, exact=True), trending.trend_total(rows, _now(), 10))


@query(f"{src.views('behaviour')},\n{BUMPS}\nSELECT domain, item, subject, occurred_at FROM bumps")
def trend_bumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bumps(spark, sf_dir).withColumn("occurred_at", F.col("occurred_at").cast("timestamp_ntz"))


@query(f"{TREND}\nSELECT domain, item, subject, occurred_at FROM capped")
def greedy_cap_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return greedy_cap(_bumps(spark, sf_dir), ["domain", "item", "subject"], "occurred_at", float(CAP_S)).withColumn("occurred_at", F.col("occurred_at").cast("timestamp_ntz"))


@query(f"{TREND}\nSELECT domain, item, round(score, 6) AS score FROM scores WHERE score >= 0.01")
def trend_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trending.trend_scores(trending.capped(_bumps(spark, sf_dir), float(CAP_S)), _now(), 172800.0).select("domain", "item", r6("score"))


@query(f"{TREND}\nSELECT domain, item, distinct_users FROM trailing_")
def trend_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trending.trend_distinct(_bumps(spark, sf_dir), _now(), 10, exact=True)


@query()
def trend_distinct_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate, from daily sketches; a test bounds its error."""
    return trending.trend_distinct(_bumps(spark, sf_dir), _now(), 10)


@query(f"{TREND}\nSELECT domain, item, total FROM trailing_")
def trend_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trending.trend_total(_bumps(spark, sf_dir), _now(), 10)


@query(f"{TREND}\nSELECT domain, item, distinct_users, total, round(wilson, 6) AS wilson, verdict FROM verdicts")
def trend_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).select("domain", "item", "distinct_users", "total", r6("wilson"), "verdict")


@query(f"{TREND}\nSELECT domain, verdict AS reason, count(*) AS n FROM verdicts WHERE verdict <> 'ok' GROUP BY 1, 2")
def gate_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trending.gate_rejections(_gated(spark, sf_dir))


@query(f"{TREND}\nSELECT domain, item, rank FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY round(score, 9) DESC, item DESC) AS rank FROM verdicts WHERE verdict = 'ok') WHERE rank <= 50")
def trend_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trending.trend_top(_gated(spark, sf_dir)).select("domain", "item", "rank")


@query(f"{TREND}\nSELECT domain, item, rank, {NOW} + INTERVAL 300 SECOND AS valid_until FROM (SELECT domain, item, row_number() OVER (PARTITION BY domain ORDER BY round(score, 9) DESC, item DESC) AS rank FROM verdicts WHERE verdict = 'ok') WHERE rank <= 50")
def trend_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list as it is published, with the time until which it holds."""
    rows = trending.snapshot(trending.trend_top(_gated(spark, sf_dir)), _now())
    return rows.select("domain", "item", "rank", F.col("valid_until").cast("timestamp_ntz").alias("valid_until"))


@query(f"{LOG}\nSELECT normalized_query, id FROM (SELECT *, row_number() OVER (PARTITION BY normalized_query ORDER BY submitted_at DESC, id DESC) AS rn FROM qlog) WHERE rn = 1")
def first_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_per_key(_log(spark, sf_dir), ["normalized_query"], [F.col("submitted_at").desc(), F.col("id").desc()]).select("normalized_query", "id")
