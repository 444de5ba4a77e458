"""Candidate retrieval for tables of queries: full text, trigrams, exact tags and channels. Each way is an equi-join; they are united, never OR-ed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.functions.text import cover_density, parse_websearch, trigrams
from wayfind.operators.windows import top_k

RECALL_SIMILARITY = 0.3  # fixed value


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, number, n_terms: the distinct terms that count for rank."""
    p = parse_websearch(F.col("query"))
    words = F.array_distinct(F.concat(p["must"], F.flatten(p["phrases"]), F.flatten(p["any_of"])))
    return queries.select("query_id", F.size(words).alias("n_terms"), F.posexplode(words).alias("number", "term"))


def fts_candidates(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """query_id, video_id of documents that hold all terms, a term of each `or` group, all phrases, and no excluded term."""
    parsed = queries.select("query_id", parse_websearch(F.col("query")).alias("p"))
    unit = lambda kind, no, words: F.struct(F.lit(kind).alias("kind"), no.alias("no"), words.alias("words"))
    number = lambda a: F.transform(a, lambda w, k: F.struct(w.alias("w"), k.alias("k")))
    units = F.concat(
        F.transform(number(F.col("p.must")), lambda x: unit("term", x["k"], F.array(x["w"]))),
        F.transform(number(F.col("p.phrases")), lambda x: unit("phrase", x["k"], x["w"])),
        F.transform(number(F.col("p.any_of")), lambda x: unit("any", x["k"], x["w"])),
    )
    wanted = parsed.select("query_id", F.size(units).alias("n_units"), F.explode(units).alias("u")).select("query_id", "n_units", "u.kind", "u.no", F.size("u.words").alias("n_words"), F.posexplode("u.words").alias("k", "term"))
    hits = wanted.join(postings.select("video_id", "term", "pos"), "term")
    single = hits.filter("kind <> 'phrase'").select("query_id", "n_units", "video_id", "kind", "no")
    phrase = hits.filter("kind = 'phrase'").groupBy("query_id", "n_units", "video_id", "kind", "no", "n_words", (F.col("pos") - F.col("k")).alias("start")).agg(F.count_distinct("k").alias("have"))
    phrase = phrase.filter("have = n_words").select("query_id", "n_units", "video_id", "kind", "no")
    met = single.unionByName(phrase).groupBy("query_id", "n_units", "video_id").agg(F.count_distinct("kind", "no").alias("met")).filter("met = n_units")
    banned = parsed.select("query_id", F.explode("p.must_not").alias("term")).join(postings.select("video_id", "term"), "term").select("query_id", "video_id").distinct()
    return met.select("query_id", "video_id").join(banned, ["query_id", "video_id"], "left_anti")


def text_rank(queries: DataFrame, postings: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """query_id, video_id, text_rank: summed weights for one term, cover density for several. Documents that lack a term rank 0 and are left out.

    With candidates (query_id, video_id) only their postings are read, else those of every document that holds a term.
    """
    terms_ = query_terms(queries)
    hits = terms_.join(postings, "term") if candidates is None else candidates.select("query_id", "video_id").join(terms_, "query_id").join(postings, ["video_id", "term"])
    spots = F.array_sort(F.collect_list(F.struct("pos", F.col("number").alias("term"), "weight")))
    found = hits.groupBy("query_id", "video_id", "n_terms").agg(F.sum("weight").alias("total"), spots.alias("spots"))
    return found.select("query_id", "video_id", F.when(F.col("n_terms") == 1, F.col("total")).otherwise(cover_density(F.col("spots"), F.col("n_terms"))).alias("text_rank"))


def _least(share: float, n: Column) -> Column:
    """The least whole number not under share * n; the product of what should be a whole number is not taken for more."""
    return F.ceil(share * n - 1e-9)


def trigram_prefixes(texts: DataFrame, key: str, counts: DataFrame, threshold: float) -> DataFrame:
    """key, n (distinct trigrams), g, place: of each distinct text's trigrams, rarest first, those among which two similar texts must meet."""
    rows = texts.select(key, "grams", F.size("grams").alias("n"), F.explode("grams").alias("g")).drop("grams")
    order = [F.coalesce("df", F.lit(0)), F.col("g")]
    placed = rows.join(counts, "g", "left").withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return placed.filter(F.col("place") <= F.col("n") - _least(threshold, F.col("n")) + 1).select(key, "n", "g", "place")


def trigram_pairs(queries: DataFrame, titles: DataFrame, threshold: float) -> DataFrame:
    """query, key, n1, n2, once for each trigram of both prefixes where neither sizes nor what is left behind it rule the similarity out.

    Two sets that are so similar share one of the first n - ceil(threshold * n) + 1 of their trigrams in any one order of all
    trigrams; in the order of how many titles hold them the common ones are left out. queries: query, grams; titles: key, grams.
    """
    counts = titles.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    q = trigram_prefixes(queries, "query", counts, threshold).withColumnsRenamed({"n": "n1", "place": "i"})
    t = trigram_prefixes(titles, "key", counts, threshold).withColumnsRenamed({"n": "n2", "place": "j"})
    sizes = (F.col("n2") >= _least(threshold, F.col("n1"))) & (F.col("n1") >= _least(threshold, F.col("n2")))
    rest = F.least(F.col("n1") - F.col("i"), F.col("n2") - F.col("j")) + 1  # at best, if this is the first trigram they share
    return q.join(t, "g").filter(sizes & (rest >= _least(threshold / (1 + threshold), F.col("n1") + F.col("n2")))).select("query", "key", "n1", "n2")


def trigram_join(queries: DataFrame, titles: DataFrame, threshold: float = RECALL_SIMILARITY) -> DataFrame:
    """query_id, key, trgm_sim of distinct titles (column key) at least so similar: a prefix-filtered set-similarity join. Equal queries are joined once."""
    sets = lambda df, text: df.select(text).distinct().withColumn("grams", trigrams(F.col(text))).filter(F.size("grams") > 0)
    q, t = sets(queries, "query"), sets(titles, "key")
    near = trigram_pairs(q, t, threshold).distinct().join(q, "query").join(t.withColumnRenamed("grams", "other"), "key")
    near = near.withColumn("c", F.size(F.array_intersect("grams", "other")))
    near = near.select("query", "key", (F.col("c") / (F.col("n1") + F.col("n2") - F.col("c"))).alias("trgm_sim")).filter(F.col("trgm_sim") >= threshold)
    return queries.select("query_id", "query").join(near, "query").select("query_id", "key", "trgm_sim")


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def recall_besides_text(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, video_id of similar titles, exact tags (case kept) and exact channel names."""
    titles = docs.select("video_id", F.lower("title").alias("key"))
    similar = trigram_join(queries, titles).join(titles, "key").select("query_id", "video_id")
    q = queries.select("query_id", F.col("query").alias("key"))
    tags = docs.select("video_id", F.explode("tags").alias("key")).distinct().join(q, "key").select("query_id", "video_id")
    channels = docs.select("video_id", F.lower("channel_name").alias("key")).join(q, "key").select("query_id", "video_id")
    return similar.unionByName(tags).unionByName(channels)


def recall(queries: DataFrame, docs: DataFrame, postings: DataFrame) -> DataFrame:
    """query_id, video_id over all documents, without eligibility: full text, similar titles, exact tags (case kept), exact channel names."""
    return fts_candidates(queries, postings).unionByName(recall_besides_text(queries, docs)).distinct()


def union_clicked(found: DataFrame, queries: DataFrame, engagement: DataFrame) -> DataFrame:
    """recall and what was clicked for the very query."""
    clicked = engagement.filter("clicks > 0").select(F.col("normalized_query").alias("query"), "video_id").join(queries.select("query_id", "query"), "query").select("query_id", "video_id")
    return union_distinct(found, clicked)


def with_engagement(candidates: DataFrame, engagement: DataFrame) -> DataFrame:
    """Candidates (query, video_id, …) with impressions, clicks and meaningful_watches, zero where none."""
    e = engagement.select(F.col("normalized_query").alias("query"), "video_id", "impressions", "clicks", "meaningful_watches")
    return candidates.join(e, ["query", "video_id"], "left").fillna(0, ["impressions", "clicks", "meaningful_watches"])


def cap_recall(candidates: DataFrame, k: int = 500) -> DataFrame:
    return top_k(candidates, ["query_id"], [F.round("text_rank", 9).desc(), F.col("views").desc(), F.col("video_id")], k)


def prefix_join(prefixes: DataFrame, items: DataFrame, key: str = "key") -> DataFrame:
    """Requests (query_id, query, …) with the items whose key starts with the query: an equi-join on leading letters.

    Each item is cut to the lengths that queries have; there are no more of those than the longest query has letters.
    """
    lengths = prefixes.agg(F.collect_set(F.length("query"))).scalar()  # looked up as the plan runs
    fits = F.filter("_lengths", lambda n: (n > 0) & (n <= F.length(F.col(key))))
    cut = items.withColumn("_lengths", lengths).withColumn("_n", F.explode(fits)).withColumn("_p", F.substring(F.col(key), F.lit(1), F.col("_n"))).drop("_n", "_lengths")
    return prefixes.withColumn("_p", F.col("query")).join(cut, "_p").drop("_p")


def per_request_rank(df: DataFrame, by: list[str], order: list) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
