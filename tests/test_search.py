"""Similar titles by prefix filtering and search by blocks: the rows of the plain ways, and how much less they read."""

import random

import pytest
from pyspark.sql import functions as F

from wayfind.functions import text
from wayfind.functions.text import trigrams
from wayfind.operators import blocks, completions, recall
from wayfind.plans import search, suggest
from wayfind.sources import adapters as src

SF = "/root/testdata/sf0.001"
def now():
    return F.lit("2024-06-01").cast("timestamp")



def grams(s):
    words = [w for w in "".join(c if c.isalnum() else " " for c in s.lower()).split()]
    return {f"  {w} "[k : k + 3] for w in words for k in range(len(w) + 1)}


@pytest.fixture(scope="module")
def titles(spark):
    rows = [r.title for r in src.text_docs(spark, SF).select("title").collect()] + ["", "!!", "a", "aa aa", "naïve café"]
    return sorted({t.lower() for t in rows})


@pytest.mark.parametrize("threshold", [0.2, 0.3, 0.35, 0.6, 1.0])
def test_similar_titles_are_those_of_all_pairs(spark, titles, threshold):
    rng = random.Random(3)
    asked = rng.sample(titles, 40) + [w for t in titles[::7] for w in t.split()][:80] + ["", "a", "naïve", "zzz"]
    asked += [t[:-1] for t in rng.sample(titles, 20)]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    got = {(r.query_id, r.key): r.trgm_sim for r in recall.trigram_join(queries, spark.createDataFrame([(t,) for t in titles + titles], "key string"), threshold).collect()}
    want = {}
    for n, q in enumerate(asked):
        for t in titles:
            a, b = grams(q), grams(t)
            if a and b and len(a & b) / len(a | b) >= threshold:
                want[n, t] = len(a & b) / len(a | b)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_prefixes_leave_a_tenth_of_the_rows(spark, titles):
    t = spark.createDataFrame([(x,) for x in titles], "key string").withColumn("grams", trigrams(F.col("key"))).filter("size(grams) > 0")
    q = t.select(F.explode(F.split("key", " ")).alias("query")).distinct().withColumn("grams", trigrams(F.col("query"))).filter("size(grams) > 0")
    every = q.select(F.explode("grams").alias("g")).join(t.select(F.explode("grams").alias("g")), "g").count()
    assert recall.trigram_pairs(q, t, 0.3).count() * 10 < every


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(9)
    rows = []
    for n in range(900):
        words = ["common"] * rng.randrange(0, 4) + [rng.choice(["red", "blue", "green", "Common", f"w{rng.randrange(300)}"]) for _ in range(5)]
        rng.shuffle(words)
        rows.append((n, " ".join(words), [rng.choice(["common", "COMMON", "x"])], rng.choice(["c1", "common", None]), rng.choice(["en", "de"]), rng.random() < 0.3, rng.random() < 0.9, int(rng.paretovariate(0.5)), rng.choice([None, 1_717_000_000 - rng.randrange(10**7)])))
    docs = spark.createDataFrame(rows, "video_id long, title string, tags array<string>, channel_name string, language string, is_sensitive boolean, eligible boolean, views long, p long")
    docs = docs.withColumns({"published_at": F.timestamp_seconds("p"), "source_updated_at": F.timestamp_seconds(F.lit(1_600_000_000)), "channel_id": F.col("channel_name"), "category": F.lit("k")}).drop("p")
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    return docs, text.postings(docs).cache()


ASKED = [(1, "common", False, None, None, 0), (2, "common", True, "en", 5, 0), (3, "common", False, None, 200, 10), (4, "w7", False, None, None, 0), (5, "red blue", False, None, None, 0), (6, "common -red", False, None, 7, 2), (7, "nothing", False, None, None, 0), (8, "", False, None, None, 0), (9, '"common red"', False, None, None, 0)]


@pytest.mark.parametrize("size", [128, 8])
def test_search_by_blocks_gives_the_same_rows(spark, corpus, size):
    docs, postings = corpus
    requests = spark.createDataFrame(ASKED, "query_id long, query string, hide_sensitive boolean, language string, limit int, offset int")
    want = sorted(map(tuple, search.search_simple(requests, docs, postings, now()).collect()))
    got = sorted(map(tuple, search.search_top(requests, docs, postings, now(), size=size).collect()))
    assert [(q, v, r) for q, v, _, r in got] == [(q, v, r) for q, v, _, r in want] and len(want) > 100
    assert all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(got, want, strict=True))


def test_few_blocks_of_a_common_word_are_read(spark, corpus):
    docs, postings = corpus
    index = search.search_blocks(docs, postings, now(), size=8)
    asked = spark.createDataFrame([(1, "common", 10)], "query_id long, term string, k int")
    every = index.filter("term = 'common'").count()
    first = index.filter("term = 'common' AND block * 8 < 10")
    scores = first.select(F.lit(1).alias("query_id"), F.explode("items").alias("i")).select("query_id", "i.video_id", "i.value")
    least = blocks.least_score(scores, asked, F.col("value"))
    later = index.filter("term = 'common' AND block * 8 >= 10").crossJoin(least).filter(F.col("top") + search.SLACK >= F.col("least")).count()
    assert every > 50 and first.count() + later < every / 2
    tops = [r.top for r in index.filter("term = 'common'").orderBy("block").collect()]
    assert tops == sorted(tops, reverse=True) and all(len(r["items"]) <= 8 for r in index.collect())


def test_completion_lists_are_those_of_every_request(spark, corpus):
    docs, _ = corpus
    titles = [r.title for r in docs.select("title").collect()]
    rng = random.Random(2)
    asked = [(n, rng.choice(titles).lower()[: rng.randrange(1, 12)], n % 2 == 0) for n in range(80)] + [(100, "zzz", False), (101, "", True)]
    requests = spark.createDataFrame(asked, "query_id long, query string, hide_sensitive boolean")
    table = suggest.title_completions(docs)
    got, want = (sorted(map(tuple, d.select("query_id", "text", "popularity").collect())) for d in (suggest.title_lists(requests, table), suggest.title_prefix(requests, docs)))
    assert got == want and len(got) > 200


def test_changed_titles_touch_their_own_prefixes_only(spark, corpus):
    docs, _ = corpus
    old = suggest.title_items(docs)
    changed_docs = docs.filter("video_id % 90 <> 3").withColumn("title", F.when(F.col("video_id") % 100 == 7, "brand new title").otherwise(F.col("title")))
    new = suggest.title_items(changed_docs)
    different = old.exceptAll(new).select("hide", "key").unionByName(new.exceptAll(old).select("hide", "key"))
    table = completions.completion_table(old, ["hide"], [F.col("key")])
    after = completions.update_completions(table, different, new, ["hide"], [F.col("key")])
    again = completions.completion_table(new, ["hide"], [F.col("key")])
    assert sorted(map(tuple, after.select(*again.columns).collect()), key=str) == sorted(map(tuple, again.collect()), key=str)
    assert completions.prefixes_of(spark.createDataFrame([("",), (None,), ("ab",)], "key string")).count() == 2
