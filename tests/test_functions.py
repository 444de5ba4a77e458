import math
import uuid

import pytest
from pyspark.sql import functions as F

from wayfind.functions import hashing, scoring, text
from wayfind.operators.predicates import eligibility, is_meaningful


def one(spark, column, **cells):
    return spark.createDataFrame([tuple(cells.values())], list(cells)).select(column.alias("v")).first()["v"] if cells else spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("raw", "want"), [("  Hello   World ", "hello world"), ("ＦＵＬＬ", "full"), ("Straße", "strasse"), ("a\t\nb", "a b"), ("", ""), ("ﬁne", "fine"), (" x ", "x")])
def test_normalize(spark, raw, want):
    got = spark.createDataFrame([(raw,), (None,)], "s string").select(text.normalize("s").alias("v")).collect()
    assert [r.v for r in got] == [want, None]
    again = spark.createDataFrame([(want,)], "s string").select(text.normalize("s").alias("v")).first().v
    assert again == want


@pytest.mark.parametrize(("privacy", "state", "want"), [("public", "published", (True, None)), ("private", "published", (False, "privacy_private")), ("", "draft", (False, "privacy_unknown")), ("public", "", (False, "state_unknown")), ("public", "draft", (False, "state_draft"))])
def test_eligibility(spark, privacy, state, want):
    ok, why = eligibility(F.lit(privacy), F.lit(state))
    assert tuple(spark.range(1).select(ok, why).first()) == want


@pytest.mark.parametrize(("position", "duration", "want"), [(30.0, 0.0, True), (29.9, None, False), (20.0, 60.0, True), (17.9, 60.0, False), (None, 10.0, False)])
def test_meaningful_watch(spark, position, duration, want):
    assert one(spark, is_meaningful(F.lit(position).cast("double"), F.lit(duration).cast("double"))) is want


def test_scores(spark):
    cosine = scoring.shrunk_cosine(F.lit(5), F.lit(5), F.lit(5))
    assert one(spark, cosine) == pytest.approx(5 / 15)
    assert one(spark, scoring.covis_blend(F.lit(0.5), F.lit(0.5))) == pytest.approx(0.5)
    assert one(spark, scoring.shrunk_cosine(F.lit(0), F.lit(1), F.lit(1))) == 0
    assert one(spark, scoring.wilson_lower_bound(F.lit(3), F.lit(5000))) < 0.1 < one(spark, scoring.wilson_lower_bound(F.lit(50), F.lit(80)))
    assert one(spark, scoring.wilson_lower_bound(F.lit(9), F.lit(5))) <= 1  # a sketch above the total
    assert one(spark, scoring.decay_factor(F.lit(10.0), 10.0)) == 0.5
    assert one(spark, scoring.decay_factor(F.lit(-3.0), 10.0)) == 1
    assert one(spark, scoring.round4(F.lit(-0.00006))) == 0
    assert one(spark, scoring.freshness(F.lit(30.0))) == pytest.approx(0.5)


def fnv(data):
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h


def test_hashes(spark):
    words = ["", "a", "foobar", "déjà", "s1\x00user"]
    rows = spark.createDataFrame([(w,) for w in words], "s string").select("s", hashing.fnv1a64(F.col("s")).alias("h"), hashing.bucket(F.lit("salt"), F.col("s")).alias("b"), hashing.exploration_draw(F.col("s"), F.lit(7)).alias("x"), hashing.uuid_v5(str(uuid.NAMESPACE_DNS), F.col("s")).alias("u"))
    for r in rows.collect():
        h = fnv(r.s.encode())
        assert (r.h.high << 32 | r.h.low) == h
        assert r.b == fnv(b"salt\x00" + r.s.encode()) % 100
        assert r.x["fires"] == ((h & 0x3FFF) / 0x4000 < 0.1) and r.x["index"] == (h >> 20) % 7
        assert r.u == str(uuid.uuid5(uuid.NAMESPACE_DNS, r.s))


def test_buckets_are_even_and_exploration_is_a_tenth(spark):
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("s"))
    counts = [r["count"] for r in rows.groupBy(hashing.bucket(F.lit("x"), F.col("s"))).count().collect()]
    assert len(counts) == 100 and min(counts) > 120 and max(counts) < 280
    fired = rows.filter(hashing.exploration_draw(F.col("s"), F.lit(3))["fires"]).count()
    assert 0.08 < fired / 20_000 < 0.12


def test_trigrams(spark):
    assert one(spark, text.trigram_similarity(F.lit("word"), F.lit("two words"))) == pytest.approx(0.363636, abs=1e-5)
    assert one(spark, text.trigram_similarity(F.lit(""), F.lit(""))) == 0


def test_parse(spark):
    p = one(spark, text.parse_websearch(F.lit('blue "Steel Bolt" cat or dog -rust')))
    assert (p.must, p.must_not, p.phrases, p.any_of) == (["blue"], ["rust"], [["steel", "bolt"]], [["cat", "dog"]])


def test_postings_positions_go_on(spark):
    d = spark.createDataFrame([(1, "Blue bolt", ["new"], "Ann", "a blue")], "video_id long, title string, tags array<string>, channel_name string, description string")
    rows = sorted((r.pos, r.term, r.weight) for r in text.postings(d).collect())
    assert rows == [(1, "blue", 1.0), (2, "bolt", 1.0), (3, "new", 0.4), (4, "ann", 0.4), (5, "a", 0.2), (6, "blue", 0.2)]


def covers(spots, n):
    """Minimal intervals with all terms."""
    found, best = 0.0, []
    for i, (start, _, _) in enumerate(spots):
        seen = {}
        for pos, term, w in spots[i:]:
            seen.setdefault(term, w) if term not in seen else None
            if len(seen) == n:
                best.append((start, pos))
                break
    for start, end in best:
        if not any((s, e) != (start, end) and s >= start and e <= end for s, e in best):
            inside = {}
            for pos, term, w in spots:
                if start <= pos <= end:
                    inside[term] = w
            found += n / sum(1 / w for w in inside.values()) / (end - start + 1 - n + 1)
    return found


@pytest.mark.parametrize("spots", [[(1, 0, 1.0), (2, 1, 1.0)], [(1, 0, 1.0), (5, 1, 0.4), (6, 0, 0.2), (9, 1, 0.2)], [(3, 0, 0.2), (4, 0, 0.2)], [(1, 1, 0.4), (2, 2, 0.4), (7, 0, 1.0), (8, 1, 0.2), (20, 2, 0.2)]])
def test_cover_density(spark, spots):
    n = 3 if any(t == 2 for _, t, _ in spots) else 2
    got = spark.createDataFrame([(spots,)], "p array<struct<pos:int,term:int,weight:double>>").select(text.cover_density(F.col("p"), F.lit(n)).alias("v")).first().v
    assert got == pytest.approx(covers(spots, n))
    assert not math.isnan(got)
