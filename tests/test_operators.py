import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wayfind.operators import covis, diversity, projection, rollups, trending, windows
from wayfind.plans import evaluate, experiment, ingest_queries, jobs, suggest
from wayfind.sources import events as ev

EVENT = "id long, session_id string, type string, video_id long, user_id long, normalized_query string, allow_history boolean, occurred_at timestamp"


@pytest.fixture
def events(spark):
    rng = random.Random(7)
    kinds = ("video.play_started", "search.result_clicked", "search.submitted", "video.impression")
    rows = [(n, f"s{rng.randrange(6)}", rng.choice(kinds), rng.randrange(8), rng.choice((None, 1, 2, 3)), rng.choice("ab"), True, n * 40) for n in range(300)]
    return spark.createDataFrame(rows, EVENT.replace("occurred_at timestamp", "t long")).withColumn("occurred_at", F.timestamp_seconds("t")).drop("t").cache()


def as_set(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_increments_equal_recount(events):
    for count in (covis.co_watch_pairs, covis.co_search_pairs):
        whole = count(events, events, 900.0)
        parts = None
        for low, high in ((-1, 100), (100, 101), (101, 299)):
            new, seen = rollups.scan_range(events, low, high), events.filter(F.col("id") <= high)
            got = count(new, seen, 900.0)
            parts = got if parts is None else covis.merge_counts(parts, got)
        assert as_set(parts.filter("count > 0")) == as_set(whole)
    plain = defaultdict(int)
    rows = [r for r in events.collect() if r.type == "video.play_started"]
    for a in rows:
        for b in rows:
            if a.id < b.id and a.session_id == b.session_id and a.video_id != b.video_id and abs((a.occurred_at - b.occurred_at).total_seconds()) <= 900:
                plain[min(a.video_id, b.video_id), max(a.video_id, b.video_id)] += 1
    assert as_set(covis.co_watch_pairs(events, events, 900.0)) == sorted(((*k, v) for k, v in plain.items()), key=str)


def test_order_of_rows_does_not_matter(events):
    a = covis.covis_neighbors(events, 900.0)
    b = covis.covis_neighbors(events.orderBy(F.rand(3)), 900.0)
    key = lambda d: [(*r[:2], round(r[2], 9)) for r in as_set(d.select("video_id", "neighbor_id", "score"))]
    assert key(a) == key(b)


def test_rollup_jobs(spark, events):
    empty = spark.createDataFrame([], "video_a long, video_b long, count long")
    w, s, n = jobs.covis_rollup(empty, empty, events, -1, 150, 900.0)
    w, s, n = jobs.covis_rollup(w, s, events, 150, 300, 900.0)
    whole = covis.covis_neighbors(events, 900.0)
    assert [(*r[:2], round(r[2], 9)) for r in as_set(n)] == [(*r[:2], round(r[2], 9)) for r in as_set(whole)]


def test_spam_by_one_user_does_not_trend(spark):
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id"))
    rows = spark.range(1000).select(F.col("id"), F.lit("search.submitted").alias("type"), F.lit("buy now").alias("normalized_query"), F.lit(1).cast("long").alias("user_id"), F.lit("s").alias("session_id"), F.lit(None).cast("long").alias("video_id"), at.alias("occurred_at"), F.col("id").alias("event_id"))
    now = F.timestamp_seconds(F.lit(1_700_001_000))
    b = trending.bumps(rows)
    gated = trending.trend_gate(trending.trend_scores(trending.capped(b), now), trending.trend_distinct(b, now), trending.trend_total(b, now)).first()
    assert (gated.distinct_users, gated.total, gated.verdict) == (1, 1000, "distinct_users")
    log = rollups.query_log(rows)
    agg = rollups.fold_query_aggregates(spark.createDataFrame([], "normalized_query string, display_query string, total_count long, distinct_users int, decayed_freq double, first_seen timestamp, last_seen timestamp, suggestible boolean, banned boolean"), log, log, F.timestamp_seconds(F.lit(0))).first()
    assert (agg.total_count, agg.distinct_users, agg.suggestible) == (1000, 1, False)


def test_sketch_is_near_the_exact_count(spark):
    b = spark.range(5000).select(F.lit("q").alias("domain"), F.lit("i").alias("item"), F.concat(F.lit("u"), F.col("id") % 1234).alias("subject"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("occurred_at"))
    now = F.timestamp_seconds(F.lit(1_700_010_000))
    assert trending.trend_distinct(b, now).first().distinct_users == pytest.approx(1234, rel=0.05)


def test_creator_penalty(spark):
    d = spark.createDataFrame([("q", n, "c" if n < 4 else None, 1.0 - n / 10) for n in range(6)], "q string, video_id int, channel_id string, score double")
    got = {r.video_id: round(r.score, 6) for r in windows.creator_penalty(d, ["q"]).collect()}
    assert got == {0: 1.0, 1: 0.9, 2: 0.65, 3: 0.4, 4: 0.6, 5: 0.5}


def test_mmr(spark):
    rows = [("r", "a", 1.0, ["x"]), ("r", "b", 0.9, ["x"]), ("r", "c", 0.8, ["y"]), ("e", "z", 0.1, [])]
    d = spark.createDataFrame(rows, "request_id string, video_id string, relevance double, tokens array<string>")
    order = lambda lam: [r.video_id for r in diversity.mmr(d, "request_id", lam).filter("request_id = 'r'").orderBy("place").collect()]
    assert order(0.7) == ["a", "c", "b"]
    assert order(1.0) == ["a", "b", "c"]


def test_ndcg_and_mrr(spark):
    lists = {"best": [2, 1, 0], "worst": [0, 0, 1], "none": [0, 0, 0]}
    rows = [(k, n + 1, r) for k, v in lists.items() for n, r in enumerate(v)]
    d = spark.createDataFrame(rows, "k string, rank int, rel int")
    n = {r.k: r.ndcg for r in evaluate.ndcg(d, ["k"]).collect()}
    m = {r.k: r.mrr for r in evaluate.mrr(d, ["k"]).collect()}
    assert n == {"best": pytest.approx(1), "worst": pytest.approx(0.5), "none": 0}
    assert m == {"best": 1, "worst": pytest.approx(1 / 3), "none": 0}


def test_too_little_to_train_on(spark):
    d = spark.createDataFrame([("q", 1)], "query string, label int")
    with pytest.raises(ValueError, match="too little"):
        evaluate.check_sufficiency(d)


def test_slots_are_kept_for_history_and_documents(spark):
    def run(sources, limit):
        d = spark.createDataFrame([("q", n + 1, s, f"t{n}") for n, s in enumerate(sources)], "query_id string, rank int, source string, text string")
        return [r.text for r in suggest.reserve_slots(d, F.lit(limit)).orderBy("rank").collect()]

    assert run(["query"] * 3 + ["history", "doc"], 3) == ["t0", "t1", "t4"]  # the document puts out the history item just put in
    assert run(["query", "doc", "query", "history"], 3) == ["t0", "t1", "t3"]
    assert run(["query", "doc"], 3) == ["t0", "t1"]
    assert run(["history", "query", "query", "doc"], 2) == ["t0", "t3"]


def test_experiments(spark):
    d = spark.createDataFrame([(n, str(n)) for n in range(200)] + [(-1, "")], "id long, subject string")
    got = experiment.assign(d, experiment.definitions(spark, experiment.EXAMPLE)).collect()
    by = defaultdict(dict)
    for r in got:
        by[r.key][r.id] = (r.bucket, r.variant)
    assert set(by) == {"ranker", "layout"} and len(by["layout"]) == 200
    assert all(v == ("control" if b < 60 else "candidate") and b < 90 for b, v in by["ranker"].values())


def test_config_values(spark):
    rows = [(1, {"a": "1.0", "b": "true"}), (2, {"a": "2.5"}), (3, {"c": None})]
    got = dict(map(tuple, ev.project_config(spark.createDataFrame(rows, "seq long, settings map<string,string>")).collect()))
    assert got == {"a": "2.5", "b": "true", "c": ""}


def test_synthetic_corpus_is_repeatable(spark):
    a, b = (as_set(ev.synthetic_corpus(spark, 50).select("video_id", "title")) for _ in range(2))
    assert a == b and len({t for _, t in a}) > 40


def test_datasets_and_lists_are_written(spark, tmp_path):
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id"))
    d = spark.range(100).select(F.concat(F.lit("q"), F.col("id") % 20).alias("query"), F.col("id").alias("video_id"), (F.col("id") % 3).cast("int").alias("label"), at.alias("updated_at"))
    counts = evaluate.write_dataset(d, str(tmp_path / "ltr"), rows=100, queries=20)
    back = spark.read.parquet(str(tmp_path / "ltr"))
    assert counts == {"rows": 100, "queries": 20, "positives": 66} and back.count() == 100
    assert back.filter("split = 'train'").agg(F.max("updated_at")).first()[0] <= back.filter("split = 'valid'").agg(F.min("updated_at")).first()[0]
    with pytest.raises(ValueError, match="too little"):
        evaluate.write_dataset(d, str(tmp_path / "ltr2"))
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    trending.publish(spark.createDataFrame([("v", "a", 1)], "domain string, item string, rank int"), str(tmp_path / "list"), now, 300)
    listed = spark.read.parquet(str(tmp_path / "list"))
    assert trending.published(listed, now + F.expr("INTERVAL 300 SECONDS")).count() == 1 and trending.published(listed, now + F.expr("INTERVAL 301 SECONDS")).count() == 0


def test_splits_inside_one_instant(spark):
    d = spark.createDataFrame([(f"q{n % 10}", n) for n in range(100)], "query string, video_id int").withColumn("updated_at", F.lit("2024-01-01").cast("timestamp"))
    got = {(r.query, r.split) for r in evaluate.time_split(d).select("query", "split").distinct().collect()}
    assert got == {(f"q{n}", "train" if n < 8 else "valid") for n in range(10)}


def test_any_column_can_score(spark):
    from wayfind.plans.search import rerank

    d = spark.createDataFrame([("q", n, "c", float(n), 0.0, 0.0, 0.0) for n in range(4)], "query_id string, video_id int, channel_id string, text_rank double, affinity double, channel_affinity double, session_intent double")
    got = {r.video_id: round(r.score, 6) for r in rerank(d, -F.col("text_rank"), penalty=0.0).collect()}
    assert got == {0: 0.0, 1: -1.0, 2: -2.0, 3: -3.0}


def test_exclusions_beyond_the_list(spark):
    """A request that excludes more than lists allow for is answered from the whole pool."""
    from wayfind.plans import recommend

    docs = spark.range(60).select(F.col("id").alias("video_id"), F.lit("c").alias("channel_id"), (60 - F.col("id")).alias("views"), F.lit(None).cast("timestamp").alias("published_at"), F.lit(True).alias("eligible"), F.lit(False).alias("is_sensitive"), F.lit("en").alias("language"))
    asked = spark.createDataFrame([(1, False), (2, False)], "request_id int, hide_sensitive boolean")
    gone = spark.createDataFrame([(1, n) for n in range(30)] + [(2, 0)], "request_id int, video_id long")
    rows = recommend.feed_lists(asked, docs, [F.col("views").desc()], 3, False, "request_id", gone, spare=5).collect()
    assert sorted((r.request_id, r.rank, r.video_id) for r in rows) == [(1, 1, 30), (1, 2, 31), (1, 3, 32), (2, 1, 1), (2, 2, 2), (2, 3, 3)]


@pytest.mark.parametrize("hot", [1, 1000])
def test_overlap_with_hot_and_rare_features(spark, hot, monkeypatch):
    """The bounded lists give what all pairs give, whether features are hot or rare."""
    from wayfind.plans import recommend

    monkeypatch.setattr(recommend, "HOT", hot)
    rng = random.Random(5)
    rows = [(n, f"c{n % 4}", rng.choice(["a", "b", None]), rng.choice(["en", "fr"]), rng.sample("uvwxyz", rng.randrange(4)), rng.randrange(50), n % 7 == 0, n % 5 != 0) for n in range(80)]
    docs = spark.createDataFrame(rows, "video_id long, channel_id string, category string, language string, tags array<string>, views long, is_sensitive boolean, eligible boolean").withColumn("published_at", F.lit(None).cast("timestamp"))
    seeds = docs.select(F.col("video_id").alias("seed_id"), (F.col("video_id") % 2 == 0).alias("hide_sensitive"))
    got = {(r.seed_id, r.rank): (r.video_id, r.overlap) for r in recommend.related_overlap(seeds, docs, 4).collect()}
    want = {}
    for s in rows:
        found = []
        for d in rows:
            both = int(s[2] is not None and s[2] == d[2]) + int(s[3] == d[3]) + len(set(s[4]) & set(d[4]))
            if d[7] and d[0] != s[0] and both and not (s[0] % 2 == 0 and d[6]):
                found.append((-both, -d[5], d[0]))
        want |= {(s[0], k): (v, -o) for k, (o, _, v) in enumerate(sorted(found)[:4], 1)}
    assert got == want


@pytest.mark.parametrize("width", [7, 50, 10**6])
def test_next_ends_of_runs(spark, width):
    rng = random.Random(3)
    ends = [(n, rng.choice(["r1", "r1", "r2", None])) for n in sorted(rng.sample(range(1, 300, 2), 25))]
    marks = [(f"v{rng.randrange(5)}", rng.choice([-1, *range(0, 300, 2)])) for _ in range(60)]
    want = set()
    for v, at in marks:
        after = [e for e in ends if e[0] > at]
        if after:
            want.add((v, *after[0]))
            want.update((v, *e) for e in [e for e in after if e[1] != after[0][1]][:1])
    got = projection.next_ends(spark.createDataFrame(marks, "video_id string, seq long"), spark.createDataFrame(ends, "seq long, run_id string"), width)
    assert {tuple(r) for r in got.collect()} == want


def plain_projection(rows):
    docs = {}
    hide = lambda d, why: d.update(eligible=False, reason=why)
    for e in sorted(rows, key=lambda r: r.seq):
        d = docs.get(e.video_id)
        if e.type in ("video.upsert", "reconcile.page"):
            p = e.doc.asDict()
            why = None if p["privacy"] == "public" and p["state"] == "published" else f"privacy_{p['privacy']}" if p["privacy"] != "public" else f"state_{p['state']}"
            run = e.run_id or (d or {}).get("run")
            docs[e.video_id] = {**p, "kind": p["kind"] or "local", "eligible": why is None, "reason": why, "run": run}
        elif e.type == "video.suppress":
            hide(docs.setdefault(e.video_id, {"kind": "local", "channel_id": None, "owner_id": None, "title": "", "views": 0, "likes": 0, "run": None}), e.reason)
        elif e.type == "video.stats" and d:
            d.update(views=e.views, likes=e.likes)
        elif e.type in ("channel.upsert", "channel.delete"):
            for x in docs.values():
                if x["channel_id"] == e.channel_id:
                    x.update(channel_handle=e.handle, channel_name=e.name, owner_id=e.owner) if e.type == "channel.upsert" else hide(x, "channel_deleted")
        elif e.type == "user.suppress":
            for x in docs.values():
                if x["owner_id"] == e.user_id:
                    if e.unlisted and x["eligible"]:
                        hide(x, "owner_unlisted")
                    elif not e.unlisted and x["reason"] == "owner_unlisted":
                        x.update(eligible=True, reason=None)
        elif e.type == "reconcile.end":
            for x in docs.values():
                if x["kind"] == "local" and x["eligible"] and x["run"] != e.run_id:
                    hide(x, "reconcile_orphan")
    return {v: (x["kind"], x["channel_id"], x.get("channel_name"), x["owner_id"], x["title"], x["views"], x["likes"], x["eligible"], x["reason"], x["run"]) for v, x in docs.items()}


def test_projection_matches_a_plain_interpreter(spark):
    rows = ingest_queries.domain_events(spark, "/root/testdata/sf0.001").persist()
    want = plain_projection(rows.collect())
    empty = spark.createDataFrame([], ingest_queries.DOC_DDL)
    cols = ("kind", "channel_id", "channel_name", "owner_id", "title", "views", "likes", "eligible", "suppressed_reason", "reconcile_run_id")
    got = {r.video_id: tuple(r[c] for c in cols) for r in projection.project_catalogue(empty, rows).collect()}
    assert got == want
    first, second = rows.filter("seq <= 400"), rows.filter("seq > 400")
    half = projection.project_catalogue(empty, first)
    again = {r.video_id: tuple(r[c] for c in cols) for r in projection.project_catalogue(half.select(*empty.columns), second).collect()}
    assert again == want


@pytest.mark.parametrize("batch", [10_000, 7])
def test_greedy_cap_is_the_plain_fold(spark, batch):
    """Dense and sparse keys, ties, null keys, keys that go on over Arrow batches."""
    rng = random.Random(batch)
    rows = [(rng.choice(["a", "b", None]), k, 1_700_000_000 + int(rng.expovariate(1 / 40) + 30 * k * (k % 3 > 0)), n) for n, k in enumerate(rng.randrange(30) for _ in range(3000))]
    rows += [("hot", 0, 1_700_000_000 + n // 3, n) for n in range(4000)]
    frame = spark.createDataFrame(rows, "k string, j int, t long, n int").withColumn("t", F.timestamp_seconds("t"))
    want, last = [], {}
    for k, j, t, n in sorted(rows, key=lambda r: (r[2], r[3])):
        if (k, j) not in last or t - last[k, j] >= 60:
            last[k, j] = t
            want.append((k, j, t, n))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = [(r.k, r.j, int(r.t.timestamp()), r.n) for r in windows.greedy_cap(frame, ["k", "j"], "t", 60.0).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got, key=str) == sorted(want, key=str)


def exchanges(df):
    """Shuffles of the plan as it starts; a shuffle that is used again counts each time."""
    return df._jdf.queryExecution().sparkPlan().toString().count("Join") + df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_basket_neighbors_equal_plain_counts_and_move_little(spark, monkeypatch):
    """Long sessions in pieces, repeated events, and no shuffle of single pairs."""
    rng = random.Random(3)
    rows = [(n, f"s{min(rng.randrange(30), 20)}", rng.randrange(25)) for n in range(400)]
    d = spark.createDataFrame(rows, "id long, session_id string, video_id long")
    count, mass = defaultdict(int), defaultdict(int)
    for n, s, v in rows:
        for n2, s2, v2 in rows:
            if s == s2 and v != v2 and n != n2:
                count[v, v2] += 1
                mass[v] += 1
    want = {k: round(0.7 * c / (mass[k[0]] * mass[k[1]]) ** 0.5 * c / (c + 10), 9) for k, c in count.items()}
    for size in (2048, 4):
        monkeypatch.setattr(covis, "SESSION", size, raising=False)
        got = {(r.video_id, r.neighbor_id): round(r.score, 9) for r in covis.basket_neighbors(d).collect()}
        assert got == pytest.approx(want, abs=2e-9)
    assert exchanges(covis.basket_neighbors(d)) <= 6


def test_sums_over_neighbours_equal_plain_ones_and_are_not_dealt_out(spark, monkeypatch):
    """Blocks of any size, split blocks and keys of several turns; one row a seed moves, none a product."""
    rng = random.Random(5)
    lists = {v: {w: rng.randrange(1, 50) / 64 for w in rng.sample(range(60), 20) if w != v} for v in range(50)}
    neighbors = spark.createDataFrame([(v, w, s) for v, near in lists.items() for w, s in near.items()], "video_id long, neighbor_id long, score double")
    seeds = {(f"u{rng.randrange(30)}", rng.randrange(60)): rng.randrange(1, 9) / 8 for _ in range(400)}
    own = spark.createDataFrame([(*k, w) for k, w in seeds.items()], "user_id string, video_id long, weight double")
    asked = [(f"u{rng.randrange(33)}", rng.randrange(70)) for _ in range(300)]
    items = spark.createDataFrame(asked, "user_id string, video_id long")
    sums, ones = defaultdict(float), defaultdict(float)
    for (u, v), w in seeds.items():
        for j, s in lists.get(v, {}).items():
            sums[u, j] += w * s
            ones[u, j] += s

    def best(of, k):
        found = defaultdict(list)
        for (u, j), s in of.items():
            if (u, j) not in seeds:
                found[u].append((-round(s, 9), j))
        return {(u, j): -s for u, rows in found.items() for s, j in sorted(rows)[:k]}

    got = lambda df: {tuple(r[:2]): round(r[2], 9) for r in df.collect()}
    for rows, few, chunk in ((500_000, 50_000, 1 << 19), (60, 10, 64)):
        for name, value in (("ROWS", rows), ("LISTS", few), ("CHUNK", chunk)):
            monkeypatch.setattr(covis, name, value, raising=False)
        assert got(covis.user_cf_topk(own, own, neighbors, 7)) == pytest.approx(best(sums, 7))
        assert got(covis.seed_topk(own.select("user_id", "video_id"), neighbors, 5)) == pytest.approx(best(ones, 5))
        assert got(covis.personal_affinity(items, own, neighbors)) == pytest.approx({k: sums[k] for k in set(asked) if k in sums})
        assert got(covis.seed_scores(own.select("user_id", "video_id"), items, neighbors)) == pytest.approx({k: ones[k] for k in set(asked) if k in ones})
    plan = covis.user_cf_topk(own, own, neighbors, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [user_id" not in plan and "neighbor_id" not in plan.split("FlatMapCoGroupsInArrow")[0]
    none = own.filter("user_id = 'x'")
    assert not got(covis.user_cf_topk(none, none, neighbors, 7)) and not got(covis.personal_affinity(items, own, neighbors.filter("score < 0")))
