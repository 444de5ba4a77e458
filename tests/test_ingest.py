"""The ingest router: batch by batch as in one go, failures, repeats, and each part of the state."""

import json
import os
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wayfind.operators import trending
from wayfind.plans import ingest
from wayfind.sources import events as ev
from wayfind.streaming.tables import KeyedTables

U = "00000000-0000-4000-8000-0000000000"


def uid(n):
    return f"{U[: 36 - max(2, len(str(n)))]}{n:02d}"


def event(n, type_, minute=0, **payload):
    return {"event_id": uid(n), "type": type_, "occurred_at": f"2024-01-01T00:{minute:02d}:00Z", "schema_version": 1, "payload": payload}


def video(n, **fields):
    return {"id": uid(n), "title": f"t{n}", "channel_id": "c", "owner_id": "o", "privacy": "public", "state": "published", "views": 1, "likes": 0} | fields


PARTS = [
    [
        event(1, "video.upsert", 0, video=video(70)),
        event(2, "video.upsert", 1, video=video(71, privacy="private")),
        event(3, "search.submitted", 2, query=" Blue  Bolt", session_id="s", user_id=uid(90), allow_history=True),
        event(4, "video.play_started", 3, video_id=uid(70), session_id="s", user_id=uid(90), allow_history=True, query="blue bolt"),
        event(5, "search.config_updated", 4, settings={"a": "1.0", "b": "x"}),
        event(6, "video.play_started", 5, video_id="bad"),
    ],
    [
        event(3, "search.submitted", 6, query="blue bolt", session_id="s", user_id=uid(90), allow_history=True),
        event(7, "video.watch_progress", 7, video_id=uid(70), session_id="s", user_id=uid(90), allow_history=True, position_seconds=40, duration_seconds=100),
        event(8, "search.submitted", 8, query="BLUE bolt", session_id="s", user_id=uid(90), allow_history=True),
        event(9, "video.suppress", 9, video_id=uid(70), reason="blocked"),
        event(10, "reconcile.page", 10, run_id=uid(60), videos=[video(72), video(73)]),
        event(11, "search.config_updated", 11, settings={"a": "2.5"}),
        event(6, "video.play_started", 12, video_id=uid(72), session_id="q"),
    ],
    [event(12, "search.submitted", 13, query="other", session_id="s", user_id=uid(91), allow_history=True), event(13, "user.history_deleted", 14, user_id=uid(90), scope="all"), event(14, "reconcile.end", 15, run_id=uid(60))],
]


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))
    stamp = 1_700_000_000 + len(list(folder.iterdir()))
    os.utime(folder / name, (stamp, stamp))


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def shown(state):
    return {
        "documents": rows(state["documents"], "video_id", "title", "eligible", "suppressed_reason", "reconcile_run_id"),
        "ledger": rows(state["ledger"], "type", "user_id", "normalized_query", "video_id"),
        "history": rows(state["history"], "user_id", "normalized_query", "use_count", "hidden"),
        "projection": [(u, v, round(w, 6)) for u, v, w in rows(state["projection"], "user_id", "video_id", "weight")],
        "settings": rows(state["settings"], "key", "value"),
        "bumps": rows(state["bumps"], "domain", "item", "subject"),
        "failures": rows(state["failures"], "event_id", "message"),
        "inbox": rows(state["inbox"], "event_id"),
    }


def test_ingest_by_batches(spark, tmp_path):
    now = F.lit("2024-01-02").cast("timestamp")
    state = ingest.empty_state(spark)
    after = []
    for n, part in enumerate(PARTS):
        put(tmp_path / "in", f"{n}.json", part)
        batch = ev.read_events(spark, str(tmp_path / "in" / f"{n}.json")).withColumn("seq", F.lit(n << 44) + F.monotonically_increasing_id())
        state = {k: spark.createDataFrame(v.collect(), v.schema) for k, v in ingest.ingest(batch, state, now).items()}
        after.append(shown(state))
    assert after[0]["documents"] == [(uid(70), "t70", True, None, None), (uid(71), "t71", False, "privacy_private", None)]
    assert after[0]["history"] == [(uid(90), "blue bolt", 1, False)] and after[0]["failures"] == [(uid(6), "bad id")]
    assert after[0]["settings"] == [("a", "1"), ("b", "x")] and after[0]["projection"] == [(uid(90), uid(70), 0.3)]
    assert after[1]["history"] == [(uid(90), "blue bolt", 2, False)]  # the repeat counts nothing
    assert ("video.meaningful_watch", uid(90), "blue bolt", uid(70)) in after[1]["ledger"]  # its query comes from an earlier batch
    assert ("video.play_started", None, None, uid(72)) in after[1]["ledger"]  # the corrected event passes
    assert after[1]["settings"] == [("a", "2.5"), ("b", "x")]
    assert after[2]["documents"] == [(uid(70), "t70", False, "blocked", None), (uid(71), "t71", False, "privacy_private", None), (uid(72), "t72", True, None, uid(60)), (uid(73), "t73", True, None, uid(60))]
    assert after[2]["history"] == [(uid(91), "other", 1, False)] and after[2]["projection"] == []
    assert not any(u == uid(90) for _, u, _, _ in after[2]["ledger"]) and len(after[2]["ledger"]) == len(after[1]["ledger"]) + 1
    assert [d for d, _, _ in after[2]["bumps"]].count("q") == 3
    # as a stream, a file a batch
    root = str(tmp_path / "state")
    reader = ingest.run_ingest(spark, str(tmp_path / "in"), root, str(tmp_path / "c"), now, files=1, buckets=8)
    assert reader.awaitTermination(240) is not False
    assert streamed(ingest.read_state(spark, root, 8)) == {k: v for k, v in after[2].items() if k in STREAMED}
    assert ingest.erase(spark, root, 8) == 2  # rows of u90 are of one day, in two batches
    assert streamed(ingest.read_state(spark, root, 8))["ledger"] == after[2]["ledger"]


STREAMED = ("documents", "ledger", "history", "projection", "settings", "failures")


def streamed(state):
    return {k: v for k, v in shown(state | {"bumps": state["accepted"], "inbox": state["watched"]}).items() if k in STREAMED}


def judged(spark, part):
    rows = [(r["event_id"], r["type"], r["occurred_at"], 1, json.dumps(r["payload"]), k) for k, r in enumerate(part)]
    frame = spark.createDataFrame(rows, "event_id string, type string, t string, schema_version int, payload string, line int")
    frame = frame.withColumns({"occurred_at": F.to_timestamp("t"), "received_at": F.lit("2024-01-02").cast("timestamp")}).drop("t")
    return ev.judge(frame, F.col("received_at"))


CATALOGUE = [
    [event(20, "video.upsert", 0, video=video(70, channel_id=uid(1), owner_id=uid(5))), event(21, "video.upsert", 0, video=video(71, channel_id=uid(1), owner_id=uid(5))), event(22, "video.upsert", 0, video=video(72, channel_id=uid(2), owner_id=uid(6)))],
    [event(23, "channel.upsert", 1, channel={"id": uid(1), "handle": "h", "display_name": "C", "owner_id": uid(7)}), event(24, "user.suppress", 1, user_id=uid(7), unlisted=True)],
    [event(25, "video.upsert", 2, video=video(71, channel_id=uid(2), owner_id=uid(6))), event(26, "channel.delete", 2, channel_id=uid(1))],
    [event(27, "user.suppress", 3, user_id=uid(6), unlisted=True), event(28, "user.suppress", 3, user_id=uid(7), unlisted=False)],
    [event(29, "reconcile.page", 4, run_id=uid(60), videos=[video(72, channel_id=uid(2), owner_id=uid(6))]), event(30, "reconcile.end", 4, run_id=uid(60))],
]


def test_channel_and_owner_events_reach_documents_in_other_buckets(spark, tmp_path):
    store = ingest.tables_at(spark, str(tmp_path / "state"), 16)
    state = ingest.empty_state(spark)
    for n, part in enumerate(CATALOGUE):
        ingest.advance(store, n, judged(spark, part), ["line"])
    rows_ = [dict(r, line=k) for k, r in enumerate(r for part in CATALOGUE for r in part)]
    frame = judged(spark, rows_).withColumn("seq", F.col("line").cast("long")).drop("p", "_why", "received_at", "line")
    want = ingest.ingest(frame, state, F.lit("2024-01-02").cast("timestamp"))["documents"]
    assert rows(ingest.read_state(spark, str(tmp_path / "state"), 16)["documents"], *want.columns) == rows(want, *want.columns)


@pytest.mark.parametrize("table", ["watched", "placements", "history", "trend_scores"])
def test_a_batch_that_dies_between_tables_is_repaired(spark, tmp_path, table, monkeypatch):
    root = str(tmp_path / "state")
    store = ingest.tables_at(spark, root, 4)
    parts = [PARTS[0], PARTS[1] + CATALOGUE[0]]
    ingest.advance(store, 0, judged(spark, parts[0]), ["line"])
    before = streamed(ingest.read_state(spark, root, 4))
    whole, put = KeyedTables.write, []

    def dies(self, name, n, *rest):
        put.append(name)
        if name == table:
            raise RuntimeError("lost")
        return whole(self, name, n, *rest)

    monkeypatch.setattr(KeyedTables, "write", dies)
    with pytest.raises(RuntimeError, match="lost"):
        ingest.advance(store, 1, judged(spark, parts[1]), ["line"])
    monkeypatch.setattr(KeyedTables, "write", whole)
    assert len(put) > 1 and streamed(ingest.read_state(spark, root, 4)) == before  # what it wrote is of no account
    for _ in range(2):  # once committed, it changes nothing any more
        ingest.advance(ingest.tables_at(spark, root, 4), 1, judged(spark, parts[1]), ["line"])
    clean = ingest.tables_at(spark, str(tmp_path / "clean"), 4)
    for n, part in enumerate(parts):
        ingest.advance(clean, n, judged(spark, part), ["line"])
    again, want = ingest.read_state(spark, root, 4), ingest.read_state(spark, str(tmp_path / "clean"), 4)
    assert streamed(again) == streamed(want) and rows(again["trend_scores"], "item", "score") == rows(want["trend_scores"], "item", "score")
    assert len(streamed(again)["ledger"]) > len(before["ledger"])


def test_batches_cost_what_they_touch(spark, tmp_path, monkeypatch):
    """Later batches read and write as much as earlier ones, and files don't pile up."""
    root, buckets, read, wrote = tmp_path / "state", 32, [], []
    store = ingest.tables_at(spark, str(root), buckets)
    held, put = KeyedTables.read, KeyedTables.write
    monkeypatch.setattr(KeyedTables, "read", lambda self, t, v, b=None: (read.append(len([x for x in (v.get(t, {}) if b is None else b) if x in v.get(t, {})])), held(self, t, v, b))[1])
    monkeypatch.setattr(KeyedTables, "write", lambda self, t, n, r, b: (wrote.append(len(b)), put(self, t, n, r, b))[1])
    cost, files = [], []
    for n in range(6):
        user = uid(10 + n % 2)
        part = [event(1000 + 10 * n + k, "search.submitted", n, query=f"q{n}", session_id=f"s{n}", user_id=user, allow_history=True) for k in range(3)]
        ingest.advance(store, n, judged(spark, part), ["line"])
        cost.append((sum(read), sum(wrote)))
        files.append(len(list(root.glob("*/batch=*/bucket=*/*.parquet"))))
        read.clear()
        wrote.clear()
    assert len({w for _, w in cost}) <= 2 and max(w for _, w in cost) <= 8 and max(r for r, _ in cost) <= 12
    assert not (root / "batches").exists() or not list((root / "batches").iterdir())
    assert len(list((root / "commits").glob("[0-9]"))) == 2
    assert files[-1] - files[-2] <= 4  # a new query's own bucket in each trend table, no second copies
    assert [r[2] for r in rows(ingest.read_state(spark, str(root), buckets)["trend_days"], "item", "day", "total")] == [3] * 6


def test_numbers_are_gapless_and_above_those_of_earlier_batches(spark, tmp_path):
    frame = spark.range(10_000).repartition(50).withColumn("k", F.col("id"))
    for n in (0, 7):
        got = [r.seq for r in ingest.numbered(frame, n, ["k"], str(tmp_path / str(n))).orderBy("k").collect()]
        assert got == list(range(n << 40, (n << 40) + 10_000))


def test_trend_state_of_any_batches_is_the_recount(spark):
    rng = random.Random(4)
    bumps = [("q", f"i{rng.randrange(4)}", f"u{rng.randrange(60)}", 1_704_000_000 + rng.randrange(200_000)) for _ in range(3000)]
    frame = lambda part: spark.createDataFrame([(d, i, u, datetime.fromtimestamp(t, UTC)) for d, i, u, t in part], ingest.STATE["bumps"])
    now = F.lit("2024-01-03").cast("timestamp")
    bumps.sort(key=lambda b: b[3])
    state = {t: spark.createDataFrame([], ingest.KEYED[t][0]) for t in ("accepted", "trend_days", "trend_scores")}
    for k in range(0, 3000, 750):
        part = frame(bumps[k : k + 750])
        taken = trending.accept_bumps(state["accepted"], part)
        state = {"trend_days": trending.fold_days(state["trend_days"], part), "trend_scores": trending.fold_scores(state["trend_scores"], taken), "accepted": state["accepted"].unionByName(taken)}
        state = {t: spark.createDataFrame(df.collect(), df.schema) for t, df in state.items()}
    every = frame(bumps)
    capped = trending.capped(every)
    assert rows(state["accepted"], "item", "subject", "occurred_at") == rows(capped, "item", "subject", "occurred_at")
    close = lambda df: [(i, round(s, 6)) for i, s in rows(df, "item", "score")]
    assert close(trending.scores_at(state["trend_scores"], now)) == close(trending.trend_scores(capped, now))
    got = trending.days_at(state["trend_days"], now)
    assert rows(got, "item", "total") == rows(trending.trend_total(every, now), "item", "total")
    exact = dict(rows(trending.trend_distinct(every, now, exact=True), "item", "distinct_users"))
    assert all(abs(n - exact[i]) <= 0.05 * exact[i] for i, n in rows(got, "item", "distinct_users")) and state["trend_days"].count() <= 4 * 4


def test_late_bumps_are_held_against_all_that_counted(spark):
    at = lambda m: datetime(2024, 1, 1, 0, 0, tzinfo=UTC) + timedelta(minutes=m)
    frame = lambda ms: spark.createDataFrame([("q", "i", "u", at(m)) for m in ms], ingest.STATE["bumps"])
    held = frame([100 * k for k in range(40)])  # more than any fixed number kept
    got = trending.accept_bumps(held, frame([30, 50, 70, 3960, 3970, 4030]))
    assert [r.occurred_at.replace(tzinfo=UTC) for r in got.orderBy("occurred_at").collect()] == [at(3960), at(4030)]
