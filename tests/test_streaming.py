import json
import os

import pytest
from pyspark.sql import functions as F

from wayfind.operators import rollups
from wayfind.streaming import intake, state

U = "00000000-0000-4000-8000-00000000000"


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))
    stamp = 1_700_000_000 + len(list(folder.iterdir()))  # streams take files by age
    os.utime(folder / name, (stamp, stamp))


def event(n, type_="search.submitted", at="2024-01-01T00:00:00Z", **payload):
    return {"event_id": f"{U}{n}", "type": type_, "occurred_at": at, "schema_version": 1, "payload": payload}


def test_intake_is_idempotent_and_failures_can_be_sent_again(spark, tmp_path):
    put(tmp_path / "in", "a.json", [event(1, query="  Blue  BOLT ", session_id="s"), event(1, query="blue bolt", session_id="s"), event(2, "video.play_started", video_id="no id")])
    for _ in range(2):
        intake.run_intake(spark, str(tmp_path / "in"), str(tmp_path / "ledger"), str(tmp_path / "c")).awaitTermination()
        put(tmp_path / "in", "b.json", [event(1, query="blue bolt", session_id="s"), event(2, "video.play_started", video_id=f"{U}9"), event(3, "unheard.of")])
    rows = {r.event_id[-1]: r for r in spark.read.parquet(str(tmp_path / "ledger")).collect()}
    assert sorted(rows) == ["1", "2", "3"]
    assert rows["1"].normalized_query == "blue bolt"
    intake.run_failures(spark, str(tmp_path / "in"), str(tmp_path / "bad"), str(tmp_path / "c2")).awaitTermination()
    assert [r.message for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ["bad id"]


def test_fold_by_batches_equals_recount(spark, tmp_path):
    schema = "normalized_query string, video_id string, type string, occurred_at timestamp"
    stamp = "2024-01-01T00:00:00Z"
    rows = [{"normalized_query": q, "video_id": v, "type": t, "occurred_at": stamp} for q in "ab" for v in "xyz" for t in ("video.impression", "search.result_clicked")]
    put(tmp_path / "in", "a.json", rows[:5])
    put(tmp_path / "in", "b.json", rows[5:])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    empty = spark.createDataFrame([], "normalized_query string, video_id string, impressions long, clicks long, meaningful_watches long, updated_at timestamp")
    intake.run_fold(stream, empty, rollups.fold_engagement, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    last = spark.read.parquet(str(tmp_path / "out" / "1"))
    whole = rollups.engagement_counts(spark.read.schema(schema).json(str(tmp_path / "in")))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, whole.select(*last.columns).collect()))


@pytest.fixture
def run(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")

    def go(rows, schema, transform):
        spark.conf.set("spark.sql.shuffle.partitions", "2")  # a state store and a worker each
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else timers keep an available-now run going
        for n, part in enumerate(rows):
            put(tmp_path / "in", f"{n}.json", part)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        q = transform(stream).writeStream.outputMode("update").format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        try:
            assert q.awaitTermination(120), "the stream did not end"
            return spark.table("found").collect()
        finally:
            q.stop()

    yield go
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_session_list(run):
    at = lambda m: f"2024-01-01T00:{m:02d}:00Z"
    rows = [[{"session_id": "s", "item": i, "occurred_at": at(m)} for m, i in enumerate("abc")], [{"session_id": "s", "item": "d", "occurred_at": at(9)}]]
    out = run(rows, "session_id string, item string, occurred_at timestamp", lambda d: state.session_push(d, 3))
    assert max(out, key=lambda r: r.updated_at)["items"] == ["d", "c", "b"]


def test_late_items_take_their_place(run):
    at = lambda m: f"2024-01-01T00:{m:02d}:00Z"
    rows = [[{"session_id": "s", "item": i, "occurred_at": at(m)} for i, m in (("a", 1), ("c", 5))], [{"session_id": "s", "item": "b", "occurred_at": at(3)}]]
    out = run(rows, "session_id string, item string, occurred_at timestamp", lambda d: state.session_push(d, 3))
    assert ["c", "b", "a"] in [r["items"] for r in out]


def test_late_bumps_are_held_against_those_that_passed(run):
    times = [[0, 300], [100, 250, 20]]
    rows = [[{"item": "i", "subject": "u", "occurred_at": f"2024-01-01T00:{t // 60:02d}:{t % 60:02d}Z"} for t in part] for part in times]
    out = run(rows, "item string, subject string, occurred_at timestamp", lambda d: state.capped_bumps(d, 60.0))
    assert sorted(r.occurred_at.minute * 60 + r.occurred_at.second for r in out) == [0, 100, 300]


def test_capped_bumps_match_the_array_fold(spark, run):
    from wayfind.operators.windows import greedy_cap

    times = [0, 10, 59, 60, 61, 119, 120, 300, 310]
    rows = [[{"item": "i", "subject": "u", "occurred_at": f"2024-01-01T00:{t // 60:02d}:{t % 60:02d}Z"} for t in part] for part in (times[:4], times[4:])]
    schema = "item string, subject string, occurred_at timestamp"
    out = run(rows, schema, lambda d: state.capped_bumps(d, 60.0))
    flat = spark.createDataFrame([(r["item"], r["subject"], r["occurred_at"]) for p in rows for r in p], "item string, subject string, t string").select("item", "subject", F.to_timestamp("t").alias("occurred_at"))
    assert sorted(r.occurred_at for r in out) == sorted(r.occurred_at for r in greedy_cap(flat, ["item", "subject"], "occurred_at", 60.0).collect())


def test_watch_weight_decays(run):
    rows = [[{"user_id": "u", "video_id": "v", "delta": 1.0, "occurred_at": "2024-01-01T00:00:00Z"}], [{"user_id": "u", "video_id": "v", "delta": 0.5, "occurred_at": "2024-01-01T00:01:00Z"}]]
    out = run(rows, "user_id string, video_id string, delta double, occurred_at timestamp", lambda d: state.watch_weights(d, 60.0))
    assert max(r.weight for r in out) == pytest.approx(1.0)
    assert out[-1].weight == pytest.approx(1.0 * 0.5 + 0.5)
