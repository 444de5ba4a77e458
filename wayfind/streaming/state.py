"""Keyed stream state: session lists that expire, capped trend bumps, decayed watch weights.

They need the RocksDB state store (spark.sql.streaming.stateStore.providerClass), and runs that take what is available
and end need spark.sql.streaming.noDataMicroBatches.enabled off, since expiry asks for batches without data.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RECENT_SCHEMA = "session_id string, items array<string>, updated_at timestamp"
CAPPED_SCHEMA = "item string, subject string, occurred_at timestamp"
WEIGHT_SCHEMA = "user_id string, video_id string, weight double, last_watched_at timestamp"


class RecentItems(StatefulProcessor):
    """The last k items of a session by event time, newest first; a session is forgotten once nothing came for ttl_ms."""

    def __init__(self, k: int = 20, ttl_ms: int = 7_200_000) -> None:
        self.k, self.ttl_ms = k, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getListState("items", "item string, at timestamp", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("occurred_at", kind="stable")
        held = [tuple(x) for x in self.items.get()] if self.items.exists() else []
        held = [*reversed(list(zip(new["item"], new["occurred_at"], strict=True))), *held]
        held = sorted(held, key=lambda x: pd.Timestamp(x[1]), reverse=True)[: self.k]  # by event time: what comes late takes its own place
        self.items.put([(i, pd.Timestamp(at).to_pydatetime()) for i, at in held])
        yield pd.DataFrame({"session_id": [key[0]], "items": [[i for i, _ in held]], "updated_at": [pd.Timestamp(held[0][1])]})

    def close(self) -> None:
        pass


class CappedBumps(StatefulProcessor):
    """Passes a subject's bump of an item only if it lies cap_s or more from those that passed, before or after; in order of time that is the cap's rule.

    All that passed within horizon_s of the latest bump are held; bumps older than that are dropped, so none is judged by less than all.
    """

    def __init__(self, cap_s: float = 3600.0, horizon_s: float = 604_800.0) -> None:
        self.cap_s, self.horizon_s = cap_s, horizon_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.passed = handle.getListState("passed", "at double", int((self.cap_s + self.horizon_s) * 1000))
        self.latest = handle.getValueState("latest", "at double", int((self.cap_s + self.horizon_s) * 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        passed = sorted(x[0] for x in self.passed.get()) if self.passed.exists() else []
        latest = self.latest.get()[0] if self.latest.exists() else float("-inf")
        new, kept = pd.concat(list(rows))["occurred_at"].sort_values(), []
        if latest < new.iloc[-1].timestamp():
            latest = new.iloc[-1].timestamp()
            self.latest.update((latest,))
        for at in new:
            t = at.timestamp()
            k = bisect.bisect_left(passed, t)
            if t >= latest - self.horizon_s and (k == 0 or t - passed[k - 1] >= self.cap_s) and (k == len(passed) or passed[k] - t >= self.cap_s):
                passed.insert(k, t)
                kept.append(at)
        if kept:
            self.passed.put([(t,) for t in passed if t >= latest - self.horizon_s - self.cap_s])
            yield pd.DataFrame({"item": key[0], "subject": key[1], "occurred_at": kept})

    def close(self) -> None:
        pass


class WatchWeight(StatefulProcessor):
    """A user's decayed weight of a video: decay to the event's time, then add."""

    def __init__(self, half_life_s: float = 2_592_000.0) -> None:
        self.half_life_s = half_life_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "weight double, at double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        weight, last = self.held.get() if self.held.exists() else (0.0, None)
        for at, delta in pd.concat(list(rows)).sort_values("occurred_at")[["occurred_at", "delta"]].itertuples(index=False):
            now = at.timestamp()
            if last is None:
                weight, last = delta, now
            elif now >= last:
                weight, last = weight * 2 ** (-(now - last) / self.half_life_s) + delta, now
            else:  # came late: decayed by its own age instead
                weight += delta * 2 ** (-(last - now) / self.half_life_s)
        self.held.update((weight, last))
        yield pd.DataFrame({"user_id": [key[0]], "video_id": [key[1]], "weight": [weight], "last_watched_at": [pd.Timestamp(last, unit="s")]})

    def close(self) -> None:
        pass


def _run(rows: DataFrame, keys: tuple[str, ...], processor: StatefulProcessor, schema: str) -> DataFrame:
    return rows.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="update", timeMode="processingTime")


def session_push(events: DataFrame, k: int = 20, ttl_ms: int = 7_200_000) -> DataFrame:
    """session_id, items, updated_at of a stream of session_id, item, occurred_at."""
    return _run(events, ("session_id",), RecentItems(k, ttl_ms), RECENT_SCHEMA)


def capped_bumps(bumps: DataFrame, cap_s: float = 3600.0, horizon_s: float = 604_800.0) -> DataFrame:
    """item, subject, occurred_at of a stream of the same columns."""
    return _run(bumps, ("item", "subject"), CappedBumps(cap_s, horizon_s), CAPPED_SCHEMA)


def watch_weights(events: DataFrame, half_life_s: float = 2_592_000.0) -> DataFrame:
    """user_id, video_id, weight, last_watched_at of a stream of user_id, video_id, delta, occurred_at."""
    return _run(events, ("user_id", "video_id"), WatchWeight(half_life_s), WEIGHT_SCHEMA)
