"""Per-request ordering, paging, capping and normalising."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int | Column) -> DataFrame:
    """The first k rows of each key; Spark limits each task's groups before the shuffle where k is a number."""
    rows = ranked(df, by, order, "_rank")
    return rows.filter(F.col("_rank") <= k).drop("_rank")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_k(df, keys, order, 1)


def page(df: DataFrame, by: list[str], order: list[Column], limit: int | Column, offset: int | Column = 0) -> DataFrame:
    offset = F.lit(offset) if isinstance(offset, int) else offset
    return ranked(df, by, order).filter((F.col("rank") > offset) & (F.col("rank") <= offset + limit))


def clamp_limit(limit: Column, default: int, highest: int) -> Column:
    """A missing or non-positive limit is the default."""
    return F.when(limit.isNull() | (limit <= 0), default).otherwise(F.least(limit, F.lit(highest)))


def clamp_suggest_limit(limit: Column, default: int = 10, highest: int = 20) -> Column:
    """Zero or missing is the default; negative is one."""
    return F.when(limit.isNull() | (limit == 0), default).otherwise(F.least(F.greatest(limit, F.lit(1)), F.lit(highest)))


def normalize_max(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Each column over its greatest value in the group; 0 where that is not positive."""
    over = Window.partitionBy(*by)
    return df.withColumns({c: F.when(F.max(c).over(over) > 0, F.col(c) / F.max(c).over(over)).otherwise(0.0) for c in columns})


def creator_penalty(df: DataFrame, by: list[str], penalty: float = 0.15, score: str = "score", channel: str = "channel_id", item: str = "video_id") -> DataFrame:
    """From a channel's third item on, in order of score, the score falls by `penalty` an item; rows without channel are exempt."""
    place = F.row_number().over(Window.partitionBy(*by, channel).orderBy(F.col(score).desc(), F.col(item)))
    off = F.when(F.col(channel).isNotNull() & (place > 2), penalty * (place - 2)).otherwise(0.0)
    return df.withColumn("_off", off).withColumn(score, F.col(score) - F.col("_off")).drop("_off")


def compose_cap(df: DataFrame, by: list[str], order: list[Column], cap: int = 2, limit: int | Column = 20, item: str = "video_id", channel: str = "channel_id") -> DataFrame:
    """In feed order: first occurrence of each item, at most `cap` of a channel (rows without one uncapped), then `limit`; adds rank."""
    once = first_per_key(df, [*by, item], order)
    place = F.row_number().over(Window.partitionBy(*by, channel).orderBy(*order))
    kept = once.withColumn("_place", place).filter(F.col(channel).isNull() | (F.col("_place") <= cap)).drop("_place")
    return page(kept, by, order, limit)


def list_score(df: DataFrame, by: list[str]) -> DataFrame:
    """(n - i) / n over the ranks 1..n of a list."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return df.withColumn("score", (n - F.col("rank") + 1) / n)


def interleave(df: DataFrame, by: list[str], stream: str, order: list[Column]) -> DataFrame:
    """Round-robin over numbered streams, each in its own order; adds place."""
    rows = ranked(df, [*by, stream], order, "_turn")
    return ranked(rows, by, [F.col("_turn"), F.col(stream)], "place").drop("_turn")


def greedy_cap(df: DataFrame, keys: list[str], ts: str, cap_s: float = 3600.0) -> DataFrame:
    """Rows kept per key: one only if at least `cap_s` after the last one kept; of one instant the least in the other columns.

    No window frame says this. Rows come sorted by key and time, and a task goes from one kept row to the next by binary search,
    so it holds a batch of rows and the last time kept, however many rows a key has. A null time is the least.
    """
    order = [*keys, ts, *[c for c in df.columns if c not in (*keys, ts)]]
    marked = df.select(*order, F.unix_micros(ts).alias("_at")).repartition(*keys).sortWithinPartitions(*order)
    cap, width = int(cap_s * 1e6), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, None  # the key at hand and its last time kept
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            at = pc.fill_null(batch.column(len(order)), -(2**62)).to_numpy(zero_copy_only=False)
            new = np.zeros(n, dtype=bool)
            for c in batch.columns[:width]:
                codes = pc.fill_null(c.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            first = tuple(c[0].as_py() for c in batch.columns[:width])
            new[0] = held is None or first != held[0]
            starts = np.flatnonzero(new)
            kept = starts.tolist()  # a key's first row is kept
            runs = [(0, int(starts[0]) if len(starts) else n, last)] if not new[0] else []
            ends = np.append(starts[1:], n)
            more = (ends - starts > 1) & (at[ends - 1] - at[starts] >= cap)
            runs += [(s + 1, e, int(at[s])) for s, e in zip(starts[more].tolist(), ends[more].tolist(), strict=True)]
            for s, e, before in runs:
                while (s := s + int(np.searchsorted(at[s:e], before + cap))) < e:
                    kept.append(s)
                    before = int(at[s])
                if e == n:
                    last = before
            if len(starts) and not more[-1]:
                last = int(at[starts[-1]])
            held = (tuple(c[n - 1].as_py() for c in batch.columns[:width]),)
            yield batch.take(pa.array(sorted(kept), pa.int64())).drop_columns(["_at"])

    return marked.mapInArrow(run, marked.drop("_at").schema).select(*keys, ts, *order[width + 1 :])


def run_groups(df: DataFrame, by: list[str], order: list[Column], key: str) -> DataFrame:
    """Numbers contiguous runs of equal key along the order, from 1."""
    over = Window.partitionBy(*by).orderBy(*order)
    new = F.when(F.lag(key).over(over).eqNullSafe(F.col(key)), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn("run", F.sum("_new").over(over.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def fuzzy_if_short(candidates: DataFrame, fuzzy: DataFrame, by: list[str], limit: Column | int) -> DataFrame:
    """All candidates, and the fuzzy ones of requests that have fewer exact-prefix candidates than the limit."""
    exact = candidates.groupBy(*by).agg(F.count_if("exact_prefix").alias("_exact"))
    short = fuzzy.join(exact, by, "left").filter(F.coalesce("_exact", F.lit(0)) < limit).drop("_exact")
    return candidates.unionByName(short)
