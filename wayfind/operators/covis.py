"""Co-visitation: items met in one session become weighted neighbours.

A pair is counted once, at its later event, so increments and a full recount agree. Long sessions are cut to time buckets of
the window's length, and an event meets only its own bucket and the one before, so no session is paired in full.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.functions.scoring import SHRINK, covis_blend, shrunk_cosine
from wayfind.operators.windows import top_k
from wayfind.sources.scratch import materialised


def _pairs(new: DataFrame, all_: DataFrame, keys: list[str], window_s: float | None) -> DataFrame:
    near = ["session_id", *keys]
    cut = lambda d: d.filter(" AND ".join(f"{c} IS NOT NULL" for c in [*near, "video_id"]))
    later = cut(new).select(*near, F.col("id").alias("id_n"), F.col("video_id").alias("v_n"), *([F.unix_micros("occurred_at").alias("t_n")] if window_s else []))
    earlier = cut(all_).select(*near, F.col("id").alias("id_p"), F.col("video_id").alias("v_p"), *([F.unix_micros("occurred_at").alias("t_p")] if window_s else []))
    met = (F.col("id_p") < F.col("id_n")) & (F.col("v_p") != F.col("v_n"))
    if window_s:
        width = int(window_s * 1e6)
        of = lambda t: F.floor(F.col(t) / width)
        later = later.withColumn("_bucket", F.explode(F.array(of("t_n") - 1, of("t_n"), of("t_n") + 1)))  # ids need not follow time
        earlier = earlier.withColumn("_bucket", of("t_p"))
        met = met & (F.abs(F.col("t_n") - F.col("t_p")) <= width)
        near = [*near, "_bucket"]
    return later.join(earlier, near).filter(met).groupBy(F.least("v_n", "v_p").alias("video_a"), F.greatest("v_n", "v_p").alias("video_b")).agg(F.count(F.lit(1)).alias("count"))


def co_watch_pairs(new: DataFrame, all_: DataFrame, window_s: float | None = 3600.0) -> DataFrame:
    """video_a < video_b and how often both were played in one session; `all_` holds `new` too. window_s None: no time limit."""
    played = lambda d: d.filter(F.col("type").isin("video.play_started", "video.meaningful_watch")) if "type" in d.columns else d
    return _pairs(played(new), played(all_), [], window_s)


def co_search_pairs(new: DataFrame, all_: DataFrame, window_s: float | None = 3600.0) -> DataFrame:
    """As co_watch_pairs, of clicks on results of one query."""
    clicked = lambda d: d.filter("type = 'search.result_clicked'")
    return _pairs(clicked(new), clicked(all_), ["normalized_query"], window_s)


def merge_counts(existing: DataFrame, pairs: DataFrame) -> DataFrame:
    return existing.unionByName(pairs).groupBy("video_a", "video_b").agg(F.sum("count").alias("count"))


def symmetrise(counts: DataFrame) -> DataFrame:
    c = F.col("count").cast("double").alias("c")
    return counts.select(F.col("video_a").alias("i"), F.col("video_b").alias("j"), c).unionAll(counts.select(F.col("video_b").alias("i"), F.col("video_a").alias("j"), c))


def node_mass(counts: DataFrame) -> DataFrame:
    """i and its summed counts over both directions."""
    return symmetrise(counts).groupBy("i").agg(F.sum("c").alias("t"))


def _directed(counts: DataFrame, score: str, shrink: float) -> DataFrame:
    edges, mass = symmetrise(counts), node_mass(counts)
    out = edges.join(mass.withColumnRenamed("t", "ti"), "i").join(mass.select(F.col("i").alias("j"), F.col("t").alias("tj")), "j")
    return out.select("i", "j", shrunk_cosine("c", "ti", "tj", shrink).alias(score))


def blend_edges(co_watch: DataFrame, co_search: DataFrame, shrink: float = SHRINK) -> DataFrame:
    """i, j, score: both shrunken cosines, blended; an edge that one table lacks counts 0 there."""
    both = _directed(co_watch, "w", shrink).join(_directed(co_search, "s", shrink), ["i", "j"], "full_outer")
    return both.select("i", "j", covis_blend(F.coalesce("w", F.lit(0.0)), F.coalesce("s", F.lit(0.0))).alias("score")).filter("score > 0")


def top_neighbors(edges: DataFrame, m: int | Column = 100) -> DataFrame:
    """video_id, neighbor_id, score, source, model_version: the best m of each item."""
    best = top_k(edges, ["i"], [F.round("score", 9).desc(), F.col("j")], m)
    return best.select(F.col("i").alias("video_id"), F.col("j").alias("neighbor_id"), "score", F.lit("blend").alias("source"), F.lit("covis-v1").alias("model_version"))


def covis_neighbors(events: DataFrame, window_s: float | None = 3600.0, shrink: float = SHRINK, top_m: int = 100) -> DataFrame:
    edges = blend_edges(co_watch_pairs(events, events, window_s), co_search_pairs(events, events, window_s), shrink)
    return top_neighbors(edges, top_m)


SESSION = 2048  # items of a session that one row pairs; a longer session is dealt out in pieces


def basket_neighbors(events: DataFrame, shrink: float = SHRINK, top_m: int = 100) -> DataFrame:
    """Neighbours from shared sessions alone, without a time limit: co-search is empty. An id is one event's own.

    A pair counts the events of one item times those of the other, summed over sessions, so an item's mass is known from sizes
    alone and goes along with the item. What moves is a row an item and session with the session's other items as arrays, dealt
    by item; counts, scores and the first of each item are taken where it lands. A session of n items is n * n / 2
    pairs, which is its result; one of over SESSION items is dealt out in pieces, each with all items beside its own.
    """
    played = events.filter(F.col("type").isin("video.play_started", "video.meaningful_watch")) if "type" in events.columns else events
    items = played.filter("session_id IS NOT NULL AND id IS NOT NULL AND video_id IS NOT NULL").groupBy("session_id", "video_id").agg(F.count(F.lit(1)).alias("m"))
    whole = Window.partitionBy("session_id")
    items = items.withColumns({"_all": F.sum("m").over(whole), "_n": F.count(F.lit(1)).over(whole)}).filter("_n > 1")
    items = items.withColumn("t", F.sum(F.col("m") * (F.col("_all") - F.col("m"))).over(Window.partitionBy("video_id"))).drop("_all")
    pieces = F.ceil(F.col("_n") / SESSION)
    dealt = items.withColumns({"_of": pieces, "_piece": F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1))})
    item = F.struct(F.col("video_id").alias("v"), "m", "t", (F.pmod(F.xxhash64("video_id"), F.col("_of")) == F.col("_piece")).alias("own"))
    sessions = dealt.groupBy("session_id", "_piece").agg(F.collect_list(item).alias("items"))
    met = sessions.select(F.explode(F.filter("items", lambda x: x["own"])).alias("x"), "items")
    others = F.filter("items", lambda y: y["v"] != F.col("x.v"))
    met = met.select(F.col("x.v").alias("i"), F.col("x.t").alias("ti"), F.col("x.m").alias("mi"), others.alias("o"))
    met = met.select("i", "ti", "mi", F.col("o.v").alias("js"), F.col("o.m").alias("ms"), F.col("o.t").alias("ts")).repartition("i")
    pairs = met.select("i", "ti", "mi", "ms", "ts", F.posexplode("js").alias("k", "j"))
    pairs = pairs.select("i", "ti", "j", (F.col("mi") * F.get("ms", F.col("k"))).alias("c"), F.get("ts", F.col("k")).alias("tj"))
    counts = pairs.groupBy("i", "ti", "j").agg(F.sum("c").alias("c"), F.first("tj").alias("tj"))
    edges = counts.select("i", "j", covis_blend(shrunk_cosine("c", "ti", "tj", shrink), F.lit(0.0)).alias("score"))
    return top_neighbors(edges.filter("score > 0"), top_m)


# reading neighbours


def neighbors_for(seeds: DataFrame, neighbors: DataFrame, k: int | Column) -> DataFrame:
    """seed_id, neighbor_id, score: the best k of each seed (seed_id, video_id)."""
    found = seeds.select("seed_id", "video_id").join(neighbors, "video_id")
    return top_k(found, ["seed_id"], [F.round("score", 9).desc(), F.col("neighbor_id")], k).select("seed_id", "neighbor_id", "score")


ROWS, LISTS = 500_000, 50_000  # rows of a block of keys; neighbour lists that a block may need before it is split by SPLIT
SPLIT = 10
CHUNK = 1 << 19  # products that a task sums at a time


def _total(pair: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order, and the sums of their values."""
    by = np.argsort(pair)
    pair = pair[by]
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    return pair[first], np.add.reduceat(value[by], first)


def _runs(a: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)


def _best(pair: np.ndarray, total: np.ndarray, who: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k of each run of who by score to nine places, then by pair."""
    value, keep = np.round(total, 9), np.ones(len(pair), bool)
    starts = _runs(who)
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(pair)], strict=False):
        if e - s > k:
            keep[s:e] = value[s:e] >= np.partition(value[s:e], e - s - k)[e - s - k]
    pair, total, value, who = pair[keep], total[keep], value[keep], who[keep]
    by = np.lexsort((pair, -value, who))
    starts = _runs(who[by])
    rank = np.arange(len(by)) - np.repeat(starts, np.diff(np.append(starts, len(by))))
    by = by[rank < k]
    return pair[by], total[by]


def _block_sums(rows: pa.Table, lists: pa.Table, k: int | None) -> pa.Table:
    """key, video_id, score of a block: rows (key, video_id, weight: null for no seed, named: an item), lists (video_id, n: ids, s: scores)."""
    schema = pa.schema([("key", rows.schema.field("key").type), ("video_id", pa.int64()), ("score", pa.float64())])
    if not len(rows) or not len(lists):
        return schema.empty_table()
    rows = rows.sort_by("key")
    codes = rows["key"].combine_chunks().dictionary_encode()
    key, item = codes.indices.to_numpy().astype(np.int64), rows["video_id"].to_numpy()
    weight, named, seed = rows["weight"].fill_null(0.0).to_numpy(), rows["named"].to_numpy(), rows["weight"].is_valid().to_numpy()
    flat = lambda c: np.concatenate([x.flatten().to_numpy() for x in lists[c].chunks])
    by = np.argsort(lists["video_id"].to_numpy())
    ends = np.cumsum(pc.list_value_length(lists["n"]).to_numpy().astype(np.int64))
    videos, begins, ends = lists["video_id"].to_numpy()[by], np.append(0, ends[:-1])[by], ends[by]
    near, score = flat("n"), flat("s")
    ids = np.unique(near)
    near = np.searchsorted(ids, near).astype(np.int32)
    at = np.minimum(np.searchsorted(videos, item), len(videos) - 1)
    met = seed & (videos[at] == item)
    begin, size = np.where(met, begins[at], 0), np.where(met, ends[at] - begins[at], 0)
    at = np.minimum(np.searchsorted(ids, item), len(ids) - 1)
    asked = np.where(named & (ids[at] == item), key * len(ids) + at, -1)
    work = np.append(0, np.cumsum(size))
    starts = _runs(key)
    starts = starts[_runs(work[starts] // CHUNK)]  # some keys a turn, about CHUNK products
    found = []
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=True):
        sums = []
        pieces = a + _runs((work[a:b] - work[a]) // (2 * CHUNK))  # a key may have any number of products
        for c, d in zip(pieces.tolist(), [*pieces[1:].tolist(), b], strict=True):
            n = size[c:d]
            row = np.repeat(np.arange(c, d), n)
            if len(row):
                entry = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + begin[row]
                sums.append(_total(key[row] * len(ids) + near[entry], weight[row] * score[entry]))
        if not sums:
            continue
        pair, total = sums[0] if len(sums) == 1 else _total(*map(np.concatenate, zip(*sums, strict=True)))
        wanted = np.unique(asked[a:b])
        spot = np.minimum(np.searchsorted(pair, wanted), len(pair) - 1)
        spot = spot[pair[spot] == wanted]
        if k is None:
            found.append((pair[spot], total[spot]))
        else:
            left = np.ones(len(pair), bool)
            left[spot] = False
            found.append(_best(pair[left], total[left], pair[left] // len(ids), k))
    if not found:
        return schema.empty_table()
    pair, total = map(np.concatenate, zip(*found, strict=True))
    return pa.table([codes.dictionary.take(pa.array(pair // len(ids))), pa.array(ids[pair % len(ids)]), pa.array(total)], schema=schema)


def _rows(df: DataFrame, weight: Column | None, named: bool) -> DataFrame:
    """Rows for _summed of key, video_id, …, written once."""
    weight = F.lit(None) if weight is None else weight
    rows = df.select(F.col(df.columns[0]).alias("key"), F.col("video_id").cast("long").alias("video_id"), weight.cast("double").alias("weight"), F.lit(named).alias("named"))
    return materialised(rows.filter("key IS NOT NULL AND video_id IS NOT NULL AND (weight IS NOT NULL OR named)"), "seeds")


def _summed(rows: DataFrame, neighbors: DataFrame, k: int | None) -> DataFrame:
    """key, video_id, score: neighbour scores times weights, summed over the seeds of each key. rows: as _rows has them.

    Without k of the named items alone, else the best k besides them. A key has far more neighbours than seeds, hardly
    any in common, so single neighbours are not dealt out: keys are cut to blocks by range, a list goes once to each block
    that has its item, and a task sums a block. A block of ROWS rows that needs over LISTS lists is split, so a task
    holds LISTS lists, or one a row of a split block. A key's rows and their lists must fit a task.
    """
    rows = rows.repartitionByRange(max(1, -(-rows.count() // ROWS)), "key")
    rows = materialised(rows.withColumn("_range", F.spark_partition_id()), "seed-blocks")  # a second exchange by range may cut elsewhere
    seeds = rows.filter("weight IS NOT NULL")
    needs = seeds.groupBy("_range").agg(F.count_distinct("video_id").alias("_lists"))
    split = F.pmod(F.xxhash64("key"), F.when(F.col("_lists") > LISTS, SPLIT).otherwise(1))
    rows = rows.join(needs, "_range").select((F.col("_range") * SPLIT + split).alias("_block"), "key", "video_id", "weight", "named")
    lists = neighbors.groupBy("video_id").agg(F.collect_list(F.struct(F.col("neighbor_id").cast("long").alias("n"), F.col("score").alias("s"))).alias("l"))
    lists = lists.select(F.col("video_id").cast("long").alias("video_id"), "l.n", "l.s")
    lists = lists.join(rows.filter("weight IS NOT NULL").select(F.col("_block").alias("_to"), "video_id").distinct(), "video_id")
    kind = rows.schema["key"].dataType.simpleString()
    return rows.groupBy("_block").cogroup(lists.groupBy("_to")).applyInArrow(lambda r, l: _block_sums(r, l, k), f"key {kind}, video_id long, score double")


def _of_items(seeds: DataFrame, items: DataFrame, neighbors: DataFrame) -> DataFrame:
    """key, video_id, score of the items (key, video_id), from seeds (key, video_id, weight)."""
    seeds, items = _rows(seeds, F.col("weight"), False), _rows(items, None, True)
    if 100 * seeds.count() > items.count():
        return _summed(seeds.unionByName(items), neighbors, None)
    # few products: they are joined to the items
    found = seeds.join(neighbors, "video_id").groupBy("key", F.col("neighbor_id").cast("long").alias("video_id")).agg(F.sum(F.col("weight") * F.col("score")).alias("score"))
    return found.join(items, ["key", "video_id"], "left_semi")


def seed_scores(seeds: DataFrame, candidates: DataFrame, neighbors: DataFrame) -> DataFrame:
    """Key, video_id, score: the summed neighbour score of each candidate (key, video_id) from the seeds (key, video_id)."""
    key = seeds.columns[0]
    return _of_items(seeds.select(key, "video_id", F.lit(1.0).alias("weight")), candidates.select(key, "video_id").distinct(), neighbors).withColumnRenamed("key", key)


def seed_topk(seeds: DataFrame, neighbors: DataFrame, k: int) -> DataFrame:
    """Key, video_id, score: the best k neighbours of all seeds of the key, without the seeds."""
    key = seeds.columns[0]
    return _summed(_rows(seeds.select(key, "video_id").distinct(), F.lit(1.0), True), neighbors, k).withColumnRenamed("key", key)


def user_cf_topk(users: DataFrame, projection: DataFrame, neighbors: DataFrame, k: int) -> DataFrame:
    """user_id, video_id, score: neighbours of what the user watched, by watch weight, without what was watched."""
    own = projection.join(users.select("user_id").distinct(), "user_id", "left_semi").select("user_id", "video_id", "weight")
    return _summed(_rows(own, F.col("weight"), True), neighbors, k).withColumnRenamed("key", "user_id")


def personal_affinity(candidates: DataFrame, projection: DataFrame, neighbors: DataFrame) -> DataFrame:
    """user_id, video_id, affinity of the candidates (user_id, video_id) that neighbour something the user watched."""
    wanted = candidates.select("user_id", "video_id").distinct()
    own = projection.join(candidates.select("user_id").distinct(), "user_id", "left_semi").select("user_id", "video_id", "weight")
    return _of_items(own, wanted, neighbors).withColumnsRenamed({"key": "user_id", "score": "affinity"})


def channel_affinity(projection: DataFrame, docs: DataFrame) -> DataFrame:
    """user_id, channel_id, weight; videos without a channel are left out."""
    return projection.join(docs.filter("channel_id IS NOT NULL").select("video_id", "channel_id"), "video_id").groupBy("user_id", "channel_id").agg(F.sum("weight").alias("weight"))
