"""Sharding by longest-processing-time scheduling: groups that must stay together go, largest first, to the least loaded shard.

Groups of equal texts above a fixed share of the corpus are scheduled one by one; there are at most `n_shards * fine`
of them whatever the corpus size. All smaller groups are hashed to bundles (as many again, in halving sizes, so that
the last ones are small and even out the loads), whose sizes Spark sums; the heap schedules bundles like groups. The
driver so sees a bounded number of sizes, never the groups.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfind.llm.shared import slices, text_of, written

LEVELS = 8


def schedule(sizes: list[tuple[str, int]], n_shards: int) -> dict[str, int]:
    """Item to shard: largest first (ties by name) to the least loaded shard (ties by number)."""
    heap = [(0, s) for s in range(n_shards)]
    placed = {}
    for name, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        placed[name] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def _bundle(key: Column, per_level: int) -> Column:
    """Level l takes every 2^-(l+1)-th group, the last level the rest; within a level groups go by hash."""
    draw = F.pmod(F.xxhash64(key, F.lit("level")), F.lit(1 << LEVELS))
    level = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        level = F.when(draw < (1 << LEVELS) - (1 << (LEVELS - 1 - k)), F.lit(k)).otherwise(level)
    return F.concat_ws("-", F.lit("b"), level, F.pmod(F.xxhash64(key, F.lit("bundle")), F.lit(per_level)))


def shard_documents(docs: DataFrame, n_shards: int = 24, fine: int = 512, overhead: int = 8, slice_rows: int = 100_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot: law `bytes`, so shards are near equal in summed size.

    Takes doc_id and text; other columns are ignored. A row's size is its text's UTF-8 bytes plus `overhead`; null text
    counts as empty and groups with empty texts. Rows of equal text share a shard. Slots number a shard's rows from 0
    without gaps, by slice and doc_id. Null doc_ids and repeated rows are rows like others; texts of any length count whole. Groups of
    equal size go by their hash. No rows: no result rows.
    """
    text = text_of(docs)
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.sha2(text, 256).alias("same"),
        F.monotonically_increasing_id().alias("row"),  # so that repeated rows are dealt too; fixed once written
    )
    rows = written(rows, "shard-rows")
    groups = written(rows.groupBy("same").agg(F.sum("size").alias("bytes"), F.sum(F.lit(1)).alias("n")), "shard-groups")
    total = groups.agg(F.sum("bytes"), F.sum("n")).first()
    least = (total[0] or 0) / (n_shards * fine)
    per_level = n_shards * fine // LEVELS
    item = lambda size: F.when(size >= least, F.col("same")).otherwise(_bundle(F.col("same"), per_level))
    sizes = groups.groupBy(item(F.col("bytes")).alias("item")).agg(F.sum("bytes").alias("bytes")).collect()  # at most 2 * n_shards * fine rows
    placed = schedule([(r["item"], r["bytes"]) for r in sizes], n_shards)
    spark = docs.sparkSession
    where = spark.createDataFrame(list(placed.items()), T.StructType([T.StructField("item", T.StringType()), T.StructField("shard", T.IntegerType())]))
    singles = where.filter(~F.col("item").startswith("b-")).withColumnsRenamed({"item": "same", "shard": "own"})
    bundles = where.filter(F.col("item").startswith("b-"))
    rows = rows.join(F.broadcast(singles), "same", "left")
    rows = rows.withColumn("item", _bundle(F.col("same"), per_level)).join(F.broadcast(bundles), "item", "left")
    rows = rows.withColumn("shard", F.coalesce("own", "shard"))
    n = slices(total[1] or 0, slice_rows)
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id", "text_crc32", "row"), F.lit(n)).cast("int"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "slice").agg(F.sum(F.lit(1)).alias("n"))
    base = counts.select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "slice").orderBy("doc_id", "text_crc32", "same")
    rows = rows.withColumn("nth", F.row_number().over(inside)).join(base, ["shard", "slice"])
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
