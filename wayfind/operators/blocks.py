"""Impact-ordered postings in blocks with their maxima, and retrieval that stops where no block can reach the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 128


def impact_blocks(postings: DataFrame, static: DataFrame, weight: float, size: int = BLOCK) -> DataFrame:
    """term, block, top, items (video_id, value): each term's documents by falling value, `size` a block, top being the block's greatest.

    A document's value for a term is its summed weights times `weight`, plus its own score in static (video_id, static);
    documents that static lacks are left out. A term's documents are dealt by their place, so a common term is many rows.
    """
    own = postings.groupBy("term", "video_id").agg(F.sum("weight").alias("w")).join(static, "video_id")
    rows = own.select("term", "video_id", (weight * F.col("w") + F.col("static")).alias("value"))
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.col("value").desc(), "video_id"))
    rows = rows.withColumn("block", F.floor((place - 1) / size).cast("int"))
    return rows.groupBy("term", "block").agg(F.max("value").alias("top"), F.collect_list(F.struct("video_id", "value")).alias("items"))


def opening(requests: DataFrame, blocks: DataFrame, size: int = BLOCK) -> DataFrame:
    """query_id, video_id of the blocks that hold each request's first k documents by value. requests: query_id, term, k."""
    met = requests.join(blocks.select("term", "block", "items"), "term").filter(F.col("block") * size < F.col("k"))
    return met.select("query_id", F.explode("items").alias("i")).select("query_id", "i.video_id")


def rest(requests: DataFrame, blocks: DataFrame, least: DataFrame, slack: float, size: int = BLOCK) -> DataFrame:
    """query_id, video_id of later documents whose value and slack reach the request's least score (query_id, least; none: all do)."""
    met = requests.join(least, "query_id", "left").join(blocks, "term")
    enough = lambda value: F.coalesce(value + slack >= F.col("least"), F.lit(True))
    met = met.filter((F.col("block") * size >= F.col("k")) & enough(F.col("top")))
    return met.select("query_id", "least", F.explode("items").alias("i")).filter(enough(F.col("i.value"))).select("query_id", "i.video_id")


def least_score(scored: DataFrame, requests: DataFrame, score: Column) -> DataFrame:
    """query_id, least: the k-th best score of each request that has so many."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(score.desc()))
    return scored.withColumns({"_place": place, "least": score}).join(requests.select("query_id", "k"), "query_id").filter(F.col("_place") == F.col("k")).select("query_id", "least")
