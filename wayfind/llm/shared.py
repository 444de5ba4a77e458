"""What several operators of this subpackage need: the shared folder, written tables, row envelopes, joins with hot keys."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see (spark.checkpoint.dir). Where it is unset, a local session gets one of its own; a cluster has to name it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        found = _own[app] = _own.get(app) or tempfile.mkdtemp(prefix="wayfind-")
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: cuts lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


def drop(*tables: DataFrame) -> None:
    """Deletes written tables that no frame still to be computed reads."""
    for table in tables:
        jvm, conf = table.sparkSession._jvm, table.sparkSession._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(conf).delete(path, True)


def slices(rows: int, each: int, least: int = 1) -> int:
    """How many parts of about `each` rows (or bytes) a job deals its input to; grows with the input, never capped."""
    return max(least, math.ceil(rows / each))


def join_spread(rows: DataFrame, table: DataFrame, key: str, by: Column, share: int = 1000) -> DataFrame:
    """Inner join of rows to the one row a key of `table`. Keys are not null.

    Keys with over 1/share of the rows (so fewer than `share` keys, which are broadcast) are dealt by `by` to as many
    tasks as they have such shares, their row of `table` copied to each.
    """
    total = rows.count()
    heavy = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") * share > total)
    heavy = F.broadcast(written(heavy.select(key, F.ceil(F.col("_n") * share / max(total, 1)).cast("int").alias("_parts")), "hot-keys"))
    parts = F.coalesce("_parts", F.lit(1))
    left = rows.join(heavy, key, "left").withColumn("_part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("_parts")
    right = table.join(heavy, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(right, [key, "_part"]).drop("_part")


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def without(df: DataFrame, *names: str) -> list[str]:
    """Columns of the frame but for those an operator adds itself; the operator's win a clash of names."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]
