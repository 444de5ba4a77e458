"""Experiment assignment: subjects hash to buckets, variants own ranges of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.functions.hashing import bucket

VARIANT = "array<struct<name:string,min:int,max:int,model_version:string>>"
#: (key, salt, enabled, variants as JSON)
EXAMPLE = (
    ("ranker", "s1", True, '[{"name": "candidate", "min": 50, "max": 90, "model_version": "v2"}, {"name": "control", "min": 0, "max": 60, "model_version": "v1"}]'),
    ("layout", "s2", True, '[{"name": "all", "min": 0, "max": 100, "model_version": ""}]'),
    ("broken", "s3", True, "[{"),
    ("off", "s4", False, '[{"name": "all", "min": 0, "max": 100, "model_version": ""}]'),
)


def definitions(spark: SparkSession, rows: tuple) -> DataFrame:
    """key, salt, bucket, variant, model_version: a row each bucket that a variant of an enabled experiment owns; the variant of lowest start wins.

    At most a hundred rows an experiment. Definitions whose variants aren't valid JSON are left out.
    """
    table = spark.createDataFrame(list(rows), "key string, salt string, enabled boolean, variants string")
    parsed = table.filter("enabled").withColumn("v", F.explode(F.from_json("variants", VARIANT)))
    owned = parsed.filter("v.min < v.max").select("key", "salt", "v.name", "v.min", "v.model_version", F.explode(F.sequence(F.col("v.min"), F.col("v.max") - 1)).alias("bucket"))
    return owned.groupBy("key", "salt", "bucket").agg(F.min_by("name", "min").alias("variant"), F.min_by("model_version", "min").alias("model_version"))


def assign_variant(buckets: DataFrame, owned: DataFrame) -> DataFrame:
    """Rows with key and bucket, with variant and model_version; rows whose bucket nobody owns are left out."""
    return buckets.join(F.broadcast(owned.select("key", "bucket", "variant", "model_version")), ["key", "bucket"])


def assign(subjects: DataFrame, owned: DataFrame) -> DataFrame:
    """Rows of subjects with key, bucket, variant and model_version for each experiment; empty subjects are in none."""
    known = subjects.filter("subject <> ''")
    salted = F.broadcast(owned.select("key", "salt").distinct())
    # every subject is in every experiment: a row for each of the few keys
    each = known.withColumn("_one", F.lit(1)).join(salted.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return assign_variant(each.withColumn("bucket", bucket(F.col("salt"), F.col("subject"))).drop("salt"), owned)
