"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Spark sums the statistics' products by class; the driver keeps one mean and one shrunken covariance a class. A score is
the difference of the two log densities (Mahalanobis distances from cached Cholesky factors), calibrated to a
probability on the training rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfind.llm.shared import written
from wayfind.llm.stats import BASE, MORE, with_stats

FEATURES = 12
BINS = 400
REACH = 40.0  # log density differences beyond this count as this


def transform(s: dict[str, np.ndarray]) -> np.ndarray:
    """Ratios of the statistics, on square-root or log scales that make them more nearly normal."""
    words, size, lines = np.maximum(s["n_words"], 1), np.maximum(s["n_chars_all"], 1), np.maximum(s["n_lines"], 1)
    root = np.sqrt
    return np.column_stack([
        np.log1p(s["n_words"]), s["word_chars"] / words, root(s["n_symbols"] / words), root(s["n_dup_lines"] / lines), root(s["n_repeat_words"] / words), root(s["n_upper"] / size),
        root(s["n_digits"] / size), root(s["n_marks"] / words), s["n_distinct"] / words, s["n_short"] / words, root(s["n_shout"] / words), np.log1p(words / lines),
    ])


@dataclass(frozen=True)
class Discriminant:
    means: np.ndarray
    lowers: np.ndarray  # inverse Cholesky factors
    halves: np.ndarray  # log prior minus half the log determinant
    slope: float = 1.0
    offset: float = 0.0

    def log_ratio(self, x: np.ndarray) -> np.ndarray:
        density = [h - 0.5 * (((x - m) @ low.T) ** 2).sum(axis=1) for m, low, h in zip(self.means, self.lowers, self.halves, strict=True)]
        return np.clip(density[1] - density[0], -REACH, REACH)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.log_ratio(x) + self.offset, -REACH, REACH)))


def fit(counts: list[float], sums: list[np.ndarray], products: list[np.ndarray], shrink: float, ridge: float) -> Discriminant:
    """Each class's covariance, drawn by `shrink` to the pooled one and by `ridge` to its diagonal's mean."""
    means = [s / max(n, 1) for n, s in zip(counts, sums, strict=True)]
    scatters = [p - n * np.outer(m, m) for n, m, p in zip(counts, means, products, strict=True)]
    pooled = sum(scatters) / max(sum(counts) - 2, 1)
    lowers, halves = [], []
    for n, scatter in zip(counts, scatters, strict=True):
        own = (1 - shrink) * scatter / max(n - 1, 1) + shrink * pooled
        own = (1 - ridge) * own + ridge * np.diag(np.diag(pooled) + 1e-6)
        factor = np.linalg.cholesky(own)
        lowers.append(np.linalg.inv(factor))
        halves.append(np.log(max(n, 0.5) / max(sum(counts), 1)) - np.log(np.diag(factor)).sum())
    return Discriminant(np.array(means), np.array(lowers), np.array(halves))


def calibrate(ratio: np.ndarray, good: np.ndarray, bad: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve over a histogram of log ratios, by Newton steps with a light prior."""
    w, n, target = np.array([1.0, 0.0]), good + bad, good
    x = np.column_stack([ratio, np.ones_like(ratio)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -REACH, REACH)))
        gradient = x.T @ (target - n * p) - (w - np.array([1.0, 0.0]))
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + np.eye(2), gradient)
        w = w + np.clip(step, -1, 1)
    return float(max(w[0], 1e-3)), float(w[1])


def score_quality(docs: DataFrame, labels: DataFrame, shrink: float = 0.1, ridge: float = 0.02, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Learns labels only from rows whose crc32 of the doc_id as text, mod 5, is not 0 (held_out false); scores never see
    labels, lang, source or doc_id. Null texts count as empty and are scored. Null doc_ids are scored, never learned
    from, and not held out. Repeated labels of a document count once, as their greatest. With a class missing from the
    labels, every score is the share of good labels, or 0.5 without labels. Repeated rows of docs are scored alike, and each
    is learned from. Other columns are ignored. Texts of any length are measured whole, one at a time. No rows: no result rows.
    """
    spark = docs.sparkSession
    names = BASE + MORE
    stats = with_stats(docs, MORE)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("x", T.ArrayType(T.DoubleType()))])

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = transform({n: batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False).astype(float) for n in names})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64()))], names=["doc_id", "x"])

    rows = written(stats.mapInArrow(shape, schema), "quality-features")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    marks = labels.filter("quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    train = written(rows.filter(~held_out).join(marks, "doc_id"), "quality-train")
    pairs = [(i, j) for i in range(FEATURES) for j in range(i, FEATURES)]
    cell = lambda i: F.col("x")[i]
    sums = train.groupBy("quality").agg(F.sum(F.lit(1)).alias("n"), F.array(*[F.sum(cell(i)) for i in range(FEATURES)]).alias("s"), F.array(*[F.sum(cell(i) * cell(j)) for i, j in pairs]).alias("p")).collect()
    by_class = {r["quality"]: r for r in sums}
    out = rows.withColumn("held_out", held_out)
    if len(by_class) < 2:
        out = out.withColumn("score", F.lit(float(next(iter(by_class), 0.5))))
    else:
        products = []
        for k in (0, 1):
            p = np.zeros((FEATURES, FEATURES))
            for (i, j), v in zip(pairs, by_class[k]["p"], strict=True):
                p[i, j] = p[j, i] = v
            products.append(p)
        model = fit([by_class[k]["n"] for k in (0, 1)], [np.array(by_class[k]["s"]) for k in (0, 1)], products, shrink, ridge)
        bins = _scored(train, spark.sparkContext.broadcast(model), raw=True).groupBy(F.floor((F.col("score") + REACH) * (BINS / (2 * REACH))).alias("bin"), "quality").count().collect()
        hist = np.zeros((2, BINS + 1))
        for r in bins:
            hist[r["quality"], r["bin"]] += r["count"]
        slope, offset = calibrate((np.arange(BINS + 1) + 0.5) * (2 * REACH / BINS) - REACH, hist[1], hist[0])
        out = _scored(out, spark.sparkContext.broadcast(Discriminant(model.means, model.lowers, model.halves, slope, offset)))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def _scored(rows: DataFrame, model, raw: bool = False) -> DataFrame:
    """raw: the log ratio in place of the probability."""
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != "x"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("x")
            x = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
            values = model.value.log_ratio(x) if raw else model.value.score(x)
            rest = [k for k in range(batch.num_columns) if k != at]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in rest], pa.array(values)], names=[*[batch.schema.names[k] for k in rest], "score"])

    return rows.mapInArrow(run, schema)
