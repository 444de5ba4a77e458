"""Quality rules: fixed base rules, then an isolation forest on the rule statistics.

The forest grows on a bounded sample (trees * sample rows, those of lowest hash) of the documents that pass the base
rules, so what differs from most is quick to isolate; every document is scored. The rejection threshold comes from all labelled rows that pass the base rules: of the
thresholds that lose no more than `good_loss` of the good ones, the one at which the share of bad ones rejected exceeds
the share of good ones rejected most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfind.llm.shared import drop, written
from wayfind.llm.stats import BASE, FOR_RULES, rule_numbers, with_stats

BINS = 4096
NUMBERS = BASE + FOR_RULES
STEADY = 20  # words of typical text that each document counts as having besides its own, so that short ones are not odd by chance


def base_failed(min_words: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _mean_path(n: np.ndarray | int) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows of a binary tree."""
    n = np.asarray(n, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 2, 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class Forest:
    """Trees as arrays over nodes: feature (-1 at leaves), cut, left child (right is the next), path length at leaves."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    depth: np.ndarray
    roots: np.ndarray
    norm: float
    typical: np.ndarray | None = None  # of the features, per word

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, higher: easier to isolate."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while (inner := self.feature[node] >= 0).any():
                right = x[rows, np.maximum(self.feature[node], 0)] >= self.cut[node]
                node = np.where(inner, self.left[node] + right, node)
            total += self.depth[node]
        return 2.0 ** (-total / (max(len(self.roots), 1) * self.norm))


def grow(x: np.ndarray, trees: int, sample: int, seed: int = 42) -> Forest:
    rng = np.random.default_rng(seed)
    feature, cut, left, depth, roots = [], [], [], [], []
    size = min(sample, len(x))
    limit = int(np.ceil(np.log2(max(size, 2))))

    def node() -> int:
        for a, v in ((feature, -1), (cut, 0.0), (left, 0), (depth, 0.0)):
            a.append(v)
        return len(feature) - 1

    for _ in range(trees if size else 0):
        roots.append(node())
        todo = [(roots[-1], rng.choice(len(x), size, replace=False), 0)]
        while todo:
            at, rows, level = todo.pop()
            low, high = x[rows].min(axis=0), x[rows].max(axis=0)
            wide = np.flatnonzero(high > low)
            if level >= limit or len(rows) < 2 or not len(wide):
                depth[at] = level + float(_mean_path(len(rows)))
                continue
            f = int(rng.choice(wide))
            c = float(rng.uniform(low[f], high[f]))
            right = x[rows, f] >= c
            if right.all():  # the cut fell on the lowest value
                c = float(np.nextafter(low[f], high[f]))
                right = x[rows, f] >= c
            feature[at], cut[at], left[at] = f, c, node()
            todo += [(left[at], rows[~right], level + 1), (node(), rows[right], level + 1)]
    return Forest(np.array(feature, int), np.array(cut), np.array(left, int), np.array(depth), np.array(roots, int), max(float(_mean_path(size)), 1.0))


def features(s: dict[str, np.ndarray], typical: np.ndarray | None = None) -> np.ndarray:
    """Letters, symbols, short words and marks a word, smoothed toward the typical values."""
    words = s["n_words"]
    counts = np.column_stack([s[c] for c in ("word_chars", "n_symbols", "n_short", "n_marks")])
    return counts / np.maximum(words, 1)[:, None] if typical is None else (counts + STEADY * typical) / (words + STEADY)[:, None]


def _numbers(rows: list) -> dict[str, np.ndarray]:
    x = np.array(rows, dtype=float).reshape(-1, len(NUMBERS))
    return dict(zip(NUMBERS, x.T, strict=True))


def drawn(rows: DataFrame, most: int) -> list:
    """Of rows with a uniform long `draw`, the `most` lowest; little more than those go to the driver, however many partitions there are."""
    rows = rows.dropDuplicates(["draw"])  # repeated rows count once
    n = rows.count()
    if (share := (most + 8 * most**0.5 + 64) / max(n, 1)) < 1:
        rows = rows.filter(F.col("draw") < int(-(1 << 63) + share * ((1 << 64) - 1)))
    return sorted(rows.collect(), key=tuple)[:most]


def best_threshold(good: np.ndarray, bad: np.ndarray, good_loss: float) -> float:
    """From counts by bin of anomaly (bin k holds scores up to k / BINS): rows above the threshold go."""
    good_above, bad_above = (x.sum() - np.cumsum(x) for x in (good, bad))
    lost, caught = good_above / max(good.sum(), 1), bad_above / max(bad.sum(), 1)
    gain = np.where(lost <= good_loss, caught - lost, -np.inf)
    if not bad.sum():
        return 2.0 if not good.sum() else float(np.flatnonzero(lost <= good_loss)[0]) / BINS
    return float(np.flatnonzero(gain == gain.max())[-1]) / BINS


def fit_rules(docs: DataFrame, labels: DataFrame, trees: int = 128, sample: int = 128, good_loss: float = 0.005, min_words: int = 50) -> tuple[DataFrame, Forest, float]:
    """The scored statistics of every row of docs, the forest, and the anomaly above which a row is rejected."""
    spark = docs.sparkSession
    stats = written(with_stats(docs, FOR_RULES).withColumn("base_failed", base_failed(min_words)), "rule-stats")
    marks = labels.filter("quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    marks = written(marks, "quality-marks").hint("merge")  # it grows with the corpus: never broadcast
    passing = stats.filter(~F.col("base_failed")).select(F.xxhash64("doc_id", *BASE).alias("draw"), *NUMBERS)
    numbers = _numbers([r[1:] for r in drawn(passing, trees * sample)])
    typical = np.median(features(numbers), axis=0) if len(numbers["n_words"]) else np.zeros(4)
    grown = replace(grow(features(numbers, typical), trees, sample), typical=typical)
    forest = spark.sparkContext.broadcast(grown)
    schema = T.StructType([*[f for f in stats.schema.fields if f.name not in FOR_RULES], T.StructField("anomaly", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = {c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in NUMBERS}
            kept = [batch.column(batch.schema.get_field_index(c)) for c in schema.names[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(forest.value.score(features(of, forest.value.typical)))], names=schema.names)

    scored = written(stats.mapInArrow(run, schema), "rule-scores")
    # the labelled rows' scores as histograms of fixed size
    bins = scored.filter(~F.col("base_failed")).join(marks, "doc_id").groupBy("quality", F.ceil(F.col("anomaly") * BINS).cast("int").alias("bin")).count().collect()
    counts = np.zeros((2, BINS + 1))
    for r in bins:
        counts[r["quality"], r["bin"]] += r["count"]
    drop(stats)
    return scored, grown, best_threshold(counts[1], counts[0], good_loss)


def quality_rules(docs: DataFrame, labels: DataFrame, **parameters: float) -> DataFrame:
    """doc_id, the base statistics, base_failed, anomaly (0 to 1) and kept, for every row of docs.

    Takes doc_id and text of docs, doc_id and quality of labels; other columns are ignored. Null text has no words, so
    it fails. Null doc_ids are judged, but match no label. Repeated rows are judged alike; of repeated labels of a document
    the greatest counts. Without labelled rows the forest rejects nothing; without bad ones it rejects `good_loss` of the good
    ones. Texts of any length are measured whole, one at a time. No rows: no result rows.
    """
    scored, _, threshold = fit_rules(docs, labels, **parameters)  # min_words: of the base rules
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= F.lit(threshold)))


def keep_good(docs: DataFrame, labels: DataFrame, min_words: int = 50, **parameters: float) -> DataFrame:
    """The rows of docs, with their columns, that quality_rules keeps. Texts are measured again rather than moved to meet their verdicts."""
    scored, forest, threshold = fit_rules(docs, labels, min_words=min_words, **parameters)
    drop(scored)
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    at = docs.columns.index(next(c for c in docs.columns if c.lower() == "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = _numbers([rule_numbers((cell.as_py() or "").encode()) for cell in batch.column(at)])
            failed = (of["n_words"] < min_words) | (100 * of["n_repeat_words"] > 50 * of["n_words"])
            odd = shared.value.score(features(of, shared.value.typical)) > threshold
            yield batch.filter(pa.array(~failed & ~odd))

    return docs.mapInArrow(run, docs.schema)
