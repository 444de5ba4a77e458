"""Word shingles: their hashes, min-hash keys and prefixes of their sets, and the similarity of two texts' sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfind.llm.shared import drop, join_spread, text_of, written

BANDS = 16
ROWS = 5
SEED = 42
BLOCK = 1 << 12
FREQUENT = 1 << 18  # shingles at most whose counts order prefixes
COUNTED = 1 << 20  # shingles counted at a time
SIGN_BITS = 10
_rng = np.random.default_rng(SEED)
TURNS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WEIGHTS = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(data: bytes, width: int) -> Iterator[np.ndarray]:
    """Hashes of the runs of `width` words, in order, block by block; fewer words are one run, none are none."""
    words = data.lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    if len(words) < width:
        starts, stops = [0], [len(joined)]
    else:
        starts = [0, *ends[: len(words) - width].tolist()]
        stops = (ends[width - 1 :] - 1).tolist()
    of = xxhash.xxh64_intdigest
    for at in range(0, len(starts), 1 << 15):
        yield np.array([of(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 15)], stops[at : at + (1 << 15)], strict=True)], dtype="<u8")


def fold(blocks: Iterator[np.ndarray]) -> int:
    """Bit by bit, what more than half of the hashes have."""
    total, n = np.zeros(64, dtype=np.int64), 0
    for h in blocks:
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray sequence, where neighbours differ in one bit."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def distinct_hashes(data: bytes, width: int) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, dtype="<u8"), *shingle_hashes(data, width)]))


def band_keys(found: np.ndarray) -> np.ndarray:
    """A key a band from the least of the shingles in each of BANDS * ROWS orders."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), BLOCK):
        least = np.minimum(least, np.multiply.outer(found[at : at + BLOCK], TURNS).min(axis=0))
    least ^= least >> np.uint64(29)
    return ((least.reshape(BANDS, ROWS) * WEIGHTS).sum(axis=1, dtype=np.uint64)).view(np.int64)


def node_of(docs: DataFrame) -> Column:
    """Rows of equal text are one node."""
    return F.xxhash64(text_of(docs))


def frequent(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles met often, sorted, and about how often: those that a stretch of rows has twice or more are counted. The most frequent ones where there are too many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["shingle", "n"])

        for batch in batches:
            for cell in batch.column(0):
                held.append(distinct_hashes(cell.as_py(), width))
                size += len(held[-1])
                if size > COUNTED:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    met = docs.select(F.encode(text_of(docs), "UTF-8").alias("data")).mapInArrow(run, "shingle long, n long")
    met = written(met.groupBy("shingle").agg(F.sum("n").alias("n")).filter("n >= 8").withColumn("octave", F.floor(F.log2("n"))), "frequent-shingles")
    least, room = 64, FREQUENT
    for octave, many in sorted(map(tuple, met.groupBy("octave").count().collect()), reverse=True):  # 64 rows at most
        room -= many
        if room < 0:
            break
        least = octave
    rows = met.filter(F.col("octave") >= least).select("shingle", "n").toArrow()
    drop(met)
    h, n = (rows.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in range(2))
    order = np.argsort(h.view(np.uint64))
    return h.view(np.uint64)[order], n[order]


def prefix_size(n: int, similarity: float) -> int:
    """Of two sets that similar, in one order of all shingles, so many first ones of each have one in common."""
    return n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0


def rare_first(found: np.ndarray, often: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sorted shingles in the one order of all shingles: those not met often, then by how often."""
    known, n = often
    at = np.searchsorted(known, found)
    hit = np.flatnonzero(at < len(known))
    hit = hit[known[at[hit]] == found[hit]]
    return np.r_[np.delete(found, hit), found[hit][np.argsort(n[at[hit]], kind="stable")]] if len(hit) else found


def sign_of(found: np.ndarray) -> np.ndarray:
    """By the first SIGN_BITS bits of a shingle, whether their number is odd: two sets differ in at least as many shingles as their signs in bits."""
    odd = np.bincount((found >> np.uint64(64 - SIGN_BITS)).astype(np.int64), minlength=1 << SIGN_BITS) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def keyed(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """doc_id, node, n (distinct shingles), fp (the SimHash of those), rank (its Gray rank), keys, prefix (the first prefix_size shingles, rare ones first) and sign of every row."""
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("node", "n", "fp", "rank")], *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("keys", "prefix", "sign")]])
    often = docs.sparkSession.sparkContext.broadcast(frequent(docs, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, codes, keys, prefixes, signs = [], [], [], [], []
            for cell in batch.column(2):
                found = distinct_hashes(cell.as_py(), width)
                codes.append(fold(found[at : at + BLOCK] for at in range(0, len(found), BLOCK)))
                sizes.append(len(found))
                keys.append(band_keys(found))
                signs.append(sign_of(found))
                prefixes.append(rare_first(found, often.value)[: prefix_size(len(found), similarity)].view(np.int64))
            fp = np.array(codes, dtype=np.uint64)
            flat = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
            ends = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(fp.view(np.int64)), pa.array(gray_rank(fp).view(np.int64)), pa.ListArray.from_arrays(ends, pa.array(flat)), pa.array(prefixes, pa.list_(pa.int64())), pa.array(signs, pa.list_(pa.int64()))], names=schema.names)

    return docs.select("doc_id", node_of(docs).alias("node"), F.encode(text_of(docs), "UTF-8").alias("data")).mapInArrow(run, schema)


def sets_of(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node and its shingles, for the given nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, held, size = [], [], 0
            for node, cell in zip(batch.column(0), batch.column(1), strict=True):
                own.append(node.as_py())
                held.append(distinct_hashes(cell.as_py(), width).view(np.int64))
                size += len(held[-1])
                if size > 1 << 18:
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(held, pa.list_(pa.int64()))], names=["node", "shingles"])
                    own, held, size = [], [], 0
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(held, pa.list_(pa.int64()))], names=["node", "shingles"])

    texts = docs.select(node_of(docs).alias("node"), F.encode(text_of(docs), "UTF-8").alias("data")).join(nodes, "node", "left_semi").dropDuplicates(["node"])
    return texts.mapInArrow(run, "node long, shingles array<long>")


def far_bits(similarity: float, bits: int = 64) -> int:
    """Differing fingerprint bits that sets of that similarity exceed with a probability under 0.0005.

    A bit differs with probability arccos(cosine) / pi; the cosine of sets of one size is 2 s / (1 + s).
    """
    p = np.arccos(min(2 * similarity / (1 + similarity), 1.0)) / np.pi
    return int(np.ceil(bits * p + 3.5 * np.sqrt(bits * p * (1 - p))))


def close_sizes(n: Column, m: Column, similarity: float) -> Column:
    """Whether sets of n and m can be that similar."""
    return F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9


def sharing(texts: DataFrame, similarity: float, block: int = 2048) -> DataFrame:
    """u, v (u greater): every pair of texts of different roots whose sets can be that similar, from node, n, root, prefix and sign of each.

    Sets that similar have a shingle in common among their prefixes. What follows the first such shingle bounds all they have in
    common, and their signs how many they have not, so pairs that this leaves short go. Texts of a shingle's commonest root meet only those of other roots. Frequent
    shingles are dealt by blocks of texts, each pair of blocks on its own.
    """
    same = Window.partitionBy("key")
    dealt = texts.select("node", "n", "root", F.posexplode("prefix").alias("pos", "key"))
    shared = dealt.withColumns({"least": F.min("root").over(same), "most": F.max("root").over(same), "many": F.count(F.lit(1)).over(same)})
    table = written(shared.filter("least <> most").select("key", "node", "n", "root", "pos", "many"), "shared-shingles")
    common = table.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("common"))
    parts = F.ceil(F.col("many") / block).cast("int")
    shared = table.join(common, "key").withColumns({"parts": parts, "part": F.pmod(F.xxhash64("node"), parts).cast("int")})
    # a text not of the commonest root meets all those that are, and others like it once
    cells = F.sequence(F.lit(0), F.col("parts") - 1)
    a = shared.filter("root <> common").withColumn("other", F.explode(cells)).select("key", "part", "other", F.struct("node", "n", "root", "pos").alias("a"))
    b = shared.withColumn("own", F.explode(cells)).select("key", F.col("own").alias("part"), F.col("part").alias("other"), F.struct("node", "n", "root", "pos").alias("b"), (F.col("root") == F.col("common")).alias("usual"))
    rest = lambda c: F.col(f"{c}.n") - F.col(f"{c}.pos")
    enough = F.least(rest("a"), rest("b")) >= similarity / (1 + similarity) * (F.col("a.n") + F.col("b.n")) - 1e-6
    met = (F.col("a.root") != F.col("b.root")) & (F.col("usual") | (F.col("a.node") > F.col("b.node"))) & close_sizes(F.col("a.n"), F.col("b.n"), similarity) & enough
    pairs = a.join(b, ["key", "part", "other"]).filter(met).select(F.greatest("a.node", "b.node").alias("u"), F.least("a.node", "b.node").alias("v"))
    side = lambda c, k: texts.select(F.col("node").alias(c), F.struct("n", "sign").alias(k))
    pairs = pairs.distinct().join(side("u", "a"), "u").join(side("v", "b"), "v")
    apart = F.aggregate(F.zip_with("a.sign", "b.sign", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    pairs = pairs.filter(apart <= (1 - similarity) / (1 + similarity) * (F.col("a.n") + F.col("b.n")) + 1e-6)
    pairs = written(pairs.select("u", "v"), "sharing-pairs")
    drop(table)
    return pairs


def verified(docs: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """Of the distinct pairs u, v those whose sets are at least that similar; two empty sets are. A node may be in many pairs as v."""
    nodes = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    nodes = written(nodes, "pair-nodes")  # of known size, so that Spark chooses whether to move them or the texts
    sets = written(sets_of(docs, nodes, width), "shingle-sets")
    a, b = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    both = join_spread(pairs, b, "v", F.col("u")).join(a, "u").select("u", "v", F.size("a").alias("n"), F.size("b").alias("m"), F.size(F.array_intersect("a", "b")).alias("common"))
    return both.filter(F.col("common") >= similarity * (F.col("n") + F.col("m") - F.col("common")) - 1e-9).select("u", "v")
