"""SimHash near-duplicates through a hierarchical index in Gray order.

Distinct fingerprints are sorted by Gray rank, where neighbours differ in few bits, and cut to parts of about `part_codes`.
One tree lies over them all: its upper levels have a node a part and are sent to every task (16 bytes a part), the levels
below are built where a part is searched. A node holds the bits that all fingerprints below it share and no node above it
holds; a search adds up differing bits on the way down and leaves out a whole node once they exceed `bits`. So the upper
levels say which parts a fingerprint must visit (C(b, 0) + … + C(b, bits) of them at most, on fingerprints without order, b
bits telling parts apart), and it visits only its own part and later ones, since links go both ways. A part emits a
spanning forest of its links, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfind.llm.components import connected
from wayfind.llm.shared import drop, join_spread, slices, text_of, without, written
from wayfind.llm.shingles import close_sizes, far_bits, fold, gray_rank, keyed, sharing, shingle_hashes, verified

WIDTH = 3
LEAF = 32
FAN = 8
BLOCK = 1 << 17
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(data: bytes, width: int = WIDTH) -> int:
    """Of the text's shingles, each as often as it occurs; 0 without words."""
    return fold(shingle_hashes(data, width))


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of every row."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), width) for x in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", F.encode(text_of(docs), "UTF-8").alias("data")).mapInArrow(run, schema)


def gray_order(fp: Column) -> Column:
    """gray_rank of a long of 64 bits, as a long that sorts like it."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


class Union:
    """Disjoint sets over numbers; the least member is the root."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        root = self.parent[x]
        while (up := self.parent[root] != root).any():
            root[up] = self.parent[root[up]]
        self.parent[x] = root
        return root

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.find(a), self.find(b)
        while (apart := a != b).any():
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            a, b = self.find(a), self.find(b)


class Tree:
    """Levels of nodes over a row of bottom nodes in Gray order; levels[0] is the bottom, each node (bits it holds, their values)."""

    def __init__(self, same: np.ndarray, value: np.ndarray) -> None:
        self.levels = [(same, value)]
        while len(same) > 1:
            same, value = self.factor(same, value, FAN)
            self.levels.append((same, value))
        # each node keeps only the bits that no node above holds
        for k in range(len(self.levels) - 1):
            same, value = self.levels[k]
            above = np.repeat(self.levels[k + 1][0], FAN)[: len(same)]
            self.levels[k] = (same & ~above, value)

    @staticmethod
    def factor(same: np.ndarray, value: np.ndarray, fan: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each run of `fan` nodes, the bits that all share."""
        at = np.arange(0, len(value), fan)
        high, low = np.bitwise_or.reduceat(value, at), np.bitwise_and.reduceat(value, at)
        return np.bitwise_and.reduceat(same, at) & ~(high ^ low), low

    def search(self, queries: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each bottom node that some queries reach: its number, the queries' numbers, their differing bits so far."""
        if not len(self.levels[0][0]):
            return
        stack = [(len(self.levels) - 1, 0, np.arange(len(queries)), np.zeros(len(queries), dtype=np.uint8))]
        while stack:
            level, node, who, apart = stack.pop()
            same, value = self.levels[level]
            apart = apart + np.bitwise_count((queries[who] ^ value[node]) & same[node])
            near = apart <= bits
            if not near.any():
                continue
            who, apart = who[near], apart[near]
            if level:
                stack += [(level - 1, k, who, apart) for k in range(node * FAN, min(node * FAN + FAN, len(self.levels[level - 1][0])))]
            else:
                yield node, who, apart


class Index:
    """Over distinct codes: the tree over runs of LEAF codes in Gray order, and the codes' bits that no node holds."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        same, value = Tree.factor(np.full(len(codes), FULL), self.codes, LEAF) if len(codes) else (codes, codes)
        self.rest = ~same
        self.tree = Tree(same, value)

    def search(self, queries: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (number of the query, number of the code in Gray order) at most `bits` apart, leaf by leaf."""
        for leaf, who, apart in self.tree.search(queries, bits):
            codes = self.codes[leaf * LEAF : leaf * LEAF + LEAF]
            hit, code = np.nonzero(apart[:, None] + np.bitwise_count((queries[who][:, None] ^ codes[None, :]) & self.rest[leaf]) <= bits)
            if len(hit):
                yield who[hit], leaf * LEAF + code


class Part:
    """One part while its visitors pass: its own codes first, then others', block by block."""

    def __init__(self, codes: np.ndarray, bits: int) -> None:
        self.bits, self.index = bits, Index(codes)
        self.sets = Union(len(codes))
        own = self.index.codes
        for at in range(0, len(own), BLOCK):
            for a, b in self.index.search(own[at : at + BLOCK], bits):
                self.sets.join(at + a, b)
        self.root = self.sets.find(np.arange(len(own)))

    def own_links(self) -> tuple[np.ndarray, np.ndarray]:
        """A spanning forest of the links between its codes: code, root."""
        linked = np.flatnonzero(self.root != np.arange(len(self.root)))
        return self.index.codes[linked], self.index.codes[self.root[linked]]

    def links_of(self, visitors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each visitor with one code of every component it links to."""
        found = [(who, self.root[code]) for who, code in self.index.search(visitors, self.bits)]
        if not found:
            return visitors[:0], visitors[:0]
        who, root = (np.concatenate(x) for x in zip(*found, strict=True))
        pair = np.unique(who * np.int64(len(self.root)) + root)
        return visitors[pair // len(self.root)], self.index.codes[pair % len(self.root)]


def upper_levels(parts: list[tuple[int, int, int]]) -> Tree:
    """The tree over parts, given as (number, and of its codes, or of its codes)."""
    both, any_ = (np.array([r[k] for r in sorted(parts)], dtype=np.int64).view(np.uint64) for k in (1, 2))
    return Tree(~(both ^ any_), both)


def links(distinct: DataFrame, bits: int, part_codes: int) -> DataFrame:
    """u, v: links that connect all fingerprints (column fp, distinct) at most `bits` apart, not all pairs."""
    n = slices(distinct.count(), part_codes, least=8)
    placed = distinct.select("fp", gray_order(F.col("fp")).alias("rank")).repartitionByRange(n, "rank").select("fp", F.spark_partition_id().alias("part"))
    placed = written(placed, "gray-order")
    nodes = [tuple(r) for r in placed.groupBy("part").agg(F.bit_and("fp"), F.bit_or("fp")).collect()]  # a row a part
    numbers = np.array(sorted(r[0] for r in nodes), dtype=np.int64)
    shared = distinct.sparkSession.sparkContext.broadcast((upper_levels(nodes), numbers))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper, number = shared.value
        for batch in batches:
            fp, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            found = [(who, np.full(len(who), number[node])) for node, who, _ in upper.search(fp.view(np.uint64), bits)]
            who, to = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, dtype=int),) * 2
            own = part[who]
            keep = to >= own
            yield pa.RecordBatch.from_arrays([pa.array(to[keep], pa.int32()), pa.array((to > own)[keep].astype(np.int8)), pa.array(fp[who[keep]])], names=["to", "visitor", "fp"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for to, own, visitors in passing(batches):
            if own is not None:
                part = Part(own, bits)
                found = part.own_links()
            else:
                found = part.links_of(visitors)
            for at in range(0, len(found[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)].view(np.int64)) for x in found], names=["u", "v"])

    sent = placed.mapInArrow(visit, "to int, visitor tinyint, fp long")
    return sent.repartition(n, "to").sortWithinPartitions("to", "visitor").mapInArrow(search, "u long, v long")


def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray | None, np.ndarray | None]]:
    """Of rows (to, visitor, fp) in order: for each part its own codes, whole, then its visitors in blocks of about BLOCK."""
    at, held, size = None, [], 0

    def full() -> tuple:
        codes = np.concatenate(held)
        return (at[0], codes, None) if not at[1] else (at[0], None, codes)

    for batch in batches:
        to, visitor, fp = (batch.column(k).to_numpy() for k in range(3))
        cuts = np.flatnonzero((to[1:] != to[:-1]) | (visitor[1:] != visitor[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(to)], strict=True):
            if a == b:
                continue
            key = (int(to[a]), int(visitor[a]))
            if key != at or (key[1] and size >= BLOCK):
                if held:
                    yield full()
                at, held, size = key, [], 0
            held.append(fp[a:b].view(np.uint64))
            size += b - a
    if held:
        yield full()


def near_duplicates(docs: DataFrame, bits: int = 2, width: int = WIDTH, part_codes: int = 1 << 18) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable over links) for every row.

    Takes doc_id and text; other columns are ignored. Null and empty texts have fingerprint zero, which links like any
    other. Null doc_ids are never a component's least; a component of null doc_ids only has component_id null. Repeated
    rows share a fingerprint and so a component. A text of any length is hashed whole, in blocks. No rows: no result rows.
    """
    rows = written(fingerprints(docs, width), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    found = connected(links(distinct, bits, part_codes))
    member = written(distinct.join(found.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "fingerprint-roots")
    drop(distinct, found)
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = written(join_spread(member.select("fp", "root"), least, "root", F.col("fp")).select("fp", "component_id"), "fingerprint-components")
    drop(member)
    return join_spread(rows, by_fp, "fp", F.col("doc_id")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_copies(docs: DataFrame, similarity: float = 0.8, width: int = 5, bits: int = 2, part_codes: int = 1 << 18) -> DataFrame:
    """doc_id and component_id (least doc_id reachable over pairs of texts whose shingle sets are at least that similar) for every row.

    All such pairs are found, but for those between texts that others connect. Two ways first propose pairs: fingerprints at most `bits` apart by the Gray-order index, and min-hash keys, since at a
    similarity of 0.8 fingerprints mostly lie 10 bits apart, where no index prunes; a pair at 0.8 shares a key with probability
    1 - (1 - 0.8^5)^16 = 0.998. In a bucket of texts with one key each is held against the least of them and against its two
    neighbours before it in Gray order, so a bucket costs its size. Proposals whose fingerprints differ in more than far_bits are
    left out, and the whole shingle sets decide all others. Then the texts not yet connected meet by an exact join on the
    prefixes of their shingle sets (sharing), which finds whatever the proposals left out; the whole sets decide here, too.

    Null and empty texts are similar to each other and to nothing else. Null doc_ids are never a component's least; a component of
    null doc_ids only has component_id null. Repeated rows share a component. No rows: no result rows.
    """
    rows = written(keyed(docs, width, similarity), "shingle-keys")
    texts = written(rows.groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("rank").alias("rank"), F.first("keys").alias("keys"), F.first("prefix").alias("prefix"), F.first("sign").alias("sign")), "texts")
    rows, whole = written(rows.select("doc_id", "node"), "nodes"), rows
    drop(whole)
    one = F.struct("node", "n", "fp", "rank")
    apart = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= far_bits(similarity)
    likely = (F.col("a.node") != F.col("b.node")) & close_sizes(F.col("a.n"), F.col("b.n"), similarity) & apart
    pairs = lambda d: d.filter(likely).select(F.greatest("a.node", "b.node").alias("u"), F.least("a.node", "b.node").alias("v"))
    # near fingerprints: texts of one fingerprint meet the least of them, and the least ones of linked fingerprints each other
    hubs = written(texts.groupBy("fp").agg(F.min(one).alias("b")), "fingerprint-hubs")
    alike = pairs(join_spread(texts.select("fp", one.alias("a"), "node"), hubs, "fp", F.col("node")))
    side = lambda c, k: hubs.select(F.col("fp").alias(c), F.col("b").alias(k))
    near = pairs(links(hubs, bits, part_codes).join(side("u", "a"), "u").join(side("v", "b"), "v").select("a", "b"))
    # min-hash keys
    dealt = texts.select(one.alias("a"), "node", F.explode("keys").alias("key"))
    first = dealt.groupBy("key").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    members = written(join_spread(dealt, first, "key", F.col("node")).drop("node"), "buckets")
    piece = F.call_function("shiftrightunsigned", F.col("a.rank"), 63 - F.greatest(F.ceil(F.log2(F.col("many") / 4096.0)), F.lit(0)).cast("int"))  # a hot bucket's Gray order, cut
    order = Window.partitionBy("key", "_piece").orderBy("a.rank", "a.node")
    beside = members.withColumn("_piece", piece).select("a", F.array_compact(F.array(F.lag("a", 1).over(order), F.lag("a", 2).over(order))).alias("bs"))
    beside = beside.select("a", F.explode("bs").alias("b"))
    proposed = written(alike.unionByName(near).unionByName(pairs(members)).unionByName(pairs(beside)).distinct(), "pairs")
    likely_roots = connected(verified(docs, proposed, width, similarity))
    placed = texts.select("node", "n", "prefix", "sign").join(likely_roots.withColumnRenamed("u", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    others = sharing(placed, similarity)
    roots = connected(likely_roots.select("u", F.col("root").alias("v")).unionByName(verified(docs, others, width, similarity)))
    least = rows.groupBy("node").agg(F.min("doc_id").alias("least"))
    member = written(least.join(roots.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least"), "roots")
    drop(texts, hubs, members, proposed, likely_roots, others, roots)
    of_root = member.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = written(join_spread(member.select("node", "root"), of_root, "root", F.col("node")).select("node", "component_id"), "components")
    drop(member)
    return join_spread(rows.select("doc_id", "node"), of_node, "node", F.col("doc_id")).select("doc_id", "component_id")


def keep_first(docs: DataFrame, similarity: float | None = None, **parameters: int) -> DataFrame:
    """The rows of docs, with their columns, whose doc_id is the least of its component, and rows with null doc_id. Repeated doc_ids stay together.

    With a similarity, components are those of near_copies, else of near_duplicates.
    """
    found = near_duplicates(docs, **parameters) if similarity is None else near_copies(docs, similarity, **parameters)
    later = written(found.filter("doc_id <> component_id").select("doc_id").distinct(), "later-copies")  # of known size, so that Spark chooses whether to move them or the texts
    return docs.select(*without(docs)).join(later, "doc_id", "left_anti")
