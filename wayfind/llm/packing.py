"""Best-fit packing of token sequences by patterns of few documents.

Texts become pieces of at most `room` tokens, so lengths have a histogram of at most `room` bins, whatever the corpus.
Patterns of one to three lengths that fill a sequence are enumerated, their repeat counts fitted to the histogram by
non-negative least squares and rounded down; what is left is packed best-fit, largest first, over the histogram as
well. Pieces then learn their sequence from their rank among the pieces of their length, which Spark counts by slices.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfind.llm.shared import slices, text_of, written

SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256
WASTE = 16


@cache
def encoder(vocabulary: str, pattern: str):
    """The byte-pair vocabulary of ranks at the path, whose ids are those of its JSON form."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})


class Words:
    """Ids of texts, as little-endian bytes. A text is encoded whole: where most words are new, a table of words takes twice the time."""

    def __init__(self, coder) -> None:
        self.coder = coder

    def document(self, text: str) -> bytes:
        return self.coder.encode_to_numpy(text, allowed_special={SPECIAL}, disallowed_special=()).astype("<u4", copy=False).tobytes()


@cache
def words(vocabulary: str, pattern: str) -> Words:
    return Words(encoder(vocabulary, pattern))


def pieces(docs: DataFrame, vocabulary: str, pattern: str, room: int = 2048, closing_id: int = 0, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, unless left out, ids (little-endian unsigned 32-bit) of every row: its text's ids, then the closing id.

    Only documents of more than `room` ids are cut, the odd part first.
    """
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), *([("ids", T.BinaryType())] if with_ids else []))]])
    arrow = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if with_ids else [])]
    close = np.array([closing_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = words(vocabulary, pattern)
        for batch in batches:
            rows, of, size = [], [], 0

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(arrow), arrow, strict=True)]], names=schema.names)  # noqa: B023

            for k, cell in enumerate(batch.column(1)):
                ids = table.document(cell.as_py()) + close
                n, start, piece = len(ids) // 4, 0, 0
                while start < n:
                    length = (n - start - 1) % room + 1 if piece == 0 else room
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append((piece, start, length, zlib.crc32(part), *([part] if with_ids else [])))
                    of.append(k)
                    start, piece = start + length, piece + 1
                size += len(ids) if with_ids else 0
                if size > 1 << 22:
                    yield out()
                    rows, of, size = [], [], 0
            yield out()

    return docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(run, schema)


Plan = list[tuple[tuple[int, ...], int]]


def patterns(have: np.ndarray, room: int, most: int = 60_000) -> np.ndarray:
    """Patterns as rows of three lengths (0: none) that fill `room` but for WASTE tokens; none where the lengths at hand are too short.

    For each pair of lengths the third is the longest that fits; pairs are thinned evenly where there are too many.
    """
    lengths = np.flatnonzero(have[: room + 1])
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return np.zeros((0, 3), dtype=int)
    step = max(1, int(np.sqrt(len(lengths) ** 2 / 2 / most)))
    longest = np.zeros(room + 1, dtype=int)  # the longest length at hand that is no longer
    longest[lengths] = lengths
    longest = np.maximum.accumulate(longest)
    second = longest[room - lengths]
    two = np.column_stack([lengths, second, longest[np.maximum(room - lengths - second, 0)]])
    a, b = (x.ravel() for x in np.meshgrid(lengths, lengths[::step], indexing="ij"))
    fits = (a >= b) & (a + b <= room)
    a, b = a[fits], b[fits]
    three = np.column_stack([a, b, longest[room - a - b]])
    found = np.unique(np.sort(np.vstack([two, three]), axis=1)[:, ::-1], axis=0)
    waste = room - found.sum(axis=1)
    return found[waste <= WASTE]


def fit_counts(found: np.ndarray, have: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |Ax - have|, A holding how often each length is in each pattern: multiplicative steps."""
    n = len(have)
    if not len(found):
        return np.zeros(0)
    mass = lambda x: np.bincount(found.ravel(), weights=np.repeat(x, 3), minlength=n)[:n]
    pull = lambda y: np.where(found > 0, y[found], 0.0).sum(axis=1)
    target = have.astype(float)
    target[0] = 0
    share = np.maximum(np.bincount(found.ravel(), minlength=n)[:n], 1)
    x = np.where(found > 0, (target / share)[found], np.inf).min(axis=1)
    top = pull(target)
    for _ in range(steps):
        at = mass(x)
        at[0] = 0
        x = x * top / np.maximum(pull(at), 1e-12)
    return x


def plan(have: np.ndarray, room: int) -> Plan:
    """Sequences as (lengths, how many); every piece of the histogram is in one. The better of patterns topped up best-fit and best-fit alone."""
    left = have.astype(np.int64).copy()
    left[0] = 0
    out: Plan = [((room,), int(left[room]))] if left[room] else []
    left[room] = 0
    alone = best_fit(left, room)
    taken: Plan = []
    found = patterns(left, room)
    x = fit_counts(found, left)
    for k in np.argsort(-x, kind="stable"):
        if x[k] < 1:
            break
        lengths = tuple(int(v) for v in found[k] if v)
        times = int(x[k])
        for v in set(lengths):
            times = min(times, int(left[v]) // lengths.count(v))
        if times > 0:
            for v in lengths:
                left[v] -= times
            taken.append((lengths, times))
    return out + min(best_fit(left, room, taken), alone, key=lambda p: sum(n for _, n in p))


def best_fit(left: np.ndarray, room: int, begun: Plan = ()) -> Plan:
    """Largest first into the fullest sequence with room, those begun included, over runs of equal lengths and of equal sequences."""
    open_: dict[int, list[list]] = defaultdict(list)  # free tokens: [lengths, how many]
    for lengths, times in begun:
        open_[room - sum(lengths)].append([lengths, times])
    free = sorted(open_)  # its keys
    for length in range(room, 0, -1):
        n = int(left[length])
        while n > 0:
            at = bisect.bisect_left(free, length)
            if at == len(free):  # a new sequence; as many at once as fill up with this length alone
                per = min(room // length, n)
                times = n // per
                was, room_left, lengths = None, room - per * length, (length,) * per
                n -= per * times
            else:
                gap = free[at]
                was = open_[gap][-1]
                per = min(gap // length, n)
                times = min(was[1], n // per)
                lengths, room_left = was[0] + (length,) * per, gap - per * length
                was[1] -= times
                n -= per * times
                if not was[1]:
                    open_[gap].pop()
                    if not open_[gap]:
                        free.pop(at)
            if not open_[room_left]:
                bisect.insort(free, room_left)
            open_[room_left].append([lengths, times])
    return [(lengths, n) for runs in open_.values() for lengths, n in runs if n]


def slots(found: Plan) -> dict[int, np.ndarray]:
    """By length, in order of rank: rows of (first rank, first sequence, offset in the sequence, how many)."""
    by_length: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    first = 0
    for lengths, times in found:
        offset = 0
        for v in lengths:
            by_length[v].append((first, offset, times))
            offset += v
        first += times
    out = {}
    for v, rows in by_length.items():
        starts = np.cumsum([0, *[t for _, _, t in rows[:-1]]])
        out[v] = np.column_stack([starts, np.array(rows, dtype=np.int64).reshape(-1, 3)])
    return out


def pack(docs: DataFrame, vocabulary: str, pattern: str, room: int = 2048, slice_rows: int = 20_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset: one row a piece, all rows of docs.

    ids are the piece's tokens as little-endian unsigned 32-bit numbers: laid end to end by offset they are the sequence.
    Takes doc_id and text; other columns are ignored. Null and empty texts are the closing id alone. Null doc_ids and
    repeated rows are packed as rows of their own; pieces of one length go by slice and doc_id. Texts of any length are
    packed whole. No rows: no pieces.
    """
    spark = docs.sparkSession
    found = pieces(docs, vocabulary, pattern, room)
    found = written(found.withColumn("slice", F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())), "pieces")
    total = found.count()
    n = slices(total, slice_rows)
    found = found.withColumn("slice", F.pmod("slice", F.lit(n)).cast("int"))
    counts = written(found.groupBy("length", "slice").agg(F.sum(F.lit(1)).alias("n")), "piece-counts")
    have = np.zeros(room + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # `room` rows at most
        have[r["length"]] = r["n"]
    table = spark.sparkContext.broadcast(slots(plan(have, room)))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32")
    ranked = found.withColumn("nth", F.row_number().over(inside)).join(base, ["length", "slice"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "ids", (F.col("base") + F.col("nth") - 1).alias("rank"))
    schema = T.StructType([*[f for f in ranked.schema.fields if f.name != "rank"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                slot = table.value[int(length[rows[0]])]
                at = np.searchsorted(slot[:, 0], rank[rows], side="right") - 1
                sequence[rows] = slot[at, 1] + rank[rows] - slot[at, 0]
                offset[rows] = slot[at, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.mapInArrow(place, schema)
