"""Cross-tokenizer alignment by whitespace-token anchors.

Each text is tokenised whole by both tokenizers. Byte offsets where both have an end and both go on with a space-marked token
are anchors; they cut a document into windows of token ids, and a window's alignment is looked up by its two id tuples
in a table of bounded size. Windows repeat like words do, so few are ever aligned token by token.

How often two ids are linked corpus-wide is a sum over documents. Pairs with over 1/`broadcast_pairs` of all links, so fewer
than that many, go to every task; the links of rarer pairs, none of which is frequent, meet their counts in a join.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfind.llm.packing import encoder
from wayfind.llm.shared import drop, text_of, written

SPACE = "▁"
KEPT_WINDOWS = 400_000
LONG = 128  # tokens of both kinds: windows above are aligned without being remembered
SLICE_BYTES = 1 << 20


class ByteTokens:
    """A byte-level vocabulary of ranks: ids of a text with a space put before it, and each id's bytes, which always spell the text."""

    def __init__(self, ranks: str, pattern: str) -> None:
        self.encode = encoder(ranks, pattern).encode_ordinary  # special tokens' names are plain text
        with open(ranks, "rb") as f:
            table = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
        self.bytes = [table.get(k, b"") for k in range(max(table) + 1)]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Packed as unsigned 32-bit numbers."""
        return [array("I", self.encode(" " + t)).tobytes() for t in texts]


class PieceTokens:
    """A sentencepiece vocabulary, which puts a space before a text itself.

    Where no piece has a space after another character, merges stay within words, so words between single spaces are looked
    up in a table of bounded size; other texts, and all texts otherwise, are encoded whole.
    """

    def __init__(self, model: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(k) else n.replace(SPACE, " ").encode() for k, n in enumerate(names)]
        self.by_words = not any(SPACE in n.lstrip(SPACE) for n in names)
        self.known: dict[str, bytes | None] = {}

    def encoded(self, texts: list[str]) -> list[bytes | None]:
        """Packed ids of each text by itself, None where their bytes are not a space and the text."""
        spelled = lambda ids, t: b"".join(map(self.bytes.__getitem__, ids)) == b" " + t.encode()
        return [array("I", ids).tobytes() if spelled(ids, t) else None for ids, t in zip(self.model.encode(texts, num_threads=1), texts, strict=True)]

    def ids(self, texts: list[str]) -> list[bytes | None]:
        words = [t.split(" ") if self.by_words and t and "  " not in t and t[0] != " " and t[-1] != " " else None for t in texts]
        if len(self.known) > KEPT_WINDOWS:
            self.known.clear()
        known = self.known
        fresh = list(dict.fromkeys(w for own in words if own for w in own if w not in known))
        known.update(zip(fresh, self.encoded(fresh), strict=True))
        rest = iter(self.encoded([t for t, own in zip(texts, words, strict=True) if own is None]))
        found = [next(rest) if own is None else list(map(known.__getitem__, own)) for own in words]
        for w in fresh:
            if len(w) > LONG:
                del known[w]
        return [(None if None in f else b"".join(f)) if isinstance(f, list) else f for f in found]


@cache
def byte_tokens(ranks: str, pattern: str) -> ByteTokens:
    return ByteTokens(ranks, pattern)


@cache
def piece_tokens(model: str) -> PieceTokens:
    return PieceTokens(model)


Aligned = tuple[str, bytes]
OF_A = np.uint32(1 << 31)  # marks the ids of the first tokenizer in a window's packed ids


class Windows:
    """Alignments of windows by their ids: the groups as text, each with its closing mark, and the linked ids at the groups' ends."""

    def __init__(self, a, b) -> None:
        self.a, self.b = a, b
        self.size_a, self.size_b = (np.array([len(x) for x in t.bytes]) for t in (a, b))
        self.marked_a, self.marked_b = (np.array([x[:1] == b" " for x in t.bytes]) for t in (a, b))
        named = lambda t, mark: np.array([f"{k}{mark}" for k in range(len(t.bytes))], dtype=object)
        self.inner_a, self.last_a, self.inner_b, self.last_b = named(a, ","), named(a, "|"), named(b, ","), named(b, ";")
        self.known: dict[bytes, Aligned] = {}

    def cut(self, a: np.ndarray, b: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The windows of texts that follow one another: each one's packed ids, A's before B's, and how many of A's ids lie before it."""
        starts_a, starts_b = np.flatnonzero(self.marked_a[a]), np.flatnonzero(self.marked_b[b])  # of space-marked tokens, a text's first among them
        before_a, before_b = (np.cumsum(size[ids]) - size[ids] for size, ids in ((self.size_a, a), (self.size_b, b)))
        _, at_a, at_b = np.intersect1d(before_a[starts_a], before_b[starts_b], assume_unique=True, return_indices=True)  # verified: both begin at one offset
        cut_a, cut_b = starts_a[at_a], starts_b[at_b]
        n_a, n_b = np.diff(cut_a, append=len(a)), np.diff(cut_b, append=len(b))
        packed = np.empty(len(a) + len(b), dtype="<u4")
        packed[np.arange(len(a)) + np.repeat(cut_b, n_a)] = a | OF_A
        packed[np.arange(len(b)) + np.repeat(cut_a + n_a, n_b)] = b
        raw, ends = packed.tobytes(), (4 * (cut_a + cut_b)).tolist() + [4 * len(packed)]
        return [raw[i:j] for i, j in zip(ends, ends[1:], strict=False)], cut_a

    def align(self, windows: list[bytes]) -> list[Aligned]:
        """Cuts windows wherever both have an end. All at once: ends of windows are shared, so their ids can stand one after another."""
        packed = np.frombuffer(b"".join(windows), dtype="<u4")
        of_a = packed >= OF_A
        a, b = packed[of_a] ^ OF_A, packed[~of_a]
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        last_a, last_b = np.searchsorted(ends_a, shared), np.searchsorted(ends_b, shared)  # each group's last tokens
        size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        place_a, place_b = np.arange(len(a)) + np.repeat(last_b + 1 - size_b, size_a), np.arange(len(b)) + np.repeat(last_a + 1, size_b)
        names = np.empty(len(packed), dtype=object)
        names[place_a], names[place_b] = self.inner_a[a], self.inner_b[b]
        names[place_a[last_a]], names[place_b[last_b]] = self.last_a[a[last_a]], self.last_b[b[last_b]]
        shown, links = names.tolist(), (a[last_a].astype("<i8") << 32 | b[last_b].astype("<i8")).tobytes()
        ends = np.cumsum([len(w) // 4 for w in windows])
        groups = [0, *(8 * np.searchsorted(last_a, np.cumsum(of_a)[ends - 1])).tolist()]
        ends = [0, *ends.tolist()]
        return [("".join(shown[s:e]), links[g:h]) for s, e, g, h in zip(ends, ends[1:], groups, groups[1:], strict=False)]

    def documents(self, texts: list[str]) -> list[tuple[int, int, str, np.ndarray] | None]:
        """n_a, n_b, groups and links of each text; None where either's bytes are not a space and the text, and for empty ones."""
        ids = [(a, b) if t and b is not None else None for t, a, b in zip(texts, self.a.ids(texts), self.b.ids(texts), strict=True)]
        told = [x for x in ids if x]
        if not told:
            return [None] * len(texts)
        n_a, n_b = [len(a) // 4 for a, _ in told], [len(b) // 4 for _, b in told]
        a, b = (np.frombuffer(b"".join([x[k] for x in told]), dtype="<u4") for k in (0, 1))
        windows, starts = self.cut(a, b)
        if len(self.known) > KEPT_WINDOWS:
            self.known.clear()
        known = self.known
        fresh = list(dict.fromkeys(w for w in windows if w not in known))
        if fresh:
            known.update(zip(fresh, self.align(fresh), strict=True))
        shown, links = zip(*map(known.__getitem__, windows), strict=True)
        for w in fresh:
            if len(w) > 4 * LONG:
                del known[w]
        ends = np.searchsorted(starts, np.cumsum(n_a)).tolist()
        rows = ((x, y, "".join(shown[i:j])[:-1], np.frombuffer(b"".join(links[i:j]), dtype="<i8")) for x, y, i, j in zip(n_a, n_b, [0, *ends], ends, strict=False))
        return [next(rows) if x else None for x in ids]


_windows: dict[tuple, Windows] = {}


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about SLICE_BYTES, so that few ids are held at once."""
    start, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= SLICE_BYTES:
            yield start, k + 1
            start, held = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


ALIGNED = "n_a long, n_b long, n_groups long, n_links long, pairs array<long>, times array<int>, groups string"


def align_documents(docs: DataFrame, byte_ranks: str, pattern: str, piece_model: str, keep_groups: bool = True) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, pairs, times, groups of every row.

    A are the byte-level tokens of a space and the text, B the pieces of the text. Groups lie between neighbouring byte
    offsets where both end, as `a1,a2|b1;a3|b2`. A link is an A and a B token that end together, so the last ones of a group;
    pairs (A's id << 32 | B's id, ascending) and times say which ids are linked how often. Texts that are null, empty, or whose
    tokens of either kind do not spell a space and the text (as with U+2581) have zeros, no pairs and no groups. Special
    tokens' names are plain text. Repeated rows and null doc_ids are rows like others; other columns are ignored; texts are
    read whole; no rows, no result. Without keep_groups the groups are their SHA-256.
    """
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(ALIGNED).fields])
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.string()]

    def row(found: tuple[int, int, str, np.ndarray] | None) -> tuple:
        if found is None:
            return 0, 0, 0, 0, [], [], ""
        n_a, n_b, shown, links = found
        pairs, times = np.unique(links, return_counts=True)
        return n_a, n_b, len(links), len(links), pairs, times.astype(np.int32), shown if keep_groups else hashlib.sha256(shown.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (byte_ranks, pattern, piece_model)
        if key not in _windows:
            _windows[key] = Windows(byte_tokens(byte_ranks, pattern), piece_tokens(piece_model))
        windows = _windows[key]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, end in _slices(texts):
                part = texts[start:end]
                rows = list(map(row, windows.documents(part)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], names=schema.names)

    return docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(run, schema)


def link_counts(aligned: DataFrame) -> DataFrame:
    """pair, n: how many links of all documents hold the two ids."""
    return aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n"))


def score_links(docs: DataFrame, byte_ranks: str, pattern: str, piece_model: str, broadcast_pairs: int = 500_000) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row, as align_documents defines them.

    A pair of ids counts as often as it is linked in all documents together. n_best are a document's links whose pair is the
    most frequent of its B id (ties included), count_sum is the sum of their counts. groups_sha256 is empty without tokens.
    """
    spark = docs.sparkSession
    aligned = written(align_documents(docs, byte_ranks, pattern, piece_model, keep_groups=False).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = written(link_counts(aligned), "link-counts")
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    tops = counts.groupBy(b_id.alias("b_id")).agg(F.max("n").alias("top"))  # at most the second vocabulary's size
    judged = counts.join(F.broadcast(tops), b_id == F.col("b_id")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * broadcast_pairs > total  # fewer than broadcast_pairs can be
    frequent = judged.filter(often).toArrow()
    order = np.argsort(frequent["pair"].to_numpy())
    shared = spark.sparkContext.broadcast(tuple(frequent[c].to_numpy()[order] for c in ("pair", "n", "best")))
    schema = T.StructType([*[f for f in aligned.schema.fields if f.name not in ("pairs", "times")], *T._parse_datatype_string("n_best long, count_sum long, rare array<struct<pair:long,times:int>>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = shared.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            flat, often = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            size = pairs.value_lengths().to_numpy()
            of = np.repeat(np.arange(len(size)), size)
            at = np.minimum(np.searchsorted(keys, flat), max(len(keys) - 1, 0))
            hit = keys[at] == flat if len(keys) else np.zeros(len(flat), dtype=bool)
            at, row, each = at[hit], of[hit], often[hit]
            sums = np.bincount(row, weights=each * best[at], minlength=len(size)).astype(np.int64), np.zeros(len(size), dtype=np.int64)
            np.add.at(sums[1], row, each * n[at])
            left = ~hit
            starts = np.concatenate([[0], np.cumsum(np.bincount(of[left], minlength=len(size)))]).astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(starts), pa.StructArray.from_arrays([pa.array(flat[left]), pa.array(often[left].astype(np.int32))], names=["pair", "times"]))
            kept = [batch.column(c) for c in schema.names[:-3]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sums[0]), pa.array(sums[1]), rare], names=schema.names)

    first = written(aligned.mapInArrow(run, schema), "aligned-frequent")
    drop(aligned)
    rare = first.select("row", F.explode("rare").alias("p")).select("row", "p.pair", "p.times").join(judged.filter(~often), "pair")
    rest = rare.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    plus = lambda c, more: (F.col(c) + F.coalesce(F.col(more), F.lit(0))).alias(c)
    return first.drop("rare").join(rest, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", plus("n_best", "more_best"), plus("count_sum", "more_sum"), F.col("groups").alias("groups_sha256"))
