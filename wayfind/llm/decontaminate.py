"""Benchmark decontamination by spaced seeds.

A seed mask picks some of a few neighbouring words and ignores the others; equal hashes of the picked words in a test
item and a document are a hit, which lays the item along the document. A hit counts once some `stretch` words of the
item, so laid, that hold the seed have no more than `stretch // 5` substitutions. MASKS hit every such stretch of 10 to
20 words, whichever words are substituted, so nothing is lost to them (a test counts through all patterns). Items of
fewer words than a mask picks are hashed whole.

A hash that more than CROWD items have (a stock phrase) would lay every text with the phrase along all of them. Such hashes meet
nothing. The stretches that hold one, of items and of documents, are hashed by wide masks instead: of five groups of places,
spread over the whole stretch, a mask picks three, so two substitutions leave one mask untouched, and a phrase fills no mask
unless it fills all but two places of the stretch (longer stretches have as many more groups as more words may differ). Which hashes are hot is told by a second sieve, to both sides alike.

Both sides' hashes meet in a join. A sieve of fixed size, one bit a hash, goes to the documents first, so that only hashes
that some item may have leave them, each with the words around it that decide; texts never move.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, cycle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfind.llm.shared import drop, join_spread, text_of, written

MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 4, 6, 7))
STRETCH = 13
SIEVE_BITS = 22
CROWD = 16  # items
KEPT_WORDS = 100_000
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)
#: ASCII white space and marks part words
SPLIT = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def words_of(data: bytes) -> list[bytes]:
    """Runs of characters other than ASCII white space, controls and marks, A-Z lower-cased."""
    return data.translate(SPLIT).lower().split()


def allowed(n_words: int, stretch: int = STRETCH) -> tuple[int, int]:
    """Length of the stretch and how many of its words may differ, for an item of so many words."""
    length = min(n_words, stretch)
    return length, length // 5 if length >= 10 else 0


class Hashes(dict):
    """64-bit hashes of words; those met are kept up to KEPT_WORDS."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word)
        if len(self) < KEPT_WORDS:
            self[word] = found
        return found

    def of(self, data: bytes) -> np.ndarray:
        words = words_of(data)
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def seeds(ids: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Hash of the picked words at each place where the mask fits."""
    n = max(len(ids) - mask[-1], 0)
    total = np.full(n, np.uint64(mask[-1] * 64 + len(mask)))
    for k, m in zip(mask, cycle(MIX)):
        total = (total ^ ids[k : k + n]) * m
        total ^= total >> np.uint64(31)
    return total


def masks_for(n_words: int) -> list[tuple[int, ...]]:
    """How an item of so many words is hashed: by the masks, or whole if it has fewer words than they pick."""
    return list(MASKS) if n_words >= len(MASKS[0]) else [tuple(range(n_words))] if n_words else []


#: all ways that documents are hashed; items of one to four words have a way each
WAYS = (*MASKS, *(tuple(range(n)) for n in range(1, len(MASKS[0]))))


@cache
def wide_masks(length: int) -> list[tuple[int, ...]]:
    """Masks over a whole stretch, three groups of places each, of three more groups than words may differ; of a stretch without substitutions, all places."""
    _, differ = allowed(length, length)
    groups = differ + 3
    of = [p % groups if p < 2 * groups else (p - length + 3) % groups for p in range(length)]  # so that both ends together have three groups in three places
    return [tuple(p for p in range(length) if of[p] not in off) for off in combinations(range(groups), differ)] if differ else [tuple(range(length))]


def wide_way(length: int, k: int) -> int:
    return 16 + sum(len(wide_masks(n)) for n in range(len(MASKS[0]), length)) + k


def stretches_with(hot: list[np.ndarray], n_words: int, length: int) -> np.ndarray:
    """Where stretches of the length begin that hold a hot seed of any mask; hot: the places of these seeds, a mask each."""
    edges = np.zeros(n_words + 2, dtype=np.int64)
    for mask, places in zip(MASKS, hot, strict=True):
        low, high = np.maximum(places + mask[-1] + 1 - length, 0), np.minimum(places, n_words - length)
        fits = low <= high
        np.add.at(edges, low[fits], 1)
        np.add.at(edges, high[fits] + 1, -1)
    return np.flatnonzero(np.cumsum(edges) > 0)


def passes(sieve: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether an item may have the hash: the bits for its high and for its low end are set."""
    size = 1 << SIEVE_BITS
    return sieve[(hashes >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)] & sieve[size + (hashes & np.uint64(size - 1)).astype(np.int64)]


def item_seeds(items: DataFrame, hot: np.ndarray | None = None, stretch: int = STRETCH) -> DataFrame:
    """way, hash, place, item (its key) of each seed of the items (item, data); with a sieve of hot hashes, wide ones of the stretches that hold one in place of these."""
    shared = None if hot is None else items.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()

        def out(way: int, found: np.ndarray, places: np.ndarray, item: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(found), way), pa.int16()), pa.array(found.view(np.int64)), pa.array(places, pa.int32()), pa.array(np.full(len(found), item), pa.int64())], names=["way", "hash", "place", "item"])

        for batch in batches:
            for item, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = hashes.of(cell.as_py())
                masks, crowded = masks_for(len(ids)), []
                for mask in masks:
                    found = seeds(ids, mask)
                    often = passes(shared.value, found) if shared and len(masks) == len(MASKS) else np.zeros(len(found), dtype=bool)
                    crowded.append(np.flatnonzero(often))
                    yield out(WAYS.index(mask), found[~often], np.flatnonzero(~often), item)
                if shared and len(masks) == len(MASKS):
                    length, _ = allowed(len(ids), stretch)
                    starts = stretches_with(crowded, len(ids), length)
                    if len(starts):
                        for k, mask in enumerate(wide_masks(length)):
                            yield out(wide_way(length, k), seeds(ids, mask)[starts], starts, item)

    return items.mapInArrow(run, "way smallint, hash long, place int, item long")


def sieve_of(found: DataFrame) -> tuple[np.ndarray, list[int]]:
    """A bit for each high end and each low end of a hash that some item has, and the ways in use; 2^(SIEVE_BITS - 5) rows at most reach the driver."""
    size = 1 << SIEVE_BITS
    ends = found.select(F.explode(F.array(F.shiftrightunsigned("hash", 64 - SIEVE_BITS), F.col("hash").bitwiseAND(F.lit(size - 1)) + F.lit(size))).alias("bit"))
    word = F.shiftright("bit", 6).cast("int").alias("at")
    rows = ends.groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("bits")).toPandas()
    words = np.zeros(2 * size // 64, dtype=np.int64)
    words[rows["at"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64)
    ways = sorted(r["way"] for r in found.select("way").distinct().collect())  # a hundred at most
    return np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool), ways


def document_hits(docs: DataFrame, sieve: tuple[np.ndarray, list[int]], stretch: int, hot: np.ndarray | None = None) -> DataFrame:
    """text_key, n_bytes, way, hash, at, words (hashes of the words around, as bytes), lead (how many of them come before `at`) of each seed that passes the sieve."""
    shared = docs.sparkSession.sparkContext.broadcast((*sieve, hot))  # 8 MB a sieve, whatever the items
    fields = "text_key long, n_bytes int, way smallint, hash long, at int, lead tinyint, words binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve, ways, hot = shared.value
        wide = [(length, wide_way(length, k), mask) for length in range(len(MASKS[0]), stretch + 1) for k, mask in enumerate(wide_masks(length)) if wide_way(length, k) in ways]
        hashes = Hashes()

        def out(rows: list[tuple]) -> pa.RecordBatch:
            types = (pa.int64(), pa.int32(), pa.int16(), pa.int64(), pa.int32(), pa.int8(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], names=[f.split()[0] for f in fields.split(", ")])

        for batch in batches:
            rows = []
            for key, size, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = hashes.of(cell.as_py())
                crowded = []
                for way in range(len(WAYS)):
                    if way not in ways and (hot is None or way >= len(MASKS)):
                        continue
                    found = seeds(ids, WAYS[way])
                    hit = passes(sieve, found)
                    if hot is not None and way < len(MASKS):
                        often = passes(hot, found)
                        crowded.append(np.flatnonzero(often))
                        hit &= ~often
                    reach = WAYS[way][-1] + 1
                    side = max(stretch - reach, 0) if way < len(MASKS) else 0
                    for at in np.flatnonzero(hit).tolist():
                        low = max(at - side, 0)
                        rows.append((key, size, way, int(found[at].view(np.int64)), at, at - low, ids[low : at + reach + side].tobytes()))
                if any(len(c) for c in crowded):
                    starts = {length: stretches_with(crowded, len(ids), length) for length in {w[0] for w in wide}}
                    for length, way, mask in wide:
                        found = seeds(ids, mask)[starts[length]] if len(starts[length]) else np.zeros(0, dtype=np.uint64)
                        for k in np.flatnonzero(passes(sieve, found)).tolist():
                            at = int(starts[length][k])
                            rows.append((key, size, way, int(found[k].view(np.int64)), at, 0, ids[at : at + length].tobytes()))
                if len(rows) > 20_000:
                    yield out(rows)
                    rows = []
            yield out(rows)

    return docs.mapInArrow(run, fields)


def verify(hits: DataFrame, stretch: int) -> DataFrame:
    """Of hits with their item (place, item_words) those that lie in a stretch with few substitutions, as text_key, n_bytes, item, start_word, equal_words, item_words."""
    fields = "text_key long, n_bytes int, item long, start_word long, equal_words long, item_words long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            at, lead, place, way = (c[n].to_numpy() for n in ("at", "lead", "place", "way"))
            kept, start, equal, size = [], [], [], []
            for k in range(batch.num_rows):
                want = np.frombuffer(c["item_words"][k].as_buffer(), dtype="<u8")
                near = np.frombuffer(c["words"][k].as_buffer(), dtype="<u8")
                length, differ = allowed(len(want), stretch)
                first = int(lead[k]) - int(place[k])  # of the item's first word among the words around
                a, b = max(first, 0), min(first + len(want), len(near))
                same = np.zeros(len(want), dtype=np.int64)
                same[a - first : b - first] = near[a:b] == want[a - first : b - first]
                total = np.r_[0, np.cumsum(same)]
                if (best := int((total[length:] - total[:-length]).max())) >= length - differ:
                    kept.append(k)
                    start.append(int(at[k]) - int(place[k]))
                    equal.append(best)
                    size.append(len(want))
            rows = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([*[c[n].take(rows) for n in ("text_key", "n_bytes", "item")], *[pa.array(x, pa.int64()) for x in (start, equal, size)]], names=[f.split()[0] for f in fields.split(", ")])

    return hits.mapInArrow(run, fields)


def _key(data: Column) -> Column:
    return F.xxhash64(data).alias("text_key")


def overlaps(docs: DataFrame, benchmark: DataFrame, stretch: int = STRETCH) -> tuple[DataFrame, DataFrame]:
    """(found, items). found: text_key, n_bytes, item, start_word, equal_words, item_words, one row a pair of texts that overlap; items: item, data."""
    items = benchmark.select(F.encode(text_of(benchmark), "UTF-8").alias("data")).distinct().select(_key(F.col("data")).alias("item"), "data")
    items = written(items, "items")
    marks = written(item_seeds(items), "item-seeds")
    crowds = marks.filter(F.col("way") < len(MASKS)).groupBy("way", "hash").agg(F.count_distinct("item").alias("n")).filter(F.col("n") > CROWD)
    hot = sieve_of(crowds)[0] if crowds.head(1) else None
    if hot is not None:
        plain, marks = marks, written(item_seeds(items, hot, stretch), "item-seeds")
        drop(plain)
    texts = docs.select(_key(text_of(docs)), F.octet_length(text_of(docs)).alias("n_bytes"), F.encode(text_of(docs), "UTF-8").alias("data"))
    hits = document_hits(texts, sieve_of(marks), stretch, hot)
    once = ["text_key", "n_bytes", "way", "hash", "at"]  # copies of a text hit alike
    hits = written(hits.groupBy(*once).agg(F.max(F.struct("lead", "words")).alias("w")).select(*once, "w.lead", "w.words"), "hits")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashes.of(x.as_py()).tobytes() for x in batch.column(1)], pa.binary())], names=["item", "item_words"])

    words = items.mapInArrow(numbered, "item long, item_words binary")
    met = join_spread(written(hits.join(marks, ["way", "hash"]).drop("hash"), "met"), words, "item", F.col("text_key"))
    found = verify(met.select("text_key", "n_bytes", "way", "at", "lead", "words", "place", "item", "item_words"), stretch)
    best = F.max(F.struct("equal_words", -F.col("start_word"), "item_words")).alias("b")
    found = found.groupBy("text_key", "n_bytes", "item").agg(best).select("text_key", "n_bytes", "item", (-F.col("b")["col2"]).alias("start_word"), "b.equal_words", "b.item_words")
    return written(found, "overlaps"), items


def find_leaks(docs: DataFrame, benchmark: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """doc_id, item_id, start_word, equal_words, item_words: one row for each row of docs and of benchmark that overlap.

    start_word is the place in the document, from 0, of the item's first word (negative where the item's beginning is cut
    off); equal_words counts equal words of the best stretch. Of several overlaps of the two the one with most equal words,
    then the first, is given. Items of up to 9 words must occur whole; null and empty items are never found. Null texts hold
    nothing. Null doc_ids and repeated rows of docs and of benchmark are judged, and given, like others; any type of id will
    do. Other columns are ignored. Texts of any length are searched whole. No rows: no result rows.
    """
    found, _ = overlaps(docs, benchmark, stretch)
    item = F.xxhash64(F.encode(text_of(benchmark), "UTF-8"))
    names = benchmark.select("item_id", item.alias("item"))
    rows = docs.select("doc_id", _key(text_of(docs)), F.octet_length(text_of(docs)).alias("n_bytes"))
    return rows.join(found, ["text_key", "n_bytes"]).join(names, "item").select("doc_id", "item_id", "start_word", "equal_words", "item_words")


def without_leaks(docs: DataFrame, benchmark: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """The rows of docs, with their columns, that overlap no test item. Rows of equal text share their verdict, whatever their ids."""
    found, _ = overlaps(docs, benchmark, stretch)
    key, size = F.xxhash64(text_of(docs)), F.octet_length(text_of(docs))
    gone = found.select(F.col("text_key").alias("_k"), F.col("n_bytes").alias("_n")).distinct()
    return docs.join(gone, (key == F.col("_k")) & (size == F.col("_n")), "left_anti")
