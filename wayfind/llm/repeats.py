"""Suffix-array dedup: removes bytes covered by a string of `min_bytes` that also starts in a document with a smaller id.

One suffix array of everything would be one task, so suffixes are dealt out first. The key of a string of `min_bytes`
is the least hash of the seeds (shorter strings) in it: equal strings have equal keys, and neighbouring strings mostly
share theirs, so a run of neighbours with one key travels as one string, at about 4 bytes a suffix.

Documents are dealt to chunks, which exchange three rounds of messages with buckets; a message is one row a chunk and
bucket, and nothing in a bucket grows with how often a string occurs beyond once a chunk:
1. chunks send keys, buckets answer which ones occur in two documents or more, and which are hot;
2. chunks send the distinct runs of those keys, each with its least document. A bucket sorts the runs' suffixes and builds
   their longest-previous-factor array: along the suffix order each one's previous and next smaller document, and of the
   two common prefixes the longer one. A run that several chunks send is sorted once, as in its least document;
3. chunks mark the bytes covered by suffixes whose longest previous factor has `min_bytes`, and by copies of a run that
   lies in a smaller document.
Keys that occur in more than `spread` chunks, or whose runs have more than `most_bytes` in all, are hot: their runs travel
string by string, dealt by the string itself, so no bucket grows with one key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfind.llm.shared import slices, text_of, without

SLAB = 1 << 17
RANGE = 1 << 17  # suffixes sorted at a time
LONGEST_RUN = 64
KEY_BITS = 48  # keys that clash cost work, not results
PAD = 64
HEAVY = 4096  # bytes of a key's runs in a chunk from which they are reported
NO_ID = np.iinfo(np.int64).max  # rows without an id come after all others
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


class Texts:
    """A chunk's texts, end to end, by id and text."""

    def __init__(self, table: pa.Table) -> None:
        ids = table.column("id").combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False)
        data = table.column("data").to_pylist()
        order = sorted(range(len(data)), key=lambda k: (ids[k], data[k]))
        self.rows = np.array(order, dtype=np.int64)
        self.ids = ids[self.rows] if order else ids
        self.raw = b"".join([data[k] for k in order])
        sizes = np.array([len(data[k]) for k in order], dtype=np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.bytes = np.frombuffer(self.raw + bytes(PAD), dtype=np.uint8)


def squeezed(data: bytes | np.ndarray) -> bytes:
    """Messages travel compressed, numbers byte plane by byte plane."""
    if isinstance(data, np.ndarray):
        data = np.ascontiguousarray(data).view(np.uint8).reshape(-1, data.itemsize).T.tobytes() if len(data) else b""
    return zstandard.compress(data, 3)


def numbers_of(data: bytes, kind: str) -> np.ndarray:
    plain = np.frombuffer(zstandard.decompress(data), dtype=np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(plain.reshape(size, -1).T).view(kind).ravel() if len(plain) else np.zeros(0, dtype=kind)


def seed_hashes(data: np.ndarray, start: int, n: int, seed: int) -> np.ndarray:
    """Of the n strings of `seed` bytes from `start` on."""
    found = np.zeros(n, dtype=np.uint64)
    for k, offset in enumerate([*range(0, seed - 8, 8), seed - 8]):
        found ^= np.ndarray((n,), "<u8", data, start + offset, (1,))
        found *= np.uint64(MULTIPLIERS[k % 3])
        found ^= found >> np.uint64(32)
    found *= np.uint64(MULTIPLIERS[1])
    return found ^ (found >> np.uint64(29))


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours."""
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    return np.minimum(values[: len(values) - (width - reach)], values[width - reach :])


def runs_of(texts: Texts, min_bytes: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """key, first suffix, how many suffixes, and text number of each run of suffixes with one key."""
    total = len(texts.raw)
    change = np.zeros(total + 1, dtype=np.int8)
    long = texts.ends - texts.starts >= min_bytes
    change[texts.starts[long]] = 1
    change[texts.ends[long] - min_bytes + 1] -= 1
    valid = np.cumsum(change, dtype=np.int8)[:total].astype(bool)
    width = min_bytes - seed + 1
    keys, firsts, counts = [], [], []
    for a in range(0, max(total - min_bytes + 1, 0), SLAB):
        b = min(a + SLAB, total - min_bytes + 1)
        key = least_of(seed_hashes(texts.bytes, a, b - a + width - 1, seed), width)
        ok = valid[a:b]
        new = np.r_[True, (key[1:] != key[:-1]) | ~ok[:-1]] & ok
        first = np.flatnonzero(new)
        if not len(first):
            continue
        # a run ends where the next begins or at its last valid suffix
        upto = np.add.reduceat(ok, first, dtype=np.int64)
        parts = -(-upto // LONGEST_RUN)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        keys.append(np.repeat(key[first], parts))
        firsts.append(a + np.repeat(first, parts) + nth * LONGEST_RUN)
        counts.append(np.minimum(np.repeat(upto, parts) - nth * LONGEST_RUN, LONGEST_RUN))
    if not keys:
        return (np.zeros(0, dtype=np.uint64), *[np.zeros(0, dtype=np.int64)] * 3)
    first = np.concatenate(firsts)
    return np.concatenate(keys) >> np.uint64(64 - KEY_BITS), first, np.concatenate(counts), np.searchsorted(texts.starts, first, side="right") - 1


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Least hashes lean to small values; mixed again they don't."""
    return ((keys * np.uint64(MULTIPLIERS[2])) >> np.uint64(24)) % np.uint64(n)


def spread_out(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, … for each start, count numbers of each."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def by_bucket(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    return [(int(bucket[part[0]]), part) for part in np.split(order, cuts)] if len(order) else []


def send_keys(key: tuple, table: pa.Table, *, min_bytes: int, seed: int, buckets: int) -> pa.Table:
    """A chunk's distinct keys, which of them two of its documents have, and how many bytes the runs of the larger ones take."""
    texts = Texts(table)
    keys, _, count, row = runs_of(texts, min_bytes, seed)
    ids = texts.ids[row] if len(row) else row
    order = np.lexsort((ids, keys))
    keys, ids, size = keys[order], ids[order], count[order] + min_bytes - 1
    new = np.r_[True, keys[1:] != keys[:-1]][: len(keys)]
    twice = np.r_[False, (keys[1:] == keys[:-1]) & (ids[1:] != ids[:-1])][: len(keys)]
    first = np.flatnonzero(new)
    if len(first):
        keys, twice, size = keys[first], np.logical_or.reduceat(twice, first), np.add.reduceat(size, first)
    rows = []
    for b, p in by_bucket(bucket_of(keys, buckets)):
        heavy = np.flatnonzero(size[p] >= HEAVY)
        rows.append((b, key[0].as_py(), squeezed(keys[p]), squeezed(np.packbits(twice[p])), squeezed(np.r_[heavy, size[p][heavy]].astype("<u4")) if len(heavy) else b""))
    return _table(rows, KEYS_SENT)


def answer_keys(key: tuple, table: pa.Table, *, spread: int, most_bytes: int) -> pa.Table:
    """To each chunk, bit by bit, which of its keys two documents have, and which of those are hot."""
    sent = [numbers_of(x, "<u8") for x in table.column("keys").to_pylist()]
    twice = [np.unpackbits(numbers_of(x, "u1"), count=len(k)).astype(bool) for x, k in zip(table.column("twice").to_pylist(), sent, strict=True)]
    found, at, n = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
    shared = n > 1
    shared[at[np.concatenate(twice)]] = True
    size = np.zeros(len(found), dtype=np.int64)
    starts = np.cumsum([0, *map(len, sent)])
    for start, blob in zip(starts[:-1].tolist(), table.column("heavy").to_pylist(), strict=True):
        if blob:
            heavy, many = numbers_of(blob, "<u4").astype(np.int64).reshape(2, -1)
            size[at[start + heavy]] += many
    hot = (n > spread) | (size > most_bytes)
    rows = []
    for start, chunk, keys in zip(starts[:-1].tolist(), table.column("chunk").to_pylist(), sent, strict=True):
        own = at[start : start + len(keys)]
        keep = shared[own]
        if keep.any():
            warm = keep & hot[own]
            rows.append((chunk, -1 - key[0].as_py(), squeezed(np.packbits(keep)), squeezed(np.packbits(warm)) if warm.any() else b""))
    return _table(rows, ANSWERS)


def told_keys(keys: np.ndarray, answers: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the chunk's distinct keys, in order, the buckets called shared, and hot."""
    told = {-1 - b: (f, h) for b, f, h in zip(*[answers.column(c).to_pylist() for c in ("bucket", "flags", "hot")], strict=True) if b < 0}
    shared, hot = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    for b, p in by_bucket(bucket_of(keys, buckets)):
        if b in told:
            for out, bits in zip((shared, hot), told[b], strict=True):
                if bits:
                    out[p] = np.unpackbits(numbers_of(bits, "u1"), count=len(p)).astype(bool)
    return shared, hot


class Runs:
    """A chunk's runs of shared keys: the distinct strings in order of first occurrence, with their least id and key."""

    def __init__(self, texts: Texts, answers: pa.Table, min_bytes: int, seed: int, key_buckets: int) -> None:
        keys, first, count, row = runs_of(texts, min_bytes, seed)
        own, at = np.unique(keys, return_inverse=True)
        shared, hot = told_keys(own, answers, key_buckets)
        kept = shared[at]
        apart = hot[at[kept]]
        keys, first, count, row = keys[kept], first[kept], count[kept], row[kept]
        if apart.any():  # string by string
            n = np.where(apart, count, 1)
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            apart, first, row = np.repeat(apart, n), np.repeat(first, n) + nth, np.repeat(row, n)
            keys, count = np.repeat(keys, n), np.where(apart, 1, np.repeat(count, n))
        self.first, self.count, self.ids = first, count, texts.ids[row] if len(row) else row
        self.number = np.zeros(len(first), dtype=np.int64)
        numbers: dict[bytes, int] = {}
        raw, more = texts.raw, min_bytes - 1
        at = []
        for k, (a, n) in enumerate(zip(first.tolist(), count.tolist(), strict=True)):
            number = numbers.setdefault(raw[a : a + n + more], len(numbers))
            if number == len(at):
                at.append(k)
            self.number[k] = number
        at = np.array(at, dtype=np.int64)
        self.strings = list(numbers)
        self.string_count, self.least = count[at], self.ids[at]  # texts go by id, so the first occurrence has the least
        self.string_key = keys[at]
        for k in np.flatnonzero(apart[at]) if len(at) else []:
            self.string_key[k] = xxhash.xxh64_intdigest(self.strings[k]) >> (64 - KEY_BITS)


def send_runs(key: tuple, table: pa.Table, answers: pa.Table, *, min_bytes: int, seed: int, key_buckets: int, buckets: int) -> pa.Table:
    if not table.num_rows or not answers.num_rows:
        return _table([], RUNS_SENT)
    runs = Runs(Texts(table), answers, min_bytes, seed, key_buckets)
    rows = []
    for b, p in by_bucket(bucket_of(runs.string_key, buckets)):
        strings = [runs.strings[k] for k in p.tolist()]
        rows.append((b, key[0].as_py(), squeezed(b"".join(strings)), squeezed(runs.string_count[p].astype("u1")), squeezed(runs.least[p])))
    return _table(rows, RUNS_SENT)


def common_prefixes(words: Iterable[np.ndarray], n: int, offsets: list[int], most: int) -> np.ndarray:
    """Of n neighbours in suffix order, given as big-endian words at the offsets: how many first bytes they share, up to `most`; 0 for the first."""
    found = np.zeros(n, dtype=np.int64)
    going = np.ones(max(n - 1, 0), dtype=bool)
    for word, offset in zip(words, offsets, strict=True):
        apart = word[1:] ^ word[:-1]
        ends = np.flatnonzero(going & (apart != 0))
        zeros = sum((apart[ends] < np.uint64(1 << (8 * k))).astype(np.int64) for k in range(1, 8))
        found[1:][ends] = offset + zeros
        going[ends] = False
    found[1:][going] = most
    return np.minimum(found, most)


def minima(values: np.ndarray, blank: int) -> list[np.ndarray]:
    """The values, the minima of pairs of them, of pairs of these, and so on to one; odd ends are filled up with blank."""
    levels = [values]
    while len(levels[-1]) > 1:
        if len(levels[-1]) % 2:
            levels[-1] = np.append(levels[-1], np.array([blank], dtype=values.dtype))
        levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
    return levels


def reach_by_minima(documents: np.ndarray, common: np.ndarray, places: np.ndarray) -> np.ndarray:
    """reach_of_smaller at some places, in at most twice as many steps as there are levels of minima, whatever the order of documents."""
    small = np.uint8 if common.max(initial=0) < 256 else np.int64
    smallest, shared = minima(documents, NO_ID), minima(common.astype(small), np.iinfo(small).max)
    found = np.zeros(len(places), dtype=np.int64)
    k, at, least, low = np.arange(len(places)), places, documents[places], common[places]
    for level in range(len(smallest) - 1):
        odd = np.flatnonzero(at & 1)
        hit = smallest[level][at[odd] - 1] < least[odd]
        inside, block = odd[hit], at[odd[hit]] - 1
        reach, own = low[inside], least[inside]
        for below in range(level - 1, -1, -1):  # to the last smaller one in the block
            right = 2 * block + 1
            there = smallest[below][right] < own
            reach = np.where(there, reach, np.minimum(reach, shared[below][right]))
            block = np.where(there, right, right - 1)
        found[k[inside]] = reach
        past = odd[~hit]
        low[past] = np.minimum(low[past], shared[level][at[past] - 1])
        going = (low > 0) & (at > 1)
        going[inside] = False
        k, at, least, low = k[going], at[going] >> 1, least[going], low[going]
    return found


def reach_of_smaller(documents: np.ndarray, common: np.ndarray, rounds: int = 16) -> np.ndarray:
    """For each place in suffix order, how long a prefix it shares with the nearest place before it of a smaller document; 0 if there is none.

    Most places have it close by, which a few rounds of following pointers find; the rest go by minima of blocks.
    """
    at = np.arange(len(documents)) - 1
    low = common.copy()
    todo = np.flatnonzero(low > 0)
    for _ in range(rounds):
        if not len(todo := todo[documents[at[todo]] >= documents[todo]]):
            return low
        low[todo] = np.minimum(low[todo], low[at[todo]])
        at[todo] = at[at[todo]]
        ended = (low[todo] == 0) | (at[todo] < 0)
        low[todo[ended]] = 0
        todo = todo[~ended]
    if len(todo := todo[documents[at[todo]] >= documents[todo]]):
        low[todo] = reach_by_minima(documents, common, todo)
    return low


def longest_previous(data: np.ndarray, suffixes: np.ndarray, documents: np.ndarray, most: int) -> np.ndarray:
    """The longest-previous-factor array, up to `most` bytes: for each suffix, how long a prefix of it also starts in a smaller document.

    The longest match lies with the nearest smaller document before or after it in suffix order.
    """
    offsets = [*range(0, most - 8, 8), most - 8]
    starts = np.ndarray((len(data) - 7,), ">u8", data, 0, (1,))
    words = [starts[suffixes + k].astype(np.uint64) for k in offsets]
    order = np.lexsort(words[::-1])
    common = common_prefixes((w[order] for w in words), len(order), offsets, most)
    del words
    of = documents[order]
    before = reach_of_smaller(of, common)
    after = reach_of_smaller(of[::-1], np.r_[common[:1], common[1:][::-1]])[::-1]
    found = np.zeros(len(order), dtype=np.int64)
    found[order] = np.maximum(before, after)
    return found


def later_copies(data: np.ndarray, suffixes: np.ndarray, documents: np.ndarray, most: int, room: int = RANGE) -> np.ndarray:
    """Which suffixes have a longest previous factor of `most` bytes. Sorted range by range of their first words, which keep equal strings together, so a bucket takes a range's memory."""
    first = np.ndarray((len(data) - 7,), ">u8", data, 0, (1,))
    words = np.array(first[suffixes], dtype=np.uint64)
    order = np.argsort(words, kind="stable")
    new = np.flatnonzero(np.r_[True, words[order[1:]] != words[order[:-1]]]) if len(order) else order
    del words
    cuts = np.unique(new[np.minimum(np.searchsorted(new, np.arange(0, len(order), room)), len(new) - 1)]) if len(order) else order
    found = np.zeros(len(suffixes), dtype=bool)
    for part in np.split(order, cuts[1:]) if len(order) else []:
        found[part] = longest_previous(data, suffixes[part], documents[part], most) >= most
    return found


def answer_runs(key: tuple, table: pa.Table, *, min_bytes: int) -> pa.Table:
    """To each chunk, bit by bit, which suffixes of its strings, as in their least document, are later copies."""
    blobs, counts, least = (table.column(c).to_pylist() for c in ("strings", "counts", "least"))
    blobs, counts = [zstandard.decompress(x) for x in blobs], [numbers_of(x, "u1").astype(np.int64) for x in counts]
    size = [len(x) for x in counts]
    numbers: dict[bytes, int] = {}
    number, at = np.zeros(sum(size), dtype=np.int64), []
    k = 0
    for blob, count in zip(blobs, counts, strict=True):
        stop = np.cumsum(count + min_bytes - 1).tolist()
        start = 0
        for end in stop:
            n = numbers.setdefault(blob[start:end], len(numbers))
            if n == len(at):
                at.append(k)
            number[k] = n
            start, k = end, k + 1
    count, least = np.concatenate(counts), np.concatenate([numbers_of(x, "<i8") for x in least])
    strings, at = list(numbers), np.array(at)
    first = np.full(len(strings), NO_ID)
    np.minimum.at(first, number, least)
    own_count = count[at]
    own_start = np.cumsum(own_count) - own_count
    long = own_count + min_bytes - 1
    data = np.frombuffer(b"".join(strings) + bytes(8), dtype=np.uint8)
    flags = later_copies(data, spread_out(np.cumsum(long) - long, own_count), np.repeat(first, own_count), min_bytes)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    bits = flags[np.repeat(own_start[number], count) + nth] | np.repeat(least > first[number], count)
    rows, start = [], 0
    for c, b, n in zip(table.column("chunk").to_pylist(), table.column("bucket").to_pylist(), [int(x.sum()) for x in counts], strict=True):
        if bits[start : start + n].any():
            rows.append((c, b, squeezed(np.packbits(bits[start : start + n])), b""))
        start += n
    return _table(rows, ANSWERS)


def cover(key: tuple, table: pa.Table, answers: pa.Table, *, min_bytes: int, seed: int, key_buckets: int, buckets: int, keep_text: bool) -> pa.Table:
    """The chunk's documents without what later copies cover."""
    texts = Texts(table)
    depth = np.int16 if min_bytes < 1 << 15 else np.int64  # a byte lies in min_bytes strings at most
    change = np.zeros(len(texts.raw) + 1, dtype=depth)
    if answers.num_rows:
        runs = Runs(texts, answers, min_bytes, seed, key_buckets)
        told = {b: f for b, f in zip(answers.column("bucket").to_pylist(), answers.column("flags").to_pylist(), strict=True) if b >= 0}
        starts = np.cumsum(runs.string_count) - runs.string_count
        flags = np.zeros(int(runs.string_count.sum()), dtype=bool)  # of each distinct string's suffixes
        for b, p in by_bucket(bucket_of(runs.string_key, buckets)):
            if b in told:
                at = spread_out(starts[p], runs.string_count[p])
                flags[at] = np.unpackbits(numbers_of(told[b], "u1"), count=len(at)).astype(bool)
        if len(runs.number):
            later = np.repeat(runs.ids > runs.least[runs.number], runs.count)
            gone = flags[spread_out(starts[runs.number], runs.count)] | later
            where = spread_out(runs.first, runs.count)[gone]  # no suffix is in two runs
            del gone, later
            change[where] += 1
            where += min_bytes
            change[where] -= 1
            del where, flags
        del runs
    removed = np.cumsum(change[:-1], dtype=depth) > 0
    del change
    starts_span = removed & ~np.r_[False, removed[:-1]][: len(removed)]
    out = []
    for a, b in zip(texts.starts.tolist(), texts.ends.tolist(), strict=True):
        gone = removed[a:b]
        n = int(gone.sum())
        kept = texts.raw[a:b] if not n else texts.bytes[a:b][~gone].tobytes()
        spans = int(starts_span[a:b].sum()) + int(n > 0 and gone[0] and not starts_span[a])
        out.append((b - a, n, spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if keep_text else None))
    rows = table.take(pa.array(texts.rows))
    found = _table(out, [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])
    return pa.Table.from_arrays([rows.column("id"), rows.column("rest"), *found.columns], names=["id", "rest", *found.column_names])


KEYS_SENT = [("bucket", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("twice", pa.binary()), ("heavy", pa.binary())]
#: from -1 down: which keys are shared, and hot; from 0 up: which suffixes of runs are later copies
ANSWERS = [("chunk", pa.int32()), ("bucket", pa.int32()), ("flags", pa.binary()), ("hot", pa.binary())]
RUNS_SENT = [("bucket", pa.int32()), ("chunk", pa.int32()), ("strings", pa.binary()), ("counts", pa.binary()), ("least", pa.binary())]


def _table(rows: list[tuple], schema: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


def _ddl(schema: list[tuple]) -> str:
    return ", ".join(f"{n} {'binary' if t == pa.binary() else 'int'}" for n, t in schema)


def _alone(f: Callable, **options: object) -> Callable:
    run = partial(f, **options)
    return lambda key, table: run(key, table)


def _both(f: Callable, **options: object) -> Callable:
    run = partial(f, **options)
    return lambda key, left, right: run(key, left, right)


def remove_repeats(docs: DataFrame, min_bytes: int = 50, keep_text: bool = True, chunk_bytes: int = 4 << 20, spread: int = 1024, most_bytes: int = 32 << 20) -> DataFrame:
    """All rows and columns of docs, plus n_bytes, n_removed, n_spans, kept_sha256; these replace columns of the same names.

    Texts are judged as UTF-8 bytes; min_bytes must be 24 or more. text becomes the remaining text (bytes of a character
    that was cut in part are left out; kept_sha256 is of all remaining bytes), or goes unless keep_text. Null text
    counts as empty; a text of any length is one chunk's. Rows that share a doc_id aren't earlier than one another; rows with null doc_id come after all others.
    No rows: no result rows.
    """
    seed = 3 * min_bytes // 5
    text = text_of(docs)
    names = without(docs, "text", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    rows = docs.select(docs["doc_id"].cast("long").alias("id"), F.encode(text, "UTF-8").alias("data"), F.struct(*[docs[c] for c in names]).alias("rest"))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunks = slices(total, chunk_bytes)
    key_buckets, run_buckets = max(chunks // 8, 12), max(2 * chunks, 12)
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "data"), F.lit(chunks)).cast("int"))
    rows = rows.repartition(slices(chunks, 4), "chunk").groupBy("chunk")  # tasks of four chunks, however many there are
    told = (
        rows.applyInArrow(_alone(send_keys, min_bytes=min_bytes, seed=seed, buckets=key_buckets), _ddl(KEYS_SENT))
        .groupBy("bucket")
        .applyInArrow(_alone(answer_keys, spread=spread, most_bytes=most_bytes), _ddl(ANSWERS))
    )
    found = (
        rows.cogroup(told.groupBy("chunk"))
        .applyInArrow(_both(send_runs, min_bytes=min_bytes, seed=seed, key_buckets=key_buckets, buckets=run_buckets), _ddl(RUNS_SENT))
        .groupBy("bucket")
        .applyInArrow(_alone(answer_runs, min_bytes=min_bytes), _ddl(ANSWERS))
    )
    schema = T.StructType(
        [T.StructField("id", T.LongType()), T.StructField("rest", T.StructType([docs.schema[c] for c in names]))]
        + [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
        + [T.StructField(n, T.StringType()) for n in ("kept_sha256", "kept")]
    )
    out = rows.cogroup(told.union(found).groupBy("chunk")).applyInArrow(_both(cover, min_bytes=min_bytes, seed=seed, key_buckets=key_buckets, buckets=run_buckets, keep_text=keep_text), schema)
    return out.select("rest.*", *([F.col("kept").alias("text")] if keep_text else []), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame, **parameters: int) -> DataFrame:
    """The rows of docs, with their columns; text is what remove_repeats keeps of it."""
    clash = {c for c in docs.columns if c.lower() in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
    found = remove_repeats(docs.withColumnsRenamed({c: f"_own_{c}" for c in clash}), **parameters)
    return found.select(*[F.col(f"_own_{c}").alias(c) if c in clash else F.col(c) for c in docs.columns])
