"""Spelling variants by finite-state composition.

Pairs of words one edit apart are what the vocabulary's acceptor, a one-edit transducer and the acceptor again accept when
composed. Before its edit a path of the composition has one state of the acceptor for both words, after it two, and the rest
of the two words is what both states accept; so pairs are enumerated state by state of the minimised acceptor, once for all
words that reach it.

Partitions hold the paths from one initial state: those after two letters that both words begin with, and, for edits within
these, those of the reversed words before the two letters both end with. A partition of more than `most` words is split by
the place of the edit: words that agree before and after a shrinking interval, down to one letter, where the alphabet bounds it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.llm.shared import drop, join_spread, slices, text_of, written

RUN = "[a-zÀ-ÿ]+"
EDGE = 2  # letters at either end that level 0 holds fixed
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Acceptor:
    """The minimal acyclic acceptor of sorted distinct words: per state its arcs by letter and whether a word ends there."""

    def __init__(self, words: list[str]) -> None:
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        known: dict[tuple, int] = {}
        path: list[tuple[list[bool], dict[str, int]]] = [([False], {})]  # the states of the last word, still open

        def freeze(upto: int) -> None:
            while len(path) > upto + 1:
                final, arcs = path.pop()
                key = (final[0], *arcs.items())
                if (state := known.get(key)) is None:
                    state = known[key] = len(self.arcs)
                    self.arcs.append(arcs)
                    self.final.append(final[0])
                path[-1][1][last[len(path) - 1]] = state

        last = ""
        for word in words:
            same = 0
            while same < len(last) and same < len(word) and last[same] == word[same]:
                same += 1
            freeze(same)
            path.extend(([False], {}) for _ in range(len(word) - same))
            path[-1][0][0] = True
            last = word
        freeze(0)
        self.arcs.append(path[0][1])
        self.final.append(path[0][0][0])
        self.start = len(self.arcs) - 1


def common(acceptor: Acceptor, x: int, y: int, not_first: str = "", longest: int | None = None) -> list[str]:
    """What both states accept, but for strings that begin with not_first or are longer than longest."""
    arcs, final = acceptor.arcs, acceptor.final
    out = [""] if final[x] and final[y] else []
    if longest == 0:
        return out
    path: list[str] = []
    stack = [(arcs[x][c], arcs[y][c], 0, c) for c in arcs[x] if c in arcs[y] and c != not_first]
    while stack:
        x, y, depth, c = stack.pop()
        path[depth:] = [c]
        if final[x] and final[y]:
            out.append("".join(path))
        if longest is None or depth + 1 < longest:
            below, other = arcs[x], arcs[y]
            stack += [(below[c], other[c], depth + 1, c) for c in below if c in other]
    return out


def edits_at(acceptor: Acceptor, state: int, longest: int | None) -> list[tuple[str, str]]:
    """What may follow, in either word, when the edit comes at the state: a letter for another, or a letter the other lacks.

    Of the places where a letter of a run may be put in, it is the last, so a pair comes from one state alone.
    """
    arcs = acceptor.arcs[state]
    out = []
    letters = list(arcs)
    for k, b in enumerate(letters):
        for a in letters[:k]:
            out += [(a + s, b + s) for s in common(acceptor, arcs[a], arcs[b], longest=longest)]
        out += [(s, b + s) for s in common(acceptor, state, arcs[b], not_first=b, longest=longest)]
    return out


def near_pairs(words: list[str], longest: int | None = None) -> Iterator[tuple[str, str]]:
    """All pairs of the sorted distinct words that one edit parts, each once; with longest, those with at most so much after the edit."""
    acceptor = Acceptor(words)
    at: dict[int, list[tuple[str, str]]] = {}
    path: list[str] = []
    stack = [(acceptor.start, 0, "")]
    while stack:
        state, depth, letter = stack.pop()
        path[max(depth - 1, 0) :] = [letter]
        if (found := at.get(state)) is None:
            found = at[state] = edits_at(acceptor, state, longest)
        if found:
            head = "".join(path)
            for u, v in found:
                yield head + u, head + v
        stack += [(to, depth + 1, c) for c, to in acceptor.arcs[state].items()]


def shared_prefix(u: str, v: str) -> int:
    n = 0
    while n < len(u) and n < len(v) and u[n] == v[n]:
        n += 1
    return n


def partition_pairs(words: list[str], base: int, low: int, high: int) -> Iterator[tuple[str, str]]:
    """Pairs of a partition's words whose edit, as far to the right as it can be put, is at low or after and before high (-1: no bound).

    base is the length of the shorter word (0: any). The words agree before low; with base also after high, else in their last letters.
    """
    if base:
        tail = max(0, base - high)
        middles = {w[low : len(w) - tail]: w for w in words}
        found = ((middles[u], middles[v]) for u, v in near_pairs(sorted(middles)))
    elif high < 0:
        head = words[0][:low]
        found = ((head + u, head + v) for u, v in near_pairs([w[low:] for w in words]))
    else:
        tail = words[0][-EDGE:]
        found = ((u[::-1] + tail, v[::-1] + tail) for u, v in near_pairs(sorted(w[-EDGE - 1 :: -1] for w in words), longest=high - 1))
    for u, v in found:
        if low <= shared_prefix(u, v) and (high < 0 or shared_prefix(u, v) < high) and base in (0, min(len(u), len(v))):
            yield u, v


def noised_words(docs: DataFrame, noise: int = 97, least_length: int = 5) -> DataFrame:
    """word, n: runs of letters, A-Z lower-cased, of at least least_length after every noise-th run (by the checksum of doc_id and run) has lost one letter."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.translate(text_of(docs), UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.filter(F.length("run") >= least_length)
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = F.pmod("h", F.length("run")).cast("int")
    word = F.when(F.pmod("h", F.lit(noise)) == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).filter(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _key() -> Column:
    word, base, low, high = F.col("word"), F.col("base"), F.col("low"), F.col("high")
    tail = F.when(base > 0, F.greatest(F.lit(0), base - high)).when(high >= 0, F.lit(EDGE)).otherwise(0)
    return F.concat_ws(":", base, low, high, F.substring(word, F.lit(1), low), F.substring(word, F.length(word) - tail + 1, tail))


def _split(rows: DataFrame, least_length: int) -> DataFrame:
    """Each row for both halves of its interval; rows without a length of the shorter word for either length it can have."""
    size = F.length("word")
    bases = F.when(F.col("base") > 0, F.array("base")).when(size > least_length, F.array(size, size - 1)).otherwise(F.array(size))
    rows = rows.withColumn("base", F.explode(bases)).withColumn("high", F.when(F.col("high") < 0, F.col("base") + 1).otherwise(F.col("high")))
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    rows = rows.withColumn("part", F.explode(F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high").alias("high")))))
    return rows.select("word", "n", "base", F.col("part.low").alias("low"), F.col("part.high").alias("high")).filter("low < high").withColumn("key", _key())


def near_words(words: DataFrame, least_length: int = 5, most: int = 40_000) -> DataFrame:
    """u, n_u, v, n_v: each pair of the words (word, n: distinct, of at least least_length >= 5) that differ by one inserted, deleted or replaced letter, once."""
    side = lambda low, high: words.select("word", "n", F.lit(0).alias("base"), F.lit(low).alias("low"), F.lit(high).alias("high"))
    rows = side(EDGE, -1).unionByName(side(0, EDGE)).withColumn("key", _key())
    found = []
    while True:
        large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") > most) & ~((F.col("key").substr(1, 2) != "0:") & (F.split_part("key", F.lit(":"), F.lit(3)).cast("int") - F.split_part("key", F.lit(":"), F.lit(2)).cast("int") == 1)))
        large = written(large.select("key"), "large-partitions")
        if not large.head(1):
            found.append(rows)
            break
        found.append(rows.join(large, "key", "left_anti"))
        rows = written(_split(rows.join(large, "key", "left_semi").drop("key"), least_length), "split-partitions")
    for part in found[1:]:
        found[0] = found[0].unionByName(part)
    rows = found[0]
    n = slices(words.count(), most)
    dealt = rows.select("key", "base", "low", "high", "word", "n").repartition(n, "key").sortWithinPartitions("key", "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 4
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["u", "n_u", "v", "n_v"])
            out.clear()
            return batch

        for (_, base, low, high), group in groupby(cells, key=lambda r: r[:4]):
            counts = {r[4]: r[5] for r in group}
            for u, v in partition_pairs(list(counts), base, low, high):
                out.append((u, counts[u], v, counts[v]))
                if len(out) >= 20_000:
                    yield flush()
        yield flush()

    return dealt.mapInArrow(run, "u string, n_u long, v string, n_v long")


def follow(forms: DataFrame) -> DataFrame:
    """word, root for each of word, form (null: its own root), following forms to the last by pointer doubling. Forms have no cycles."""
    ways = written(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        ahead = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = join_spread(ways.filter("word <> root"), ahead, "root", F.col("word"))
        moved = written(moved.select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
        again = moved.agg(F.bool_or("moved")).first()[0]
        ways, last = written(ways.filter("word = root").unionByName(moved.select("word", "root")), "roots"), ways
        drop(last, moved)
        if not again:
            return ways


def spelling_variants(docs: DataFrame, noise: int = 97, least_length: int = 5, least_count: int = 3, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word with least_count occurrences in all documents.

    Words are runs of [A-Za-z] and U+00C0 to U+00FF with A-Z lower-cased; where noise divides the CRC-32 of `<doc_id>:<run>`, h,
    the run's letter h % length is left out. A word's form is its most frequent near word (ties: least in code points) if
    that is at least ratio times as frequent; root follows forms to the last. Null texts have no words, null doc_ids count
    as empty. Repeated rows count each; other columns are ignored; texts and words of any length are whole. No rows: no words.
    """
    words = written(noised_words(docs, noise, least_length).filter(F.col("n") >= least_count), "words")
    pairs = written(near_words(words, least_length), "near-words")
    both = pairs.select(F.col("u").alias("word"), F.col("v").alias("other"), F.col("n_v").alias("m")).unionByName(pairs.select(F.col("v").alias("word"), F.col("u").alias("other"), F.col("n_u").alias("m")))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("top"))
    forms = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("top.m") >= ratio * F.col("n"), F.struct(F.col("top.other").alias("form"), (-F.col("top.m")).alias("m"))).alias("to"))
    forms = written(forms.select("word", "n", "n_near", F.col("to.form").alias("form"), F.col("to.m").alias("form_n")), "forms")
    return forms.join(follow(forms), "word").select("word", "form", "root", "n", "n_near", "form_n")
