"""Statistics of whole texts. Words are runs of bytes other than space, tab, newline, vertical tab, form feed and return."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfind.llm.shared import text_of

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FOR_RULES = ("n_marks", "n_short")
MORE = ("n_chars_all", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct", "n_short", "n_shout")
BLANKS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
MARKS = b"!?.,;:"


def repeated_words(ids: np.ndarray, n_ids: int) -> int:
    """Words that lie in a 3-word window found twice or more; ids number the text's words."""
    if len(ids) < 4:
        return 0
    pair = ids[:-1] * n_ids + ids[1:]
    if n_ids >= 1 << 20:
        _, pair = np.unique(pair, return_inverse=True)
    grams = pair[:-1] * n_ids + ids[2:]
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(len(grams), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(ids), dtype=bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def base_of(data: bytes) -> tuple[int, int, int, int, int, list[bytes], int]:
    """The five base statistics, then the words and how many are distinct."""
    words = data.split()
    numbers: dict[bytes, int] = {}
    ids = np.fromiter([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64, count=len(words))
    solid = data.translate(None, BLANKS)
    chars = len(solid.decode("utf-8", "replace")) if not solid.isascii() else len(solid)
    lines = [x for x in data.split(b"\n") if x.strip(BLANKS)]
    return len(words), chars, len(solid) - len(solid.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(ids, len(numbers)), words, len(numbers)


def more_of(data: bytes, words: list[bytes], distinct: int) -> tuple[int, ...]:
    count = lambda these: len(data) - len(data.translate(None, these))
    return (len(data), data.count(b"\n") + 1, count(UPPER), count(DIGITS), count(MARKS), distinct, sum(len(w) < 4 for w in words), sum(w.isupper() for w in words))


def rule_numbers(data: bytes, names: tuple[str, ...] = FOR_RULES) -> tuple[int, ...]:
    """The base statistics and those of the names (all FOR_RULES, or all MORE, or none)."""
    *base, words, distinct = base_of(data)
    if names == FOR_RULES:
        return (*base, len(data) - len(data.translate(None, MARKS)), sum(len(w) < 4 for w in words))
    return (*base, *(more_of(data, words, distinct) if names else ()))


def with_stats(docs: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the base statistics and more (FOR_RULES or MORE) of every row; null text counts as empty. Other columns are left out."""
    names = BASE + more
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for cell in batch.column(1):  # one text at a time
                rows.append(rule_numbers(cell.as_py(), more))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns]], names=["doc_id", *names])

    return docs.select("doc_id", F.encode(text_of(docs), "UTF-8").alias("data")).mapInArrow(run, schema)
