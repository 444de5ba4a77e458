"""Token counts under a unigram vocabulary by trie-shared dynamic programming.

The distinct pre-tokens of a batch of documents, sorted, are a trie: those with a common prefix lie side by side, and the
best segmentation score of a prefix is computed once, for the first of them, level by level for all prefixes of one length
at a time. A node carries the starts from which a piece may still grow, as states of the trie of pieces; where a pre-token
ends its node's token count is stored. Counts of frequent pre-tokens stay with the worker in a table of bounded size.
Documents never move.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfind.llm.shared import text_of

SPACE = "▁"
KEPT = 400_000
LONG = 64
SLICE = 4096  # documents whose pre-tokens form one trie


@cache
def unigrams(vocabulary: str) -> tuple[dict[str, float], int, float]:
    """Pieces with their log probabilities, the longest piece's length, and what a byte of an unknown character costs.

    The public vocabulary file has ranks, not counts, and no tokenizer is trained here, so probabilities follow Zipf's law
    of the rank. Pieces for control and single bytes are left out: a character that no piece has costs its UTF-8 bytes, each
    as the rarest piece.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    names = [model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]
    total = math.log(sum(1 / (k + 1) for k in range(len(names))))
    scores = {name: -math.log(k + 1) - total for k, name in enumerate(names)}
    return scores, max(map(len, names)), -math.log(len(names) + 1) - total


def codes_of(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)


class Pieces:
    """The pieces' trie as sorted edges (node, character) with the node each leads to, and each node's score, -inf where no piece ends."""

    def __init__(self, scores: dict[str, float]) -> None:
        names = sorted(scores)
        letters = np.unique(codes_of(names))
        self.letters = letters
        self.width = len(letters) + 1  # the last number is for characters that no piece has
        nodes: dict[str, int] = {"": 0}
        edges = {}
        for name in names:
            for k in range(1, len(name) + 1):
                if name[:k] not in nodes:
                    nodes[name[:k]] = len(nodes)
                    edges[nodes[name[: k - 1]], ord(name[k - 1])] = nodes[name[:k]]
        at = np.array(list(edges), dtype=np.int64)
        keys = at[:, 0] * self.width + np.searchsorted(letters, at[:, 1])
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.array(list(edges.values()), dtype=np.int64)[order]
        self.score = np.full(len(nodes), -np.inf)
        self.score[[nodes[n] for n in names]] = [scores[n] for n in names]

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        return np.where(self.letters[at] == codes, at, self.width - 1)

    def step(self, states: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The node each state's letter leads to, -1 if none."""
        keys = states * self.width + letters
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.to[at], -1)


@cache
def pieces_of(vocabulary: str) -> Pieces:
    return Pieces(unigrams(vocabulary)[0])


def count_alone(word: str, scores: dict[str, float], longest: int, byte: float) -> int:
    """Tokens of the best segmentation of one word, by itself; fewest tokens break ties."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for k in range(1, len(word) + 1):
        n = len(word[k - 1].encode("utf-8", "surrogatepass"))
        score, tokens = best[-1]
        top = (score + n * byte, tokens - n)
        for j in range(max(0, k - longest), k):
            if (gain := scores.get(word[j:k])) is not None:
                score, tokens = best[j - k]
                top = max(top, (score + gain, tokens - 1))
        best.append(top)
        if len(best) > longest + 1:
            del best[0]
    return -best[-1][1]


def count_shared(words: list[str], pieces: Pieces, byte: float) -> np.ndarray:
    """Tokens of the best segmentation of each of the distinct words, which are sorted; each prefix is scored once."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    found = np.zeros(len(words), dtype=np.int64)
    codes = codes_of(words)
    letters, start = pieces.numbers(codes), np.cumsum(size) - size
    cost = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
    node_of = np.zeros(len(words), dtype=np.int64)  # of each word's prefix of the last length
    score, tokens = np.zeros(1), np.zeros(1, dtype=np.int64)  # of the nodes of the last length
    open_of, open_state, open_score, open_tokens = (np.zeros(0, dtype=t) for t in (np.int64, np.int64, float, np.int64))  # starts that may still grow, by node
    for depth in range(1, int(size.max(initial=0)) + 1):
        live = np.flatnonzero(size >= depth)
        at = start[live] + depth - 1
        parent, letter = node_of[live], letters[at]
        code = codes[at]
        new = np.r_[True, (parent[1:] != parent[:-1]) | (code[1:] != code[:-1])]
        node_of[live] = np.cumsum(new) - 1
        parent, letter, bytes_ = parent[new], letter[new], cost[at[new]]
        n = len(parent)
        first = np.searchsorted(open_of, np.arange(len(score)))
        many = np.searchsorted(open_of, np.arange(len(score)), side="right") - first
        take = many[parent]
        rows = np.repeat(first[parent] - (np.cumsum(take) - take), take) + np.arange(take.sum())
        of = np.concatenate([np.repeat(np.arange(n), take), np.arange(n)])
        state = pieces.step(np.concatenate([open_state[rows], np.zeros(n, dtype=np.int64)]), letter[of])
        kept = np.flatnonzero(state >= 0)
        before, used = np.concatenate([open_score[rows], score[parent]])[kept], np.concatenate([open_tokens[rows], tokens[parent]])[kept]
        of, state = of[kept], state[kept]
        order = np.argsort(of, kind="stable")
        open_of, open_state, open_score, open_tokens = of[order], state[order], before[order], used[order]
        reached = open_score + pieces.score[open_state]
        alone, alone_tokens = score[parent] + bytes_ * byte, tokens[parent] + bytes_
        top = alone.copy()
        np.maximum.at(top, open_of, reached)
        least = np.where(alone == top, alone_tokens, np.iinfo(np.int64).max)
        best = reached == top[open_of]
        np.minimum.at(least, open_of[best], open_tokens[best] + 1)
        score, tokens = top, least
        ends = live[size[live] == depth]
        found[ends] = tokens[node_of[ends]]
    return found


@cache
def _kept(vocabulary: str) -> dict[str, int]:
    return {}


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of every row.

    Pre-tokens are the text's runs of characters other than white space (as str.split has it), each after a word mark.
    Null and empty texts have none. Null doc_ids and repeated rows are counted like others. Other columns are ignored.
    Texts are counted whole; a pre-token of LONG characters or more, which shares little, is segmented by itself. No rows: no
    result rows.
    """
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, longest, byte = unigrams(vocabulary)
        pieces, known = pieces_of(vocabulary), _kept(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = batch.slice(at, SLICE)
                texts = [x.as_py().split() for x in rows.column(1)]
                seen = Counter(w for words in texts for w in words)
                counts = {w: known[w] for w in seen if w in known}
                fresh = sorted(w for w in seen if w not in counts)
                short = [w for w in fresh if len(w) < LONG]
                counts.update(zip(short, count_shared([SPACE + w for w in short], pieces, byte).tolist(), strict=True))
                counts.update((w, count_alone(SPACE + w, scores, longest, byte)) for w in fresh if len(w) >= LONG)
                if len(known) > KEPT:
                    known.clear()
                known.update((w, counts[w]) for w in short if seen[w] > 1 or len(w) < 12)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([sum(map(counts.__getitem__, t)) for t in texts], pa.int64())], names=schema.names)

    return docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(run, schema)
