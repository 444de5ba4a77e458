"""Alignment of two tokenizers against offsets compared one by one, with ids from the vocabularies' other forms."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfind.llm import alignment
from wayfind.llm.catalog import byte_bpe

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None), (2, ""), (3, " "), (4, "one"), (5, "  two  spaces \n\n x\ty "), (6, "a▁b"), (7, "<|endoftext|> <s> </s> <unk> <0x41>"), (8, "漢字 かな 한글 🙂🙂 é"), (9, "x" * 5000), (None, "null id it's"), (10, "word " * 3000), (10, "word " * 3000),
    (11, "\x00\x07 　end"), (12, "ﬁne ① ²"), (13, "​ ‍"),
]


@pytest.fixture(scope="module")
def models():
    import public_tokenizers as P

    return (*byte_bpe(), P.path("piece_bpe_32k.model"))


def plain(rows):
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a_model = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in letters} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in letters)}
    b_model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    docs = []
    for i, t in rows:
        groups, links, n_a, n_b = [], [], 0, 0
        if t:
            a, b = a_model.encode(" " + t, add_special_tokens=False).ids, b_model.encode(t)
            bytes_a = [bytes(table[c] for c in a_model.id_to_token(k)) for k in a]
            bytes_b = [bytes([int(p[3:5], 16)]) if b_model.is_byte(k) else p.replace("▁", " ").encode() for k, p in zip(b, map(b_model.id_to_piece, b), strict=True)]
            if b"".join(bytes_a) == b"".join(bytes_b) == b" " + t.encode():
                n_a, n_b = len(a), len(b)
                end_a, end_b = {}, {}
                for ends, ids, bs in ((end_a, a, bytes_a), (end_b, b, bytes_b)):
                    at = 0
                    for k, (x, own) in enumerate(zip(ids, bs, strict=True)):
                        at += len(own)
                        ends[at] = (k, x)
                i = j = 0
                for at in sorted(set(end_a) & set(end_b)):
                    groups.append(",".join(map(str, a[i : end_a[at][0] + 1])) + "|" + ",".join(map(str, b[j : end_b[at][0] + 1])))
                    links.append((end_a[at][1], end_b[at][1]))
                    i, j = end_a[at][0] + 1, end_b[at][0] + 1
        docs.append((n_a, n_b, links, groups))
    counts = Counter(x for _, _, links, _ in docs for x in links)
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    out = []
    for (i, _), (n_a, n_b, links, groups) in zip(rows, docs, strict=True):
        out.append((i, n_a, n_b, len(groups), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast_pairs", [500_000, 300, 0])
def test_odd_texts(spark, models, broadcast_pairs):
    docs = spark.createDataFrame([(*r, 1, "x") for r in ODD], "doc_id long, text string, row int, pair string")
    got = alignment.score_links(docs, *models, broadcast_pairs=broadcast_pairs)
    assert sorted(map(tuple, got.collect()), key=str) == plain(ODD)
    assert alignment.score_links(docs.filter("doc_id < 0"), *models).collect() == []


def test_whole_table(spark, models):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, alignment.score_links(docs, *models, broadcast_pairs=2000).collect()), key=str) == plain(rows)


def test_groups_and_pairs_are_given_whole(spark, models):
    docs = spark.createDataFrame([(1, "the cats' naïve café")], "doc_id long, text string")
    r = alignment.align_documents(docs, *models).first()
    assert hashlib.sha256(r.groups.encode()).hexdigest() == plain([(1, "the cats' naïve café")])[0][-1]
    assert sum(r.times) == r.n_links == r.groups.count(";") + 1 and all(p >> 32 < 50257 and p & 0xFFFFFFFF < 32000 for p in r.pairs)
    assert alignment.link_counts(alignment.align_documents(docs, *models)).agg(F.sum("n")).first()[0] == r.n_links


def test_windows_are_bounded_and_alike_without_memory(models, monkeypatch):
    monkeypatch.setattr(alignment, "KEPT_WINDOWS", 5)
    ranks, pattern, model = models
    windows = alignment.Windows(alignment.ByteTokens(ranks, pattern), alignment.PieceTokens(model))
    texts = ["some words repeat and some words do not repeat in rows " * 20, "x" * 3000 + " rows of words", "", "other words"]
    for _ in range(3):
        for text in texts:
            (found,) = windows.documents([text])
            if text:
                a, b = (np.frombuffer(t.ids([text])[0], dtype="<u4") for t in (windows.a, windows.b))
                ((shown, links),) = windows.align([(a | alignment.OF_A).tobytes() + b.tobytes()])  # the document as one window
                assert found[2] == shown[:-1] and found[3].tobytes() == links
            else:
                assert found is None
            assert all(len(w) <= 4 * alignment.LONG for w in windows.known)
    assert len(windows.known) <= 5 + 20
