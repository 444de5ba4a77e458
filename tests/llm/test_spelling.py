"""Spelling variants against brute force, split partitions included."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from wayfind.llm import spelling

SF = "/root/testdata/sf0.001"


def one_edit(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    return len(u) + 1 == len(v) and any(v[:k] + v[k + 1 :] == u for k in range(len(v)))


def all_near(words):
    by_size = defaultdict(list)
    for w in words:
        by_size[len(w)].append(w)
    return {tuple(sorted((u, v))) for n, own in by_size.items() for u in own for v in own + by_size.get(n + 1, []) if u != v and one_edit(u, v)}


def plain(rows, noise=97, least=3, ratio=2):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= least}
    near = defaultdict(list)
    for u, v in all_near(words):
        near[u].append(v)
        near[v].append(u)
    form = {}
    for w, n in words.items():
        top = min(near[w], key=lambda o: (-words[o], o), default=None)
        form[w] = top if top is not None and words[top] >= ratio * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def test_words_of_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert found(spelling.spelling_variants(docs)) == plain(rows)
    assert found(spelling.spelling_variants(docs, noise=3)) == plain(rows, noise=3)  # so that noised words are many


def test_odd_texts(spark):
    long = "ab" * 5000
    rows = [(1, None), (2, ""), (3, "Häuser häuser HÄUSER Ähre x" * 3), (4, "hauser " * 9), (4, "hauser " * 9), (None, "hausers hausers hausers"), (5, f"{long} {long} {long} {long}c {long}c {long}c"), (6, "a×b÷c " * 4), (7, "ābcdef " * 5)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int")
    got = found(spelling.spelling_variants(docs))
    assert got == plain(rows) and long in got and "a×b÷c" in got
    assert found(spelling.spelling_variants(docs.filter("doc_id < 0"))) == {}


@pytest.mark.parametrize("most", [40_000, 50, 3])
def test_partitions_are_split_without_losing_pairs(spark, most):
    rng = random.Random(most)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(5, 9))) for _ in range(1500)} | {"a" * n for n in range(5, 40)} | {"abcde" + "xyz" * n for n in range(12)}
    got = [tuple(sorted((r.u, r.v))) for r in spelling.near_words(spark.createDataFrame([(w, len(w)) for w in words], "word string, n long"), most=most).collect()]
    assert len(set(got)) == len(got) and set(got) == all_near(words)


def test_minimised_acceptor():
    words = sorted({a + b + c for a in ("", "un", "re") for b in ("do", "make", "bind") for c in ("", "s", "ing")})
    machine = spelling.Acceptor(words)

    def accepted(state):
        return ([""] if machine.final[state] else []) + [c + rest for c, to in machine.arcs[state].items() for rest in accepted(to)]

    assert sorted(accepted(machine.start)) == words
    languages = [tuple(sorted(accepted(s))) for s in range(len(machine.arcs))]
    assert len(set(languages)) == len(languages)  # no two states accept the same, so it is minimal


def test_roots_follow_forms_to_the_last(spark):
    chain = [(f"w{k}", f"w{k + 1}" if k < 20 else None) for k in range(21)] + [(f"x{k}", "w20") for k in range(50)]
    got = found(spelling.follow(spark.createDataFrame(chain, "word string, form string")))
    assert got == {w: ("w20",) for w, _ in chain}
    assert found(spelling.follow(spark.createDataFrame([("a", None)], "word string, form string"))) == {"a": ("a",)}
