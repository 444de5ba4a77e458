"""Each operator against a brute-force version, and its defined results for nulls, empty texts, repeated rows and clashing columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wayfind.llm import chat, decontaminate, packing, quality_model, quality_rules, repeats, shards, shingles, simhash, stats, token_counts, urls
from wayfind.llm.catalog import byte_bpe
from wayfind.llm.components import connected

SF = "/root/testdata/sf0.001"
WORDS = "the of stone river light and moon wind a to paper glass iron cloud small lamp".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(("", "", ".", ",")) for _ in range(n))


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls, empties, copies, near copies, repeated rows, a long text, and columns whose names operators use inside."""
    rng = random.Random(3)
    base = text(rng, 120)
    rows = [(n, text(rng, rng.randrange(3, 200))) for n in range(40)]
    rows += [(100, base), (101, base), (102, base + " once more"), (103, base.replace("stone", "brick", 1)), (104, None), (105, ""), (106, "   \n "), (106, "   \n "), (107, "one two"), (None, base), (108, text(rng, 6000)), (109, "é" * 70 + base), (110, "漢字 " * 40), (111, "\n".join([base[:60]] * 4))]
    schema = "doc_id long, text string, chunk int, fp string, n_removed string, rank int, id string, host string"
    return spark.createDataFrame([(*r, 1, "f", "x", 2, "i", "h") for r in rows], schema).cache()


@pytest.fixture(scope="module")
def empty(odd_docs):
    return odd_docs.filter("doc_id < -1")


def docs_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# 1


def plain_repeats(rows, size):
    last = float("inf")
    first, out = {}, []
    rank = lambda i: last if i is None else i
    rows = sorted(rows, key=lambda r: rank(r[0]))
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - size + 1):
            w = b[k : k + size]
            first[w] = min(first.get(w, last), rank(i))
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - size + 1):
            if first[b[k : k + size]] < rank(i):
                gone[k : k + size] = True
        spans = int((gone & ~np.r_[False, gone[:-1]][: len(gone)]).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, dtype=np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("chunk", "spread"), [(4 << 20, 1024), (3000, 1024), (3000, 1)])
def test_repeats(spark, odd_docs, chunk, spread):
    docs = odd_docs.unionByName(spark.read.parquet(f"{SF}/documents.parquet").limit(60).select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"), allowMissingColumns=True)
    found = repeats.remove_repeats(docs, 50, chunk_bytes=chunk, spread=spread)
    got = sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect()], key=str)
    assert got == plain_repeats(docs_of(docs), 50)


def test_repeats_keep_rows_and_columns(odd_docs, empty):
    out = repeats.without_repeats(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    kept = {r.doc_id: r.text for r in out.collect()}
    assert kept[101] == "" and kept[100] != "" and out.first().n_removed == "x"
    assert repeats.remove_repeats(empty).count() == 0


def test_reach_of_smaller_in_any_order_of_documents():
    rng = np.random.default_rng(5)

    def plain(of, common):
        out = []
        for i in range(len(of)):
            low = next((int(common[j + 1 : i + 1].min()) for j in range(i - 1, -1, -1) if of[j] < of[i]), 0)
            out.append(low)
        return out

    for n in (1, 2, 7, 64, 150):
        for most in (50, 1000):
            common = rng.integers(0, most + 1, n)
            common[0] = 0
            orders = [rng.integers(0, 9, n), np.arange(n), np.arange(n)[::-1], np.r_[np.arange(n // 2) + 1, np.zeros(n - n // 2, dtype=int)]]
            for of in orders:
                for rounds in (0, 1, 16):
                    assert repeats.reach_of_smaller(of, common, rounds).tolist() == plain(of, common)
    n = 300_000  # ascending, then the first again: each place of it looks past all others
    common = np.full(2 * n, 50)
    common[0] = 0
    began = time.time()
    repeats.reach_of_smaller(np.r_[np.arange(n) + 1, np.zeros(n, dtype=int)], common)
    assert time.time() - began < 5


def test_later_copies_by_ranges():
    """Range by range of the suffix order as in one sort, in a part of its memory."""
    import tracemalloc

    rng = np.random.default_rng(17)
    text = rng.integers(97, 99, 300_000, dtype=np.uint8)
    text[100_000:130_000] = text[5_000:35_000]
    text[200_000:260_000] = 32
    data = np.r_[text, np.zeros(64, dtype=np.uint8)]
    suffixes, documents = np.arange(len(text)), np.arange(len(text)) // 1000 * 7 % 300
    whole = repeats.longest_previous(data, suffixes, documents, 50) >= 50
    assert whole.sum() > 50_000
    for room in (100, 5000, 10**7):
        assert (repeats.later_copies(data, suffixes, documents, 50, room) == whole).all()
    peaks = []
    spread = np.delete(suffixes, np.arange(200_000, 260_000))
    for f in (repeats.longest_previous, lambda *a: repeats.later_copies(*a, room=10_000)):
        tracemalloc.start()
        f(data, spread, documents[spread], 50)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 0.5 * peaks[0]
    assert repeats.later_copies(data, suffixes[:0], documents[:0], 50).size == 0


# 2


def plain_stats(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    n = Counter(grams)
    hit = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_rule_statistics(odd_docs):
    got = sorted([tuple(r) for r in stats.with_stats(odd_docs).collect()], key=str)
    assert got == sorted([(i, *plain_stats(t)) for i, t in docs_of(odd_docs)], key=str)


def test_rules(spark, odd_docs, empty):
    labels = spark.createDataFrame([(n, 1, 0) for n in range(40)], "doc_id long, quality int, toxic int")
    out = quality_rules.quality_rules(odd_docs, labels).collect()
    for r in out:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed) and 0 <= r.anomaly <= 1
    kept = quality_rules.keep_good(odd_docs, labels)
    assert kept.columns == odd_docs.columns and sorted(kept.select("doc_id").toPandas().doc_id.dropna()) == sorted(r.doc_id for r in out if r.kept and r.doc_id is not None)
    assert quality_rules.quality_rules(empty, labels).count() == 0
    none = quality_rules.quality_rules(odd_docs, labels.filter("quality = 9")).collect()
    assert all(r.kept != r.base_failed for r in none)


def test_forest_paths_isolate_outliers():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(500, 4)), np.full((1, 4), 9.0)])
    s = quality_rules.grow(x, 64, 128).score(x)
    assert s[-1] > np.sort(s[:-1])[-5]
    assert quality_rules.grow(x[:0], 4, 8).score(x).shape == (501,)


def test_rules_part_good_from_bad(spark):
    """On rows whose labels the threshold has not seen: nearly all good ones stay, most bad ones that pass the base rules go; a plain forest gives the scores."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    seen = F.crc32(F.col("doc_id").cast("string")) % 3 != 0
    scored, forest, threshold = quality_rules.fit_rules(docs, labels.filter(seen))
    held = scored.filter(~seen & ~F.col("base_failed")).join(labels, "doc_id").toPandas()
    good, bad = (held[held.quality == q].anomaly > threshold for q in (1, 0))
    assert len(good) > 900 and len(bad) > 60 and good.mean() < 0.02 and bad.mean() > 0.8
    kept = quality_rules.keep_good(docs, labels, min_words=1).join(labels.filter("quality = 1"), "doc_id", "left_semi").count()
    assert kept > 0.98 * labels.filter("quality = 1").count()
    rows = docs.join(labels, "doc_id").limit(40).collect()
    numbers = quality_rules._numbers([stats.rule_numbers((r.text or "").encode()) for r in rows])
    x = quality_rules.features(numbers, forest.typical)

    def path(row, node, level=0):
        return forest.depth[node] if forest.feature[node] < 0 else path(row, forest.left[node] + (row[forest.feature[node]] >= forest.cut[node]), level + 1)

    want = {r.doc_id: 2 ** (-np.mean([path(v, root) for root in forest.roots]) / forest.norm) for r, v in zip(rows, x, strict=True)}
    got = {r.doc_id: r.anomaly for r in scored.filter(F.col("doc_id").isin(list(want))).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_drawn_rows_are_bounded_and_repeated_rows_count_once(spark):
    rows = spark.range(50_000).select(F.xxhash64(F.col("id") % 30_000).alias("draw"), "id")
    found = quality_rules.drawn(rows, 500)
    every = sorted(r.draw for r in rows.select("draw").distinct().collect())
    assert [r.draw for r in found] == every[:500]


def test_threshold_parts_bad_from_good():
    good, bad = np.zeros(quality_rules.BINS + 1), np.zeros(quality_rules.BINS + 1)
    good[[100, 200, 300]] = 970, 28, 2
    bad[[150, 250, 400]] = 10, 80, 10
    best = lambda loss: quality_rules.best_threshold(good, bad, loss) * quality_rules.BINS
    assert 200 <= best(0.005) < 250 and 250 <= best(0.001) < 400 or best(0.001) >= 300
    assert quality_rules.best_threshold(good * 0, bad * 0, 0.01) == 2.0
    assert quality_rules.best_threshold(good, bad * 0, 0.005) == 200 / quality_rules.BINS


# 3


def test_shards(spark, odd_docs, empty):
    docs = odd_docs.unionByName(spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"), allowMissingColumns=True)
    rows = shards.shard_documents(docs, 4, slice_rows=7).collect()
    assert len(rows) == docs.count() and {r.law for r in rows} == {"bytes"}
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in docs_of(docs))
    by, groups = defaultdict(list), defaultdict(set)
    for r in rows:
        by[r.shard].append(r)
        groups[r.text_crc32, r.size].add(r.shard)
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in by.values())
    assert all(len(s) == 1 for s in groups.values())
    loads = [sum(r.size for r in own) for own in by.values()]
    assert max(loads) - min(loads) < 0.02 * sum(loads)
    assert shards.shard_documents(empty).count() == 0


def test_schedule_goes_to_the_least_loaded():
    rng = random.Random(5)
    items = [(f"i{n}", rng.randrange(1, 500)) for n in range(300)]
    load = [0] * 7
    for name, size in sorted(items, key=lambda x: (-x[1], x[0])):
        k = load.index(min(load))
        load[k] += size
    placed = shards.schedule(items, 7)
    got = [0] * 7
    for name, size in items:
        got[placed[name]] += size
    assert sorted(got) == sorted(load)


def test_bundles_when_groups_are_many(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 3000).alias("text"))
    rows = shards.shard_documents(docs, 3, fine=64).toPandas()
    assert rows.groupby("text_crc32").shard.nunique().max() == 1
    loads = rows.groupby("shard")["size"].sum()
    assert loads.max() - loads.min() < 0.02 * loads.sum()


def test_bundles_are_as_even_as_single_groups(spark):
    """Groups just under the share from which they are scheduled one by one: the loads against those of the plain schedule."""
    rng = random.Random(6)
    docs = spark.createDataFrame([(n, f"{n} " + "x" * rng.randrange(1, 400)) for n in range(6000)], "doc_id long, text string")
    loads = sorted(shards.shard_documents(docs, 4, fine=256).groupBy("shard").agg(F.sum("size").alias("s")).toPandas().s)
    plain = [0] * 4
    for _, size in sorted(((r.doc_id, len(r.text) + 8) for r in docs.collect()), key=lambda x: -x[1]):
        plain[plain.index(min(plain))] += size
    assert max(loads) - min(loads) < max(plain) - min(plain) + 0.002 * sum(plain)


def test_equal_sizes_and_repeated_rows_are_dealt(spark):
    docs = spark.createDataFrame([(n % 50, f"t{n % 10}") for n in range(1000)] + [(None, None)] * 5, "doc_id long, text string")
    rows = shards.shard_documents(docs, 3, slice_rows=50).toPandas()
    assert len(rows) == 1005 and rows.groupby("text_crc32").shard.nunique().max() == 1
    assert all(sorted(own) == list(range(len(own))) for _, own in rows.groupby("shard").slot)
    packed = packing.pack(docs, *byte_bpe(), room=16, slice_rows=50).toPandas()
    assert len(packed) == 1005 and not packed.duplicated(["sequence_id", "offset"]).any()


# 4


def test_urls(spark):
    cases = {
        "http://a.com/en/x": ("block", "com/en/"), "https://example.com/en/7": ("allow", "example.com/en/7"), "http://EXAMPLE.com/en/78?q": ("allow", "example.com/en/7"), "http://m.example.com/en/71": ("allow", "example.com/en/7"),
        "http://badexample.com/en/7": ("block", "com/en/"), "http://b.net/de/": ("allow", "net/de/"), "http://x.example.net/de/8#t": ("block", "example.net/de/8"), "http://q.org/es/1": ("block", "org/es/"), "http://q.org/ES/1": ("allow", None),
        "http://spam-farm.example.org/xx": ("block", None), "http://a.org/casino/": ("block", None), "http://a.org/casinos/": ("allow", None), "no scheme": ("allow", None), "": ("allow", None), None: ("allow", None), "x://com/en/": ("block", "com/en/"),
    }
    pages = spark.createDataFrame([(n, u, "h", "v") for n, u in enumerate(cases)], "page_id long, url string, host string, verdict string")
    table = spark.createDataFrame([(r.name, r.verdict, r.pattern, r.weight) for r in urls.RULES + urls.PATTERNS], "name string, verdict string, pattern string, weight int")
    for rules, block in ((urls.RULES + urls.PATTERNS, 20), (table, 20), (table, 100_000)):
        rows = urls.filter_urls(pages, rules, block_rules=block).collect()
        assert {r.url: (r.verdict, r.rule) for r in rows} == cases
    assert {r.host for r in rows if r.url == "http://EXAMPLE.com/en/78?q"} == {"example.com"}
    assert urls.filter_urls(pages.filter("page_id < 0")).count() == 0
    clash = urls.filter_urls(pages.select("page_id", "url", F.lit(3).alias("_weight")).union(pages.limit(1).select("page_id", "url", F.lit(4))))
    assert clash.columns == ["page_id", "url", "_weight", "host", "path", "rule", "verdict"] and clash.count() == len(cases) + 1
    long = spark.createDataFrame([(1, "http://a.com/" + "q/" * 100_000 + "casino/")], "page_id long, url string")
    assert urls.filter_urls(long).first().verdict == "block"


def test_rules_hang_on_their_rarest_token():
    rules = (urls.host_path_rule("block", "com", "/en/"), urls.host_path_rule("allow", "shop.com", "/x"))
    assert [t for t, _ in urls.rare_token(rules, {"com": 9, "en": 3, "shop": 1})] == ["en", "shop"]


@pytest.mark.parametrize(
    ("pattern", "tokens"),
    [(r"^ads\.", ("ads",)), (r"(?:^|[./])bet365/", ("bet365",)), (r"[-/](?:win)-(?:big)[-/]", ("win", "big")), (r"/a+b/c/", ("c",)), (r"/x(?:\.y)?/zz$", ("zz",)), (r"^(?:[^/]*\.)?q\.net/k", ("q", "net"))],
)
def test_literals_come_from_patterns(pattern, tokens):
    """Whatever matches holds them whole; patterns that have none are refused."""
    assert urls.literals(pattern) == tokens


@pytest.mark.parametrize("pattern", ["casino", r"\d+", r"/[a-z]+x/", r"(?:/a/|/b/)", "/ab*/", "(?i)/sale/", "/x/(?i:/sale/)", "(?:/y/(?:(?i:a))?)+/z/"])
def test_patterns_without_a_whole_literal_are_refused(pattern):
    with pytest.raises(ValueError, match="no token"):
        urls.Rule("", "block", pattern, 1).literals  # noqa: B018


# 5


def test_pieces_and_packing(spark, odd_docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    k = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", " x  y   z\n\n  q", "don't can't' we'll   x", "a,b.c ,, d..\t e \n f", "it's'' o'neil's. 's", "x\u00a0 y\u3000 z", "abc'!! def'. don'"]
    docs = odd_docs.unionByName(spark.createDataFrame(list(enumerate(texts, 500)), "doc_id long, text string"), allowMissingColumns=True)
    room = 256
    rows = packing.pack(docs, *byte_bpe(), room=room, slice_rows=10).collect()
    want = Counter()
    for i, t in docs_of(docs):
        ids = [*k.encode(t or "", add_special_tokens=False).ids, 0]
        cut = len(ids) % room
        starts = [0, *range(cut, len(ids), room)] if len(ids) > room and cut else list(range(0, len(ids), room))
        for n, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            want[i, n, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= room
    assert len(by) <= -(-sum(r.length for r in rows) // room) + 1
    assert packing.pack(empty, *byte_bpe()).count() == 0


def test_packed_rows_hold_their_tokens(odd_docs):
    rows = packing.pack(odd_docs, *byte_bpe(), room=256, slice_rows=10).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    of = defaultdict(list)
    for r in rows:
        if r.doc_id not in (None, 106):
            of[r.doc_id].append(r)
    encode = packing.encoder(*byte_bpe())
    for i, t in docs_of(odd_docs):
        if i in of:
            ids = np.frombuffer(b"".join(r.ids for r in sorted(of[i], key=lambda r: r.piece)), dtype="<u4")
            assert ids[-1] == 0 and encode.decode(ids[:-1].tolist()) == (t or "")


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(2)
    have = np.bincount(np.minimum(rng.lognormal(5.5, 1, 50_000).astype(int) + 1, 2048), minlength=2049)
    found = packing.plan(have, 2048)
    packed = np.zeros_like(have)
    for lengths, n in found:
        assert sum(lengths) <= 2048
        for v in lengths:
            packed[v] += n
    assert (packed == have).all()
    assert sum(n for _, n in found) <= 1.002 * -(-(have * np.arange(2049)).sum() // 2048)


def test_ids_of_every_character():
    """The fast path gives the ids of the JSON vocabulary for each code point, inside a word, after a blank and between blanks."""
    import public_tokenizers
    from tokenizers import Tokenizer

    k = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    table = packing.words(*byte_bpe())
    chars = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(chars), 8192):
        texts = [f"ab{c}cd {c}x {c} y.{c}" for c in chars[at : at + 8192]]
        for text, want in zip(texts, k.encode_batch(texts, add_special_tokens=False), strict=True):
            assert np.frombuffer(table.document(text), dtype="<u4").tolist() == want.ids, ascii(text)


def test_a_text_of_new_words_is_encoded_at_once():
    class Counted:
        calls = 0

        def __getattr__(self, name):
            Counted.calls += name.startswith("encode")
            return getattr(packing.encoder(*byte_bpe()), name)

    rng = random.Random(21)
    texts = ["".join(rng.choice(("ab", "é,", " ", "  ", "\n", "\t", "it's", packing.SPECIAL, "\x1c", "\u3000", "...")) for _ in range(40)) for _ in range(200)] + [" ".join(f"new{n}w." for n in range(500))]
    coder = Counted()
    table = packing.Words(coder)
    for text in texts:
        want = packing.encoder(*byte_bpe()).encode(text, allowed_special={packing.SPECIAL}, disallowed_special=())
        assert np.frombuffer(table.document(text), dtype="<u4").tolist() == want
    assert Counted.calls <= len(texts)


@pytest.mark.parametrize(("lengths", "slack"), [([100], 1.03), ([1], 1), ([256], 1), ([257], 1.16), (list(range(20, 300)), 1.005), ([16, 676, 680], 1.005)])
def test_plan_of_short_lengths_only(lengths, slack):
    have = np.bincount(lengths * 3000, minlength=2049)
    found = packing.plan(have, 2048)
    packed = np.zeros_like(have)
    for own, n in found:
        assert sum(own) <= 2048
        for v in own:
            packed[v] += n
    assert (packed == have).all()
    assert sum(n for _, n in found) <= slack * -(-(have * np.arange(2049)).sum() // 2048) + 1


# 6


def test_masks_hit_every_pattern_of_substitutions():
    from itertools import combinations

    for n in range(10, 21):
        for off in combinations(range(n), n // 5):
            assert any(not {s + k for k in mask} & set(off) for mask in decontaminate.MASKS for s in range(n - mask[-1]))


def test_leaks(spark, odd_docs, empty):
    rng = random.Random(8)
    words = [f"w{n}" for n in range(500)]
    items = [[rng.choice(words) for _ in range(n)] for n in (30, 13, 20, 7, 4, 12)]
    bench = spark.createDataFrame([*[(n, " ".join(x), 1) for n, x in enumerate(items)], (90, None, 1), (91, "", 1)], "item_id long, text string, doc_id int")
    rows = []
    for n in range(120):
        item = list(items[n % 6])
        for _ in range(rng.randrange(5)):
            item[rng.randrange(len(item))] = "zz"
        cut = item[: rng.randrange(3, len(item) + 1)]
        rows.append((n, " ".join([rng.choice(words) for _ in range(rng.randrange(20))] + [w.upper() + "," for w in cut] + [rng.choice(words) for _ in range(5)])))
    docs = spark.createDataFrame([*rows, (200, None), (201, "")], "doc_id long, text string")
    want = set()
    for i, t in rows:
        d = decontaminate.words_of(t.encode())
        for k, item in enumerate(items):
            size, off = decontaminate.allowed(len(item))
            for a in range(len(item) - size + 1):
                part = [w.encode() for w in item[a : a + size]]
                if any(sum(x != y for x, y in zip(d[b : b + size], part, strict=True)) <= off for b in range(len(d) - size + 1)):
                    want.add((i, k))
    got = decontaminate.find_leaks(docs, bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and 20 < len(want) < 120
    assert all(r.item_words == len(items[r.item_id]) and r.equal_words <= r.item_words for r in got.collect())
    named = decontaminate.find_leaks(docs, bench.withColumn("item_id", F.col("item_id").cast("int")))
    assert named.schema["item_id"].dataType.simpleString() == "int" and {(r.doc_id, r.item_id) for r in named.collect()} == want
    clean = decontaminate.without_leaks(odd_docs.unionByName(docs, allowMissingColumns=True), bench)
    assert clean.columns == odd_docs.columns and clean.count() == odd_docs.count() + docs.count() - len({i for i, _ in want})
    assert decontaminate.find_leaks(empty, bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.filter("item_id < 0")).count() == 0


def test_short_items_and_common_phrases(spark):
    """Items of one to four words stand whole; a phrase of a thousand items is no leak by itself; repeated and null ids are answered like others."""
    phrase = "which of the following best describes"
    bench = spark.createDataFrame([*[(n, f"{phrase} x{n} y{n} z{n} a{n} b{n} c{n} d{n} e{n}") for n in range(1000)], (2000, "only four words here"), (2001, "solo"), (2002, "  Solo! "), (2003, "!!")], "item_id int, text string")
    docs = spark.createDataFrame(
        [(1, f"say {phrase} nothing at all of that kind"), (2, f"{phrase} x7 y7 z7 a7 zz c7 d7 e7"), (3, "not only four words, but here"), (4, "ONLY four, words here."), (None, "a solo b"), (4, "only four words here"), (5, "soloist")],
        "doc_id long, text string",
    )
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect())
    assert got == Counter({(2, 7): 1, (4, 2000): 2, (None, 2001): 1, (None, 2002): 1})
    assert sorted(str(r.doc_id) for r in decontaminate.without_leaks(docs, bench).collect()) == ["1", "3", "5"]


def test_wide_masks_hit_every_pattern_of_substitutions():
    from itertools import combinations

    for n in range(10, 14):
        for off in combinations(range(n), n // 5):
            assert any(not set(mask) & set(off) for mask in decontaminate.wide_masks(n))
        for phrase in range(n - 3):  # a phrase that fills all but three places fills no mask
            assert not any(set(mask) <= set(range(phrase, phrase + n - 3)) for mask in decontaminate.wide_masks(n))


@pytest.mark.parametrize("n", [200, 1000])
def test_stock_phrases_cost_in_proportion(spark, monkeypatch, n):
    """Items and documents that share a phrase only are laid along each other nowhere; leaks among them are found all the same."""
    rng = random.Random(n)
    phrase = "which of the following is the best answer to".split()
    bench = [(k, " ".join([*(f"p{rng.randrange(10**6)}" for _ in range(k % 3)), *phrase, *(f"x{rng.randrange(10**6)}" for _ in range(4 + k % 9))])) for k in range(n)]
    docs = []
    for k in range(n):
        own = bench[k][1].split()
        if k % 50 == 0:  # leaks, with substitutions within what is allowed
            for at in rng.sample(range(len(own)), min(2, len(own) // 5)):
                own[at] = "zz"
        else:
            own = [f"y{rng.randrange(10**6)}" if w not in phrase else w for w in own]
        docs.append((k, " ".join([*(f"d{rng.randrange(10**6)}" for _ in range(5)), *own, "end"])))
    rows, kept = {}, decontaminate.written

    def counting(df, name):
        found = kept(df, name)
        rows[name] = found.count()
        return found

    monkeypatch.setattr(decontaminate, "written", counting)
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    want = set()
    for i, t in docs[:: max(1, n // 40)] + docs[::50]:
        d = t.split()
        for j, u in bench:
            b = u.split()
            size, off = decontaminate.allowed(len(b))
            if any(sum(x != y for x, y in zip(d[p : p + size], b[q : q + size], strict=True)) <= off for q in range(len(b) - size + 1) for p in range(len(d) - size + 1)):
                want.add((i, j))
    looked = {i for i, _ in docs[:: max(1, n // 40)] + docs[::50]}
    assert {x for x in got if x[0] in looked} == want and len(want) >= n // 50
    assert {x for x in got if x[0] not in looked} == set()
    assert rows["met"] <= 60 * n and rows["hits"] <= 60 * n


# 7


def test_token_counts(odd_docs, empty):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    scores, longest, byte = token_counts.unigrams(path)

    def plain(word):
        best = [(0.0, 0)]
        for k in range(1, len(word) + 1):
            n = len(word[k - 1].encode())
            options = [(best[k - 1][0] + n * byte, best[k - 1][1] - n)]
            options += [(best[j][0] + scores[word[j:k]], best[j][1] - 1) for j in range(max(0, k - longest), k) if word[j:k] in scores]
            best.append(max(options))
        return -best[-1][1]

    got = sorted([tuple(r) for r in token_counts.count_tokens(odd_docs, path).collect()], key=str)
    want = [(i, len((t or "").split()), sum(plain(token_counts.SPACE + w) for w in (t or "").split())) for i, t in docs_of(odd_docs)]
    assert got == sorted(want, key=str)
    assert token_counts.count_tokens(empty, path).count() == 0


def test_shared_prefixes_and_long_pretokens(spark):
    """The trie's counts are those of each word by itself; a text without blanks is one pre-token, however long."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    scores, longest, byte = token_counts.unigrams(path)
    rng = random.Random(2)
    words = sorted({token_counts.SPACE + "".join(rng.choice("abetionrs\u00e9\u6f22\U0001f600x") for _ in range(rng.randrange(0, 14))) for _ in range(3000)})
    assert token_counts.count_shared(words, token_counts.pieces_of(path), byte).tolist() == [token_counts.count_alone(w, scores, longest, byte) for w in words]
    assert token_counts.count_shared([], token_counts.pieces_of(path), byte).tolist() == []
    long = "".join(rng.choice("thequickbrown") for _ in range(200_000))
    got = token_counts.count_tokens(spark.createDataFrame([(1, long), (2, long[:63]), (3, long[:64])], "doc_id long, text string"), path).collect()
    assert [r.n_tokens for r in sorted(got)] == [token_counts.count_alone(token_counts.SPACE + t, scores, longest, byte) for t in (long, long[:63], long[:64])]


# 8


def test_scores_are_those_of_a_plain_discriminant(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    numbers = stats.with_stats(docs, stats.MORE).toPandas().merge(labels.toPandas(), on="doc_id", how="left")
    x = quality_model.transform({c: numbers[c].to_numpy(float) for c in stats.BASE + stats.MORE})
    train = np.array([zlib.crc32(str(i).encode()) % 5 != 0 for i in numbers.doc_id]) & numbers.quality.notna().to_numpy()
    parts = [x[train & (numbers.quality == k).to_numpy()] for k in (0, 1)]
    pooled = sum((p - p.mean(axis=0)).T @ (p - p.mean(axis=0)) for p in parts) / (len(parts[0]) + len(parts[1]) - 2)
    density = []
    for p in parts:
        own = 0.9 * np.cov(p.T) + 0.1 * pooled
        own = 0.98 * own + 0.02 * np.diag(np.diag(pooled) + 1e-6)
        d = x - p.mean(axis=0)
        density.append(np.log(len(p)) - 0.5 * np.linalg.slogdet(own)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(own), d))
    ratio = density[1] - density[0]
    got = quality_model.score_quality(docs, labels).toPandas().set_index("doc_id").score[numbers.doc_id].to_numpy()
    model = quality_model.fit([len(p) for p in parts], [p.sum(axis=0) for p in parts], [p.T @ p for p in parts], 0.1, 0.02)
    ratio = np.clip(ratio, -quality_model.REACH, quality_model.REACH)
    assert np.abs(model.log_ratio(x) - ratio).max() < 1e-6
    order = np.argsort(ratio, kind="stable")
    assert (np.diff(got[order]) >= -1e-9).all() and got[ratio > 30].min() > 0.5 > got[ratio < -30].max()


def test_quality_model(spark, odd_docs, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality_model.score_quality(docs, labels)
    rows = out.toPandas()
    assert len(rows) == docs.count() and rows.score.between(0, 1).all() and ((rows.score >= 0.3) == (rows.predicted == 1)).all()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]).all()
    held = rows[rows.held_out].merge(labels.toPandas(), on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.95
    # held-out labels change nothing
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality_model.score_quality(docs, flipped).toPandas()
    assert np.allclose(rows.sort_values("doc_id").score, again.sort_values("doc_id").score)
    assert quality_model.score_quality(odd_docs, labels).count() == odd_docs.count()
    assert quality_model.score_quality(empty, labels).count() == 0
    assert {r.score for r in quality_model.score_quality(odd_docs, labels.filter("quality = 7")).collect()} == {0.5}


# 9


def test_chats_read_back(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<\\s>", "[INST\\]", "[ROLE]x[/ROLE]", "", None, "a\nb", "<<SYS>>\\<</SYS>>", "<", "[", "é漢\U0001f600", "<</s>"]
    rng = random.Random(4)
    rows = []
    for c in range(60):
        roles = ["system", "user", "assistant", "user", "assistant"] if c % 3 else [rng.choice(("user", "assistant", "tool[/ROLE]", None, "\\")) for _ in range(5)]
        rows += [(c, n, r, rng.choice(nasty) if c else n * "x", "own") for n, r in enumerate(roles)]
    rows += [(None, None, "user", "x", "own"), (None, None, "assistant", "y", "own"), (80, 0, "user", "</s>long " * 50_000, "own"), (80, 1, "assistant", "<s>\\" * 50_000, "own"), (70, 1, "user", "b", ""), (70, 1, "user", "a", ""), (70, 1, "user", "a", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, start string")
    out = chat.format_chats(turns)
    read = out.withColumns({"read": chat.read_turns(F.col("formatted")), "under": chat.read_loss(F.col("formatted"), F.col("loss_spans"))}).collect()
    want = defaultdict(list)
    for k, (c, n, r, t, _) in enumerate(rows):
        want[c if c is not None else f"alone {k}"].append((n if n is not None else -1, r or "", t or ""))
    assert len(read) == len(want)
    for r in read:
        told = [x[1:] for x in (sorted(want[r.conv_id]) if r.conv_id is not None else next(w for k, w in want.items() if str(k).startswith("alone") and w[0][1] == r.read[0]["role"]))]
        assert [tuple(t) for t in r.read] == told and r.n_turns == len(told)
        assert r.under == "".join(t for role, t in told if role == "assistant")
        if r.conv_id and r.conv_id < 60 and r.conv_id % 3:
            assert r.valid
    assert not next(r.valid for r in read if r.conv_id == 70)
    assert chat.format_chats(turns.filter("conv_id < 0")).count() == 0


# 10


def plain_fingerprint(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < 3 else [" ".join(words[k : k + 3]) for k in range(len(words) - 2)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_near_duplicates(odd_docs, empty):
    rows = sorted(docs_of(odd_docs), key=lambda r: (r[0] is None, r[0] or 0, str(r[1])))
    f = np.array([plain_fingerprint(t) for _, t in rows], dtype=np.uint64)
    root = roots(len(rows), [(i, j) for i, j in zip(*np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= 2), strict=True) if i < j])
    want = Counter((i, format(int(x), "016x"), rows[r][0]) for (i, _), x, r in zip(rows, f, root, strict=True))
    got = simhash.near_duplicates(odd_docs)
    assert Counter(map(tuple, got.collect())) == want
    kept = simhash.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for (i, _, c) in want if i is None or i == c}
    assert simhash.near_duplicates(empty).count() == 0


def plain_similarity(a, b):
    """Of the sets of five-word runs."""
    sets = []
    for t in (a, b):
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


def test_near_copies_are_found_and_others_kept(spark, odd_docs, empty):
    """Recall of pairs of similarity 0.8 or more against brute force; no link without that similarity."""
    import corpus_pipeline

    rng = random.Random(11)
    rows, pairs = [], []
    for k in range(400):
        w = [f"w{rng.randrange(5000)}" for _ in range(100)]
        near = list(w)
        for at in rng.sample(range(100), 1 + k % 5):
            near[at] = f"x{rng.randrange(5000)}"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(near))]
        pairs.append(plain_similarity(rows[-2][1], rows[-1][1]) >= 0.8)
    assert 100 < sum(pairs) < 300
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()}
    found = [2 * k + 1 not in kept for k in range(400)]
    assert not any(f and not p for f, p in zip(found, pairs, strict=True))
    assert sum(f and p for f, p in zip(found, pairs, strict=True)) >= 0.98 * sum(pairs)
    base = [f"w{n}" for n in range(200)]
    chain = [" ".join(base[k : k + 120]) for k in range(0, 80, 4)]  # neighbours are similar, ends are not
    more = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(chain, 1000)), "doc_id long, text string"))
    own = sorted(docs_of(more), key=lambda r: (r[0] is None, r[0] or 0, str(r[1])))
    root = roots(len(own), [(i, j) for i in range(len(own)) for j in range(i + 1, len(own)) if plain_similarity(own[i][1], own[j][1]) >= 0.8])
    assert Counter(map(tuple, simhash.near_copies(more).collect())) == Counter((i, own[r][0]) for (i, _), r in zip(own, root, strict=True))
    assert simhash.near_copies(empty).count() == 0


def test_near_copies_in_a_crowd(spark):
    """Many texts share half of their words with all others but are no near copies of them; pairs of near copies among them are found all the same."""
    rng = random.Random(12)
    shared = " ".join(f"s{n}" for n in range(100))
    rows = []
    for k in range(150):
        own = [f"c{rng.randrange(10**6)}" for _ in range(100)]
        near = list(own)
        near[rng.randrange(100)] = "other"
        rows += [(2 * k, f"{shared} {' '.join(own)}"), (2 * k + 1, f"{shared} {' '.join(near)}")]
    found = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(c // 2 == i // 2 for i, c in found.items())
    assert sum(found[2 * k + 1] == 2 * k for k in range(150)) >= 147


def test_near_copies_miss_no_pair_at_the_threshold(spark):
    """4,000 pairs of similarity 40 in 50: keys and fingerprints alone leave some of them out."""
    rows = []
    for k in range(4000):
        w = [f"{k}w{n}" for n in range(49)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w[:44], *[f"{k}x{n}" for n in range(5)]]))]
    assert plain_similarity(rows[0][1], rows[1][1]) == 0.8
    found = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: i // 2 * 2 for i, _ in rows}


def test_sharing_proposes_every_similar_pair(spark):
    """Against brute force, with shingles that most texts have, blocks of few texts, and texts already connected."""
    rng = random.Random(13)
    common = [f"s{n}" for n in range(60)]
    texts = []
    for _ in range(40):
        w = [*common[: rng.randrange(61)], *[f"c{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 30))]]
        texts.append(w)
        for _ in range(4):
            near = list(w)
            for at in rng.sample(range(len(w)), min(len(w), rng.randrange(3))):
                near[at] = rng.choice(("other", "s3"))
            texts.append(near[: len(w) - rng.randrange(4)] or ["one"])
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string").dropDuplicates(["text"])
    rows = shingles.keyed(docs, 5, 0.8).withColumn("root", F.expr("if(doc_id % 7 = 0, 0, node)")).cache()
    assert len(shingles.frequent(docs, 5)[0]) > 20
    own = {r.node: (r.doc_id, r.root) for r in rows.collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    want = {(a, b) for a in own for b in own if a > b and own[a][1] != own[b][1] and plain_similarity(text[own[a][0]], text[own[b][0]]) >= 0.8}
    for block in (3, 2048):
        pairs = shingles.sharing(rows.select("node", "n", "root", "prefix", "sign"), 0.8, block)
        assert len(want) > 100 and want <= {(r.u, r.v) for r in pairs.collect()}
        assert {(r.u, r.v) for r in shingles.verified(docs, pairs, 5, 0.8).collect()} == want


def test_index_finds_all_links_in_a_large_group():
    rng = np.random.default_rng(6)
    codes = set()
    for b in rng.integers(0, 2**63, 12, dtype=np.uint64):
        for _ in range(80):
            c = int(b)
            for k in rng.integers(0, 64, rng.integers(0, 5)):
                c ^= 1 << int(k)
            codes.add(c)
    codes = np.array(sorted(codes), dtype=np.uint64)
    number = {int(c): n for n, c in enumerate(codes)}
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 2
    want = roots(len(codes), [(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j])
    a, b = simhash.Part(codes, 2).own_links()
    assert roots(len(codes), [(number[int(x)], number[int(y)]) for x, y in zip(a, b, strict=True)]) == want and len(a) < len(codes)


def test_index_prunes_and_links_across_parts(spark):
    """On the fingerprints of the documents: few nodes are visited, parts included, and the links are those of brute force."""
    rows = simhash.fingerprints(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).select("fp").distinct().collect()
    codes = np.sort(np.array([r.fp for r in rows], dtype=np.int64).view(np.uint64))
    codes = np.unique(np.r_[codes, codes[::7] ^ np.uint64(1 << 63), codes[::11] ^ np.uint64(5)])  # also links over far ends of the order
    number = {int(c): n for n, c in enumerate(codes)}
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 2
    want = roots(len(codes), [(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j])
    index = simhash.Index(codes)
    pairs = {(int(codes[q]), int(index.codes[c])) for a, b in index.search(codes, 2) for q, c in zip(a, b, strict=True)}
    assert len(pairs) == near.sum()
    many = np.unique(np.random.default_rng(9).integers(0, 1 << 63, 20_000, dtype=np.uint64))
    index = simhash.Index(many)
    assert sum(len(a) for a, _ in index.search(many, 2)) >= len(many)
    leaves = len(index.tree.levels[0][0])
    assert leaves > 600 and sum(len(who) for _, who, _ in index.tree.search(many, 2)) < 0.15 * len(many) * leaves  # leaves reached, of all
    upper = simhash.upper_levels([(n, int(np.bitwise_and.reduce(c.view(np.int64))), int(np.bitwise_or.reduce(c.view(np.int64)))) for n, c in enumerate(np.array_split(index.codes, 256))])
    assert sum(len(who) for _, who, _ in upper.search(many, 2)) < 0.3 * len(many) * 256  # parts to visit
    df = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    for part_codes in (100, 10**6):
        found = [(number[int(np.int64(r.u).view(np.uint64))], number[int(np.int64(r.v).view(np.uint64))]) for r in simhash.links(df, 2, part_codes).collect()]
        assert roots(len(codes), found) == want


def test_components_of_chains_and_stars(spark):
    links = [(n, n + 1) for n in range(40)] + [(100, n) for n in range(101, 130)] + [(200, 200), (130, 129)]
    got = {r.u: r.root for r in connected(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(got[n] == 0 for n in range(1, 41)) and all(got[n] == 100 for n in range(101, 131)) and 200 not in got


# the pipeline


def test_pipeline(spark):
    """Each stage, on what the one before it kept, against a brute-force version of it."""
    import corpus_pipeline

    whole = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = whole.columns, [f for _, f in corpus_pipeline.STAGES]
    docs = whole
    seen = []
    for stage in stages[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns and docs.count() > 0.4 * whole.count()
        seen.append(sorted(docs_of(docs)))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored, _, threshold = quality_rules.fit_rules(whole, labels, min_words=1)
    fine = {r.doc_id for r in scored.collect() if not r.base_failed and r.anomaly <= threshold}
    assert seen[0] == sorted((i, t) for i, t in docs_of(whole) if i in fine and plain_stats(t)[0] and 2 * plain_stats(t)[4] <= plain_stats(t)[0])
    root = roots(len(seen[0]), [(i, j) for i in range(len(seen[0])) for j in range(i) if plain_similarity(seen[0][i][1], seen[0][j][1]) >= 0.8])
    assert seen[1] == [r for k, r in enumerate(seen[0]) if root[k] == k]
    kept = {i: sha for i, _, _, _, sha in plain_repeats(seen[1], 50)}
    assert [i for i, _ in seen[2]] == [i for i, _ in seen[1]]
    assert sum(hashlib.sha256(t.encode()).hexdigest() == kept[i] for i, t in seen[2]) > 0.95 * len(kept)  # a cut inside a character leaves bytes that are no text
    items = [decontaminate.words_of(r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def leaks(text):
        d = decontaminate.words_of((text or "").encode())
        for item in items:
            size, off = decontaminate.allowed(len(item))
            for a in range(len(item) - size + 1):
                part = item[a : a + size]
                for b in range(len(d) - size + 1):
                    if sum(x != y for x, y in zip(d[b : b + size], part, strict=True)) <= off:
                        return True
        return False

    own = set(map(tuple, seen[3]))
    rng = random.Random(1)
    for r in [x for x in seen[2] if tuple(x) not in own] + rng.sample(seen[3], min(len(seen[3]), 12)):
        assert leaks(r[1]) == (tuple(r) not in own)
    packed = stages[-1](spark, docs, SF)
    want = Counter()
    encode = packing.encoder(*byte_bpe())
    for i, t in seen[3]:
        ids = [*encode.encode(t or "", allowed_special={packing.SPECIAL}, disallowed_special=()), 0]
        cut = len(ids) % 2048
        starts = [0, *range(cut, len(ids), 2048)] if len(ids) > 2048 and cut else list(range(0, len(ids), 2048))
        for n, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            want[i, n, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += 1
    assert Counter(map(tuple, packed.select("doc_id", "piece", "ids_crc32").collect())) == want
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "ids_crc32").collect())) == want
