"""Archives: records read back as written, the merged index in order, and the query against its SQL twin."""

import base64
import gzip
import hashlib
import random
import zlib

import duckdb
import pytest

from wayfind.llm import catalog, warc

SF = "/root/testdata/sf0.001"
TRICKY = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
PAGES = [
    (1, "http://b.example/x?q=1#f", "<p>one</p>"), (2, "http://www.B.example:80/x?q=1", "<p>one</p>"), (3, "https://u@a.b.example:8080/", "<p>two</p>"), (4, None, None), (5, "no scheme \r\n x", ""), (6, "http://b.example/a", TRICKY),
    (7, "http://b.example/a", TRICKY), (8, "http://b.example/a", "é漢" * 5000), (None, "http://z.example", "<p>one</p>"), (9, "http://c.example", "z" * 3_000_000), (10, "http://d.example", None), (10, "http://e.example", None), (11, "", "\x1f\x00a"),
]


def plain(rows, least=0):
    head = {}
    for i, _, html in rows:
        b = (html or "").encode()
        if i is not None and len(b) >= least:
            head[b] = max(head.get(b, i), i)
    out = []
    for i, _, html in rows:
        b = (html or "").encode()
        top = head.get(b)
        again = top is not None and i != top
        out.append((str(i if i is not None else ""), len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", str(top) if again else None))
    return sorted(out, key=str)


def of(df):
    return sorted(((r.page_id, r.payload_bytes, r.digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


@pytest.mark.parametrize(("file_bytes", "least"), [(32 << 20, 0), (2000, 0), (2000, 11)])
def test_archives_read_back(spark, tmp_path, file_bytes, least):
    pages = spark.createDataFrame([(*r, "c", 1) for r in PAGES], "page_id long, url string, html string, head string, bytes int")
    folder = str(tmp_path / "archives")
    index = warc.archive_pages(pages, folder, least_bytes=least, file_bytes=file_bytes)
    rows = index.collect()
    assert of(index) == plain(PAGES, least) and all(r.intact for r in rows)
    texts = {str(i): (h or "").encode() for i, _, h in PAGES if i is not None}
    for r in rows:  # by place, as a reader of the index would
        got = warc.read_record((tmp_path / "archives" / r.file).read_bytes(), r.offset, r.length)
        assert got["warc-type"] == r.record_type
        if r.record_type == "response" and r.page_id:
            assert got["payload"] == texts[r.page_id]
    for file in (tmp_path / "archives").glob("part-*"):  # any gzip reader can read an archive
        assert gzip.decompress(file.read_bytes()).count(b"WARC-Record-ID: ") >= sum(r.file == file.name for r in rows)


def test_empty_tables(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_pages(pages, str(tmp_path / "a")).collect() == []


def test_index_is_in_order_across_runs_and_parts(spark, tmp_path):
    rng = random.Random(5)
    rows = [(n, f"http://{rng.choice('abc')}.example/{0 if n % 3 == 0 else rng.randrange(50)}", f"<p>{rng.randrange(400)}</p>") for n in range(600)]  # a third of one path
    at = "timestamp_seconds(1700000000 + pmod(page_id * 7919, 1000))"
    from pyspark.sql import functions as F
    from wayfind.llm.shared import written

    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "a"), taken_at=F.expr(at), file_bytes=20_000)
    runs = written(warc.capture_runs(spark, str(tmp_path / "a")), "runs")
    assert runs.select("file").distinct().count() > 5
    index = warc.capture_index(runs, range_rows=40)
    got = [(r.url_key, r.taken_at, r.page_id) for r in index.orderBy("part", "place").collect()]
    assert got == sorted(got) and len(got) == 600 and len({r.part for r in index.collect()}) > 8
    assert of(index) == plain(rows)


def test_loser_tree():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7, 64):
        runs = [sorted((rng.randrange(20), r, n) for n in range(rng.randrange(0, 30))) for r in range(k)]
        assert list(warc.merge_runs(runs)) == sorted(x for r in runs for x in r)


def test_members_and_keys():
    parts = [b"a" * 10, b"", b"b" * 200_000, b"c"]
    packed = b"".join(gzip.compress(p) for p in parts)
    assert [p for _, _, p in warc.members(packed, step=37)] == [p for p in parts if p]
    assert all(zlib.decompress(packed[o : o + n], 31) == p for o, n, p in warc.members(packed))
    with pytest.raises(ValueError, match="within a record"):
        list(warc.members(packed[:-3]))
    assert warc.url_key("https://user@www.Example.com:443/A?b#c") == "com,example)/A?b" and warc.url_key("http://x.org:81") == "org,x:81)/" and warc.url_key("") == ""


def test_query_equals_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = db.sql(catalog.OP12_SQL).fetchall()
    got = catalog.op12_warc(spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
