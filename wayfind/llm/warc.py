"""WARC archives of pages, and their index by external merge.

Writing: payloads of equal content have one response record, other captures revisit it. Which, is decided over digests alone; the
pages then move once, dealt to files of about `file_bytes`. Records are gzip members of their own, so any can be read by its
offset. Spark's text sink writes the bytes, as it does wherever the folder lies; what it puts between two records is an empty
member.

Reading: each file is parsed record by record and gives its captures as one run, sorted by URL key and time. Runs are written;
the key space is then cut into ranges of about `range_rows` captures, and each range merges its stretch of all runs by a loser
tree. Parts in order, and rows in order within, are the captures of all archives in order.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.llm.shared import drop, join_spread, slices, written

#: a gzip member without content, as Latin-1
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00".decode("latin-1")
HEAD_BYTES = 512  # what a record takes besides its payload, for planning
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = "urn:page:"
TAKEN_AT = "2024-01-01T00:00:00Z"
CAPTURES = "url_key string, taken_at string, url string, page_id string, record_type string, digest string, payload_bytes long, refers_to string, intact boolean, file string, offset long, length long"


def header_value(value: str) -> str:
    """The text as it may stand in a header line: controls and blanks percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", value)


def url_key(url: str) -> str:
    """Sort key: host labels from the last to the first, then port, path and query; scheme, user, a leading www. and the fragment are left out."""
    rest = url.split("#", 1)[0].split("://", 1)[-1]
    host, path = re.match(r"([^/?]*)(.*)", rest, re.DOTALL).groups()
    host, _, port = host.rsplit("@", 1)[-1].lower().partition(":")
    host = host.removeprefix("www.")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port not in ("", "80", "443") else "") + ")" + (path or "/") if host else ""


def record(page_id: str, url: str | None, taken_at: str, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC/1.1 record of an HTTP answer: a response with its payload, or a revisit with the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{NAMESPACE}{header_value(page_id)}>", f"WARC-Date: {taken_at}"]
    lines += [f"WARC-Target-URI: {header_value(url)}"] if url else []
    lines += [f"WARC-Payload-Digest: sha1:{digest}"]
    lines += [f"WARC-Refers-To: <{NAMESPACE}{header_value(refers_to)}>", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, taken_at: Column | None = None, least_bytes: int = 0, file_bytes: int = 32 << 20) -> None:
    """Writes a record for every row of pages (page_id, url, html) to archives in the folder.

    Null html is an empty payload, a null url has no target header, a null page_id an empty one. Of payloads with equal digests
    and at least least_bytes bytes that with the largest page_id is the response, the others are revisits of it; rows that repeat
    its page_id and payload are responses too. Payloads are whole, of any length a row can have. Other columns are ignored; no
    rows, no records.
    """
    taken_at = F.lit(TAKEN_AT) if taken_at is None else F.date_format(taken_at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    payload = F.coalesce(pages["html"].cast("string"), F.lit(""))
    rows = pages.select(F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("id"), F.col("page_id").alias("number"), F.col("url").cast("string").alias("url"), taken_at.alias("taken_at"), payload.alias("payload"), F.sha2(payload, 256).alias("same"))
    slim = written(rows.select("id", "number", "same", F.octet_length("payload").cast("long").alias("bytes")), "payloads")
    groups = slim.filter(F.col("bytes") >= least_bytes).groupBy("same").agg(F.max("number").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND head IS NOT NULL")
    again = join_spread(slim.select("id", "number", "same"), groups.select("same", F.col("head").cast("string").alias("head")), "same", F.col("id")).filter("id <> head")
    total = slim.agg(F.sum(F.col("bytes") + HEAD_BYTES)).first()[0] or 0
    n = slices(total, file_bytes)
    # both in one exchange, a decision before the page it is about: a join would deal the pages once more to get more tasks
    decided = again.select("id", "same", "head").distinct().withColumn("page", F.lit(0)).unionByName(rows.drop("number").withColumn("page", F.lit(1)), allowMissingColumns=True)
    placed = decided.repartition(n, "id", "same").sortWithinPartitions("id", "same", "page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, head = None, None
        for batch in batches:
            out, held = [], 0
            for k in range(batch.num_rows):
                own = {name: batch.column(name)[k].as_py() for name in ("id", "same", "head", "page", "url", "taken_at")}
                if (own["id"], own["same"]) != key or not own["page"]:
                    key, head = (own["id"], own["same"]), own["head"]
                if not own["page"]:
                    continue
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                out.append(packer.compress(record(own["id"], own["url"], own["taken_at"], batch.column("payload")[k].as_buffer().to_pybytes(), head)) + packer.flush())
                held += len(out[-1])
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    members = placed.mapInArrow(run, "member binary").select(F.col("member").cast("string").alias("value"))
    members.write.option("lineSep", EMPTY_MEMBER).option("encoding", "ISO-8859-1").text(folder)
    drop(slim)


def members(content: bytes, step: int = 1 << 16) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member that is not empty."""
    view, at = memoryview(content), 0
    while at < len(content):
        reader, start, parts = zlib.decompressobj(31), at, []
        while not reader.eof:
            if at >= len(content):
                raise ValueError("an archive ends within a record")
            parts.append(reader.decompress(view[at : at + step]))
            at += min(step, len(content) - at) - len(reader.unused_data)
        if whole := b"".join(parts):
            yield start, at - start, whole


def parsed(raw: bytes) -> dict[str, Any]:
    """A record's headers in lower case, its HTTP headers and the payload."""
    head, rest = raw.split(b"\r\n\r\n", 1)
    headers = {k.lower(): v for k, v in (line.split(": ", 1) for line in head.decode().split("\r\n")[1:])}
    block = rest[: int(headers["content-length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in http.decode().split("\r\n")[1:])}
    return headers | {"payload": payload, "http": fields}


def captures_of(file: str, content: bytes) -> list[tuple]:
    """The captures of one archive, sorted by URL key, time, page and place. A response's digest and size are taken of the payload that is there; intact says if the header agrees."""
    out = []
    own = lambda uri: uri.removeprefix("<" + NAMESPACE).removesuffix(">")
    for offset, length, raw in members(content):
        r = parsed(raw)
        url, said, kind = r.get("warc-target-uri", ""), r["warc-payload-digest"].removeprefix("sha1:"), r["warc-type"]
        stated = int(r["http"]["content-length"])
        if kind == "response":
            digest, size, refers_to = base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode(), len(r["payload"]), None
        else:
            digest, size, refers_to = said, stated, own(r["warc-refers-to"])
        out.append((url_key(url), r["warc-date"], url, own(r["warc-record-id"]), kind, digest, size, refers_to, (digest, size) == (said, stated), file, offset, length))
    return sorted(out, key=lambda c: (c[0], c[1], c[3], c[10]))


def capture_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The captures of each archive in the folder as a sorted run: run is the archive's name, pos the place in it."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    names = [c.split()[0] for c in CAPTURES.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    types = [*[kinds[c.split()[1]] for c in CAPTURES.split(", ")], pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = [(*c, k) for k, c in enumerate(captures_of(file.as_py(), content.as_buffer().to_pybytes()))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(types), types, strict=True)], names=[*names, "pos"])

    return files.mapInArrow(run, f"{CAPTURES}, pos long")


def merge_runs(runs: list[list[tuple]]) -> Iterator[tuple]:
    """The items of sorted runs in order, by a tree of losers: each inner node keeps the run that lost there, so the next winner costs one path."""
    k = len(runs)
    if k < 2:
        yield from (runs[0] if runs else [])
        return
    at = [0] * k
    key = [r[0] if r else None for r in runs]  # None: the run is over
    less = lambda i, j: key[j] is None or (key[i] is not None and (key[i], i) < (key[j], j))
    losers = [-1] * k
    winner = [0] * k + list(range(k))  # node n has the children 2 n and 2 n + 1, leaves are k and on
    for node in range(k - 1, 0, -1):
        i, j = winner[2 * node], winner[2 * node + 1]
        winner[node], losers[node] = (i, j) if less(i, j) else (j, i)
    top = winner[1]
    while key[top] is not None:
        yield key[top]
        at[top] += 1
        key[top] = runs[top][at[top]] if at[top] < len(runs[top]) else None
        node = (top + k) // 2
        while node:
            if less(losers[node], top):
                losers[node], top = top, losers[node]
            node //= 2


def capture_index(runs: DataFrame, range_rows: int = 50_000) -> DataFrame:
    """The captures of all runs (written, as capture_runs gives them), with part and place: in order of URL key, time, page, archive and offset by part, then place.

    A URL with many captures is cut between them like any other keys.
    """
    names = [c.split()[0] for c in CAPTURES.split(", ")]
    order = ["url_key", "taken_at", "page_id", "file", "offset"]
    dealt = runs.select(*names, "pos").repartitionByRange(slices(runs.count(), range_rows), *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        held.clear()
        stretches: dict[str, list[tuple]] = {}
        for row, key in enumerate(zip(*(table[c].to_pylist() for c in order), table["pos"].to_pylist(), strict=True)):
            stretches.setdefault(key[3], []).append((*key[:5], row, key[5]))
        for stretch in stretches.values():
            if any(x[6] > y[6] for x, y in zip(stretch, stretch[1:], strict=False)):
                stretch.sort(key=lambda x: x[6])  # a shuffle may hand a run's blocks over in another order
        rows = pa.array([x[5] for x in merge_runs(list(stretches.values()))], pa.int64())
        merged = table.drop_columns(["pos"]).take(rows).append_column("place", pa.array(range(len(rows)), pa.int64())).combine_chunks()
        yield from merged.to_batches(max_chunksize=20_000)

    merged = dealt.mapInArrow(run, f"{CAPTURES}, place long")
    return merged.withColumn("part", F.spark_partition_id())


def read_record(content: bytes, offset: int, length: int) -> dict[str, Any]:
    """The record at a place of an archive."""
    return parsed(next(members(content[offset : offset + length]))[2])


def archive_pages(pages: DataFrame, folder: str, least_bytes: int = 0, file_bytes: int = 32 << 20) -> DataFrame:
    """Writes the archives, reads them back, and gives the merged index of their captures."""
    write_archives(pages, folder, least_bytes=least_bytes, file_bytes=file_bytes)
    return capture_index(written(capture_runs(pages.sparkSession, folder), "capture-runs"))
