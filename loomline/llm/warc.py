"""WARC archives, index first.

Writing: pages with equal payloads are brought together by their SHA-256 and length (SHA-1, of which collisions are known, only names them); the smallest id is a `response`, the others `revisit` it. Each
task writes files of its own in the shared folder, under names that no other attempt uses, and returns an index row per record:
file, offset, length, URL and digest. Each record is a gzip member of its own, so that any range of whole records can be read alone.
The index is a table; only files it names count, so what a lost or repeated task left behind
is never read.

Reading: index rows are selected first; their byte ranges, sorted by file and offset, are coalesced where the gap is small, up to
`MAX_RANGE` bytes a read, and each range is one read. Records are parsed from the bytes, and payloads are checked against
their digests.

Files are opened with Arrow's file systems by the URI of `spark.checkpoint.dir` (file, hdfs, s3, gs, abfs).

Defined results: a null payload is empty; a null page id is always a response and nothing refers to it; equal ids with equal payloads are each a response; a null or unprintable URL is omitted or
percent-encoded; payloads under `min_bytes` are all responses; an empty table gives an empty index.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import new_path, pin

MAX_FILE = 256 << 20
MAX_RANGE = 8 << 20
MAX_GAP = 64 << 10
TASK_BYTES = 32 << 20
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"
INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string"


def open_store(uri: str):
    """(Arrow file system, path) of a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def table(rows: list, columns: list[str]) -> pd.DataFrame:
    """A frame of rows; ids are exact beside nulls."""
    lists = zip(*rows, strict=True) if rows else [[] for _ in columns]
    return pd.DataFrame(
        {c: pd.array(list(x), dtype="Int64") if c in ("page_id", "refers_to") else list(x) for c, x in zip(columns, lists, strict=True)}
    )


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def clean_url(url: str | None) -> str:
    return "".join(c if "!" <= c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> tuple[bytes, str, str]:
    """(record, digest, type). A revisit's block has the headers of the full payload and no payload."""
    digest, kind = base32_sha1(payload), "response" if refers_to is None else "revisit"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    named = "null" if page_id is None else page_id
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{named}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {clean_url(url)}")
    if refers_to is not None:
        head += [
            f"WARC-Refers-To: <urn:page:{refers_to}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    head += [
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest, kind


def parse_record(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    named = lambda name: fields.get(name, "<urn:page:null>").removeprefix("<urn:page:")[:-1]
    number = lambda name: None if named(name) == "null" else int(named(name))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']}: the payload doesn't match its digest")
    return {
        "page_id": number("WARC-Record-ID"),
        "url": fields.get("WARC-Target-URI"),
        "payload": payload,
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": number("WARC-Refers-To"),
    }


def with_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """(page_id, url, payload, refers_to). Groups of equal payloads meet as counts and minima; the pages come to them by an
    equi-join, which adaptive execution can split for a payload of very many pages."""
    base = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"),
        F.col(f"`{url_col}`").alias("url"),
        F.coalesce(F.col(f"`{html_col}`"), F.lit("")).cast("binary").alias("payload"),
    ).withColumns({"sha": F.sha2("payload", 256), "bytes": F.octet_length("payload")})
    firsts = (
        base.where(F.col("bytes") >= min_bytes)
        .groupBy(F.col("sha").alias("f_sha"), F.col("bytes").alias("f_bytes"))
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("f_sha", "f_bytes", "first")
    )
    return base.join(firsts, (F.col("sha") == F.col("f_sha")) & (F.col("bytes") == F.col("f_bytes")), "left").select(
        "page_id", "url", "payload", F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("refers_to")
    )


def write_archive(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0
) -> DataFrame:
    """Write a record per page below `folder` and return the index, a table read back from there."""

    def run(frames):
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        out, name, at = None, None, 0
        try:
            for frame in frames:
                rows = []
                for page_id, url, payload, refers_to in zip(
                    frame["page_id"], frame["url"], frame["payload"], frame["refers_to"], strict=True
                ):
                    if out is None or at >= MAX_FILE:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    page_id, refers_to = (None if x is None else int(x) for x in (page_id, refers_to))
                    data, digest, kind = record_bytes(page_id, url, bytes(payload), refers_to)
                    data = gzip.compress(data, LEVEL, mtime=0)
                    out.write(data)
                    rows.append((name, at, len(data), page_id, url, digest, kind))
                    at += len(data)
                yield table(rows, ["file", "offset", "length", "page_id", "url", "digest", "record_type"])
        finally:
            if out is not None:
                out.close()

    rows = with_revisits(pages, id_col, url_col, html_col, min_bytes)
    rows = rows.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})  # exact beside nulls
    return pin(rows.mapInPandas(run, INDEX), "warc-index")


def ranges(selected: DataFrame) -> DataFrame:
    """(file, start, length, records): the coalesced reads of index rows, records as (offset, length), sorted."""
    order = Window.partitionBy("file").orderBy("offset")
    gap = F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(order)
    block = F.floor(F.col("offset") / MAX_RANGE)
    opens = (gap.isNull() | (gap > MAX_GAP) | (block != F.lag(block).over(order))).cast("int")
    return (
        selected.select("file", "offset", "length", opens.alias("opens"))
        .withColumn("n", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("file", "n")
        .agg(
            F.min("offset").alias("start"),
            F.max(F.col("offset") + F.col("length")).alias("end"),
            F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("records"),
        )
        .select("file", "start", (F.col("end") - F.col("start")).alias("length"), "records")
    )


def read_archive(selected: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records of index rows: (page_id, payload_bytes, payload_digest, record_type, refers_to, url), and `payload` if asked."""
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", *(["payload"] if payloads else [])]

    def run(frames):
        store, root = open_store(folder)
        for frame in frames:
            for file, start, length, records in zip(
                frame["file"], frame["start"], frame["length"], frame["records"], strict=True
            ):
                with store.open_input_file(f"{root}/{file}") as source:
                    data = source.read_at(length, start)
                found = [parse_record(gzip.decompress(data[r["offset"] - start : r["offset"] - start + r["length"]])) for r in records]
                yield table([[r[c] for c in columns] for r in found], columns)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    total = selected.agg(F.sum("length")).first()[0] or 0
    # dealt by the archive's bytes: the index's own, by which adaptive execution would merge tasks, are a hundredth of them
    dealt = ranges(selected).repartition(max(1, -(-total // TASK_BYTES)), "file", "start")
    return dealt.mapInPandas(run, schema + (", payload binary" if payloads else ""))


def op10_warc(spark, sf_dir: str) -> DataFrame:
    """Contract query: write all pages, read all records back."""
    folder = new_path(spark, "warc")
    index = write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archive(index, folder).drop("url")


OP10_SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT sha, min(page_id) AS first FROM p GROUP BY sha),
b AS (
  SELECT p.*, f.first, array_to_string(list_transform(string_split(p.sha, ''), lambda c: substr(
    '0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', c) - 1)::INT + 1, 4)), '') AS bits
  FROM p JOIN f USING (sha))
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + 16 * substr(bits, i::INT * 5 + 1, 1)::INT + 8 * substr(bits, i::INT * 5 + 2, 1)::INT + 4 * substr(bits, i::INT * 5 + 3, 1)::INT
           + 2 * substr(bits, i::INT * 5 + 4, 1)::INT + substr(bits, i::INT * 5 + 5, 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""
