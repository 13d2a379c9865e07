"""WARC archives: an index of offset, length, URL and digest is written with the
records; reads are coalesced byte ranges in the order of the index."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Opened, parts_for, saved, scratch_path

DATE = "2024-01-01T00:00:00Z"
LEAST_REVISIT = 1000
GAP = 64 << 10
RANGE = 8 << 20
INDEX = "archive string, offset long, length long, url string, digest string, record_type string, key long"


def open_store(path: str):
    """File system of a path and the path in it; bare paths are local."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def _clean(value: str | None) -> str:
    """Header value of a URL: a line break cannot stand in it."""
    return (value or "").replace("\r", "%0D").replace("\n", "%0A")


def record_id(key: int) -> str:
    digest = hashlib.md5(b"page %d" % key).hexdigest()
    return f"<urn:uuid:{digest[:8]}-{digest[8:12]}-{digest[12:16]}-{digest[16:20]}-{digest[20:]}>"


def make_record(key: int, url: str | None, payload: bytes, digest: str, revisited: int | None) -> bytes:
    """A response with its payload, or a revisit that names the response instead."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisited is not None else http + payload
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'response' if revisited is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(key)}",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Row-Key: {key}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisited is not None:
        fields += [
            f"WARC-Refers-To: {record_id(revisited)}",
            f"X-Refers-To-Key: {revisited}",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """WARC fields and the payload behind the HTTP header of an uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _packed(record: bytes) -> bytes:
    """A gzip member of its own, so that a range of the file is a record."""
    press = zlib.compressobj(3, zlib.DEFLATED, 31)
    return press.compress(record) + press.flush()


def _written(root: str, archive_bytes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, folder = open_store(root)
        stream, name, at = None, "", 0
        for pdf in batches:
            rows = []
            for key, url, html, digest, refers in zip(pdf["key"], pdf["url"], pdf["html"], pdf["digest"], pdf["refers"], strict=True):
                if stream is None or at >= archive_bytes:
                    if stream is not None:
                        stream.close()
                    name, at = f"{uuid4().hex}.warc.gz", 0
                    stream = store.open_output_stream(f"{folder}/{name}", compression=None)
                revisited = None if pd.isna(refers) else int(refers)
                raw = _packed(make_record(key, url, html or b"", digest, revisited))
                stream.write(raw)
                rows.append((f"{root}/{name}", at, len(raw), url, digest, "response" if revisited is None else "revisit", key))
                at += len(raw)
            yield pd.DataFrame(rows, columns=["archive", "offset", "length", "url", "digest", "record_type", "key"])
        if stream is not None:
            stream.close()

    return run


def write_archives(pages: DataFrame, root: str, archive_bytes: int = 256 << 20) -> DataFrame:
    """Write ``key url html`` (binary) ``digest refers`` as archives; returns the index.

    Each task writes files under new names and only its index rows name them, so
    the files of a lost or repeated attempt are never read. The index is written
    to the shared folder before it is returned.
    """
    spark = pages.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    return saved(pages.select("key", "url", "html", "digest", "refers").mapInPandas(_written(root, archive_bytes), INDEX))


def coalesced(entries: Iterable[tuple], gap: int = GAP, most: int = RANGE) -> Iterator[tuple[str, int, int, list[tuple]]]:
    """Ranges (archive, start, end, entries) of entries in the order of (archive,
    offset): neighbours share a range while the gap and the range are small."""
    held: list[tuple] = []
    archive, start, end = "", 0, 0
    for entry in entries:
        where, offset, length = entry[:3]
        if held and where == archive and offset - end <= gap and offset + length - start <= most:
            end = max(end, offset + length)
        else:
            if held:
                yield archive, start, end, held
            held, archive, start, end = [], where, offset, offset + length
        held.append(entry)
    if held:
        yield archive, start, end, held


READ = "key long, url string, record_type string, refers long, stated_digest string, payload binary"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def entries() -> Iterator[tuple]:
        for pdf in batches:
            yield from zip(pdf["archive"], pdf["offset"], pdf["length"], strict=True)

    stream, name = None, ""
    for archive, start, end, held in coalesced(entries()):
        if archive != name:
            if stream is not None:
                stream.close()
            store, path = open_store(archive)
            stream, name = store.open_input_file(path), archive
        data = stream.read_at(end - start, start)
        rows = []
        for _, offset, length in held:
            fields, payload = parse_record(zlib.decompress(data[offset - start : offset - start + length], 31))
            refers = int(fields["X-Refers-To-Key"]) if "X-Refers-To-Key" in fields else None
            rows.append(
                (int(fields["X-Row-Key"]), fields["WARC-Target-URI"], fields["WARC-Type"], refers, fields["WARC-Payload-Digest"].removeprefix("sha1:"),
                 payload if refers is None else None)
            )
        frame = pd.DataFrame(rows, columns=["key", "url", "record_type", "refers", "stated_digest", "payload"])
        yield frame.astype({"refers": "Int64"})
    if stream is not None:
        stream.close()


def read_records(index: DataFrame, range_rows: int = 20_000) -> DataFrame:
    """Records of the selected index rows, by byte ranges.

    Index rows are range-partitioned and sorted by (archive, offset); neighbouring
    ones within 64 KB are read at once, up to 8 MB at a time. Returns ``key url
    record_type refers stated_digest payload`` (null for revisits).
    """
    wanted = index.select("archive", "offset", "length")
    parts = parts_for(index.sparkSession, index.count(), range_rows)
    ranged = wanted.repartitionByRange(parts, "archive", "offset").sortWithinPartitions("archive", "offset")
    return ranged.mapInPandas(_read, READ)


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, DataFrame, Opened]:
    """Write every row as a record and return the index and the rows with their keys.

    The payload is the html in UTF-8; null is empty. Of records with equal payloads
    (digest and size) of 1,000 bytes or more, that with the largest key is the
    response, the others revisit it. Repeated rows are records each.
    """
    opened = Opened(pages, id_col, html_col)
    spark = pages.sparkSession
    html = F.coalesce(F.col(opened.text), F.lit("")).cast("binary")
    base = opened.df.select("key", F.col(f"in_{opened.names.index(url_col)}").cast("string").alias("url"), html.alias("html"))
    digests = saved(base.select("key", F.sha1("html").alias("digest"), F.octet_length("html").cast("long").alias("size")))
    last = digests.where(F.col("size") >= LEAST_REVISIT).groupBy("digest", "size").agg(F.max("key").alias("last"), F.count("*").alias("n")).where("n > 1")
    named = digests.join(last, ["digest", "size"], "left").select("key", "digest", F.when(F.col("last") != F.col("key"), F.col("last")).alias("refers"))
    root = scratch_path(spark, "warc")
    return write_archives(base.join(named, "key"), root), digests, opened


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Pages archived and read back; a revisit's size and digest are those of the
    payload of the response that it names."""
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    return listed_records(pages)


def listed_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``<id> payload_bytes payload_digest record_type refers_to`` of every row, from its
    archived record.

    Ids come back as given, ``refers_to`` is the id of the row whose record is the
    response. Where ids are missing or repeat, the last row in the order of (id, nulls
    last; html; other columns) is the response. Null html is an empty payload, very
    long ones are records of their own, an empty table has no records; further
    columns, also of clashing names, are not read.
    """
    index, _, opened = archived(pages, id_col, url_col, html_col)
    records = read_records(index).select(
        "key", "record_type", "refers", "stated_digest", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("digest")
    )
    records = saved(records)
    responses = records.where("record_type = 'response'").select(F.col("key").alias("of"), F.col("size").alias("of_size"), F.col("digest").alias("of_digest"))
    joined = records.withColumn("of", F.coalesce("refers", "key")).join(responses, "of", "left")
    id_type = opened.df.schema[opened.id].dataType
    if opened.id_is_key:
        page, other = F.col("key").cast(id_type), F.col("refers").cast(id_type)
    else:
        named = opened.df.select("key", F.col(opened.id).alias("page"))
        others = named.select(F.col("key").alias("refers"), F.col("page").alias("other"))
        joined = joined.join(named, "key").join(others, "refers", "left")
        page, other = F.col("page"), F.col("other")
    return joined.select(
        page.alias(id_col),
        F.col("of_size").alias("payload_bytes"),
        F.col("of_digest").alias("payload_digest"),
        "record_type",
        other.alias("refers_to"),
    )


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
  d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest FROM p),
  l AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN last END AS refers_to FROM l
"""
