"""WARC archives: index first, then coalesced range reads.

``write`` appends one gzip member per page to archives in a shared folder, and gives an index
with each record's archive, offset, length, URL and payload digest. ``read`` takes any
selection of index rows, sorts it by archive and offset, joins records that lie close
together into byte ranges, and reads each range once.

* Of pages with equal payloads of at least ``least`` bytes, that with the smallest page_id is
  a response and the others are revisits of it, without a payload. Smaller payloads are
  always responses.
* A null html is an empty payload; a null url is left out of the record. Pages without an id
  are never referred to; a group of them alone are responses. Repeated rows are repeated, and
  where they have the smallest page_id all of them are responses.
* An empty table makes an empty index and no archive. Other columns are not read.
* An archive's name holds the attempt that wrote it, and only the index of attempts that
  ended well is kept; so a lost executor leaves a file that nothing names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.llm.common import shared_path, texts_of, written

#: Bytes after which a new archive begins, and those that one range read spans at most (its last record aside).
ARCHIVE_BYTES, RANGE_BYTES = 1 << 30, 8 << 20
#: Unwanted bytes between two records that are still read together.
GAP_BYTES = 64 << 10
#: Ways in which pages with one payload are spread when they look for their response.
SPREAD = 16

INDEX = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, archive string, offset long, length long"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP headers, whose Content-Length is the full payload's."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(member: bytes) -> dict:
    """Headers, payload and sizes of a record; the payload of a response is held against its digest."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record here: {lines[0][:40]!r}")
    own = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(own["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = own["WARC-Payload-Digest"].removeprefix("sha1:")
    if own["WARC-Type"] == "response" and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"payload of {own['WARC-Record-ID']} differs from its digest")
    number = lambda key: int(n) if (n := own.get(key, "").removeprefix("<urn:page:").removesuffix(">")) else None
    return {"page_id": number("WARC-Record-ID"), "url": own.get("WARC-Target-URI"), "record_type": own["WARC-Type"], "refers_to": number("WARC-Refers-To"), "payload_digest": digest, "payload_bytes": size, "payload": payload if own["WARC-Type"] == "response" else None}


def with_responses(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html and refers_to: the page whose payload this one repeats, or null."""
    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    own = own.withColumn("digest", F.unhex(F.sha1(F.encode("html", "UTF-8")))).withColumn("spread", F.pmod(F.xxhash64("page_id"), F.lit(SPREAD)).cast("int"))
    firsts = own.where(F.octet_length("html") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1 and first is not null")
    firsts = written(firsts.select("digest", "first"), "responses").withColumn("spread", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return own.join(firsts, ["digest", "spread"], "left").select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Archives of ``pages`` in ``folder``, a URI that all executors can write to, and their index."""
    names = [x.split()[0] for x in INDEX.split(", ")]

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root)
        stream, name, at, n = None, "", 0, 0
        for b in batches:
            rows = []
            for page_id, url, payload, refers_to in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b.column(2)), b.column(3).to_pylist(), strict=True):
                if stream is None or at > ARCHIVE_BYTES:
                    if stream:
                        stream.close()
                    name, at, n = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{n:04d}.warc.gz", 0, n + 1
                    stream = store.open_output_stream(f"{root}/{name}", compression=None)
                digest = digest_of(payload)
                member = gzip.compress(record(page_id, url, payload, refers_to, digest), 6, mtime=0)
                stream.write(member)
                rows.append((page_id, url, "response" if refers_to is None else "revisit", refers_to, digest, len(payload), name, at, len(member)))
                at += len(member)
            if rows:
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        if stream:
            stream.close()

    return written(with_responses(pages, least).mapInArrow(archive, INDEX), "warc-index")


def ranges(index: DataFrame) -> DataFrame:
    """(archive, start, end, records): byte ranges that hold the records of ``index``, which lie within them."""
    by_place = Window.partitionBy("archive").orderBy("offset")
    before = F.lag(F.col("offset") + F.col("length")).over(by_place)
    apart = (before.isNull() | (F.col("offset") - before > GAP_BYTES) | (F.floor(F.col("offset") / RANGE_BYTES) != F.floor(F.lag("offset").over(by_place) / RANGE_BYTES))).cast("int")
    grouped = index.withColumn("apart", apart).withColumn("range", F.sum("apart").over(by_place)).groupBy("archive", "range")
    return grouped.agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"))


READ = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def read(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that ``index`` names, from the archives in ``folder``; ``payload`` is null for revisits, or if not wanted."""
    names = [x.split()[0] for x in READ.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for row in b.to_pylist():
                with store.open_input_file(f"{root}/{row['archive']}") as file:
                    data = file.read_at(row["end"] - row["start"], row["start"])
                found = []
                for r in row["records"]:
                    at = r["offset"] - row["start"]
                    own = parsed(zlib.decompress(data[at : at + r["length"]], wbits=31))
                    found.append([own[k] if payloads or k != "payload" else None for k in names])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

    # ranges are few rows that stand for many bytes: they are dealt by number, a few to a task
    wanted = written(ranges(index), "warc-ranges")
    n, size = wanted.agg(F.count("*"), F.sum(F.col("end") - F.col("start"))).first()
    tasks = max(1, min(n, max(index.sparkSession.sparkContext.defaultParallelism, -(-(size or 0) // (4 * RANGE_BYTES)))))
    return wanted.repartition(tasks, "archive", "start").mapInArrow(fetch, READ)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes all ``pages`` to archives and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    folder = shared_path(pages.sparkSession, "warc")
    index = write(pages, folder, least)
    return read(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH hashed AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS hex FROM pages),
fives AS (SELECT page_id, n, [CAST('0x' || substr(hex, 5 * i + 1, 5) AS BIGINT) for i in range(0, 8)] AS v FROM hashed),
letters AS (SELECT page_id, n, [[(x >> s) & 31 for s in [15, 10, 5, 0]] for x in v] AS w FROM fives),
coded AS (SELECT page_id, n, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(c AS INTEGER) + 1, 1) for c in flatten(w)], '') AS digest FROM letters),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM coded)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM firsts
"""
