"""Dictionary-compressed WARC archives of pages.

A Zstandard dictionary is built from a bounded sample of records (``DICTIONARY_RECORDS`` of the pages whose ids
hash lowest). Each archive starts with a skippable frame that holds the dictionary; each record is a frame of its
own after it, so any record can be decompressed alone. Tasks write archives to the shared folder under names no
other attempt uses and return the names; only archives in that written manifest count, so a task that is run
again leaves at most an unused file.

Records with equal payloads of at least ``REVISIT_BYTES`` bytes: the one with the smallest page_id is a response,
the others revisit it. A record with a null page_id, or one with that smallest id again, is a response.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

REVISIT_BYTES = 100
DICTIONARY_RECORDS, DICTIONARY_BYTES = 400, 64 << 10
#: Compressed bytes after which a task starts its next archive.
ARCHIVE_BYTES = 64 << 20
#: Magic number of the skippable frame with a dictionary (fixed value of the format).
DICTIONARY_MAGIC = 0x184D2A5D
LEVEL = 3


def record(page_id, url, payload: bytes, digest: str, revisits, date: str) -> bytes:
    """One WARC record; a revisit holds the HTTP headers, with the payload's length, but no payload."""
    of = lambda p: f"<urn:uuid:{uuid.uuid4() if p is None else uuid.uuid5(uuid.NAMESPACE_URL, f'page:{p}')}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisits is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if revisits is None else 'revisit'}", f"WARC-Record-ID: {of(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisits is not None:
        head += [f"WARC-Refers-To: {of(revisits)}", f"X-Refers-To-Page-Id: {revisits}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def read_archive(file) -> Iterator[tuple[dict[str, str], bytes]]:
    """WARC headers and content of each record of an open archive, in bounded memory."""
    magic, size = struct.unpack("<II", file.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive does not start with a dictionary frame")
    dictionary = file.read(size)
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
    stream = io.BufferedReader(d.stream_reader(file, read_across_frames=True), 1 << 20)
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not a record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()) != b"\r\n":
            k, _, v = line.decode().rstrip("\r\n").partition(": ")
            head[k] = v
        content = stream.read(int(head["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield head, content


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with the scheme and host of the file system that Hadoop's settings give it, so that all tasks open the same one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/+", "file:///", uri)


def _writer(folder: str, dictionary: bytes, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if d is not None:
            d.precompute_compress(level=LEVEL)
        c = zstandard.ZstdCompressor(level=LEVEL, dict_data=d)
        out, path, n, size, done = None, "", 0, 0, []
        for batch in batches:
            for page_id, url, html, digest, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.zst", 0, 0
                    path, out = f"{folder}/{name}", store.open_output_stream(f"{base}/{name}")
                    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
                frame = c.compress(record(page_id, url, html.encode(), digest, first, date))
                out.write(frame)
                n, size = n + 1, size + len(frame)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n, size))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, scratch: Scratch, *, folder: str | None = None, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write one record for each row of ``pages(page_id, url, html)``; returns the manifest (path with its scheme, records, bytes).

    ``folder`` is where the archives stay, any file system that Arrow knows; without it they go to the scratch folder.

    A null html is an empty payload, a null url leaves the header out. Repeated rows each get a record. An
    empty table gives an empty manifest. Other columns are ignored.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = pages.withColumn("digest", F.sha2("html", 256)).withColumn("n", F.octet_length("html"))
    firsts = keyed.where(F.col("n") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("m")).where("m > 1").select("digest", "least")
    firsts = scratch.keep(firsts, "firsts")  # a table of its own, so that Spark can split the rows of a payload with many copies
    first = F.when((F.col("n") >= REVISIT_BYTES) & (F.col("page_id") > F.col("least")), F.col("least"))
    rows = keyed.join(firsts, "digest", "left").select("page_id", "url", "html", "digest", first.alias("first"))
    ids = [r.page_id for r in pages.select("page_id").where("page_id is not null").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(DICTIONARY_RECORDS).collect()]
    sample = pages.where(F.col("page_id").isin(ids)).dropDuplicates(["page_id"]).collect() if ids else []
    sample.sort(key=lambda r: r.page_id)
    dictionary = build_dictionary([record(r.page_id, r.url, r.html.encode(), hashlib.sha256(r.html.encode()).hexdigest(), None, date) for r in sample])
    folder = _qualified(scratch.spark, folder or scratch.path("warc"))
    store, base = _open(folder)
    store.create_dir(base, recursive=True)
    return scratch.keep(rows.mapInArrow(_writer(folder, dictionary, date), "path string, records long, bytes long"), "manifest")


def _reader():
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, records in zip(batch["path"], batch["records"], strict=True):
                rows, seen = [], 0
                store, place = _open(path)
                with store.open_input_stream(place) as file:
                    for head, content in read_archive(file):
                        at = content.index(b"\r\n\r\n") + 4
                        http = dict(x.split(": ", 1) for x in content[: at - 4].decode().split("\r\n")[1:])
                        kind, digest, payload = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:"), content[at:]
                        n = int(http["Content-Length"])
                        if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != n):
                            raise ValueError(f"{path}: payload {head['WARC-Record-ID']} is damaged")
                        page, of = head.get("X-Page-Id"), head.get("X-Refers-To-Page-Id")
                        rows.append((None if page is None else int(page), n, digest, kind, None if of is None else int(of)))
                        seen += 1
                        if len(rows) == 5000:
                            yield _frame(rows)
                            rows = []
                if seen != records:
                    raise ValueError(f"{path} holds {seen} records, not {records}")
                yield _frame(rows)

    return run


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]).astype({"page_id": "Int64", "refers_to": "Int64"})


def read_archives(manifest: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of every record of the archives, verified."""
    rows = manifest.repartition(max(1, manifest.count()), "path")
    return rows.mapInPandas(_reader(), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back."""
    return read_archives(write_archives(pages, Scratch(pages.sparkSession, "warc")))
