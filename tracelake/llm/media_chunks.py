"""Media columns in content-defined chunks.

A text's payload is its UTF-8 bytes with zero bytes up to a positive multiple of 64, stored as the 8-bit mono
samples of a WAV file. The file is cut where a rolling gear hash of the last 32 bytes has its upper bits zero, so
an edit moves only the cuts near it. The header follows from the number of samples, so only samples are in chunks.
The chunk store holds each different chunk once: digests (rows without bytes) are joined to find the first file
with each chunk, and only those chunks' bytes pass on, to a table bucketed by digest, with buckets of bounded
size. A media row is the ordered list of its chunk digests.

Reading back joins the lists with the store on the digest, puts the chunks of each file in order, and verifies the
digest of every chunk and file before any feature is computed. Equal files are one list, however many rows share
it. The store is written and read in rounds, so the shuffle of one round, not of all bytes, is on disk beside it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .textops import byte_blocks

#: Sizes of chunks, in bytes: none smaller but the last, none larger, and the mean distance of cuts.
LEAST, MEAN, MOST = 512, 2048, 16384
#: Rounds in which the store is written and read back.
ROUNDS = 5
#: Text bytes for each bucket of the store.
BUCKET_BYTES = 64 << 20
_GEAR = np.random.RandomState(20240229).randint(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
RATE = 8000


def wav(payload: bytes) -> bytes:
    """A WAV file of 8-bit mono samples."""
    n = len(payload)
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n) + payload


def samples(media: bytes) -> bytes:
    """The samples of such a file."""
    (n,) = struct.unpack("<I", media[40:44])
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or media[36:40] != b"data" or len(media) != 44 + n:
        raise ValueError("not a WAV file of ours")
    return media[44:]


def padded(text: bytes) -> bytes:
    return text + bytes(max(1, -(-len(text) // 64)) * 64 - len(text))


def cut_points(data: np.ndarray) -> np.ndarray:
    """Ends of content-defined chunks of a payload; the gear hash of all positions comes from five doubling steps."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    places = np.flatnonzero(h >> np.uint32(32 - (MEAN.bit_length() - 1)) == 0) + 1
    ends, start, n = [], 0, len(data)
    while n - start > LEAST:
        k = np.searchsorted(places, start + LEAST)
        end = min(int(places[k]) if k < len(places) else n, start + MOST, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return np.array(ends)


def chunks(payload: bytes) -> list[bytes]:
    """The content-defined chunks of the samples."""
    ends = cut_points(np.frombuffer(payload, np.uint8)).tolist()
    return [payload[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _payloads(column: pa.Array) -> Iterator[tuple[int, int, bytes]]:
    for i, j, data, offs in byte_blocks(column):
        data = data.tobytes()
        for r in range(i, j):
            text = data[offs[r - i] : offs[r - i + 1]]
            yield r, len(text), padded(text)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, sha, digests, sizes = [], [], [], []
        for _, size, payload in _payloads(batch.column(1)):
            parts, media = chunks(payload), wav(payload)
            n.append(size)
            sha.append(hashlib.sha256(media).digest())
            digests.append([hashlib.sha256(c).digest() for c in parts])
            sizes.append(len(media))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.binary()), pa.array(sizes, pa.int64()), pa.array(digests, pa.list_(pa.binary()))], names=["doc_id", "n_bytes", "media", "size", "digests"])


def _bytes(rounds: int, number: int):
    """The chunks of one round, each once a task as far as it remembers, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=3, write_checksum=False)
        for batch in batches:
            rows: dict[tuple[bytes, bytes], bytes] = {}
            for _, _, payload in _payloads(batch.column(0)):
                sha = None
                for part in chunks(payload):
                    d = hashlib.sha256(part).digest()
                    if d[0] % rounds == number:
                        sha = sha or hashlib.sha256(wav(payload)).digest()
                        rows[d, sha] = part
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in rows], pa.binary()), pa.array([k[1] for k in rows], pa.binary()), pa.array([c.compress(v) for v in rows.values()], pa.binary())], names=["digest", "media", "data"])

    return run


def feature_of(payload: bytes) -> str:
    """Level, loudness, sign changes and a histogram of the samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    bins = np.bincount((x + 128) >> 4, minlength=16)
    return f"mean={int(x.sum() * 1000 // len(x))};energy={int((x * x).sum())};turns={int(((x[1:] >= 0) != (x[:-1] >= 0)).sum())};bins={','.join(map(str, bins.tolist()))}"


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = zstandard.ZstdDecompressor()
    for batch in batches:
        out = {x: [] for x in ("media", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks")}
        for sha, parts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            whole = []
            for p in sorted(parts.as_py(), key=lambda p: p["i"]):
                c = d.decompress(p["data"])
                if hashlib.sha256(c).digest() != p["digest"] or p["i"] != len(whole):
                    raise ValueError(f"chunk {p['i']} of {sha.hex()} is damaged or missing")
                whole.append(c)
            media = wav(b"".join(whole))
            if hashlib.sha256(media).digest() != sha:
                raise ValueError(f"file {sha.hex()} is damaged")
            payload = samples(media)
            for x, v in zip(out, (sha, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), sha.hex(), feature_of(payload), len(whole)), strict=True):
                out[x].append(v)
        types = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))


_READ = "media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks long"


def store_media(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, str]:
    """Write the chunk store; returns the rows (doc_id, n_bytes, media), the lists (media, digests) and the store's table name."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = scratch.keep(docs.mapInArrow(_lists, "doc_id long, n_bytes long, media binary, size long, digests array<binary>"), "media")
    lists = scratch.keep(rows.groupBy("media").agg(F.first("digests").alias("digests")), "lists")
    owner = lists.select("media", F.explode("digests").alias("digest")).groupBy("digest").agg(F.min("media").alias("media"))
    owner = scratch.keep(owner, "owners")
    table, path = f"chunks_{scratch.root.rsplit('-', 1)[1]}", scratch.path("store")
    total = int(rows.agg(F.sum("n_bytes")).first()[0] or 0)
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_BYTES)
    for k in range(ROUNDS):
        part = docs.select("text").mapInArrow(_bytes(ROUNDS, k), "digest binary, media binary, data binary")
        # dealt out as the buckets are, so the bytes are shuffled once more only
        first = part.join(owner, ["digest", "media"], "left_semi").repartition(buckets, "digest").groupBy("digest").agg(F.first("data").alias("data"))
        with scratch.releasing():
            first.write.mode("append").option("path", path).option("compression", "zstd").bucketBy(buckets, "digest").saveAsTable(table)
    return rows, lists, table


def media_report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: n_bytes, and from the stored bytes payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_chunks.

    The store is dropped once it is read back. Null and empty texts have a payload of 64 zero bytes. Equal texts have equal values; repeated rows stay. An empty
    table gives an empty result. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "media")
    rows, lists, table = store_media(docs, scratch)
    store = docs.sparkSession.table(table)
    read = None
    for k in range(ROUNDS):
        own = lists.where(F.pmod(F.hash("media"), F.lit(ROUNDS)) == k).select("media", F.posexplode("digests").alias("i", "digest"))
        parts = own.join(store, "digest").groupBy("media").agg(F.collect_list(F.struct("i", "digest", "data")).alias("parts"))
        part = scratch.keep(parts.mapInArrow(_rebuild, _READ), "read")
        read = part if read is None else read.union(part)
    scratch.drop(store)
    docs.sparkSession.sql(f"DROP TABLE {table}")
    return rows.select("doc_id", "n_bytes", "media").join(read, "media", "left").drop("media")
