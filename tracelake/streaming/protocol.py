"""Frames of the wire protocol: an 18-byte prefix, a header of canonical JSON, a payload.

The prefix is magic (4 bytes), major and minor version, kind (2), flags (2), length of the header (4) and of the payload
(4), big-endian. Lengths are checked before a body is awaited. Where a frame ends after an error can't be
known, so an error stops its stream until a reset.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codecs import canonical_json, parse_strict
from ..sources.checkpoints import cut
from ..sources.ordered import running
from .segments import CHUNKS, byte_ranges, each_range, entries, joined

#: Message kinds by code, and the greatest lengths of header and payload (fixed values).
KINDS = {1: "hello", 2: "status", 3: "command", 4: "mission", 5: "trace", 6: "ack", 7: "inventory", 8: "error"}
PREFIX = 18
MAX_HEADER, MAX_PAYLOAD = 1 << 20, 64 << 20


def kind_name(code: Column) -> Column:
    """The name of a kind's code; null for unknown codes."""
    return F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))[code.cast("int")]


def _next(buffer: bytes, at: int, length: int, magic: bytes, major: int) -> tuple[int, str | None, str | None]:
    """Of the frame at ``at`` in a stream of ``length`` bytes: its end, its header and the error that stops the stream; end -1: not whole yet.

    ``buffer`` holds the prefix and the header where these are whole.
    """
    if length - at < PREFIX:
        return -1, None, None
    number = lambda a, b: int.from_bytes(buffer[at + a : at + b], "big")
    head, body = number(10, 14), number(14, 18)
    for broken, error in ((buffer[at : at + 4] != magic, "bad_magic"), (head > MAX_HEADER, "header_length"), (body > MAX_PAYLOAD, "payload_length")):
        if broken:
            return at, None, error
    end = at + PREFIX + head + body
    if end > length:
        return -1, None, None
    text = buffer[at + PREFIX : at + PREFIX + head]
    try:
        canonical = canonical_json(parse_strict(text.decode("ascii"))).encode() == text
    except ValueError:
        canonical = False
    for broken, error in ((buffer[at + 4] != major, "version"), (number(6, 8) not in KINDS, "unknown_kind"), (number(8, 10) != 0, "flags"), (not canonical, "bad_header")):
        if broken:
            return at, None, error
    return end, text.decode(), None


def split_frames(buffer: bytes, magic: bytes, major: int = 1) -> tuple[list[tuple], bytes, str | None]:
    """Whole frames (kind, header, payload), what is left, and the error that stops the stream."""
    out, at = [], 0
    while True:
        end, header, error = _next(buffer, at, len(buffer), magic, major)
        if error:
            return out, b"", error
        if end < 0:
            return out, buffer[at:], None
        out.append((KINDS[int.from_bytes(buffer[at + 6 : at + 8], "big")], header, buffer[at + PREFIX + len(header) : end]))
        at = end


_OUT = "stream long, n long, kind string, header string, payload binary, error string"


def _feed(stream: int, chunks: pd.DataFrame, left: bytes, error: str | None, n: int, magic: bytes) -> tuple[pd.DataFrame, bytes, str | None, int]:
    rows, held = [], [left]

    def drain() -> bytes:
        nonlocal error, n
        if error:
            return b""
        got, rest, error = split_frames(b"".join(held), magic)
        for kind, header, payload in got:
            rows.append((stream, n, kind, header, payload, None))
            n += 1
        if error:
            rows.append((stream, n, None, None, None, error))
            n += 1
        return rest

    for data, reset in zip(chunks["data"], chunks["reset"], strict=True):
        if reset:
            drain()
            held, error = [], None
        held.append(data or b"")
    left = drain()
    return pd.DataFrame(rows, columns=[x.split()[0] for x in _OUT.split(", ")]), left, error, n


#: Bytes of a stream that one task parses; the longest frame.
RANGE_BYTES, MOST = 8 << 20, PREFIX + MAX_HEADER + MAX_PAYLOAD


def _pack(length: int, keys: np.ndarray, exits: np.ndarray) -> bytes:
    return np.concatenate([[length], keys, exits]).astype(np.int64).tobytes()


def _unpack(f: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    x = np.frombuffer(f, np.int64)
    n = (len(x) - 1) // 2
    return int(x[0]), x[1 : 1 + n], x[1 + n :]


def _applied(f: bytes, entry: np.ndarray) -> np.ndarray:
    """Where entries leave: those behind the range pass it, those at one of its frames go where that leads, any other stops (-1)."""
    length, keys, exits = _unpack(f)
    keys, exits = np.append(keys, length), np.append(exits, -1)
    k = np.minimum(np.searchsorted(keys, entry), len(keys) - 1)
    return np.where(entry >= length, entry - length, np.where(keys[k] == entry, exits[k], -1))


def _composed(f: bytes, g: bytes) -> bytes:
    """f, then g. A frame's length is bounded, so only frames near the beginning can ever be entered."""
    (nf, kf, xf), (ng, kg, xg) = _unpack(f), _unpack(g)
    keys, exits = np.concatenate([kf, kg + nf]), np.concatenate([np.where(xf >= 0, _applied(g, xf), -1), xg])
    return _pack(nf + ng, keys[keys <= MOST], exits[keys <= MOST])


def frames(chunks: DataFrame, magic: bytes, major: int = 1, range_bytes: int | None = None) -> DataFrame:
    """``chunks(stream, seq, data, reset)`` to ``(stream, n, kind, header, payload, error)``.

    Each stream is parsed as if it were read from its start, however it is cut in chunks. An error is a row of its own,
    and what follows it is dropped up to the next chunk with ``reset``, which also drops an unfinished frame: what lies
    between resets is parsed apart. It is cut in ranges of bytes that tasks read apart: where there are several, each
    first tells, for every place in it that may begin a frame, where the frames from there leave it; composed, that
    tells where each range is entered. A frame over several ranges is put together last. Rows without a stream are left out.
    """
    size, key = range_bytes or RANGE_BYTES, ["stream", "part"]
    opened = running(chunks.where("stream is not null"), ["stream"], ["seq"], CHUNKS, {"part": F.when(F.col("reset"), 1)})
    opened = opened.withColumn("part", F.col("part") + F.when(F.col("reset"), 1).otherwise(0)).withColumn("data", F.coalesce("data", F.lit(b"")))
    length = opened.groupBy(*key).agg(F.sum(F.octet_length("data")).cast("long").alias("length"))
    pieces = cut(byte_ranges(opened, key, size, PREFIX + MAX_HEADER).join(length, key))

    def leads(t: pa.Table) -> pa.Table:
        data, left = joined(t), t["length"][0].as_py() - t["r"][0].as_py() * size
        to, at = {}, data.find(magic)
        while 0 <= at < size:
            end, _, error = _next(data, at, left, magic, major)
            to[at] = -1 if error else end
            at = data.find(magic, at + 1)
        for at in sorted(to, reverse=True):  # within the range, on to where the next one leads
            end = to[at]
            to[at] = end if end < 0 else end - size if end >= size else to.get(end, -1)
        keys = np.array(sorted(to), np.int64)
        return pa.table({"stream": t["stream"][:1], "part": t["part"][:1], "r": t["r"][:1], "f": pa.array([_pack(size, keys, np.array([to[k] for k in keys.tolist()], np.int64))], pa.binary())})

    text, number = ("string", pa.string()), ("long", pa.int64())
    fields = {"i": number, "kind": text, "header": text, "error": text, "ends": number, "body": number, "whole": ("boolean", pa.bool_()), "payload": ("binary", pa.binary())}

    def read(r: int, data: bytes, at: int, length: int) -> list[tuple]:
        left, base = length - r * size, r * size
        rows, i = [], 0
        if at > 0:  # the rest of a frame that an earlier range began
            rows.append((-1, None, None, None, base + at, base, False, data[: min(at, size)]))
        while 0 <= at < min(size, left):
            end, header, error = _next(data, at, left, magic, major)
            if error:
                rows.append((i, None, None, error, None, None, True, None))
            if error or end < 0:
                break
            body = at + PREFIX + len(header)
            rows.append((i, KINDS[int.from_bytes(data[at + 6 : at + 8], "big")], header, None, base + end, base + body, end <= size, data[body : min(end, max(size, body))]))
            at, i = end, i + 1
        return rows

    long = pieces.where(F.col("r") > 0).select(*key).distinct()
    functions = cut(pieces.join(long, key, "left_semi").groupBy(*key, "r").applyInArrow(leads, "stream long, part long, r long, f binary"))
    at = entries(functions, key, _composed, lambda f, e: int(_applied(f, np.array([e]))[0]))
    rows = cut(each_range(pieces, at, key, read, fields, ("length",)))
    # a frame over several ranges: what each of them holds of it, less what of its header lies there
    whole, parts = rows.where("i >= 0"), rows.where("not whole").select(*key, "ends", F.struct("r", "i", F.col("body").alias("from"), "payload").alias("x"))
    met = parts.groupBy(*key, "ends").agg(F.array_sort(F.collect_list("x")).alias("parts"))
    rest = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, F.substring(x["payload"], (F.greatest(F.lit(0), F.col("body") - x["from"]) + 1).cast("int"), F.octet_length(x["payload"]))))
    whole = whole.join(met, [*key, "ends"], "left").withColumn("payload", F.when(F.col("whole"), F.col("payload")).otherwise(rest))
    counts = whole.groupBy(*key, "r").agg(F.count("*").alias("count"))
    before = running(counts, ["stream"], ["part", "r"], CHUNKS, {"before": F.col("count")}).drop("count")
    return whole.join(before, [*key, "r"]).select("stream", (F.col("before") + F.col("i")).alias("n"), "kind", "header", "payload", "error")


def frames_stream(chunks: DataFrame, magic: bytes) -> DataFrame:
    """The same for a stream; the state is what is left and the error. Chunks of one trigger are put in order by seq."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        left, error, n = state.get if state.exists else (b"", None, 0)
        out, left, error, n = _feed(key[0], pd.concat(list(pdfs)).sort_values("seq"), bytes(left), error, n, magic)
        state.update((left, error, n))
        yield out

    return chunks.groupBy("stream").applyInPandasWithState(run, _OUT, "left binary, error string, n long", "append", GroupStateTimeout.NoTimeout)


def bound_decode(traces: DataFrame, missions: DataFrame, digest: Column) -> DataFrame:
    """``traces`` with ``verdict``: accepted, unknown_mission, channels, axis or hash, the first that fails.

    ``traces(mission_id, channels, axis, hash, ...)`` carry a digest, which is compared with ``digest``, computed from
    what was received; ``missions(mission_id, channels, axis)`` are the configurations they are bound to.
    """
    m = missions.select("mission_id", F.col("channels").alias("channels_"), F.col("axis").alias("axis_"))
    j = traces.withColumn("digest_", digest).join(m, "mission_id", "left")
    verdict = F.when(F.col("channels_").isNull(), "unknown_mission").when(~F.col("channels").eqNullSafe(F.col("channels_")), "channels").when(~F.col("axis").eqNullSafe(F.col("axis_")), "axis").when(~F.col("hash").eqNullSafe(F.col("digest_")), "hash").otherwise("accepted")
    return j.withColumn("verdict", verdict).drop("channels_", "axis_", "digest_")
