"""Byte streams: packets, datapoints, sweeps and health, as batch operators and as stateful streams."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.checkpoints import cut
from ..sources.ordered import running
from .segments import byte_ranges, each_range, entries, joined, numbered

#: Framing (fixed values): first byte, least and largest length, type without checksum.
HEADER, LEAST, MOST, DATAPOINT = 0x5A, 8, 4096, 27
#: Rows, and nanoseconds, of a stream that one task looks at.
RANGE_ROWS, RANGE_NS = 100_000, 86_400_000_000_000


#: Bytes of a stream that one task deframes.
RANGE_BYTES = 4 << 20


def packets_from(buffer: bytes, at: int = 0, stop: int | None = None) -> tuple[list[tuple[int, bytes]], int]:
    """Whole packets that begin in [at, stop), and where the next one may begin: noise is skipped, an impossible length or a bad checksum realigns."""
    out, stop = [], len(buffer) if stop is None else stop
    while at < stop:
        at = buffer.find(HEADER, at, stop)
        if at < 0:
            return out, stop
        if len(buffer) - at < 4:
            return out, at
        (size,) = struct.unpack_from("<H", buffer, at + 1)
        if not LEAST <= size <= MOST:
            at += 1
            continue
        if len(buffer) - at < size:
            return out, at
        raw = buffer[at : at + size]
        at += size
        if raw[3] == DATAPOINT or struct.unpack("<I", raw[-4:])[0] == zlib.crc32(raw[:-4]):
            out.append((raw[3], raw[4:-4]))
    return out, at


def split_packets(buffer: bytes) -> tuple[list[tuple[int, bytes]], bytes]:
    """Whole packets of a buffer and what is left."""
    out, at = packets_from(buffer)
    return out, buffer[at:]


def passage(data: bytes, size: int) -> np.ndarray:
    """For each offset below ``MOST`` at which a range of ``size`` bytes may be entered, the offset at which the next range is.

    ``data`` goes on for at least two bytes behind the range, where the stream does. Where a header leads depends on its length alone, so the headers' jumps are followed all at once,
    twice as far each time.
    """
    x = np.frombuffer(data, np.uint8)
    size = min(size, max(0, len(x) - 2))
    length = x[1 : size + 1].astype(np.int64) | x[2 : size + 2].astype(np.int64) << 8
    heads = np.flatnonzero((x[:size] == HEADER) & (length >= LEAST) & (length <= MOST))
    end = heads + length[heads]
    after = np.append(np.searchsorted(heads, end), len(heads))
    leave = np.append(np.maximum(end - size, 0), 0)  # the last one stands for no header: noise up to the end
    jump = np.where(np.append(end < size, False), after, np.arange(len(heads) + 1))
    while (further := jump[jump]).tolist() != jump.tolist():
        jump = further
    entry = np.arange(MOST)
    out = leave[jump[np.searchsorted(heads, entry)]]
    return np.where(entry >= size, entry - size, out).astype(np.int16)


def packet(kind: int, payload: bytes) -> bytes:
    body = struct.pack("<BHB", HEADER, len(payload) + 8, kind) + payload
    return body + struct.pack("<I", zlib.crc32(body))


def packets(chunks: DataFrame, range_bytes: int | None = None) -> DataFrame:
    """``chunks(stream, seq, data)`` to ``(stream, n, kind, payload)``: the packets of each stream in order, as if it were read from its start.

    A stream is cut in ranges of bytes that tasks read apart. Of a stream with several, each range first gives its
    ``passage``; composed, these say where the first packet of each range begins, and so ranges are deframed in
    parallel. Rows without a stream are left out.
    """
    size = max(range_bytes or RANGE_BYTES, MOST)
    pieces = cut(byte_ranges(chunks.where("stream is not null"), ["stream"], size, MOST + 3))
    long = pieces.where(F.col("r") > 0).select("stream").distinct()

    def pass_(t: pa.Table) -> pa.Table:
        return pa.table({"stream": t["stream"][:1], "r": t["r"][:1], "f": pa.array([passage(joined(t), size).tobytes()], pa.binary())})

    def read(r: int, data: bytes, entry: int) -> list[tuple]:
        return [(i, *p) for i, p in enumerate(packets_from(data, entry, min(size, len(data)))[0])]

    functions = cut(pieces.join(long, "stream", "left_semi").groupBy("stream", "r").applyInArrow(pass_, "stream long, r long, f binary"))
    view = lambda f: np.frombuffer(f, np.int16)
    at = entries(functions, ["stream"], lambda f, g: view(g)[view(f)].tobytes(), lambda f, e: int(view(f)[e]))
    rows = each_range(pieces, at, ["stream"], read, {"i": ("long", pa.int64()), "kind": ("int", pa.int32()), "payload": ("binary", pa.binary())})
    return numbered(cut(rows), ["stream"]).select("stream", "n", "kind", "payload")


def packets_stream(chunks: DataFrame) -> DataFrame:
    """The same for a stream: what is left of a buffer is the state. Chunks of one trigger are put in order by seq."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        left, n = state.get if state.exists else (b"", 0)
        got, left = split_packets(bytes(left) + b"".join(pd.concat(list(pdfs)).sort_values("seq")["data"]))
        state.update((left, n + len(got)))
        yield pd.DataFrame({"stream": key[0], "n": range(n, n + len(got)), "kind": [k for k, _ in got], "payload": [p for _, p in got]})

    return chunks.groupBy("stream").applyInPandasWithState(run, "stream long, n long, kind int, payload binary", "left binary, n long", "append", GroupStateTimeout.NoTimeout)


def datapoints(rows: DataFrame) -> DataFrame:
    """``payload`` to point number, frequency and receivers, in Arrow batches; a malformed payload has nulls and ``malformed``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p in b["payload"]:
                k, rest = divmod(len(p) - 12, 9)
                if len(p) < 12 or rest:
                    out.append((None, None, None, True))
                    continue
                f, _, point = struct.unpack_from("<QhH", p, 0)
                re, im, desc = struct.unpack_from(f"<{k}f", p, 12), struct.unpack_from(f"<{k}f", p, 12 + 4 * k), p[12 + 8 * k :]
                out.append((point, f, [{"desc": d, "re": x, "im": y} for d, x, y in zip(desc, re, im, strict=True)], False))
            yield pd.DataFrame({"stream": b["stream"], "n": b["n"], "point": pd.array([x[0] for x in out], "Int64"), "frequency": pd.array([x[1] for x in out], "Int64"), "receivers": [x[2] for x in out], "malformed": [x[3] for x in out]})

    return rows.select("stream", "n", "payload").mapInPandas(run, "stream long, n long, point long, frequency long, receivers array<struct<desc: int, re: float, im: float>>, malformed boolean")


def packet_counters(rows: DataFrame) -> DataFrame:
    """Per stream of ``rows(stream, kind, payload)``: packets, those of other kinds than datapoints, datapoints that are malformed."""
    size = F.octet_length("payload")
    mine = F.col("kind") == DATAPOINT
    return rows.groupBy("stream").agg(F.count("*").alias("packets"), F.count_if(~mine).alias("ignored"), F.count_if(mine & ((size < 12) | ((size - 12) % 9 != 0))).alias("malformed"))


def sweeps(points: DataFrame, size: int) -> DataFrame:
    """Strict assembly of ``points(stream, n, point)``: (stream, sweep, first_n, points, complete).

    A point 0 opens a sweep; only 0..size-1 in order completes it, and anything else, a null included, drops it.
    """
    opens = F.col("point") == 0
    df = running(points.select("stream", "n", "point"), ["stream"], ["n"], RANGE_ROWS, {"opened": F.when(opens, 1)}, {"before": F.struct("point")})
    df = df.withColumn("sweep", F.col("opened") + F.when(opens, 1).otherwise(0)).where("sweep > 0")
    broken = F.coalesce(~opens & (F.col("point") != F.col("before.point") + 1), F.lit(True))
    # in order up to the first break: the first last point must come before it; what follows a whole sweep, up to the next point 0, is a drop of its own
    got = df.groupBy("stream", "sweep").agg(F.min("n").alias("first_n"), F.count("*").alias("points"), F.min(F.when(broken, F.col("n"))).alias("bad"), F.min(F.when(F.col("point") == size - 1, F.col("n"))).alias("done"))
    return got.select("stream", "sweep", "first_n", "points", F.coalesce(F.col("done") < F.coalesce("bad", F.col("done") + 1), F.lit(False)).alias("complete"))


def sweeps_stream(points: DataFrame, size: int) -> DataFrame:
    """For a stream of ``points(stream, n, point)``: whole sweeps ``(stream, sweep, first_n)`` as soon as they are complete.

    Sweeps have the numbers that ``sweeps`` gives them. Points of one trigger are put in order by n; the state is two numbers and a flag.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sweep, first, want = state.get if state.exists else (0, 0, -1)  # the point that must follow; -1: wait for a point 0
        out = []
        rows = pd.concat(list(pdfs)).sort_values("n")
        for n, point in zip(rows["n"].tolist(), rows["point"].tolist(), strict=True):
            if point == 0:
                sweep, first, want = sweep + 1, n, 1
            else:
                want = want + 1 if point == want else -1
            if want == size:
                out.append((key[0], sweep, first))
                want = -1
        state.update((sweep, int(first), want))
        yield pd.DataFrame(out, columns=["stream", "sweep", "first_n"])

    return points.groupBy("stream").applyInPandasWithState(run, "stream long, sweep long, first_n long", "sweep long, first_n long, want long", "append", GroupStateTimeout.NoTimeout)


def sweep_timeouts(points: DataFrame, size: int, timeout_ms: int) -> DataFrame:
    """Of ``points(stream, n, at_ms, point)``: the sweeps that a deadline ends, ``(stream, sweep, first_n, started_ms, last_ms)``.

    A point 0 opens a sweep. The deadline is looked at before each later point and at the end of the stream's rows (a
    point of null is a mere tick): a sweep that is not whole ``timeout_ms`` after its start, the very moment included, is dropped.
    """
    opens = F.col("point") == 0
    df = running(points.select("stream", "n", "at_ms", "point"), ["stream"], ["n"], RANGE_ROWS, {"opened": F.when(opens, 1)}, {"before": F.col("point"), "since": F.when(opens, F.col("at_ms"))})
    df = df.withColumns({"sweep": F.col("opened") + F.when(opens, 1).otherwise(0), "started": F.when(opens, F.col("at_ms")).otherwise(F.col("since"))}).where("sweep > 0")
    ends = F.coalesce(~opens & (F.col("point") != F.col("before") + 1), F.lit(False)) | F.coalesce(F.col("point") == size - 1, F.lit(False))
    due = F.col("at_ms") - F.col("started") >= timeout_ms
    got = df.groupBy("stream", "sweep").agg(F.min("n").alias("first_n"), F.min_by("started", "n").alias("started_ms"), F.min(F.when(ends, F.col("n"))).alias("end"), F.min(F.when(due, F.struct("n", "at_ms"))).alias("due"))
    # active until the sweep is whole or broken by a point out of order, that point included
    return got.where("due is not null and (end is null or due.n <= end)").select("stream", "sweep", "first_n", "started_ms", F.col("due.at_ms").alias("last_ms"))


def receiver_plan(receivers, stage: int, port: int):
    """True where exactly one finite receiver holds the slot: its stage in bits 5-7, reference in bit 4, ports below."""
    fits = lambda r: (F.shiftright(r["desc"], 5) == stage) & (r["desc"].bitwiseAND(F.lit(16 if port == 0 else 1 << (port - 1))) != 0) & ((r["desc"].bitwiseAND(F.lit(16)) == 0) if port else F.lit(True)) & ~F.isnan(r["re"]) & ~F.isnan(r["im"])
    return F.size(F.filter(receivers, fits)) == 1


def health(events: DataFrame, stale_ns: int) -> DataFrame:
    """State of a receiver at each of ``events(stream, at, kind)``: kinds valid, invalid, sentence, connect, disconnect, tick."""
    kind = F.col("kind")
    marks = {"link": kind.isin("connect", "disconnect"), "fix": kind == "valid", "heard": kind.isin("invalid", "valid", "sentence")}
    mark = {n: F.when(c, F.struct("at", "seq", "kind")) for n, c in marks.items()}
    df = running(events.select("stream", "at", "seq", "kind"), ["stream"], ["at", "seq"], RANGE_NS, lasts=mark)
    df = df.withColumns({n: F.coalesce(c, F.col(n)) for n, c in mark.items()}).where("link is not null")
    since = lambda c: F.struct(f"{c}.at", f"{c}.seq") > F.struct("link.at", "link.seq")
    fix, heard = F.coalesce(since("fix"), F.lit(False)), F.coalesce(since("heard"), F.lit(False))
    state = F.when(F.col("link.kind") == "disconnect", "disconnected").when(fix, F.when(F.col("at") - F.col("fix.at") > stale_ns, "stale").otherwise("valid")).when(heard & (F.col("heard.kind") == "invalid"), "invalid").when(heard, "no_fix").otherwise("no_sentence")
    return df.select("stream", "at", "seq", "kind", state.alias("state"))


def health_stream(events: DataFrame, stale_ns: int) -> DataFrame:
    """The same for a stream; the state of a receiver is its link, its last valid fix, and what came since it was connected."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        link, fix, heard = state.get if state.exists else (None, None, None)
        out = []
        rows = pd.concat(list(pdfs)).sort_values(["at", "seq"])
        for at, seq, kind in zip(rows["at"].tolist(), rows["seq"].tolist(), rows["kind"].tolist(), strict=True):
            if kind in ("connect", "disconnect"):
                link, fix, heard = kind, None, None
            elif kind in ("valid", "invalid", "sentence"):
                heard = kind
                fix = at if kind == "valid" else fix
            if link is None:
                continue
            if link == "disconnect":
                now = "disconnected"
            elif fix is not None:
                now = "stale" if at - fix > stale_ns else "valid"
            else:
                now = {None: "no_sentence", "invalid": "invalid"}.get(heard, "no_fix")
            out.append((key[0], at, seq, kind, now))
        state.update((link, fix, heard))
        yield pd.DataFrame(out, columns=["stream", "at", "seq", "kind", "state"])

    return events.groupBy("stream").applyInPandasWithState(run, "stream long, at long, seq long, kind string, state string", "link string, fix long, heard string", "append", GroupStateTimeout.NoTimeout)
