"""One stream in many tasks: packets, lines, frames, sweeps and health are the same however the stream is cut in ranges."""

import json
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelake.sources.ordered import running
from tracelake.streaming import frames, ingest, protocol, segments

MAGIC = b"TLK1"


def dealt(spark, texts, rng, kind="data binary"):
    rows = []
    for stream, text in texts.items():
        at = seq = 0
        while at < len(text):
            n = rng.randrange(1, 400)
            rows.append((stream, seq, text[at : at + n]))
            at, seq = at + n, seq + rng.randrange(1, 3)
    rng.shuffle(rows)
    return spark.createDataFrame(rows, f"stream long, seq long, {kind}").repartition(3)


def noisy(rng, n):
    """Packets among noise that has headers with any length, broken checksums and a piece of a packet at the end."""
    out = b""
    while len(out) < n:
        p = frames.packet(rng.choice([1, 2, 27]), rng.randbytes(rng.choice([0, 3, 40, 900, 4088])))
        out += rng.choice([p, p, p, p[:-1] + bytes([p[-1] ^ 1]), rng.randbytes(7), b"\x5a" * rng.randrange(5), b"\x5a" + struct.pack("<H", rng.randrange(1, 9000)), p[: len(p) // 2]])
    return out


def test_packets_in_ranges(spark):
    rng = random.Random(4)
    streams = {1: noisy(rng, 60_000), 2: noisy(rng, 9_000), 3: b"", 4: b"\x5a", 5: frames.packet(1, b"x")}
    df = dealt(spark, streams, rng)
    want = sorted((s, n, k, p) for s, x in streams.items() for n, (k, p) in enumerate(frames.split_packets(x)[0]))
    assert len(want) > 25
    for size in (4096, 16_384):
        got = sorted((r.stream, r.n, r.kind, bytes(r.payload)) for r in frames.packets(df, size).collect())
        assert got == want


def test_passages_compose():
    rng = random.Random(5)
    data = noisy(rng, 40_000)
    size = 6000
    whole = frames.passage(data, 12_000)
    one, two = (frames.passage(data[a : a + size + 4099], size) for a in (0, size))
    assert np.array_equal(two[one], whole)
    _, at = frames.packets_from(data, 0, 12_000)
    assert 12_000 + int(whole[0]) == at


@pytest.mark.parametrize("fan", [2, 3, 64])
def test_entries_whatever_the_fan(spark, fan):
    rng = np.random.default_rng(fan)
    jump = {(k, r): rng.integers(0, 10, 10).astype(np.int16) for k, n in ((1, 23), (2, 1), (3, 9)) for r in range(n)}
    df = spark.createDataFrame([(k, r, f.tobytes()) for (k, r), f in jump.items()], "k long, r long, f binary")
    view = lambda f: np.frombuffer(f, np.int16)
    got = segments.entries(df, ["k"], lambda f, g: view(g)[view(f)].tobytes(), lambda f, e: int(view(f)[e]), fan)
    want, at = {}, {}
    for k, r in sorted(jump):
        want[k, r] = at.get(k, 0)
        at[k] = int(jump[k, r][want[k, r]])
    assert {(x.k, x.r): x.entry for x in got.collect()} == want


def test_lines_in_pieces(spark):
    rng = random.Random(6)
    part = lambda: rng.choice(["ab", "é", "\r", "\n", "\r\n", "", "x" * 200, "y" * 256, "\r\r", " ", "z" * 3000, "\n\n"])
    texts = {s: "".join(part() for _ in range(400)) for s in (1, 2, 3)}
    df = dealt(spark, texts, rng, "text string").unionByName(spark.createDataFrame([(1, -1, None), (None, 1, "lost\n")], "stream long, seq long, text string"))
    want = sorted((s, n, x) for s, text in texts.items() for n, x in enumerate(x.rstrip("\r") for x in text.split("\n")[:-1] if 0 < len(x.rstrip("\r")) <= 256))
    assert sorted((r.stream, r.n, r.line) for r in ingest.lines(df).collect()) == want


def frame(kind=1, header="{}", payload=b"", magic=MAGIC, major=1, flags=0):
    return magic + bytes([major, 0]) + struct.pack(">HHII", kind, flags, len(header), len(payload)) + header.encode() + payload


def test_frames_in_ranges(spark):
    rng = random.Random(7)
    rows, want = [], []
    for stream in range(4):
        seq = n = 0
        for _ in range(4):
            data = b""
            for _ in range(rng.randrange(1, 12)):
                head = json.dumps({"id": rng.randrange(99), "t": "h" * rng.choice([0, 5, 300])}, separators=(",", ":"))
                data += frame(rng.randrange(1, 9), head, rng.choice([b"", MAGIC + b"fake", rng.randbytes(rng.randrange(900)), frame(2)]))
            data += rng.choice([b"", frame(major=3), frame(magic=b"NOPE") + frame(), frame()[:-1], frame(1, "{}", b"x" * 50)[:40], frame(header='{"b":1,"a":1}')])
            got, _, error = protocol.split_frames(data, MAGIC)
            for kind, header, payload in got:
                want.append((stream, n, kind, header, payload, None))
                n += 1
            if error:
                want.append((stream, n, None, None, None, error))
                n += 1
            at, first = 0, True
            while at < len(data):
                size = rng.randrange(1, 120)
                rows.append((stream, seq, data[at : at + size], first))
                at, seq, first = at + size, seq + 1, False
    rng.shuffle(rows)
    df = spark.createDataFrame([*rows, (None, 1, b"x", False)], "stream long, seq long, data binary, reset boolean").repartition(3)
    for size in (300, 1 << 23):
        got = [(r.stream, r.n, r.kind, r.header, None if r.payload is None else bytes(r.payload), r.error) for r in protocol.frames(df, MAGIC, range_bytes=size).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("size", [1, 3, 50, 10_000])
def test_running_values_however_cut(spark, size):
    rng = random.Random(size)
    rows = [(k, x, rng.choice([None, 1, 2, 5])) for k in ("a", None) for x in sorted(rng.sample(range(-40, 90), 40))]
    got = running(spark.createDataFrame(rows, "k string, x long, v long").repartition(3), ["k"], ["x"], size, {"sum": F.col("v")}, {"last": F.col("v")})
    have, want = {}, set()
    for k, x, v in rows:
        s, last = have.get(k, (0, None))
        want.add((k, x, v, s, last))
        have[k] = (s + (v or 0), last if v is None else v)
    assert {tuple(r) for r in got.select("k", "x", "v", "sum", "last").collect()} == want


def test_sweeps_timeouts_and_health_however_cut(spark, monkeypatch):
    rng = random.Random(9)
    points = [(s, n, 10 * n + rng.randrange(10), rng.choice([0, 1, 2, 3, None]) if rng.random() < 0.4 else n % 4) for s in (1, 2) for n in range(200)]
    df = spark.createDataFrame(points, "stream long, n long, at_ms long, point long")
    events = spark.createDataFrame([(s, 10 * (n // 3), n, rng.choice(["valid", "invalid", "sentence", "connect", "disconnect", "tick"])) for s in (1, 2) for n in range(150)], "stream long, at long, seq long, kind string")
    got = []
    for rows, ns in ((3, 7), (100_000, 10**15)):
        monkeypatch.setattr(frames, "RANGE_ROWS", rows)
        monkeypatch.setattr(frames, "RANGE_NS", ns)
        got.append([sorted(map(repr, x.collect())) for x in (frames.sweeps(df, 4), frames.sweep_timeouts(df, 4, 25), frames.health(events, 45))])
    assert got[0] == got[1]
    # brute force
    want = []
    for s in (1, 2):
        mine, sweep = [p for p in points if p[0] == s], 0
        for i, (_, n, at, p) in enumerate(mine):
            if p == 0:
                sweep += 1
                rest = mine[i:]
                upto = next((k for k, x in enumerate(rest) if k and x[3] == 0), len(rest))
                expect, ended = 1, False
                for k, x in enumerate(rest[:upto]):
                    if x[2] - at >= 25 and not ended:
                        want.append((s, sweep, n, at, x[2]))
                        break
                    if k and x[3] is not None:
                        ended |= x[3] != expect or expect == 3
                        expect += 1
    assert sorted(tuple(r) for r in frames.sweep_timeouts(df, 4, 25).collect()) == sorted(want)


def test_many_short_ranges_pass_one_task_and_keep_their_own_bytes_and_entries(spark, monkeypatch):
    """Ranges are told apart within a task; no group of Spark's own, which costs milliseconds, for each of them."""
    monkeypatch.setattr(segments, "ROWS_OUT", 7)
    rows = [(s, r, at, bytes([s % 251, r, at])) for s in range(400) for r in range(2) for at in range(s % 3 + 1)]
    random.Random(3).shuffle(rows)
    pieces = spark.createDataFrame(rows, "stream long, r long, start long, data binary").withColumn("length", F.col("stream") + 5)
    entered = spark.createDataFrame([(s, 1, s + 1) for s in range(0, 400, 2)], "stream long, r long, entry long")
    fields = {"entry": ("long", pa.int64()), "length": ("long", pa.int64()), "data": ("binary", pa.binary())}

    def read(r, data, entry, length):
        return [] if length == 10 else [(entry, length, data)] * (2 if length == 11 else 1)

    df = segments.each_range(pieces, entered, ["stream"], read, fields, ("length",))
    assert "CoGroup" not in df._jdf.queryExecution().optimizedPlan().toString() and df.columns == ["stream", "r", "entry", "length", "data"]
    want = [(s, r, s + 1 if r == 1 and s % 2 == 0 else 0, s + 5, b"".join(bytes([s % 251, r, at]) for at in range(s % 3 + 1))) for s in range(400) if s != 5 for r in range(2) for _ in range(2 if s == 6 else 1)]
    assert sorted((x.stream, x.r, x.entry, x.length, bytes(x.data)) for x in df.collect()) == want
    assert segments.each_range(pieces.limit(0), entered.limit(0), ["stream"], read, fields, ("length",)).count() == 0
