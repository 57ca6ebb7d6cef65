"""Codecs, calibration terms against NumPy, refusals, and frames however their bytes are cut."""

import hashlib
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.functions import codecs
from tracelake.functions import scalars as S
from tracelake.plans import dsp
from tracelake.streaming import protocol

MAGIC = b"TLK1"


def test_strict_and_canonical_json(spark):
    texts = ['{"a": 1, "a": 2}', '[{"b": {"c": 1, "c": 1}}]', "NaN", "[Infinity]", "-Infinity", "{", "", None, '{"a": 1e400, "b": [null, true]}', '"x"', " 1 "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.v for r in df.select(codecs.strict_json(F.col("t")).alias("v")).collect()] == [False] * 7 + [None, True, True, True]
    assert codecs.canonical_json({"b": -0.0, "a": [{"z": "é", "y": 1}]}) == '{"a":[{"y":1,"z":"\\u00e9"}],"b":0.0}'
    one = {"points": 3, "start": -0.0, "note": "x", "created_utc": 1}
    assert codecs.config_digest(one) == codecs.config_digest({"start": 0.0, "points": 3}) != codecs.config_digest({"start": 1.0, "points": 3})
    with pytest.raises(ValueError):
        codecs.config_digest({"start": float("nan")})


def test_raw_hash_of_arrays(spark):
    axis, raw = [1e9, 1.5e9, 2.25e9], np.array([[1 - 2j, 0.1 + 0j, -0.0 + 3e-300j], [5j, 6.5, -7]])
    row = (axis, [{"re": z.real, "im": z.imag} for z in raw.ravel().tolist()])
    df = spark.createDataFrame([row, (None, None)], "axis array<double>, raw array<struct<re: double, im: double>>")
    h = S.raw_trace_sha256("MAGIC", F.lit("m"), F.lit("uid"), F.lit(7), F.array(F.lit("s1"), F.lit("s2")), F.lit(3), codecs.le_doubles(F.col("axis")), codecs.le_complex(F.col("raw")))
    u64 = lambda n: struct.pack(">Q", n)
    text = lambda t: u64(len(t)) + t.encode()
    want = hashlib.sha256(b"MAGIC" + u64(1) + text("m") + text("uid") + u64(7) + u64(2) + text("s1") + text("s2") + u64(3) + np.array(axis).astype("<f8").tobytes() + raw.astype("<c16").tobytes()).hexdigest()
    assert [r.h for r in df.select(h.alias("h")).collect()] == [want, None]


def test_terms_against_numpy(spark):
    rng = np.random.default_rng(2)
    c = lambda z: {"re": float(z.real), "im": float(z.imag)}
    rows, want = [], {}
    for k in range(40):
        a, m = rng.normal(size=(2, 3)) + 1j * rng.normal(size=(2, 3))
        d, e, s = np.linalg.solve(np.stack([np.ones(3), a, a * m], axis=1), m)
        want[k] = (d, e + d * s, s)
        rows += [(0, k, n, c(m[i]), c(a[i])) for i, n in enumerate(("open", "short", "load"))]
    rows += [(0, 40, n, c(1 + 1j), c(0.5 + 0j)) for n in ("open", "short", "load")] + [(0, 41, "open", c(1 + 1j), c(0.5 + 0j))]
    df = spark.createDataFrame(rows, "channel int, k int, standard string, measured struct<re: double, im: double>, actual struct<re: double, im: double>")
    got = {r.k: r for r in dsp.solve_terms(df).collect()}
    assert not got[40].ok and not got[41].ok and got[40].D is None
    for k, terms in want.items():
        assert got[k].ok and np.allclose([complex(*got[k][x]) for x in "DTS"], terms, rtol=1e-9)


def test_a_reference_that_does_not_fit_is_refused(spark):
    values = "array<struct<re: double, im: double>>"
    s = spark.createDataFrame([(1, 0, [(1.0, 0.0), (2.0, 0.0)])], f"trace_id long, channel int, values {values}")
    ref = spark.createDataFrame([(0, 0, 0.5, 0.0), (0, 1, 0.5, 0.0)], "channel int, k int, re double, im double")
    assert dsp.subtract_background(s, ref).first()["values"][1].re == 1.5
    for other in (ref.withColumn("channel", F.lit(3)), ref.where("k = 0")):
        with pytest.raises(Exception, match="does not fit channel"):
            dsp.subtract_background(s, other).collect()


def frame(kind=5, header='{"id":1}', payload=b"x", magic=MAGIC, major=1, flags=0, head=None):
    h = header.encode()
    return magic + bytes([major, 0]) + struct.pack(">HHII", kind, flags, len(h) if head is None else head, len(payload)) + h + payload


def test_frames_however_cut(spark, tmp_path):
    good = [frame(k, json.dumps({"id": k}, separators=(",", ":")), bytes(k)) for k in range(1, 9)]
    bad = {"bad_magic": frame(magic=b"XXXX"), "version": frame(major=2), "unknown_kind": frame(9), "flags": frame(flags=1), "bad_header": frame(header='{"b":1,"a":2}'), "header_length": frame(head=1 << 21)}
    bad2 = {"bad_header": frame(header='{"a":1,"a":1}')}
    rows, want = [], {}
    for s, (error, x) in enumerate([*bad.items(), *bad2.items()]):
        parts = [(b"".join(good) + x + good[0], False), (good[1] + good[2][:9], True), (good[3], True)]
        cut, seq = 1 + 5 * s, 0
        for data, reset in parts:
            for i in range(0, len(data), cut):
                rows.append((s, seq, data[i : i + cut], reset and i == 0))
                seq += 1
        kinds = [*protocol.KINDS.values(), error, "status", "mission"]
        want[s] = kinds
    df = spark.createDataFrame(rows, "stream long, seq long, data binary, reset boolean")
    of = lambda t: {s: [r.kind or r.error for r in sorted(t, key=lambda r: r.n) if r.stream == s] for s in want}
    assert of(protocol.frames(df, MAGIC).collect()) == want
    for k, part in enumerate((df.where("seq < 3"), df.where("seq >= 3 and seq < 20"), df.where("seq >= 20"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = protocol.frames_stream(stream, MAGIC).writeStream.format("memory").queryName("got_frames").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert of(spark.table("got_frames").collect()) == want
