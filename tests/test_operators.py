"""Small cases: ties, thresholds, quirks, rejections and any order of rows."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.functions import nmea
from tracelake.functions import scalars as S
from tracelake.operators import match
from tracelake.operators.match import nearest_fix
from tracelake.operators.reconcile import reconcile
from tracelake.plans import chain, dsp
from tracelake.plans.provenance import Dataset
from tracelake.sources import sinks, views
from tracelake.streaming import frames, ingest

NS = 1_000_000_000
TRACES = "mission_id string, trace_index long, trace_uid string, hash string, latitude double, record_position long"


def traces(spark, rows):
    return spark.createDataFrame([("m", i, u, h, lat, p) for p, (i, u, h, lat) in enumerate(rows)], TRACES)


def test_reconcile_quirks(spark):
    air = traces(spark, [(0, "a", "x", 1.0), (1, "b", "x", 1.0), (1, "b", "y", 1.0), (2, "c", "x", None), (3, "d", "x", 1.0), (3, "d", "z", 1.0), (4, "e", "", 1.0), (4, "e", "", 1.0), (5, "f", "x", 1.0), (5, "f", "y", 1.0)])
    ground = traces(spark, [(0, "a", "x", 1.0), (1, "b", "x", 1.0), (2, "c", "x", 2.0), (4, "e", "", 1.0), (5, "f", "x", 1.0), (5, "f", "y", 1.0), (6, "g", "x", None)])
    got = {r.trace_index: (r.kind, r.detail) for r in reconcile(air, ground).collect()}
    assert got == {0: ("consistent", None), 1: ("conflict", "conflict within air"), 2: ("gnss_diff", "air has no match"), 4: ("consistent", None), 6: ("extra", None)}
    again = {r.trace_index: (r.kind, r.detail) for r in reconcile(air.orderBy(F.rand(3)), ground.orderBy(F.rand(4))).collect()}
    assert again == got


def test_reconcile_empty(spark):
    none = traces(spark, [])
    assert reconcile(none, none).count() == 0
    assert [r.kind for r in reconcile(traces(spark, [(0, "a", "x", None)]), none).collect()] == ["missing"]


def test_nearest_fix_ties_and_thresholds(spark):
    s = spark.createDataFrame([(1, 1, 100 * NS, 100 * NS), (1, 2, 200 * NS, 200 * NS), (1, 3, 300 * NS, 300 * NS), (2, 4, 0, 1), (1, 5, 400 * NS, 400 * NS)], "domain long, sweep_id long, started_ns long, finished_ns long")
    f = [(1, 10, 90 * NS, 5, True), (1, 11, 110 * NS, 1, True), (1, 12, 195 * NS, 2, False), (1, 13, 206 * NS, 3, True), (1, 14, 320 * NS, 9, True), (1, 15, 320 * NS, 8, True), (1, 16, 500 * NS + 1, 1, True)]
    f = spark.createDataFrame(f, "domain long, fix_id long, received_ns long, seq long, valid boolean")
    for bucket in (86_400, 60, 7):
        got = {r.sweep_id: (r.fix_id, r.reason) for r in nearest_fix(s, f, stale_after_s=15, window_s=80, bucket_s=bucket).collect()}
        assert got == {1: (10, None), 2: (12, "invalid"), 3: (15, "stale"), 4: (None, "no_fix"), 5: (15, "stale")}
    assert {r.reason for r in nearest_fix(s, f, stale_after_s=1, window_s=2, shared_clock=False).collect()} == {"clock_unavailable"}
    exact = {r.sweep_id: r.reason for r in nearest_fix(s, f, stale_after_s=10, window_s=79, bucket_s=50).collect()}
    assert exact[1] is None and exact[5] == "out_of_range"
    with pytest.raises(ValueError):
        nearest_fix(s, f, stale_after_s=5, window_s=1)


def test_nearest_fix_of_null_instants_and_domains(spark):
    s = spark.createDataFrame([(1, 1, 10, 10), (1, 2, None, 10), (1, 3, 10, None), (None, 4, 10, 10), (None, 5, None, None), (2, 6, 10, 10)], "domain long, sweep_id long, started_ns long, finished_ns long")
    f = [(1, 20, 8, 1, True), (1, 21, None, 2, True), (None, 22, 9, 3, True), (None, 23, None, 4, True), (2, 24, None, 5, True)]
    f = spark.createDataFrame(f, "domain long, fix_id long, received_ns long, seq long, valid boolean")
    got = {r.sweep_id: (r.fix_id, r.distance_ns, r.reason, r.usable) for r in nearest_fix(s, f, stale_after_s=15, window_s=80).collect()}
    assert got == {1: (20, 2, None, True)} | {i: (None, None, "no_fix", False) for i in range(2, 7)}


def test_nearest_fix_of_a_crowded_bucket(spark):
    """One bucket holds all rows; no frame runs from a row to the end of it, which would cost the square of its rows."""
    rng = np.random.default_rng(5)
    at, fixed = rng.integers(0, 40_000, 3000), np.unique(rng.integers(0, 40_000, 2000))
    s = spark.createDataFrame([(1, i, t, t) for i, t in enumerate(at.tolist())], "domain long, sweep_id long, started_ns long, finished_ns long")
    f = spark.createDataFrame([(1, t, t, t, True) for t in fixed.tolist()], "domain long, fix_id long, received_ns long, seq long, valid boolean")
    df = nearest_fix(s, f, stale_after_s=15, window_s=80)
    assert "unboundedfollowing" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
    got = {r.sweep_id: r.fix_id for r in df.collect()}
    assert got == {i: int(fixed[np.argmin(np.abs(fixed - t))]) for i, t in enumerate(at.tolist())}


@pytest.mark.parametrize(("window", "block", "chunk", "ids"), [(5, 8, 4, 10), (31, 8, 100, 7), (37, 4, 1, 1000), (3, 512, 256, 1)])
def test_flat_reflection_in_blocks(spark, monkeypatch, window, block, chunk, ids):
    for name, value in (("BLOCK_TRACES", block), ("CHUNK_SAMPLES", chunk), ("ID_RANGE", ids)):
        monkeypatch.setattr(dsp, name, value)
    rng = np.random.default_rng(window)
    z = rng.normal(size=(37, 2, 6)) + 1j * rng.normal(size=(37, 2, 6))
    at = np.cumsum(rng.integers(1, 9, 37)).tolist()  # ids with holes
    s = spark.createDataFrame([(at[t], c, [(float(v.real), float(v.imag)) for v in z[t, c]]) for t in range(37) for c in range(2)], "trace_id long, channel int, values array<struct<re: double, im: double>>")
    p = np.pad(z, ((window // 2, window // 2), (0, 0), (0, 0)), mode="edge")
    want = z - sum(p[k : k + 37] for k in range(window)) / window
    got = {(r.trace_id, r.channel): np.array([complex(v.re, v.im) for v in r["values"]]) for r in dsp.flat_reflection(s, window).collect()}
    assert len(got) == 74 and all(np.allclose(got[at[t], c], want[t, c]) for t in range(37) for c in range(2))
    ragged = s.withColumn("values", F.when(F.col("trace_id") == at[3], F.slice("values", 1, 5)).otherwise(F.col("values")))
    with pytest.raises(Exception, match="one length"):
        dsp.flat_reflection(ragged, window).collect()


def test_flat_reflection_of_traces_that_one_chunk_holds(spark):
    """They are not shuffled again after the mean; the length that was named must be theirs."""
    s = spark.range(9).selectExpr("id as trace_id", "0 as channel", "transform(sequence(0, 6), i -> named_struct('re', double(id * id + i), 'im', double(id % 3))) as values")
    df = dsp.flat_reflection(s, 5, points=7)
    assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(df.collect()) == sorted(dsp.flat_reflection(s, 5).collect())
    with pytest.raises(Exception, match="of 8 samples"):
        dsp.flat_reflection(s, 5, points=8).collect()


def test_last_before_in_buckets(spark):
    rows = spark.createDataFrame([("d", 1, 5), ("d", 2, 100), ("d", 3, 101), ("d", 4, None), ("e", 5, 50), ("d", 6, 400), (None, 7, 9)], "domain string, id long, at long")
    others = spark.createDataFrame([("d", 6, "a"), ("d", 100, "b"), ("d", 390, "c"), (None, 8, "n")], "domain string, at long, v string")
    for bucket in (10, 64, 1_000_000):
        got = {r.id: r.v for r in match.last_before(rows, others, "v", 10, bucket_ns=bucket).collect()}
        assert got == {1: None, 2: "b", 3: "b", 4: None, 5: None, 6: "c", 7: "n"}
        assert {r.id: r.v for r in match.last_before(rows, others, "v", 300, bucket_ns=bucket).collect()}[6] == "c"
    far = others.where("at < 390")
    assert {r.id: r.v for r in match.last_before(rows, far, "v", 300, bucket_ns=10).collect()}[6] == "b"


def test_views(spark):
    t = traces(spark, [(3, "a", "x", None), (1, "b", "x", None), (3, "a", "x", None), (6, "c", "x", None), (7, "c", "y", None)])
    assert [r.trace_index for r in views.logical(t).orderBy("trace_index").collect()] == [1, 3]
    assert sorted(r.trace_index for r in views.missing_indices(t).collect()) == [0, 2, 4, 5]
    assert sorted((r.low, r.high) for r in views.ranges(views.missing_indices(t)).collect()) == [(0, 0), (2, 2), (4, 5)]
    assert views.by_index(t, "m", 1).count() == 1
    with pytest.raises(LookupError, match="excluded"):
        views.by_index(t, "m", 6)
    with pytest.raises(LookupError, match="absent"):
        views.by_index(t, "m", 99)
    m = spark.createDataFrame([("m", 9)], "mission_id string, committed_record_count long")
    assert views.check_committed(t, m).count() == 1


def test_append_is_idempotent(spark, tmp_path):
    t = traces(spark, [(0, "a", "x", None), (1, "b", "x", None), (1, "b", "y", None)])
    path = f"file://{tmp_path}/sink"
    assert sinks.append_batch(t, path) == {"append": 2, "conflict": 1}
    assert sinks.append_batch(t, path) == {"duplicate": 2, "conflict": 1}
    assert spark.read.parquet(f"{path}/data").count() == 2
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.finalize(t, f"{path}/data")


def test_nmea_reasons(spark):
    def line(body):
        x = 0
        for c in body:
            x ^= ord(c)
        return f"${body}*{x:02X}"

    good = "GPGGA,120000,4807.038,N,01131.000,E,1,08,0.9,545.4,M,46.9,M,,"
    cases = [
        (line(good), None), (line(good)[:-2] + "00", "bad_checksum"), ("GPGGA", "not_a_sentence"), ("$GPGGA,1", "missing_checksum"), ("$é*00", "non_ascii"), ("$" + "x" * 300, "line_too_long"), (None, "not_a_sentence"), ("", "not_a_sentence"),
        (line("GPGSV,1"), "unsupported_sentence"), (line("GPX"), "bad_talker"), (line("GPGGA,1,2"), "too_few_fields"), (line(good.replace("N", "E", 1)), "malformed_field"), (line(good.replace("4807", "4860")), "out_of_range"), (line(good.replace("E,1,", "E,3,")), "unsupported_fix_quality"),
        (line("GPRMC,235959,A,4807.038,N,01131.000,E,10.0,084.4,310599,,"), None), (line("GPRMC,235959,A,4807.038,N,01131.000,E,10.0,084.4,310299,,"), "out_of_range"), (line("GPRMC,235959,V,,,,,,,,,"), None),
    ]
    got = nmea.parse(spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, line string")).orderBy("i").collect()
    assert [r.reason for r in got] == [x for _, x in cases]
    assert got[0].latitude == pytest.approx(48 + 7.038 / 60) and got[0].quality == "gps_fix"
    assert got[14].speed_mps == pytest.approx(10 * 1852 / 3600) and str(got[14].date) == "1999-05-31" and got[16].latitude is None


def test_axis_rules(spark):
    rows = [[0.0, 1.0, 2.0], [1.0, 1.0], [], None, [0.0, float("nan")], [5.0], [0.0, 1e9, 2e9 + 900.0], [0.0, 1e9, 2e9 + 2100.0]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, a array<double>")
    assert [r.v for r in df.select("i", S.axis_valid(F.col("a")).alias("v")).orderBy("i").collect()] == [True, False, False, False, False, True, True, True]
    got = [r.v for r in df.where("i >= 6").select("i", S.axis_uniform(F.col("a")).alias("v")).orderBy("i").collect()]
    assert got == [True, False]


def test_stages_against_numpy(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(size=(7, 2, 16)) + 1j * rng.normal(size=(7, 2, 16))
    rows = [(t, c, [(float(v.real), float(v.imag)) for v in z[t, c]]) for t in range(7) for c in range(2)]
    s = spark.createDataFrame(rows, "trace_id long, channel int, values array<struct<re: double, im: double>>")
    back = lambda df: {(r.trace_id, r.channel): np.array([complex(v.re, v.im) for v in r["values"]]) for r in df.collect()}
    t = back(dsp.ifft(s, 0.52e9, 1e8, 2))
    full = np.zeros(64, complex)
    full[5:21] = z[3, 1]
    assert np.allclose(t[3, 1], np.fft.ifft(full) * np.exp(2j * np.pi * 2e7 * np.arange(64) / 6.4e9))
    w = back(dsp.dewow(s, 5))
    p = np.pad(z, ((0, 0), (0, 0), (2, 2)), mode="reflect")
    assert np.allclose(w[0, 0], (z - sum(p[..., k : k + 16] for k in range(5)) / 5)[0, 0])
    f = back(dsp.flat_reflection(s.orderBy(F.rand(1)), 5))
    p = np.pad(z, ((2, 2), (0, 0), (0, 0)), mode="edge")
    want = z - sum(p[k : k + 7] for k in range(5)) / 5
    assert all(np.allclose(f[k, c], want[k, c]) for k in range(7) for c in range(2))
    with pytest.raises(ValueError):
        dsp.bandpass(s, 5e9, 1e8, (0.5e9, 1e9, 1.5e9, 2.5e9), 16)
    with pytest.raises(ValueError):
        dsp.window_samples(1e-12, 1e-9, 10)
    assert dsp.window_samples(2.5, 1.0, 9) == 3  # half to even, then up to odd


def test_provenance_rules(spark):
    d = Dataset(spark.range(1))
    with pytest.raises(ValueError):
        d.then("x", "frequency_raw", lambda r: r)
    t = d.then("ifft", "time_base", lambda r: r)
    with pytest.raises(ValueError):
        t.then("ifft", "time_processed", lambda r: r)
    f = t.then("flat_reflection", "time_processed", lambda r: r)
    with pytest.raises(ValueError):
        f.then("dewow", "time_processed", lambda r: r)
    assert chain.Profile(1.0, 1.0, 4).oversampling == 16


def test_packets_cut_anywhere(spark):
    one, two = frames.packet(3, b"abc"), frames.packet(27, b"\x5a\x5a")
    whole = b"\x00" + one + b"\x5a\x00\x00" + two[:-4] + struct.pack("<I", zlib.crc32(b"")) + one[:-1] + b"\x00" + one
    want = [(3, b"abc"), (27, b"\x5a\x5a"), (3, b"abc")]
    rows = [(cut, k, part) for cut in range(len(whole) + 1) for k, part in enumerate((whole[:cut], whole[cut:]))]
    got = frames.packets(spark.createDataFrame(rows, "stream long, seq long, data binary")).collect()
    for cut in range(len(whole) + 1):
        assert sorted((r.n, r.kind, bytes(r.payload)) for r in got if r.stream == cut) == [(i, *x) for i, x in enumerate(want)]


def test_packets_stream_equals_batch(spark, tmp_path):
    data = frames.packet(1, b"one") + b"noise" + frames.packet(2, b"two") + frames.packet(3, b"three")
    rows = [(s, k, data[5 * k : 5 * k + 5]) for s in (1, 2) for k in range(-(-len(data) // 5))]
    df = spark.createDataFrame(rows, "stream long, seq long, data binary")
    for k, part in enumerate((df.where("seq < 3"), df.where("seq >= 3"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = frames.packets_stream(stream).writeStream.format("memory").queryName("got_packets").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r.stream, r.n, r.kind, bytes(r.payload))
    assert sorted(map(key, spark.table("got_packets").collect())) == sorted(map(key, frames.packets(df).collect()))


def test_sweeps_strict(spark):
    points = [3, 0, 1, 2, 0, 1, 1, 0, 1, 2, 2, 0]
    df = spark.createDataFrame([(1, n, p) for n, p in enumerate(points)], "stream long, n long, point long")
    assert [(r.sweep, r.complete) for r in frames.sweeps(df, 3).orderBy("sweep").collect()] == [(1, True), (2, False), (3, True), (4, False)]


def test_append_stream_writes_once(spark, tmp_path):
    t = traces(spark, [(0, "a", "x", None), (1, "b", "x", None), (1, "b", "x", None)])
    t.write.parquet(f"{tmp_path}/in")
    for run in (1, 2):  # a second query over the same input finds everything stored
        stream = spark.readStream.schema(t.schema).parquet(f"{tmp_path}/in")
        ingest.append_stream(stream, f"file://{tmp_path}/sink", f"{tmp_path}/check{run}").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/sink/data").count() == 2


def test_lines_stream_equals_batch(spark, tmp_path):
    text = "one\r\n" + "y" * 300 + "\ntwo\n\nthree\nrest"
    rows = [(s, k, text[7 * k : 7 * k + 7]) for s in (1, 2) for k in range(-(-len(text) // 7))]
    df = spark.createDataFrame(rows, "stream long, seq long, text string")
    want = [(s, n, x) for s in (1, 2) for n, x in enumerate(("one", "two", "three"))]
    assert sorted(map(tuple, ingest.lines(df).collect())) == want
    for k, part in enumerate((df.where("seq < 9"), df.where("seq >= 9 and seq < 44"), df.where("seq >= 44"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = ingest.lines_stream(stream).writeStream.format("memory").queryName("got_lines").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("got_lines").collect())) == want


def test_views_on_wide_rows(spark):
    """The look-up by position gives whole rows; a uid elsewhere in the mission excludes an index, one of another mission does not."""
    rows = [("m", 1, "a", "h", 0, b"x"), ("m", 1, "a", "h", 9, b"y"), ("m", 2, "b", "h", 1, b"z"), ("m", 3, "b", "h", 2, b"z"), ("m", 4, "c", "h", 3, b"z"), ("m", 4, "c", "k", 4, b"z"), ("m", 5, None, None, 5, b"n"), ("m", 6, None, None, 6, b"n"), ("o", 1, "c", "h", 0, b"o")]
    t = spark.createDataFrame(rows, "mission_id string, trace_index long, trace_uid string, hash string, record_position long, raw binary")
    assert sorted((r.mission_id, r.trace_index, bytes(r.raw)) for r in views.logical(t).collect()) == [("m", 1, b"x"), ("m", 5, b"n"), ("m", 6, b"n"), ("o", 1, b"o")]
    assert bytes(views.by_index(t, "m", 1).first().raw) == b"x" and views.by_index(t, "m", 5).count() == views.by_index(t, "o", 1).count() == 1
    for index, why in ((2, "excluded"), (4, "excluded"), (7, "absent")):
        with pytest.raises(LookupError, match=why):
            views.by_index(t, "m", index)
