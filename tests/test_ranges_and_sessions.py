"""Windows in ranges against windows over all, sessions, refusals of the library operators, and stream twins."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake import schemas
from tracelake.functions import codecs
from tracelake.functions import scalars as S
from tracelake.operators import constraints, match, timing
from tracelake.plans import capture, dsp
from tracelake.sources import legacy, sinks, views
from tracelake.sources.ordered import with_previous
from tracelake.streaming import frames, ingest

TRACES = "mission_id string, trace_index long, trace_uid string, hash string, latitude double, record_position long"


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_previous_however_cut(spark, size):
    rng = random.Random(size)
    rows = [(k, x, rng.choice([None, 1, 2])) for k in ("a", "b", None) for x in sorted(rng.sample(range(-40, 60), 30))]
    df = spark.createDataFrame(rows, "k string, x long, v long").repartition(3)
    got = {(r.k, r.x): r._previous for r in with_previous(df, ["k"], ["x"], ["v"], size).collect()}
    assert len(got) == len(rows)
    for before, now in zip([None, *rows], rows, strict=False):
        want = (before[1], before[2]) if before and before[0] == now[0] else None
        assert got[now[0], now[1]] == want


@pytest.mark.parametrize("size", [1, 4, 1_000])
def test_holes_and_islands_however_cut(spark, monkeypatch, size):
    monkeypatch.setattr(views, "INDEX_RANGE", size)
    rng = random.Random(3)
    have = {m: sorted(rng.sample(range(60), n)) for m, n in (("a", 40), ("b", 9), ("c", 1))} | {"full": list(range(24))}
    rows = spark.createDataFrame([(m, i) for m, x in have.items() for i in x + x[:2]], "mission_id string, trace_index long")
    gone = sorted((m, i) for m, x in have.items() for i in range(max(x)) if i not in x)
    assert sorted(map(tuple, views.missing_indices(rows).collect())) == gone

    def islands(x):
        cuts = [k for k in range(1, len(x)) if x[k] != x[k - 1] + 1]
        return [(x[a], x[b - 1]) for a, b in zip([0, *cuts], [*cuts, len(x)], strict=True)]

    assert sorted(map(tuple, views.ranges(rows).collect())) == sorted((m, *i) for m, x in have.items() for i in islands(x))
    holes = {m: [i for n, i in gone if n == m] for m in have}
    assert sorted(map(tuple, views.missing_ranges(rows).collect())) == sorted((m, *i) for m, x in holes.items() if x for i in islands(x))
    assert views.ranges(rows.limit(0)).count() == views.missing_indices(rows.limit(0)).count() == 0


@pytest.mark.parametrize("day", [3, 50, 10_000])
def test_deadlines_however_cut(spark, monkeypatch, day):
    monkeypatch.setattr(timing, "DAY_NS", day)
    rng = random.Random(day)
    rows = [(d, i, at, rng.choice([True, False, False, None])) for d in (1, 2) for i, at in enumerate(sorted(rng.sample(range(400), 40)))]
    want, anchor, k = {}, 0, 0
    for d, i, at, resumed in rows:
        anchor, k = (at, 0) if resumed or i == 0 else (anchor, k + 1)
        want[d, i] = anchor + 10 * k
    got = timing.deadlines(spark.createDataFrame(rows, "domain long, sweep_id long, started_ns long, resumed boolean"), 10)
    assert {(r.domain, r.sweep_id): r.deadline_ns for r in got.collect()} == want


def test_replay_pacing(spark):
    t = spark.createDataFrame([("m", i, at) for i, at in enumerate((5, 5, 9, 2, 19))], "mission_id string, trace_index long, at_ns long")
    waits = lambda *a: [r.gap_ns for r in timing.paced(t, *a).orderBy("trace_index").collect()]
    assert waits("per_trace") == [0] * 5
    assert waits("original_time") == [0, 0, 4, 0, 17]
    assert waits("accelerated", 4.0) == [0, 0, 1, 0, 4]
    for bad in (("accelerated",), ("accelerated", 0.5), ("accelerated", float("inf")), ("original_time", 2.0), ("fast",)):
        with pytest.raises(ValueError):
            timing.paced(t, *bad)


def test_stack_and_legacy_refusals(spark):
    one = spark.createDataFrame([("m", 1)], "mission_id string, trace_index long")
    assert views.stack([one, one.select("trace_index", "mission_id")]).count() == 2
    with pytest.raises(ValueError, match="columns"):
        views.stack([one, one.withColumn("trace_index", F.lit(1))])
    axis = lambda n: spark.createDataFrame([("m", n)], "mission_id string, points int")
    assert views.stack([one, one], [axis(4), axis(4)], ("points",)).count() == 2
    with pytest.raises(ValueError, match="contracts of m differ"):
        views.stack([one, one], [axis(4), axis(None)], ("points",))
    with pytest.raises(ValueError, match="unknown columns"):
        views.with_legacy(one, one.withColumn("more", F.lit(1)))


def test_lookup_of_unknown_ids(spark):
    rows = spark.createDataFrame([(1, "s"), (2, "t"), (None, "u")], "id long, name string")
    registry = spark.createDataFrame([(1, "one"), (2, None)], "key long, spec string")
    got = constraints.lookup(rows, "id", registry, "key", "spec", unknown="?").orderBy("name").collect()
    assert [r.spec for r in got] == ["one", None, "?"]
    assert constraints.lookup(rows.where("id < 3"), "id", registry, "key", "spec").count() == 2
    with pytest.raises(Exception, match="unknown id null"):
        constraints.lookup(rows, "id", registry, "key", "spec").collect()


def test_quantities(spark):
    df = spark.createDataFrame([(1.9e9, -0.125, 0.5, 5.0), (-1.9, 0.135, 6.0, None), (2.0, 1.0, 8.0, None)], "hz double, dbm double, ratio double, explicit double")
    q = S.quantized(F.col("hz"), F.col("hz"), F.col("hz"), F.col("dbm"))
    got = df.select(q.alias("q"), S.window_samples(F.col("ratio"), 9).alias("w"), S.sweep_timeout(F.col("explicit"), F.lit(501), F.lit(2), F.lit(0)).alias("t")).collect()
    assert [(r.q.start_hz, r.w, r.t) for r in got] == [(1_900_000_000, None, 5.0), (-1, 7, pytest.approx(100.2)), (2, 9, pytest.approx(100.2))]
    assert got[0].q.power_dbm == -0.12
    for n in range(3, 30):
        for ratio in (2.5, 3.5, 8.0, 11.2, n / 2):
            try:
                want = dsp.window_samples(ratio, 1.0, n)
            except ValueError:
                want = None
            assert spark.range(1).select(S.window_samples(F.lit(ratio), n).alias("w")).first().w == want if n % 9 == 0 else True


def test_envelopes_and_snapshots(spark):
    texts = ['{"a": "é"}', "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", codecs.seal(F.col("t")))
    assert [r.u and tuple(r.u) for r in df.select(codecs.unseal(F.col("e")).alias("u")).collect()] == [(texts[0], True), ("", True), None]
    for broken in ("{", "{}", json.dumps({"payload": "x", "sha256": "0" * 64})):
        assert tuple(spark.range(1).select(codecs.unseal(F.lit(broken)).alias("u")).first().u) == (None, False)
    z = [(1.5, -0.0), (float("nan"), 3e-300)]
    s = spark.createDataFrame([(z,), ([],), (None,)], "v array<struct<re: double, im: double>>")
    back = [r.b for r in s.select(codecs.unpack_complex(codecs.pack_complex(F.col("v"))).alias("b")).collect()]
    assert np.array_equal(np.array([tuple(x) for x in back[0]]), np.array(z), equal_nan=True) and back[1:] == [[], None]
    text = s.select(codecs.pack_complex(F.col("v")).alias("p")).first().p
    for bad in (text.replace("[2]", "[3]"), text.replace("<c16", "<c8"), "{}"):
        assert spark.range(1).select(codecs.unpack_complex(F.lit(bad)).alias("b")).first().b is None


def test_sessions(spark):
    c = spark.createDataFrame([(s, i) for s, n in ((1, 5), (2, 14)) for i in range(n)], "session long, at long")
    steps = capture.reference_session(c, session="session", order="at", per_step=2, steps=6)
    assert sorted((r.session, r.at, r.step) for r in steps.collect()) == [(s, i, i // 2) for s, n in ((1, 5), (2, 12)) for i in range(n)]
    state = {r.session: (r.step, r.captured, r.complete) for r in capture.session_state(c, session="session", order="at", per_step=2).collect()}
    assert state == {1: (2, 1, False), 2: (6, 0, True)}
    s = spark.createDataFrame([(t, 0, [(float(t), 0.0)]) for t in (4, 7, 9)], "trace_id long, channel int, values array<struct<re: double, im: double>>")
    assert capture.background_session(s, 2).first().re == 5.5
    with pytest.raises(ValueError, match="3 of 4"):
        capture.background_session(s, 4)


def test_nearest_and_snapshot(spark):
    rows = spark.createDataFrame([(1, 10, 3), (1, 11, -3), (1, 12, 9), (2, 13, None)], "g long, id long, d long")
    assert sorted(map(tuple, match.nearest(rows, "g", F.abs("d"), ["id"]).collect())) == [(1, 10, 3), (2, 13, None)]
    f = spark.createDataFrame([(2, 1, 5, 1), (1, 2, 9, 2), (1, 3, 9, 1), (1, 4, 2, 7)], "domain long, fix_id long, received_ns long, seq long")
    assert [r.fix_id for r in match.snapshot(f).collect()] == [4, 3, 2, 1]


def test_recovery_copies_the_committed_prefix(spark, tmp_path):
    t = spark.createDataFrame([("m", i, f"u{i}", "x", None, i) for i in range(6)], TRACES)
    m = lambda n: spark.createDataFrame([("m", n)], "mission_id string, committed_record_count long")
    sinks.recover(t, m(4), f"file://{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r.record_position for r in got.collect()) == [0, 1, 2, 3] and got.where("length(source_digest) = 64").count() == 4
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.recover(t, m(4), f"file://{tmp_path}/out")
    with pytest.raises(ValueError, match="more committed rows"):
        sinks.recover(t, m(9), f"file://{tmp_path}/other")
    holes = sinks.inspect_partial(t.where("record_position <> 2"), m(4)).first()
    assert (holes.stored, holes.tail_rows, holes["last"], holes.missing_positions) == (5, 2, 5, 1)
    assert tuple(sinks.inspect_partial(t.limit(0), m(4)).first()) == ("m", 0, 0, None, None)


def test_attached_outputs_leave_raw_data_alone(spark, tmp_path):
    t = spark.createDataFrame([("m", i, f"u{i}", "x", None, i) for i in range(3)], TRACES)
    d = spark.createDataFrame([("m", 1, [0.5])], "mission_id string, trace_index long, processed array<double>")
    sinks.attach(t, d, ("processed",), f"file://{tmp_path}/out")
    got = {r.trace_index: r.processed for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {0: None, 1: [0.5], 2: None}
    for bad in (d.withColumnRenamed("processed", "other"), d.withColumnRenamed("processed", "hash")):
        with pytest.raises(ValueError, match="not declared"):
            sinks.attach(t, bad, ("processed", "hash"), f"file://{tmp_path}/no")
    with pytest.raises(ValueError, match="raw columns changed"):
        sinks.attach(t, d.union(d), ("processed",), f"file://{tmp_path}/twice")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"]


def test_the_sink_reads_the_ranges_of_a_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "INDEX_RANGE", 10)
    path = f"file://{tmp_path}/sink"
    rows = lambda lo, hi, h: spark.createDataFrame([("m", i, f"u{i}", h, None, i) for i in range(lo, hi)], TRACES)
    assert sinks.append_batch(rows(0, 25, "x"), path) == {"append": 25}
    assert sinks.append_batch(rows(20, 35, "x"), path) == {"append": 10, "duplicate": 5}
    assert sinks.append_batch(rows(9, 11, "y"), path) == {"conflict": 2}
    assert sinks.append_batch(rows(0, 0, "y"), path) == {}
    assert spark.read.parquet(f"{path}/data").count() == 35


def test_files_of_a_manifest(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"abc")
    got = sinks.manifest(spark.read.format("binaryFile").load(str(tmp_path)), "path", "content").first()
    assert got.digest == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad" and got.bytes == 3


def test_contracts(spark, tmp_path):
    t = spark.createDataFrame([], schemas.schema("history"))
    t.select("*", F.lit(1).alias("more")).write.parquet(f"{tmp_path}/h")
    assert schemas.read(spark, f"{tmp_path}/h", "history").columns == schemas.schema("history").fieldNames()
    assert schemas.probe(t.schema) == "history" and schemas.probe(t.drop("stage").schema) is None
    with pytest.raises(ValueError, match="mission_id: missing"):
        schemas.read(spark, f"{tmp_path}/h", "samples")
    with pytest.raises(ValueError, match="ordinal: bigint"):
        t.withColumn("ordinal", F.lit(1).cast("long")).write.parquet(f"{tmp_path}/l")
        schemas.read(spark, f"{tmp_path}/l", "history")


def test_migration(spark):
    t = spark.createDataFrame([("m", i, at, None) for i, at in enumerate((10, 10, 12))], "mission_id string, trace_index long, at_ns long, latitude double")
    m = lambda **x: spark.createDataFrame([({"mission_id": "m", "created_ns": 4, "points": 8, "time_points": None, "source_digest": "d"} | x,)], "s struct<mission_id: string, created_ns: long, points: int, time_points: int, source_digest: string>").select("s.*")
    space = "6ba7b8129dad11d180b400c04fd430c8"
    got = legacy.migrate(t, m(), space).orderBy("trace_index").collect()
    assert [(r.record_position, r.mono_ns, r.latitude, r.version) for r in got] == [(0, 6, None, 2), (1, 6, None, 2), (2, 8, None, 2)]
    assert [r.trace_uid for r in legacy.migrate(t, m(), space).orderBy("trace_index").collect()] == [r.trace_uid for r in got] != [r.trace_uid for r in legacy.migrate(t, m(source_digest="e"), space).orderBy("trace_index").collect()]
    late = t.withColumn("at_ns", F.when(F.col("trace_index") != 1, F.col("at_ns")))
    falling = t.withColumn("at_ns", F.col("at_ns") - F.col("trace_index"))
    for rows, mission, reason in ((late, m(), "no trace time"), (t.limit(0), m(), "no trace time"), (t, m(created_ns=None), "no creation time"), (falling, m(), "time decreases"), (t, m(created_ns=11), "time before creation"), (t, m(time_points=7), "time axis")):
        with pytest.raises(ValueError, match=reason):
            legacy.migrate(rows, mission, space)
    told = {r["field"]: r["state"] for r in legacy.inspect(t, {"mission_id": ("string", True), "at_ns": ("double", True), "raw": ("binary", True), "note": ("string", False)})}
    assert told == {"mission_id": "ok", "at_ns": "type", "raw": "missing", "note": "absent", "trace_index": "unknown", "latitude": "unknown"}


def _replayed(spark, tmp_path, df, by, cuts, twin, name):
    for k, (lo, hi) in enumerate(zip([-1, *cuts], [*cuts, 10**9], strict=True)):
        df.where((F.col(by) > lo) & (F.col(by) <= hi)).coalesce(1).write.parquet(f"{tmp_path}/{name}/{k}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/*")
    q = twin(stream).writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return sorted(map(tuple, spark.table(name).collect()), key=repr)


def test_stream_twins_of_sweeps_and_health(spark, tmp_path):
    rng = random.Random(8)
    points = [(s, n, p) for s in (1, 2) for n, p in enumerate([3, 0, 1, 2, 0, 1, 1, 0, 1, 2, 2, 0, 0, 1, 2, 1, 0, 1, None, 0, 1, 2] * 2)]
    df = spark.createDataFrame(points, "stream long, n long, point long")
    want = frames.sweeps(df, 3).where("complete").select("stream", "sweep", "first_n")
    assert _replayed(spark, tmp_path, df, "n", [8, 13], lambda x: frames.sweeps_stream(x, 3), "got_sweeps") == sorted(map(tuple, want.collect()), key=repr)
    kinds = ["valid", "invalid", "sentence", "connect", "disconnect", "tick", "tick"]
    events = spark.createDataFrame([(s, 10 * (n // 2), n, rng.choice(kinds)) for s in (1, 2, 3) for n in range(60)], "stream long, at long, seq long, kind string")
    want = frames.health(events, 25)
    assert _replayed(spark, tmp_path, events, "seq", [21, 40], lambda x: frames.health_stream(x, 25), "got_health") == sorted(map(tuple, want.collect()), key=repr)


def test_streams_are_read_batch_by_batch(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        data = b"".join(frames.packet(k, bytes([k]) * k) for k in range(1, 9))
        chunks = [(s, k, data[5 * k : 5 * k + 5]) for s in (1, 2, None) for k in range(-(-len(data) // 5))]
        got = frames.packets(spark.createDataFrame(chunks, "stream long, seq long, data binary").orderBy(F.rand(2))).collect()
        assert sorted((r.stream, r.n, r.kind, bytes(r.payload)) for r in got) == [(s, k - 1, k, bytes([k]) * k) for s in (1, 2) for k in range(1, 9)]
        text = "\n".join(f"line {k}" + "x" * 250 * (k == 4) for k in range(9)) + "\n" + "y" * 256 + "\r\n"
        chunks = [(s, k, text[4 * k : 4 * k + 4]) for s in (1, 2) for k in range(-(-len(text) // 4))]
        got = ingest.lines(spark.createDataFrame([*chunks, (1, -1, None)], "stream long, seq long, text string").orderBy(F.rand(2))).collect()
        want = [x for x in text.split("\n")[:-1] if len(x.rstrip("\r")) <= 256]
        assert sorted((r.stream, r.n, r.line) for r in got) == [(s, n, x.rstrip("\r")) for s in (1, 2) for n, x in enumerate(want)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
