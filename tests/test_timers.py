"""Timers in streams: what happens without a further row, held against brute force and the batch operators."""

import random
import time as clock

import pytest
from pyspark.sql import functions as F

from tracelake.operators.match import nearest_fix
from tracelake.streaming import frames, timers

NS = 1_000_000_000


@pytest.fixture(autouse=True)
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    timers.prepare(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def played(spark, tmp_path, rows, schema, at, cuts, twin, name):
    """The rows by time in files of a batch each, then one far row of another key that moves the watermark on."""
    df = spark.createDataFrame(rows, schema)
    for k, (lo, hi) in enumerate(zip([-(10**18), *cuts], [*cuts, 10**18], strict=True)):
        df.where((F.col(at) > lo) & (F.col(at) <= hi)).coalesce(1).write.parquet(f"{tmp_path}/{name}/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/*")
    q = twin(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}-ck").start()
    q.processAllAvailable()
    q.stop()
    return sorted(map(tuple, spark.table(name).collect()), key=repr)


def test_sweeps_time_out_without_a_row(spark, tmp_path):
    rng = random.Random(3)
    rows, want = [], []
    for s in (1, 2):
        at, seen = 0, []
        for n in range(80):
            at += rng.choice([1, 5, 5, 5, 40])
            seen.append((s, n, at, rng.choice([0, 0, 1, 2, None]) if rng.random() < 0.4 else n % 3))
        rows += seen
        sweep = 0
        for i, (_, n, t, p) in enumerate(seen):
            if p == 0:
                sweep, expect, outcome = sweep + 1, 1, (t + 30, "timeout")
                for _, _, u, q in seen[i + 1 :]:
                    if u >= t + 30:
                        break
                    if q is None:
                        continue
                    if q != expect:
                        outcome = None
                        break
                    expect += 1
                    if expect == 3:
                        outcome = (u, "complete")
                        break
                if outcome:
                    want.append((s, sweep, n, t, *outcome))
    rows.append((99, 0, 10**7, None))
    schema = "stream long, n long, at_ms long, point long"
    got = played(spark, tmp_path, rows, schema, "at_ms", [200, 420], lambda x: timers.timed_sweeps(timers.with_time(x, "at_ms"), 3, 30), "timed_sweeps")
    assert got == sorted(want, key=repr) and {x[-1] for x in got} == {"timeout", "complete"}
    batch = {tuple(r)[:4] for r in frames.sweep_timeouts(spark.createDataFrame(rows, schema), 3, 30).collect()}
    assert batch <= {x[:4] for x in got if x[-1] == "timeout"}


def test_fixes_go_stale_without_a_row(spark, tmp_path):
    rng = random.Random(4)
    events = [(s, 7 * k + s, k, rng.choice(["valid", "invalid", "sentence", "tick", "tick", "tick", "connect", "connect", "disconnect"])) for s in (1, 2) for k in range(90)]
    schema = "stream long, at_ms long, seq long, kind string"
    df = spark.createDataFrame(events, schema)
    rows = {tuple(r) for r in frames.health(df.withColumnRenamed("at_ms", "at"), 25).collect()}
    stale = set()
    for s in (1, 2):
        link, fix = None, None
        for _, at, _, kind in [*(e for e in events if e[0] == s), (s, 10**9, 0, "tick")]:
            if fix is not None and at > fix + 25:
                stale.add((s, fix + 26, None, "timer", "stale"))
                fix = None
            if kind in ("connect", "disconnect"):
                link, fix = kind, None
            elif kind == "valid":
                fix = at if link == "connect" else None
    got = played(spark, tmp_path, [*events, (99, 10**7, 0, "tick")], schema, "at_ms", [150, 400], lambda x: timers.timed_health(timers.with_time(x, "at_ms"), 25), "timed_health")
    assert stale and set(got) == rows | stale and len(got) == len(rows | stale)


def test_caches_evict_without_a_row(spark, tmp_path):
    rng = random.Random(5)
    fixes, at = [], 0
    for k in range(60):
        at += rng.choice([1, 3, 30])
        fixes.append((1 + k % 2, k, at))
    want = []
    for s in (1, 2):
        have = {}
        for _, i, at in [*(f for f in fixes if f[0] == s), (s, None, 10**9)]:
            for j, t in sorted(have.items()):
                if t + 50 < at:
                    want.append((s, j, "age", t + 51))
                    del have[j]
            if i is not None:
                have[i] = at
                if len(have) > 4:
                    j = min(have, key=lambda x: (have[x], x))
                    want.append((s, j, "count", at))
                    del have[j]
    got = played(spark, tmp_path, [*fixes, (99, 0, 10**7)], "source long, fix_id long, at_ms long", "at_ms", [200, 420], lambda x: timers.evictions(timers.with_time(x, "at_ms"), 4, 50), "evicted").copy()
    assert got == sorted(want, key=repr) and {x[2] for x in got} == {"age", "count"}


def test_sweeps_wait_for_their_window(spark, tmp_path):
    rng = random.Random(6)
    sweeps = [(d, k, t, t) for d in (1, 2) for k, t in enumerate(sorted(rng.sample(range(10, 900), 40)))]
    sweeps = [(d, 1000 * d + k, a * NS, b * NS) for d, k, a, b in sweeps]
    fixes = [(d, k, t * NS, k % 3, rng.random() < 0.8) for d in (1, 2) for k, t in enumerate(sorted(rng.choices(range(900), k=50))) if not 300 < t < 420]
    s = spark.createDataFrame(sweeps, "domain long, sweep_id long, started_ns long, finished_ns long")
    f = spark.createDataFrame(fixes, "domain long, fix_id long, received_ns long, seq long, valid boolean")
    batch = {(r.domain, r.sweep_id): (r.fix_id, r.distance_ns, r.reason) for r in nearest_fix(s, f, stale_after_s=4, window_s=12).collect()}
    rows = [(d, a, a // 10**6, "sweep", i, 0, None) for d, i, a, _ in sweeps] + [(d, t, t // 10**6, "fix", i, q, v) for d, i, t, q, v in fixes]
    rows.append((99, 10**7 * 10**6, 10**7, "fix", 0, 0, True))
    schema = "domain long, at_ns long, at_ms long, kind string, id long, seq long, valid boolean"
    twin = lambda x: timers.nearest_fix_stream(timers.with_time(x, "at_ms"), stale_after_s=4, window_s=12)
    got = {x[:2]: x[2:] for x in played(spark, tmp_path, rows, schema, "at_ms", [200_000, 500_000], twin, "nearest")}
    assert got.keys() == batch.keys()
    for k, (fix, distance, reason) in batch.items():
        assert got[k][2] == reason or (reason == "out_of_range" and got[k][2] == "no_fix")
        if reason not in ("out_of_range", "no_fix"):
            assert got[k][:2] == (fix, distance) or (got[k][1] == distance and batch[k][2] == got[k][2])


def test_a_sweep_times_out_by_the_clock(spark, tmp_path):
    """In processing time nothing at all comes after the sweep's first point."""
    now = int(clock.time() * 1000)
    spark.createDataFrame([(1, 0, now, 0)], "stream long, n long, at_ms long, point long").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("stream long, n long, at_ms long, point long").parquet(f"{tmp_path}/in")
    q = timers.timed_sweeps(stream, 3, 500, "processingTime").writeStream.format("memory").queryName("by_clock").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            clock.sleep(0.5)
            if rows := spark.table("by_clock").collect():
                break
    finally:
        q.stop()
    assert [(r.sweep, r.outcome) for r in rows] == [(1, "timeout")]
