import time

import pytest
from pyspark.sql import functions as F

from tracelake.streaming import replay

S = 1_000_000_000
#: Recorded times of a mission's traces: one goes back, one comes a thousand seconds late.
TIMES = {"m": [100, 101, 100, 103, 1104], "n": [5, 5, 7]}
DUE = {("m", 0): 0, ("m", 1): 1, ("m", 2): 1, ("m", 3): 4, ("m", 4): 1005, ("n", 0): 0, ("n", 1): 0, ("n", 2): 2}
def digest():
    return F.sha2("trace_uid", 256)


def traces(spark, extra=()):
    rows = [(m, i, f"{m}{i}", i, t * S) for m, times in TIMES.items() for i, t in enumerate(times)] + [("m", 1, "m1", 9, 999 * S), *extra]
    return spark.createDataFrame(rows, "mission_id string, trace_index long, trace_uid string, record_position long, at_ns long").withColumn("hash", digest())


def missions(spark, names=("m", "n")):
    return spark.createDataFrame([(m,) for m in names], "mission_id string")


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    return replay.prepare(traces(spark), missions(spark), digest(), str(tmp_path_factory.mktemp("r") / "t"), file_ns=2 * S)


def run(stream, out, wanted=None):
    """Run until all that is due has been delivered, or ``wanted`` rows are there; rows by (mission, index)."""
    q = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").trigger(processingTime="200 milliseconds").start()
    try:
        end = time.time() + 60
        read = lambda: [(r.mission_id, r.trace_index, r.due_ns) for r in stream.sparkSession.read.parquet(f"{out}/rows").collect()]
        while time.time() < end and q.exception() is None:
            if q.lastProgress is not None and (got := read()) and (wanted is None or len(got) >= wanted):
                break
            time.sleep(0.3)
        assert q.exception() is None
        time.sleep(0.5)
    finally:
        q.stop()
    return sorted(read())


def all_rows(below=10**9):
    return sorted((m, i, d * S) for (m, i), d in DUE.items() if d <= below)


def test_no_waits(spark, path, tmp_path):
    assert run(replay.replay(spark, path, "per_trace"), tmp_path, len(DUE)) == all_rows()


def test_waits_and_a_restart_that_repeats_nothing(spark, path, tmp_path):
    started = time.time_ns() - 100 * S
    assert run(replay.replay(spark, path, "original_time", started_ns=started), tmp_path, 7) == all_rows(100)
    again = run(replay.replay(spark, path, "original_time", started_ns=started), tmp_path, 7)
    assert again == all_rows(100)
    assert run(replay.replay(spark, path, "original_time", started_ns=started - 1000 * S), tmp_path, 8) == all_rows()


def test_accelerated(spark, path, tmp_path):
    assert run(replay.replay(spark, path, "accelerated", 50.0, started_ns=time.time_ns() - 30 * S), tmp_path, 8) == all_rows()


def test_offsets_follow_the_clock(spark, path, monkeypatch):
    about = replay._about(path)
    reader = replay.ReplayReader(path, about["last"], about["schema"], 2.0, 1000)
    seen = []
    for now in (900, 1000, 1000 + S // 2, 1000 + S // 4, 1000 + 600 * S):
        monkeypatch.setattr(replay.time, "time_ns", lambda now=now: now)
        seen.append(reader.latestOffset()["due"])
    assert seen == [-1, 0, S, S, 1005 * S]
    rows = lambda a, b: sum(x.num_rows for p in reader.partitions({"due": a}, {"due": b}) for x in reader.read(p))
    assert [rows(-1, 0), rows(0, S), rows(S, 1005 * S), rows(S, S), rows(S, 0)] == [3, 2, 3, 0, 0]


def test_refusals(spark, tmp_path):
    no_row = missions(spark, ("m", "n", "z"))
    with pytest.raises(replay.RefusedReplay, match="z: no rows"):
        replay.prepare(traces(spark), no_row, digest(), str(tmp_path / "a"))
    with pytest.raises(replay.RefusedReplay, match="n: hashes"):
        replay.prepare(traces(spark).withColumn("hash", F.when(F.col("mission_id") != "n", F.col("hash"))), missions(spark), digest(), str(tmp_path / "b"))
    with pytest.raises(replay.RefusedReplay, match="m: conflicts"):
        replay.prepare(traces(spark, [("m", 1, "other", 10, 0)]), missions(spark), digest(), str(tmp_path / "c"))
    with pytest.raises(replay.RefusedReplay, match="without index or time"):
        replay.prepare(traces(spark, [("n", 3, "n3", 11, None)]), missions(spark), digest(), str(tmp_path / "d"))
    for mode, x in (("fast", 1.0), ("accelerated", 1.0), ("accelerated", float("inf")), ("original_time", 2.0)):
        with pytest.raises(replay.RefusedReplay):
            replay.replay(spark, str(tmp_path), mode, x)
