"""What must be told apart or refused: digests, windows that don't fit, samples that aren't finite, replays, scans."""

import pytest
from pyspark.sql import functions as F

from tracelake.operators import constraints
from tracelake.plans import dsp, provenance


def digest(spark, rows, schema="a string, b string"):
    df = spark.createDataFrame(rows, schema)
    return tuple(provenance.fingerprint(df, *df.columns).first())


def test_digests_tell_rows_apart(spark):
    alike = [[("x|y", "z")], [("x", "y|z")], [(None, "z")], [("z", None)], [("", "z")], [("-", "z")], [("p", "p"), ("p", "p")], [("q", "q"), ("q", "q")], [("p", "p")], [], [("1:p", "p")], [("p", "1:p")]]
    got = [digest(spark, x) for x in alike]
    assert len(set(got)) == len(got) and all(len(d) == 64 for _, d in got)
    assert digest(spark, [("a", "b"), ("c", "d"), ("a", "b")]) == digest(spark, [("c", "d"), ("a", "b"), ("a", "b")])
    assert digest(spark, [([1.0, 2.0], b"\x00")], "a array<double>, b binary") != digest(spark, [([1.0], b"\x00")], "a array<double>, b binary")
    assert digest(spark, [([None], b"0")], "a array<string>, b binary") != digest(spark, [(["null"], b"0")], "a array<string>, b binary")


def test_digest_is_the_sum_of_the_rows(spark):
    import hashlib

    rows = [(f"k{i}", None if i % 3 else "v") for i in range(500)]
    text = lambda x: "-" if x is None else f"{len(x)}:{x}"
    want = sum(int(hashlib.sha256((text(a) + text(b)).encode()).hexdigest(), 16) for a, b in rows) % (1 << 256)
    assert digest(spark, rows) == (500, f"{want:064x}")


@pytest.mark.parametrize("fan", [8])
def test_trees_say_where_copies_differ(spark, fan):
    rows = [(m, i, f"h{i}") for m in ("a", "b") for i in range(-20, 300)]
    other = [x for x in rows if x[:2] != ("a", 77)] + [("b", 200, "again"), ("c", 5, "new")]
    one, two = (spark.createDataFrame(x, "mission_id string, trace_index long, hash string").repartition(3) for x in (rows, other))
    got = provenance.differing_ranges(one, two, ["mission_id"], "trace_index", ["trace_index", "hash"], 10, fan)
    assert sorted(map(tuple, got.collect())) == [("a", 70, 79), ("b", 200, 209), ("c", 0, 9)]
    assert provenance.differing_ranges(one, one, ["mission_id"], "trace_index", ["hash"], 10, fan).count() == 0
    assert provenance.equal_data(one, one.orderBy(F.rand(1)), "mission_id", "hash") and not provenance.equal_data(one, two, "mission_id", "hash")
    levels = provenance.digest_tree(one, ["mission_id"], "trace_index", ["hash"], 10, fan)
    assert len({r.digest for r in levels[-1].where("mission_id = 'a'").collect()}) == levels[-1].where("mission_id = 'a'").count()


def samples(spark, n, bad=None):
    value = lambda t, k: (float("nan") if (t, k) == bad else float(t), 0.0)
    return spark.createDataFrame([(t, 0, [value(t, k) for k in range(8)]) for t in range(n)], "trace_id long, channel int, values array<struct<re: double, im: double>>")


def test_windows_and_samples_that_do_not_fit(spark):
    assert dsp.flat_reflection(samples(spark, 5), 5).count() == 5
    with pytest.raises(Exception, match="a window of 5 traces does not fit the 4 of channel 0"):
        dsp.flat_reflection(samples(spark, 4), 5).collect()
    for stage in (lambda s: dsp.dewow(s, 3), lambda s: dsp.flat_reflection(s, 3)):
        with pytest.raises(Exception, match="finite"):
            stage(samples(spark, 5, (2, 3))).collect()


def test_replay_refuses(spark):
    traces = [("good", 0, "u0", "r0"), ("twice", 0, "u1", "r0"), ("twice", 0, "u1", "r1"), ("uid", 0, "u2", "r0"), ("uid", 1, "u2", "r1"), ("wrong", 0, "u3", "x"), ("none", 0, "u4", None), ("empty string", 0, "u5", "")]
    df = spark.createDataFrame([(*t, f"r{k}" if t[3] in ("r0", "r1") else "y", k) for k, t in enumerate(traces)], "mission_id string, trace_index long, trace_uid string, hash string, raw string, record_position long")
    df = df.withColumn("raw", F.when(F.col("hash").isin("r0", "r1"), F.col("hash")).otherwise("y"))
    missions = spark.createDataFrame([(m,) for m in sorted({t[0] for t in traces} | {"nothing"})], "mission_id string")
    got = {r.mission_id: r.reason for r in constraints.replay_refusals(df, missions, F.col("raw")).collect()}
    assert got == {"twice": "conflicts", "uid": "conflicts", "wrong": "hashes", "none": "hashes", "empty string": "hashes", "nothing": "no rows"}


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_scan_rules(spark, monkeypatch, size):
    monkeypatch.setattr(constraints, "POSITION_RANGE", size)
    rows = [("s", 0, "m", 0, "a"), ("s", 1, "m", 1, "b"), ("s", 5, "m", 1, "b"), ("s", 7, "n", 4, "c"), ("s", 8, "m", 3, "d"), ("t", 2, "n", 9, "a")]
    df = spark.createDataFrame(rows, "scan string, record_position long, mission_id string, trace_index long, trace_uid string")
    got = sorted((r.scan, r.record_position, r.rule) for r in constraints.scan_violations(df, ["scan"]).collect())
    assert got == [("s", 5, "identity"), ("s", 5, "order"), ("s", 5, "uid"), ("s", 7, "mission"), ("s", 8, "order")]
