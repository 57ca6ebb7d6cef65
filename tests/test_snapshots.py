"""Versions of a table: races, crashes, replays of batches, ends, attachments and revisions."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tracelake.sources import snapshots
from tracelake.sources.snapshots import Refused, Snapshots

TRACES = "mission_id string, trace_index long, trace_uid string, hash string, record_position long"


@pytest.fixture
def table(spark, tmp_path):
    return Snapshots(spark, f"file://{tmp_path}/t")


def traces(spark, lo, hi, h="x", mission="m"):
    return spark.createDataFrame([(mission, i, f"u{mission}{i}", h, i) for i in range(lo, hi)], TRACES)


def test_appends_and_versions(spark, table, monkeypatch):
    monkeypatch.setattr(snapshots, "INDEX_RANGE", 10)
    assert table.append(traces(spark, 0, 25)) == {"append": 25}
    assert table.append(traces(spark, 20, 30)) == {"append": 5, "duplicate": 5}
    assert table.append(traces(spark, 9, 11, "y")) == {"conflict": 2}
    assert table.append(traces(spark, 0, 3, mission="far")) == {"append": 3}
    assert table.append(traces(spark, 0, 3, mission="far")) == {"duplicate": 3}
    assert table.versions() == [0, 1, 2]  # what adds nothing makes no version
    assert [table.read(v).count() for v in table.versions()] == [25, 30, 33] and table.read().columns == traces(spark, 0, 1).columns
    with pytest.raises(Refused, match="other columns"):
        table.append(traces(spark, 40, 41).withColumn("more", F.lit(1)))
    with pytest.raises(Refused, match="no version"):
        Snapshots(spark, table.path + "-other").read()


def test_a_range_is_written_by_one_task(spark, table, monkeypatch):
    """Else each task writes a file in each range, and a table of many ranges is all files."""
    monkeypatch.setattr(snapshots, "INDEX_RANGE", 10)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        assert table.append(traces(spark, 0, 30).unionByName(traces(spark, 0, 30, mission="n"))) == {"append": 60}
    finally:
        spark.conf.set(name, before)
    names = [r.f for r in table.read().select(F.input_file_name().alias("f")).distinct().collect()]
    ranges = [n.split("index_range=")[1].split("/")[0] for n in names]
    assert set(ranges) == {"0", "1", "2"} and max(map(ranges.count, ranges)) <= 2 and table.read().count() == 60


def test_two_writers_race_and_nothing_is_lost(spark, table):
    table.append(traces(spark, 0, 1))
    with ThreadPoolExecutor(4) as pool:  # overlapping ranges from four writers at once
        got = list(pool.map(lambda k: Snapshots(spark, table.path).append(traces(spark, 10 * k, 10 * k + 15)), range(4)))
    assert sum(x.get("append", 0) for x in got) == 44 and sum(x.get("duplicate", 0) for x in got) == 16
    assert sorted(r.trace_index for r in table.read().collect()) == list(range(45))
    assert table.vacuum() == []  # who lost a race left nothing behind


def test_only_one_puts_a_number(spark, table):
    table.append(traces(spark, 0, 1))
    state = table.state()
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: table._put(snapshots.replace(state, version=1, lifecycle=f"w{k}")), range(8)))
    assert sum(won) == 1 and table.state().lifecycle == f"w{won.index(True)}"


def test_a_crash_before_the_commit_is_not_seen(spark, table, monkeypatch):
    table.append(traces(spark, 0, 5), "s", 0)

    def crash(self, state):
        raise RuntimeError("gone")

    with monkeypatch.context() as m:
        m.setattr(Snapshots, "_put", crash)
        with pytest.raises(RuntimeError):
            table.append(traces(spark, 5, 9), "s", 1)
    assert table.read().count() == 5 and table.versions() == [0]
    assert table.append(traces(spark, 5, 9), "s", 1) == {"append": 4}  # the batch is run again
    assert table.append(traces(spark, 5, 9), "s", 1) == {} and table.state().batches == {"s": 1}
    assert len(table.vacuum()) == 1 and table.read().count() == 9


def test_readers_keep_their_version(spark, table):
    table.append(traces(spark, 0, 5))
    before = table.read()
    table.append(traces(spark, 5, 9))
    assert before.count() == 5 and table.read(0).count() == 5 and table.read().count() == 9


def test_an_ended_table_stays_as_it_is(spark, table):
    with pytest.raises(Refused, match="not there"):
        table.finalize()
    table.append(traces(spark, 0, 5))
    assert table.finalize("aborted").lifecycle == "aborted"
    for change in (lambda: table.append(traces(spark, 5, 6)), table.finalize):
        with pytest.raises(Refused, match="aborted"):
            change()
    assert table.read().count() == 5


def test_attachments_are_verified_before_they_are_put(spark, table):
    table.append(traces(spark, 0, 3))
    derived = spark.createDataFrame([("m", 1, [0.5])], "mission_id string, trace_index long, processed array<double>")
    with pytest.raises(Refused, match="raw columns changed"):
        table.attach(derived.union(derived), ("processed",))  # would double a trace
    with pytest.raises(Refused, match="not declared"):
        table.attach(derived.withColumnRenamed("processed", "hash"), ("hash",))
    assert table.versions() == [0] and table.vacuum() == []
    table.attach(derived, ("processed",))
    assert {r.trace_index: r.processed for r in table.read().collect()} == {0: None, 1: [0.5], 2: None}
    assert "processed" not in table.read(0).columns


def test_stale_revisions_are_refused(spark, table):
    rows = spark.range(3)
    table.publish("d", 2, rows)
    for stale in (1, 2):
        with pytest.raises(Refused, match="stale"):
            table.publish("d", stale, spark.range(9))
    assert table.published("d").count() == 3
    table.publish("d", 5, spark.range(9))
    with ThreadPoolExecutor(4) as pool:
        def attempt(k):
            try:
                table.publish("e", k)
                return True
            except Refused:
                return False

        list(pool.map(attempt, range(4)))
    assert table.published("d").count() == 9 and table.state().revisions == {"d": 5, "e": 3}


def test_a_stream_is_put_batch_by_batch(spark, table, tmp_path):
    for k in range(3):
        traces(spark, 4 * k, 4 * k + 6).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    for _ in range(2):  # the second run finds nothing new
        source = spark.readStream.schema(TRACES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        snapshots.append_stream(source, table, "s", f"{tmp_path}/ck").awaitTermination()
    assert sorted(r.trace_index for r in table.read().collect()) == list(range(14)) and table.state().batches == {"s": 2}
