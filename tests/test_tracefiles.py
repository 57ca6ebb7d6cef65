import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, LessThan

from tracelake import schemas
from tracelake.sources import tracefiles, views

#: (mission, index, uid, hash, position)
ROWS = [("m", i, f"u{i}", f"h{i}", i) for i in range(50)] + [("m", 7, "u7", "h7", 60), ("m", 8, "u8", "other", 61), ("m", 30, "u31", "h30", 62), ("n", 7, None, None, 0), ("n", 45, "u7", "x", 1)]


def traces(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "mission_id string, trace_index long, trace_uid string, hash string, record_position long")
    return schemas.completed(df, "traces").withColumn("started_utc", F.timestamp_seconds("trace_index")).withColumn("raw", F.encode("trace_uid", "utf-8"))


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    return tracefiles.publish(traces(spark), str(tmp_path_factory.mktemp("t") / "table"), role="air", chunk_rows=10)


def test_views_of_a_published_table(spark, path):
    table = tracefiles.open_table(spark, path)
    want = traces(spark)
    assert sorted(table.drop("first", "excluded").collect(), key=repr) == sorted(want.collect(), key=repr)
    assert sorted(tracefiles.logical(table).drop("first", "excluded").collect(), key=repr) == sorted(views.logical(want).select(*want.columns).collect(), key=repr)
    assert "Exchange" not in tracefiles.logical(table)._jdf.queryExecution().executedPlan().toString()


def test_a_lookup_reads_one_chunk(spark, path):
    reader = tracefiles.TraceReader(path, len(ROWS), schemas.schema("traces"))
    assert sum(len(p.files) for p in reader.partitions()) == 7
    for filters, files in (([EqualTo(("mission_id",), "m"), EqualTo(("trace_index",), 12)], 1), ([EqualTo(("trace_index",), 45)], 2), ([In(("trace_index",), (3, 14))], 3), ([LessThan(("trace_index",), 10)], 2), ([EqualTo(("mission_id",), "z")], 0)):
        reader = tracefiles.TraceReader(path, len(ROWS), schemas.schema("traces"))
        assert list(reader.pushFilters(filters)) == filters
        assert sum(len(p.files) for p in reader.partitions()) == files
    narrow = tracefiles.open_table(spark, path, task_bytes=1).where("mission_id = 'm' and trace_index between 12 and 13")
    assert narrow.rdd.getNumPartitions() == 1 and narrow.count() == 2
    assert tracefiles.open_table(spark, path, task_bytes=1).rdd.getNumPartitions() == 7


def test_lookups(spark, path):
    assert tracefiles.lookup(spark, path, "m", 7, ["record_position"]).collect() == [(7,)]
    assert tracefiles.lookup(spark, path, "n", 45, ["trace_uid"]).collect() == [("u7",)]
    for mission, index, word in (("m", 8, "excluded"), ("m", 30, "excluded"), ("m", 31, "excluded"), ("m", 50, "absent"), ("z", 0, "absent")):
        with pytest.raises(LookupError, match=word):
            tracefiles.lookup(spark, path, mission, index)


@pytest.mark.parametrize("change", [{"version": [3, 0]}, {"version": [2, 1]}, {"version": "2"}, {"version": [2, True]}, {"role": "sea"}, {"lifecycle": "open"}, {"lifecycle": None}, {"table": "fixes"}, {"rows": -1}, {"schema": None}, {"schema": {"type": "struct", "fields": []}}])
def test_bad_headers_fail_at_open(spark, path, tmp_path, change):
    (tmp_path / "header.json").write_text(json.dumps({"table": "traces", "version": [2, 0], "role": "air", "lifecycle": "complete", "rows": 0, "schema": schemas.schema("traces").jsonValue()} | change))
    with pytest.raises(Exception) as e:
        tracefiles.open_table(spark, str(tmp_path))
    assert e.type is tracefiles.Unreadable or "Unreadable" in str(e.value)


def test_no_header_more_rows_than_chunks_and_partial(spark, tmp_path):
    with pytest.raises(Exception, match="no header"):
        tracefiles.open_table(spark, str(tmp_path))
    root = tracefiles.publish(traces(spark), str(tmp_path / "t"), role="air", lifecycle="partial")
    assert tracefiles.open_table(spark, root, lifecycle=("complete", "partial")).count() == len(ROWS)
    header = Path(root.removeprefix("file:")) / "header.json"
    (header.parent / ".header.json.crc").unlink(missing_ok=True)
    header.write_text(json.dumps(json.loads(header.read_text()) | {"rows": 99, "lifecycle": "complete"}))
    with pytest.raises(Exception, match="99 rows"):
        tracefiles.open_table(spark, root).count()


def test_empty_tables_and_refusals(spark, tmp_path):
    root = tracefiles.publish(traces(spark, []), str(tmp_path / "e"), role="ground")
    assert tracefiles.open_table(spark, root).count() == 0
    with pytest.raises(tracefiles.Unreadable, match="without mission"):
        tracefiles.publish(traces(spark, [(None, 1, "u", "h", 0)]), str(tmp_path / "n"), role="air")
    with pytest.raises(tracefiles.Unreadable, match="role"):
        tracefiles.publish(traces(spark), str(tmp_path / "r"), role="sea")
    with pytest.raises(tracefiles.Unreadable, match="hash: missing"):
        tracefiles.publish(traces(spark).drop("hash"), str(tmp_path / "c"), role="air")


def test_odd_mission_names(spark, tmp_path):
    names = ["", "a b", "x/y", "50%2F=é?#", "NULL"]
    rows = [(m, i, f"{m}{i}", "h", i) for m in names for i in (0, 3)]
    root = tracefiles.publish(traces(spark, rows), str(tmp_path / "o d"), role="air", chunk_rows=2)
    assert sorted((r.mission_id, r.trace_index) for r in tracefiles.open_table(spark, root).collect()) == sorted((m, i) for m in names for i in (0, 3))
    for m in names:
        assert tracefiles.lookup(spark, root, m, 3, ["trace_uid"]).collect() == [(f"{m}3",)]
