"""Recorded traces as a paced stream: a Python streaming source whose offsets are places in the recorded time.

``prepare`` gives every trace ``due_ns``, the sum of the waits before it (a wait is never negative), and writes the traces
in files by ranges of ``due_ns``, with an index of these files. An offset of the source is the greatest ``due_ns`` that is delivered. Where it
stands follows from the wall clock alone: what has passed since ``started_ns`` times the acceleration. A restart from a
checkpoint with the same ``started_ns`` goes on behind the last offset, repeats nothing, and delivers at once what fell due meanwhile. The clock must not
be set back while a query is down.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader

from ..operators.constraints import replay_refusals
from ..operators.timing import replay_gaps
from ..sources.ordered import running
from ..sources.tracefiles import TASK_BYTES, Chunks, Unreadable, arrow_path, hadoop_fs, qualified
from ..sources.views import INDEX_RANGE

#: Recorded time that one file spans; rows of a file, beyond which it is parted.
FILE_NS, FILE_ROWS = 3_600_000_000_000, 1_000_000
MODES = ("per_trace", "original_time", "accelerated")


class RefusedReplay(ValueError):
    """Missions that can't be replayed, or a mode that is none."""


def due(traces: DataFrame) -> DataFrame:
    """``traces(mission_id, trace_index, at_ns, ...)`` with ``due_ns``, the recorded time from the mission's first trace; missions run side by side."""
    gaps = replay_gaps(traces)
    before = running(gaps, ["mission_id"], ["trace_index"], INDEX_RANGE, {"_before": F.col("gap_ns")})
    return before.withColumn("due_ns", F.col("_before") + F.col("gap_ns")).drop("_before", "gap_ns")


def prepare(traces: DataFrame, missions: DataFrame, digest: Column, path: str, *, file_ns: int = FILE_NS) -> str:
    """Write a replay of ``traces(mission_id, trace_index, trace_uid, hash, record_position, at_ns, ...)`` at ``path``; its qualified path.

    Missions with conflicts, with hashes that are missing or differ from ``digest``, or without rows refuse the whole replay, as do rows
    without a time. Of the copies of an index the first committed one is replayed.
    """
    bad = replay_refusals(traces, missions, digest).limit(5).collect()
    if bad:
        raise RefusedReplay(", ".join(f"{r.mission_id}: {r.reason}" for r in bad))
    if not traces.where("at_ns is null or trace_index is null").isEmpty():
        raise RefusedReplay("traces without index or time")
    spark, root = traces.sparkSession, qualified(traces.sparkSession, path)
    first = traces.groupBy("mission_id", "trace_index").agg(F.min("record_position").alias("record_position"))
    rows = due(traces.join(first, ["mission_id", "trace_index", "record_position"], "left_semi").select(*traces.columns))
    part = F.floor(F.col("due_ns") / file_ns)
    rows = rows.withColumn("_part", part).repartition("_part", F.pmod(F.xxhash64("mission_id"), F.lit(64))).sortWithinPartitions("_part", "due_ns")
    rows.write.partitionBy("_part").option("maxRecordsPerFile", FILE_ROWS).mode("error").parquet(f"{root}/files")
    stored = spark.read.schema("due_ns long").parquet(f"{root}/files")
    index = stored.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(F.min("due_ns").alias("low"), F.max("due_ns").alias("high"))
    index.sort("low").coalesce(1).write.mode("error").parquet(f"{root}/index")
    last = spark.read.parquet(f"{root}/index").agg(F.max("high")).first()[0]
    fs, hadoop = hadoop_fs(spark, root)
    out = fs.create(hadoop(f"{root}/replay.json"), False)
    try:
        out.write(bytearray(json.dumps({"last": -1 if last is None else last, "schema": T.StructType([f for f in rows.schema if f.name != "_part"]).jsonValue()}).encode()))
    finally:
        out.close()
    return root


def _about(path: str) -> dict:
    fs, root = arrow_path(path)
    try:
        with fs.open_input_stream(f"{root}/replay.json") as f:
            about = json.loads(f.read())
    except FileNotFoundError:
        raise Unreadable(f"{path} is no prepared replay") from None
    return about | {"schema": T.StructType.fromJson(about["schema"])}


class ReplayReader(DataSourceStreamReader):
    """Offsets are ``{"due": ns}``; a batch holds what is due after its start up to its end."""

    def __init__(self, path: str, last: int, schema: T.StructType, rate: float | None, started_ns: int) -> None:
        self.path, self.last, self.schema, self.rate, self.started_ns, self.most = path, last, schema, rate, started_ns, -1

    def initialOffset(self) -> dict:
        return {"due": -1}

    def latestOffset(self) -> dict:
        reached = self.last if self.rate is None else min(self.last, int((time.time_ns() - self.started_ns) * self.rate))
        self.most = max(self.most, reached)
        return {"due": self.most}

    def partitions(self, start: dict, end: dict) -> list[Chunks]:
        import pyarrow.dataset as ds

        fs, root = arrow_path(self.path)
        self.most = max(self.most, end["due"])
        index = ds.dataset(f"{root}/index", filesystem=fs, format="parquet")
        out, held = [], TASK_BYTES
        for batch in index.to_batches(columns=["file", "bytes"], filter=(ds.field("low") <= end["due"]) & (ds.field("high") > start["due"])):
            for file, size in zip(batch["file"].to_pylist(), batch["bytes"].to_pylist(), strict=True):
                if held + size > TASK_BYTES:
                    out.append(Due([], start["due"], end["due"]))
                    held = 0
                out[-1].files.append(unquote(file))
                held += size
        return out or [Due([], start["due"], end["due"])]

    def read(self, partition: Due) -> Iterator:
        import pyarrow.dataset as ds
        from pyspark.sql.pandas.types import to_arrow_schema

        want = to_arrow_schema(self.schema)
        met = (ds.field("due_ns") > partition.start) & (ds.field("due_ns") <= partition.end)
        for file in partition.files:
            fs, path = arrow_path(file)
            for batch in ds.dataset(path, filesystem=fs, format="parquet").to_batches(columns=want.names, filter=met, batch_size=8192):
                if batch.num_rows:
                    yield batch.cast(want)


class Due(Chunks):
    """Files with the bounds of a batch."""

    def __init__(self, files: list[str], start: int, end: int) -> None:
        super().__init__(files)
        self.start, self.end = start, end


class ReplaySource(DataSource):
    """``format("trace_replay")`` with the options ``rate`` (empty: no waits) and ``started_ns``."""

    @classmethod
    def name(cls) -> str:
        return "trace_replay"

    def schema(self) -> T.StructType:
        return _about(self.options["path"])["schema"]

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        rate = self.options.get("rate") or None
        return ReplayReader(self.options["path"], _about(self.options["path"])["last"], schema, rate and float(rate), int(self.options["started_ns"]))


def replay(spark: SparkSession, path: str, mode: str, acceleration: float = 1.0, *, started_ns: int | None = None) -> DataFrame:
    """The stream of a prepared replay: ``per_trace`` (no waits), ``original_time``, or ``accelerated`` by more than 1.

    ``started_ns`` is the wall clock at the mission's first trace, now by default; a restart must give that of the first start.
    """
    fits = 1 < acceleration < float("inf") if mode == "accelerated" else acceleration == 1
    if mode not in MODES or not fits:
        raise RefusedReplay("only the accelerated mode takes an acceleration, a finite one above 1")
    spark.dataSource.register(ReplaySource)
    rate = "" if mode == "per_trace" else repr(float(acceleration))
    return spark.readStream.format("trace_replay").option("rate", rate).option("started_ns", str(time.time_ns() if started_ns is None else started_ns)).load(qualified(spark, path))
