"""A table with a log of numbered commits: readers see whole versions, writers race and retry, nothing is seen half.

``<path>/_log/<version>.json`` holds the whole state of a version: the live folders of data, the schema, the lifecycle
state, the last batch of every stream, the revision of every dataset. A commit writes data below a folder of its own first, checks it, and
then puts the next number, which only one writer can: by a hard link on local disks, by a rename that replaces nothing elsewhere (atomic on HDFS). Whoever loses
reads the new state and decides again. What a crash leaves is a folder that no version names; ``vacuum`` removes it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.provenance import fingerprint
from .ordered import bucket

#: Times that a writer decides again after it lost a race.
ATTEMPTS = 50
#: Indices of a mission that one folder of the stored data holds.
INDEX_RANGE = 100_000


class Refused(ValueError):
    """A commit that the state of the table forbids."""


@dataclass(frozen=True)
class State:
    """What a version holds; version -1 is a table that is not there yet."""

    version: int = -1
    folders: tuple[str, ...] = ()
    schema: str | None = None
    lifecycle: str = "open"
    batches: dict[str, int] = field(default_factory=dict)
    revisions: dict[str, int] = field(default_factory=dict)


class Snapshots:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- the log

    def versions(self) -> list[int]:
        log = self._path(f"{self.path}/_log")
        if not self._fs.exists(log):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(log)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def state(self, version: int | None = None) -> State:
        """The state of a version, by default the last one."""
        if version is None:
            version = max(self.versions(), default=-1)
        if version < 0:
            return State()
        stream = self._fs.open(self._path(f"{self.path}/_log/{version:012d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        have = json.loads(text)
        return State(**(have | {"folders": tuple(have["folders"])}))

    def _put(self, state: State) -> bool:
        """Whether this state became its version: only if no other writer put one of that number."""
        jvm, log = self.spark._jvm, f"{self.path}/_log"
        self._fs.mkdirs(self._path(log))
        ready, target = self._path(f"{log}/.{uuid.uuid4().hex}"), self._path(f"{log}/{state.version:012d}.json")
        out = self._fs.create(ready)
        try:
            out.write(bytearray(json.dumps(asdict(state)).encode()))
        finally:
            out.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                name = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
                try:
                    jvm.java.nio.file.Files.createLink(name(target), name(ready))
                    return True
                except Exception as e:
                    if "FileAlreadyExistsException" in str(e):
                        return False
                    raise
            return not self._fs.exists(target) and bool(self._fs.rename(ready, target))
        finally:
            self._fs.delete(ready, False)

    def commit(self, decide: Callable[[State], State | None]) -> State:
        """Put what ``decide`` makes of the last state; decide again when another writer was first. None: nothing to do."""
        for _ in range(ATTEMPTS):
            before = self.state()
            after = decide(before)
            if after is None:
                return before
            after = replace(after, version=before.version + 1)
            if self._put(after):
                return after
            for folder in set(after.folders) - set(before.folders):
                self._drop(folder)
        raise Refused(f"{self.path}: other writers were first {ATTEMPTS} times")

    # ---- data

    def _drop(self, folder: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{folder}"), True)

    def _write(self, rows: DataFrame) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        # a range of a mission is one task's, or each task would write a file in each range
        rows = rows.withColumn("index_range", bucket("trace_index", INDEX_RANGE)).repartition("mission_id", "index_range")
        rows.write.partitionBy("index_range").parquet(f"{self.path}/{folder}")
        return folder

    def _rows(self, state: State) -> DataFrame | None:
        """Rows of a state with ``index_range``; None where there are none."""
        if not state.folders:
            return None
        schema = T.StructType.fromJson(json.loads(state.schema)).add("index_range", "long")
        frames = [self.spark.read.schema(schema).option("basePath", f"{self.path}/{f}").parquet(f"{self.path}/{f}") for f in state.folders]
        out = frames[0]
        for x in frames[1:]:
            out = out.unionByName(x)
        return out

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, as they were when it was put, whatever is written meanwhile."""
        state = self.state(version)
        if state.schema is None:
            raise Refused(f"{self.path} has no version")
        rows = self._rows(state)
        return self.spark.createDataFrame([], T.StructType.fromJson(json.loads(state.schema))) if rows is None else rows.drop("index_range")

    # ---- what writers do

    def append(self, incoming: DataFrame, stream: str | None = None, batch: int | None = None) -> dict[str, int]:
        """Append what is new; ``{action: rows}``. A batch of a ``stream`` that has been put is not looked at again.

        Duplicates are left out and conflicts rejected, against what is stored in the same ranges of the same missions.
        """
        from .sinks import classify

        counts: dict[str, int] = {}

        def decide(state: State) -> State | None:
            counts.clear()
            if state.lifecycle != "open":
                raise Refused(f"the table is {state.lifecycle}")
            if stream is not None and state.batches.get(stream, -1) >= batch:
                return None
            if state.schema is not None and T.StructType.fromJson(json.loads(state.schema)).simpleString() != incoming.schema.simpleString():
                raise Refused("the batch has other columns than the table")
            key = ["mission_id", "trace_index", "trace_uid", "hash", "record_position"]
            stored = self._rows(state)
            if stored is None:
                stored = incoming.select(*key).limit(0)
            else:
                spans = incoming.select("mission_id", bucket("trace_index", INDEX_RANGE).alias("index_range")).distinct()
                stored = stored.join(spans, ["mission_id", "index_range"], "left_semi").select(*key)
            rows = classify(incoming, stored).persist()
            try:
                counts.update({r.action: r["count"] for r in rows.groupBy("action").count().collect()})
                folders = (self._write(rows.where("action = 'append'").drop("action")),) if counts.get("append") else ()
            finally:
                rows.unpersist()
            batches = state.batches if stream is None else state.batches | {stream: batch}
            if not folders and batches == state.batches and state.schema is not None:
                return None
            return replace(state, folders=state.folders + folders, schema=state.schema or incoming.schema.json(), batches=batches)

        self.commit(decide)
        return counts

    def finalize(self, lifecycle: str = "complete") -> State:
        """End the table; an ended one takes no more rows and no other end."""

        def decide(state: State) -> State:
            if state.version < 0 or state.lifecycle != "open":
                raise Refused(f"the table is {state.lifecycle if state.version >= 0 else 'not there'}")
            return replace(state, lifecycle=lifecycle)

        return self.commit(decide)

    def attach(self, derived: DataFrame, declared: tuple[str, ...]) -> State:
        """Add columns of ``derived(mission_id, trace_index, ...)`` that ``declared`` names: staged, read back, compared, then put.

        The raw columns' digest of what was staged must be that of the version it was made from; else it is removed and nothing is put.
        """
        key = ["mission_id", "trace_index"]
        new = [c for c in derived.columns if c not in key]

        def decide(state: State) -> State:
            rows = self._rows(state)
            if rows is None:
                raise Refused("there are no traces")
            rows = rows.drop("index_range")
            if bad := sorted(c for c in new if c not in declared or c in rows.columns):
                raise Refused(f"not declared as derived, or raw: {bad}")
            staged = self._write(rows.join(derived, key, "left"))
            schema = rows.join(derived.limit(0), key, "left").schema
            after = replace(state, folders=(staged,), schema=schema.json())
            raw = [fingerprint(x, *rows.columns).first() for x in (rows, self._rows(after))]
            if raw[0] != raw[1]:
                self._drop(staged)
                raise Refused("the raw columns changed while derived ones were attached")
            return after

        return self.commit(decide)

    def publish(self, dataset: str, revision: int, rows: DataFrame | None = None) -> State:
        """Make ``revision`` of a dataset the current one; one that is not above it is stale and refused."""

        def decide(state: State) -> State:
            if (current := state.revisions.get(dataset, -1)) >= revision:
                raise Refused(f"revision {revision} of {dataset} is stale, {current} is current")
            if rows is not None:
                rows.write.mode("overwrite").parquet(f"{self.path}/results/{dataset}/{revision}")
            return replace(state, revisions=state.revisions | {dataset: revision})

        return self.commit(decide)

    def published(self, dataset: str) -> DataFrame:
        """The results of a dataset's current revision."""
        return self.spark.read.parquet(f"{self.path}/results/{dataset}/{self.state().revisions[dataset]}")

    def vacuum(self, keep: int = 10) -> list[str]:
        """Remove folders that none of the last ``keep`` versions names, such as those of writers that broke off; no writer may be at work."""
        live = {f for v in self.versions()[-keep:] for f in self.state(v).folders}
        data = self._path(f"{self.path}/data")
        there = [f"data/{s.getPath().getName()}" for s in self._fs.listStatus(data)] if self._fs.exists(data) else []
        dead = sorted(set(there) - live)
        for f in dead:
            self._drop(f)
        return dead


def append_stream(traces: DataFrame, table: Snapshots, name: str, checkpoint: str):
    """Every micro-batch of a stream as one commit; a batch that is run again after a failure is known by its number."""
    return traces.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: table.append(df, name, n) and None).trigger(availableNow=True).start()


def shared_table(spark: SparkSession, name: str) -> Snapshots:
    """A table of its own in the folder that driver and executors share."""
    from .checkpoints import shared_dir

    return Snapshots(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
