"""Published trace tables, and a Python data source that reads them by chunks.

``publish`` writes ``<path>/chunks`` (Parquet; a file holds the indices of one mission in a range of ``CHUNK_ROWS``),
``<path>/index`` (a row a file: mission, lowest and highest index, rows, bytes) and last ``<path>/header.json`` (table,
version, role, lifecycle, rows, schema): without a header there is no table. Every row carries ``first`` (the first of its
index) and ``excluded`` (a conflict takes its index out), found once when the table is published, so that the logical view and
lookups are filters and need no shuffle.

``spark.read.format("traces").load(path)`` checks the header when it is opened, plans partitions from the index alone, and
reads only files whose mission and indices meet the filters; the same filters prune row groups. Paths are those
that pyarrow opens (``file:``, ``hdfs:``, ``s3:``); ``open_table`` gives a path without scheme that of Hadoop's default file system.
"""

from __future__ import annotations

import json
import operator
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .. import schemas
from .views import index_view

#: Tables of this major version are read, up to this minor version.
VERSION = (2, 0)
ROLES, LIFECYCLES = ("ground", "air", "processed"), ("open", "partial", "complete")
#: Indices of a mission in one file; bytes that one task reads.
CHUNK_ROWS, TASK_BYTES = 100_000, 128 << 20
FLAGS = T.StructType([T.StructField("first", T.BooleanType()), T.StructField("excluded", T.BooleanType())])
_KEYS = ["mission_id", "trace_index", "trace_uid", "hash", "record_position"]


class Unreadable(ValueError):
    """A table whose header, version, role, lifecycle or chunks break the contract."""


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that Hadoop's settings give it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def publish(traces: DataFrame, path: str, *, role: str, lifecycle: str = "complete", chunk_rows: int = CHUNK_ROWS) -> str:
    """Write ``traces`` (the contract's columns) as a table at ``path``, which must not exist; its qualified path.

    Rows without mission, index or position, columns that break the contract, an unknown role or lifecycle are refused. An empty
    table has a header and no chunks. Columns beyond the contract are left out.
    """
    spark = traces.sparkSession
    if bad := schemas.contract_violations(traces.schema, "traces"):
        raise Unreadable(f"no table of traces: {', '.join(bad)}")
    if role not in ROLES or lifecycle not in LIFECYCLES:
        raise Unreadable(f"unknown role or lifecycle: {role}, {lifecycle}")
    root = qualified(spark, path)
    rows = traces.select(*schemas.schema("traces").fieldNames())
    if not rows.where("mission_id is null or trace_index is null or record_position is null").isEmpty():
        raise Unreadable("rows without mission, index or position")
    flags = index_view(rows.select(*_KEYS)).select("mission_id", "trace_index", F.col("row.record_position").alias("_first"), "excluded")
    chunk = F.floor(F.col("trace_index") / chunk_rows)
    rows = rows.join(flags, ["mission_id", "trace_index"]).select(*rows.columns, (F.col("record_position") == F.col("_first")).alias("first"), "excluded", F.col("mission_id").alias("_mission"), chunk.alias("_chunk"))
    rows.repartition("_mission", "_chunk").sortWithinPartitions("_mission", "_chunk", "trace_index", "record_position").write.partitionBy("_mission", "_chunk").mode("error").parquet(f"{root}/chunks")
    fs, hadoop = hadoop_fs(spark, root)
    stored = 0
    if any(s.isDirectory() for s in fs.listStatus(hadoop(f"{root}/chunks"))):
        written = spark.read.schema("mission_id string, trace_index long").parquet(f"{root}/chunks")
        files = written.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"), "mission_id").agg(F.min("trace_index").alias("low"), F.max("trace_index").alias("high"), F.count("*").alias("rows"))
        files.sort("mission_id", "low").coalesce(1).write.mode("error").parquet(f"{root}/index")
        stored = spark.read.parquet(f"{root}/index").agg(F.sum("rows")).first()[0]
    out = fs.create(hadoop(f"{root}/header.json"), False)
    try:
        out.write(bytearray(json.dumps({"table": "traces", "version": list(VERSION), "role": role, "lifecycle": lifecycle, "rows": stored, "schema": T.StructType([*schemas.schema("traces"), *FLAGS]).jsonValue()}).encode()))
    finally:
        out.close()
    return root


def hadoop_fs(spark: SparkSession, root: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    return hadoop(root).getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def arrow_path(path: str):
    """pyarrow's file system of a path, which isn't encoded as a URI is, and the path in it."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), path
    authority, rest = rest[2:].split("/", 1) if rest.startswith("//") else ("", rest.lstrip("/"))
    system, base = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return system, f"{base.rstrip('/')}/{rest}"


def probe(path: str) -> dict:
    """The header of a table, checked; what is wrong raises ``Unreadable``."""
    fs, root = arrow_path(path)
    try:
        with fs.open_input_stream(f"{root}/header.json") as f:
            header = json.loads(f.read())
    except FileNotFoundError:
        raise Unreadable(f"{path} has no header") from None
    except ValueError:
        raise Unreadable(f"{path}: the header is no JSON") from None
    if not isinstance(header, dict) or header.get("table") != "traces":
        raise Unreadable(f"{path} is no table of traces")
    version = header.get("version")
    if not (isinstance(version, list) and [type(v) for v in version] == [int, int] and version[0] == VERSION[0] and 0 <= version[1] <= VERSION[1]):
        raise Unreadable(f"{path}: version {version} is not read here")
    for name, known in (("role", ROLES), ("lifecycle", LIFECYCLES)):
        if header.get(name) not in known:
            raise Unreadable(f"{path}: {name} {header.get(name)}")
    if type(header.get("rows")) is not int or header["rows"] < 0:
        raise Unreadable(f"{path}: rows {header.get('rows')}")
    try:
        header["schema"] = T.StructType.fromJson(header["schema"])
    except (KeyError, TypeError, ValueError, AttributeError):
        raise Unreadable(f"{path}: no schema") from None
    return header


class Chunks(InputPartition):
    """Files that one task reads."""

    def __init__(self, files: list[str]) -> None:
        super().__init__(files)
        self.files = files


class TraceReader(DataSourceReader):
    """Plans from the index; bounds on mission and index come from pushed filters, which Spark still applies to the rows."""

    PUSHED = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}

    def __init__(self, path: str, rows: int, schema: T.StructType, task_bytes: int = TASK_BYTES) -> None:
        self.path, self.rows, self.schema, self.task_bytes = path, rows, schema, task_bytes
        self.bounds: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in ("mission_id", "trace_index"):
                if isinstance(f, In):
                    self.bounds.append((column, "in", [v for v in f.value if v is not None]))
                elif type(f) in self.PUSHED and f.value is not None:
                    self.bounds.append((column, self.PUSHED[type(f)].__name__, f.value))
            yield f

    def _rows_meet(self):
        """The bounds on rows, None without any."""
        import pyarrow.dataset as ds

        out = None
        for column, how, value in self.bounds:
            one = ds.field(column).isin(value) if how == "in" else getattr(operator, how)(ds.field(column), value)
            out = one if out is None else out & one
        return out

    def _files_meet(self):
        """The bounds on the lowest and highest index of a file."""
        import pyarrow.dataset as ds

        out = ds.scalar(True)
        for column, how, value in self.bounds:
            if column == "mission_id":
                one = ds.field(column).isin(value) if how == "in" else getattr(operator, how)(ds.field(column), value)
            elif how == "in":
                one = (ds.field("high") >= min(value)) & (ds.field("low") <= max(value)) if value else ds.scalar(False)
            else:
                above, below = how in ("eq", "gt", "ge"), how in ("eq", "lt", "le")
                one = (getattr(operator, "gt" if how == "gt" else "ge")(ds.field("high"), value) if above else ds.scalar(True)) & (getattr(operator, "lt" if how == "lt" else "le")(ds.field("low"), value) if below else ds.scalar(True))
            out = out & one
        return out

    def partitions(self) -> list[Chunks]:
        import pyarrow.dataset as ds

        if not self.rows:
            return [Chunks([])]
        fs, root = arrow_path(self.path)
        index = ds.dataset(f"{root}/index", filesystem=fs, format="parquet", exclude_invalid_files=False)
        counted = sum(b["rows"].to_numpy().sum() for b in index.to_batches(columns=["rows"]))
        if counted != self.rows:
            raise Unreadable(f"{self.path}: the header has {self.rows} rows, the index {counted}")
        out, held = [], self.task_bytes
        for batch in index.to_batches(columns=["file", "bytes"], filter=self._files_meet()):
            for file, size in zip(batch["file"].to_pylist(), batch["bytes"].to_pylist(), strict=True):
                if held + size > self.task_bytes:
                    out.append(Chunks([]))
                    held = 0
                out[-1].files.append(unquote(file))
                held += size
        return out or [Chunks([])]

    def read(self, partition: Chunks) -> Iterator:
        import pyarrow.dataset as ds
        from pyspark.sql.pandas.types import to_arrow_schema

        want = to_arrow_schema(self.schema)
        for file in partition.files:
            fs, path = arrow_path(file)
            chunk = ds.dataset(path, filesystem=fs, format="parquet")
            if lacking := [n for n in want.names if n not in chunk.schema.names]:
                raise Unreadable(f"{file} lacks {', '.join(lacking)}")
            for batch in chunk.to_batches(columns=want.names, filter=self._rows_meet(), batch_size=8192):
                if batch.num_rows:
                    yield batch.cast(want)


class TraceSource(DataSource):
    """``format("traces")``. Option ``lifecycle``: the states that may be read, by default ``complete``; ``columns``: the only ones read; ``task_bytes``: of a task."""

    @classmethod
    def name(cls) -> str:
        return "traces"

    def schema(self) -> T.StructType:
        path = self.options.get("path") or ""
        header = probe(path)
        if header["lifecycle"] not in (allowed := self.options.get("lifecycle", "complete").split(",")):
            raise Unreadable(f"{path} is {header['lifecycle']}, only {', '.join(allowed)} is read")
        full = header["schema"]
        columns = [c for c in self.options.get("columns", "").split(",") if c] or full.fieldNames()
        if unknown := set(columns) - set(full.fieldNames()):
            raise Unreadable(f"no columns of traces: {', '.join(sorted(unknown))}")
        return T.StructType([full[c] for c in columns])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return TraceReader(self.options["path"], probe(self.options["path"])["rows"], schema, int(self.options.get("task_bytes", TASK_BYTES)))


def open_table(spark: SparkSession, path: str, *, columns: list[str] | None = None, lifecycle: tuple[str, ...] = ("complete",), task_bytes: int = TASK_BYTES) -> DataFrame:
    """A published table, rows as they were committed; a header whose schema breaks the contract is refused.

    Registers the source and turns on filters for Python sources in the session.
    """
    root = qualified(spark, path)
    if bad := schemas.contract_violations(probe(root)["schema"], "traces"):
        raise Unreadable(f"{root} is no table of traces: {', '.join(bad)}")
    spark.dataSource.register(TraceSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("traces").option("lifecycle", ",".join(lifecycle)).option("task_bytes", str(task_bytes))
    return (reader.option("columns", ",".join(columns)) if columns else reader).load(root)


def logical(table: DataFrame) -> DataFrame:
    """The logical view of a published table, a filter."""
    return table.where("first and not excluded")


def lookup(spark: SparkSession, path: str, mission: str, index: int, columns: list[str] | None = None) -> DataFrame:
    """One logical trace, from the one file that may hold it; an index that is excluded or absent raises."""
    need = list(dict.fromkeys(["mission_id", "trace_index", "first", "excluded", *columns])) if columns else None
    rows = open_table(spark, path, columns=need).where((F.col("mission_id") == mission) & (F.col("trace_index") == index))
    if (found := rows.where("first").select("excluded").first()) is None:
        raise LookupError(f"trace {index} of {mission} is absent")
    if found.excluded:
        raise LookupError(f"trace {index} of {mission} is excluded by a conflict")
    rows = logical(rows)
    return rows.select(*columns) if columns else rows
