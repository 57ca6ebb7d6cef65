"""Tables that cut lineage, written in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


_temporary: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or a temporary folder where it is unset and all runs in one process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        base = _temporary[app] = _temporary.get(app) or "file://" + tempfile.mkdtemp(prefix="tracelake-")
    return base.rstrip("/")


#: Rows of an Arrow batch.
BATCH_ROWS = 1000


class Scratch:
    """Intermediate tables of one operator call, as Parquet in the shared folder.

    A table is written whole and read again, so a lost executor costs a re-read, not the lineage. The folder goes when
    the application ends.
    While a call writes, shuffle files of finished writes are released, which bounds the disk.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        # whole texts in Arrow batches: fewer rows at once keep both sides of a Python worker small
        if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    @contextlib.contextmanager
    def releasing(self) -> Iterator[None]:
        """Writes within release their shuffle files when they end."""
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(key, None)
        self.spark.conf.set(key, "true")
        try:
            yield
        finally:
            self.spark.conf.unset(key) if before is None else self.spark.conf.set(key, before)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the table read again."""
        to = self.path(name)
        with self.releasing():
            df.write.option("compression", "zstd").parquet(to)
        return self.spark.read.schema(df.schema).parquet(to)

    def drop(self, df: DataFrame) -> None:
        """Delete a kept table that nothing reads any more."""
        jvm = self.spark._jvm
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            if self.root.split("://")[-1].split(":")[-1] in f:
                path = jvm.org.apache.hadoop.fs.Path(f)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
