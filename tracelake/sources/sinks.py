"""Incremental sink of traces: what a batch adds, repeats or contradicts; recovery of a committed prefix."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.provenance import fingerprint

#: Indices of a mission that one folder of the stored data holds.
INDEX_RANGE = 100_000


def classify(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """``incoming`` with ``action``: ``append``, ``duplicate`` (nothing to write) or ``conflict`` (rejected, kept as evidence).

    Within a batch the first row of an index counts as stored for the rows after it.
    """
    key = ["mission_id", "trace_index"]
    have = stored.groupBy(*key).agg(F.min_by("hash", "record_position").alias("old"))
    w = Window.partitionBy(*key).orderBy("record_position")
    rows = incoming.join(have, key, "left").withColumn("_n", F.row_number().over(w)).withColumn("_first", F.first("hash").over(w))
    against = F.coalesce("old", F.when(F.col("_n") > 1, F.col("_first")))
    return rows.withColumn("action", F.when(against.isNull(), "append").when(against == F.col("hash"), "duplicate").otherwise("conflict")).drop("old", "_n", "_first")


def append_batch(incoming: DataFrame, path: str) -> dict[str, int]:
    """Append what is new below ``path``; running a batch again writes nothing. Data first, then the row of the manifest.

    Data are kept by ranges of the index, and a batch is held only against the ranges that it spans.
    """
    spark = incoming.sparkSession
    span = F.call_function("div", F.col("trace_index"), F.lit(INDEX_RANGE))
    key = ["mission_id", "trace_index", "trace_uid", "hash", "record_position"]
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    there = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)
    stored = incoming.select(*key).limit(0)
    if there:
        lo, hi = incoming.agg(F.min(span), F.max(span)).first()
        stored = spark.read.parquet(f"{path}/data").where(F.col("index_range").between(lo, hi)).select(*key)
    rows = classify(incoming, stored).persist()
    try:
        counts = {r.action: r["count"] for r in rows.groupBy("action").count().collect()}
        if counts.get("append"):
            rows.where("action = 'append'").drop("action").withColumn("index_range", span).repartition("mission_id", "index_range").write.mode("append").partitionBy("index_range").parquet(f"{path}/data")
        if counts.get("conflict"):
            rows.where("action = 'conflict'").drop("action").write.mode("append").parquet(f"{path}/conflicts")
        spark.createDataFrame([(counts.get("append", 0), counts.get("duplicate", 0), counts.get("conflict", 0))], "appended long, duplicates long, conflicts long").write.mode("append").parquet(f"{path}/manifest")
    finally:
        rows.unpersist()
    return counts


def finalize(rows: DataFrame, path: str) -> None:
    """Write a finished table; one that is there is never overwritten."""
    rows.write.mode("errorifexists").parquet(path)


def recovery_plan(traces: DataFrame, missions: DataFrame) -> DataFrame:
    """Per mission: committed and stored rows, tail rows to drop, and whether a recovery can go ahead."""
    have = traces.groupBy("mission_id").agg(F.count("*").alias("stored"), F.max("record_position").alias("last"))
    df = missions.join(have, "mission_id", "left").withColumn("stored", F.coalesce("stored", F.lit(0)))
    tail = F.greatest(F.lit(0), F.coalesce("last", F.lit(-1)) + 1 - F.col("committed_record_count"))
    fits = F.coalesce("last", F.lit(-1)) + 1 >= F.col("committed_record_count")
    return df.select("mission_id", "committed_record_count", "stored", tail.alias("tail_rows"), F.when(fits, "recover").otherwise("refuse").alias("plan"))


def recover(traces: DataFrame, missions: DataFrame, path: str) -> None:
    """Copy the committed prefix of every mission to ``path``, its rows as they are; a plan that refuses a mission stops it all.

    ``source_digest`` of each row names the plan it was copied under; a table that is there is never overwritten.
    """
    plan = recovery_plan(traces, missions)
    if bad := plan.where("plan = 'refuse'").select("mission_id").first():
        raise ValueError(f"mission {bad[0]} claims more committed rows than are stored")
    note = plan.select("mission_id", "committed_record_count", F.sha2(F.to_json(F.struct(*plan.columns)), 256).alias("source_digest"))
    finalize(traces.join(note, "mission_id").where("record_position < committed_record_count").drop("committed_record_count"), path)


def inspect_partial(traces: DataFrame, missions: DataFrame) -> DataFrame:
    """Per mission of an unfinished table: stored rows, rows of the tail, last position, positions that are missing below it; a mission without rows has none of them."""
    have = missions.select("mission_id", "committed_record_count").join(traces.select("mission_id", "record_position"), "mission_id", "left").groupBy("mission_id")
    got = have.agg(F.count("record_position").alias("stored"), F.count_if(F.col("record_position") >= F.col("committed_record_count")).alias("tail_rows"), F.max("record_position").alias("last"), F.count_distinct("record_position").alias("_n"))
    return got.select("mission_id", "stored", "tail_rows", "last", (F.col("last") + 1 - F.col("_n")).alias("missing_positions"))


def manifest(rows: DataFrame, key: str, content: str) -> DataFrame:
    """(key, digest, bytes) of a payload column; with Spark's ``binaryFile`` source, of files (key ``path``, content ``content``)."""
    return rows.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("digest"), F.octet_length(content).cast("long").alias("bytes"))


def attach(traces: DataFrame, derived: DataFrame, declared: tuple[str, ...], path: str) -> None:
    """Write ``traces`` with the derived columns of ``derived(mission_id, trace_index, ...)`` as a new table at ``path``.

    Only columns that the schema declares as optional outputs are taken, and none that the traces have. The table is
    written beside ``path`` and read back; it is moved there only if the digest of its raw columns is that of the traces, else it is removed.
    """
    key = ["mission_id", "trace_index"]
    new = [c for c in derived.columns if c not in key]
    if bad := sorted(c for c in new if c not in declared or c in traces.columns):
        raise ValueError(f"not declared as derived, or raw: {bad}")
    spark = traces.sparkSession
    staged, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.staged-{uuid.uuid4().hex}", path))
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(target):
        raise ValueError(f"{path} is there")
    finalize(traces.join(derived, key, "left"), staged.toString())
    if fingerprint(traces, *traces.columns).first() != fingerprint(spark.read.parquet(staged.toString()), *traces.columns).first():
        files.delete(staged, True)
        raise ValueError("the raw columns changed while derived ones were attached")
    files.rename(staged, target)
