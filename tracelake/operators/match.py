"""Nearest position fix of each sweep, on both sides in time, with the reason where it can't be used.

A self-join by distance would be quadratic. Instead fixes and sweeps of a clock domain form one stream ordered by
time, and window functions carry the last fix before and the first fix after every sweep. Domains longer than
``bucket_ns`` are cut into buckets, each with the fixes of its surroundings of one window, so no domain is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import midpoint

NS = 1_000_000_000


def nearest_fix(sweeps: DataFrame, fixes: DataFrame, *, stale_after_s: float, window_s: float, shared_clock: bool = True, bucket_s: int = 86_400) -> DataFrame:
    """``sweeps(domain, sweep_id, started_ns, finished_ns)`` with ``fix_id, distance_ns, usable, reason``.

    ``fixes(domain, fix_id, received_ns, seq, valid)``: nearest by whole nanoseconds, valid or not; of equal distance the
    earlier one, of equal time the lowest seq. A fix beyond the window stays as evidence. Null instants and domains are no_fix.
    """
    if not 0 < stale_after_s <= window_s:
        raise ValueError("0 < stale_after_s <= window_s is needed")
    stale, window = int(stale_after_s * NS), int(window_s * NS)
    s = sweeps.withColumn("at", midpoint(F.col("started_ns"), F.col("finished_ns")))
    if not shared_clock:
        return s.select(*sweeps.columns, F.lit(None).cast("long").alias("fix_id"), F.lit(None).cast("long").alias("distance_ns"), F.lit(False).alias("usable"), F.lit("clock_unavailable").alias("reason"))
    # windows put nulls together, where a join would not: a fix without domain or time would meet the sweeps without
    fixes = fixes.where(F.col("domain").isNotNull() & F.col("received_ns").isNotNull())
    first = fixes.groupBy("domain", "received_ns").agg(F.min_by(F.struct("fix_id", "valid"), "seq").alias("f")).select("domain", F.col("received_ns").alias("at"), "f.fix_id", "f.valid")
    size = bucket_s * NS
    bucket = F.call_function("div", F.col("at"), F.lit(size))
    # the last fix before and the first after a bucket stand in for all that lie beyond it
    ends = first.groupBy("domain", bucket.alias("bucket")).agg(F.min(F.struct("at", "fix_id", "valid")).alias("lo"), F.max(F.struct("at", "fix_id", "valid")).alias("hi"))
    buckets = s.select("domain", bucket.alias("bucket")).distinct().join(ends, ["domain", "bucket"], "full_outer")
    # what follows is found backwards: a frame that runs from each row to the end costs Spark the square of the rows
    forth, back = (Window.partitionBy("domain").orderBy(order).rowsBetween(Window.unboundedPreceding, -1) for order in (F.col("bucket").asc(), F.col("bucket").desc()))
    edge = buckets.select("domain", "bucket", F.last("hi", True).over(forth).alias("before"), F.last("lo", True).over(back).alias("after"))
    extra = edge.select("domain", "bucket", F.explode(F.array_compact(F.array("before", "after"))).alias("f")).select("domain", "bucket", "f.*")
    fix = first.withColumn("bucket", bucket).unionByName(extra).select("domain", "bucket", "at", F.struct("at", "fix_id", "valid").alias("fix"), F.lit(None).cast("long").alias("sweep_id"), F.lit(0).alias("is_sweep"), F.lit(None).cast("long").alias("started_ns"), F.lit(None).cast("long").alias("finished_ns"))
    sweep = s.select("domain", bucket.alias("bucket"), "at", F.lit(None).cast("struct<at: bigint, fix_id: bigint, valid: boolean>").alias("fix"), "sweep_id", F.lit(1).alias("is_sweep"), "started_ns", "finished_ns")
    o = Window.partitionBy("domain", "bucket")
    forth, back = (o.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0) for order in (("at", "is_sweep"), (F.col("at").desc(), F.col("is_sweep").desc())))
    both = fix.unionByName(sweep)
    both = both.withColumn("prev", F.last("fix", True).over(forth)).withColumn("next", F.last("fix", True).over(back)).where("is_sweep = 1")
    d0, d1 = F.col("at") - F.col("prev.at"), F.col("next.at") - F.col("at")
    best = F.when(d1.isNull() | (d0 <= d1), F.col("prev")).otherwise(F.col("next"))
    df = both.withColumn("best", best).withColumn("distance_ns", F.abs(F.col("best.at") - F.col("at")))
    reason = F.when(F.col("best.fix_id").isNull(), "no_fix").when(F.col("distance_ns") > window, "out_of_range").when(~F.col("best.valid"), "invalid").when(F.col("distance_ns") > stale, "stale")
    return df.select("domain", "sweep_id", "started_ns", "finished_ns", F.col("best.fix_id").alias("fix_id"), "distance_ns", reason.isNull().alias("usable"), reason.alias("reason"))


def last_before(rows: DataFrame, others: DataFrame, value: str, within_ns: int, *, bucket_ns: int = 86_400 * NS) -> DataFrame:
    """``rows(domain, id, at)`` with the last ``value`` of ``others(domain, at)`` at or before it, no older than ``within_ns``.

    A domain is cut into buckets of ``bucket_ns``; the last value before a bucket is carried into it.
    """
    bucket = F.call_function("div", F.col("at"), F.lit(bucket_ns)).alias("bucket")
    o = F.struct("at", F.col(value).cast("string").alias("v")).alias("_o")
    a = rows.select("domain", bucket, "id", "at", F.lit(1).alias("_is_row"), F.lit(None).cast("struct<at: bigint, v: string>").alias("_o"))
    b = others.select("domain", bucket, F.lit(None).cast("long").alias("id"), "at", F.lit(0).alias("_is_row"), o)
    ends = a.select("domain", "bucket", "_o").unionByName(b.select("domain", "bucket", "_o")).groupBy("domain", "bucket").agg(F.max("_o").alias("_o"))
    carried = F.last("_o", True).over(Window.partitionBy("domain").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select("domain", "bucket", carried.alias("_o")).where(F.col("_o").isNotNull()).select("domain", "bucket", F.lit(None).cast("long").alias("id"), F.col("_o.at").alias("at"), F.lit(0).alias("_is_row"), "_o")
    so_far = Window.partitionBy("domain", "bucket").orderBy("at", "_is_row").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).unionByName(carried).withColumn("_o", F.last("_o", True).over(so_far)).where("_is_row = 1")
    return both.select("domain", "id", "at", F.when(F.col("at") - F.col("_o.at") <= within_ns, F.col("_o.v")).alias(value))


def bounded_cache(fixes: DataFrame, now_ns: int, *, max_age_s: float = 120.0, keep: int = 256) -> DataFrame:
    """The newest ``keep`` fixes of each domain that are not older than ``max_age_s``."""
    young = fixes.where(F.col("received_ns") >= now_ns - int(max_age_s * NS))
    n = F.row_number().over(Window.partitionBy("domain").orderBy(F.col("received_ns").desc(), F.col("seq").desc()))
    return young.withColumn("_n", n).where(F.col("_n") <= keep).drop("_n")


def snapshot(fixes: DataFrame) -> DataFrame:
    """All fixes by receive time within their domain; of equal times the lowest seq first. A range sort over the cluster."""
    return fixes.orderBy("domain", "received_ns", "seq")


def nearest(rows: DataFrame, by: str, distance: Column, ties: list[str]) -> DataFrame:
    """The nearest row of each ``by``: least distance, then least ``ties``. Partial minima before the shuffle."""
    return rows.groupBy(by).agg(F.min_by(F.struct(*(c for c in rows.columns if c != by)), F.struct(distance, *ties)).alias("_r")).select(by, "_r.*")
