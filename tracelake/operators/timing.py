"""Timing of sweeps: intervals, errors, overruns, deadlines, replay gaps, percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.checkpoints import cut
from ..sources.ordered import bucket, of_bucket, with_previous

#: What one window may span: a day of a clock, a million traces of a mission.
DAY_NS, INDEX_RANGE = 86_400_000_000_000, 1_000_000


def schedule(sweeps: DataFrame, target_ns: int) -> DataFrame:
    """``sweeps(domain, sweep_id, started_ns, finished_ns)`` with interval, schedule error (both null first) and overrun."""
    interval = F.col("started_ns") - F.col("_previous.started_ns")
    over = F.greatest(F.lit(0), F.col("finished_ns") - F.col("started_ns") - target_ns)
    df = with_previous(sweeps, ["domain"], ["started_ns", "sweep_id"], [], DAY_NS)
    return df.withColumns({"interval_ns": interval, "error_ns": interval - target_ns, "overrun_ns": over}).drop("_previous")


def deadlines(sweeps: DataFrame, target_ns: int) -> DataFrame:
    """Absolute deadlines: an anchor, and whole intervals after it; a resume sets a new anchor. ``sweeps`` has ``resumed``.

    Ranks and anchors are found within a day, and carried from day to day.
    """
    days = Window.partitionBy("domain").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    day = Window.partitionBy("domain", "_bucket").orderBy("started_ns", "sweep_id")
    df = sweeps.withColumn("_bucket", bucket("started_ns", DAY_NS))
    before = df.groupBy("domain", "_bucket").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(days), F.lit(0)))
    df = of_bucket(df.withColumn("_rank", F.row_number().over(day)), ["domain"], before, "_before").withColumn("_rank", F.col("_rank") + F.col("_before"))
    df = df.withColumn("_anchor", F.when(F.coalesce("resumed", F.lit(False)) | (F.col("_rank") == 1), F.struct("_rank", "started_ns")))
    carried = df.groupBy("domain", "_bucket").agg(F.max("_anchor").alias("_own")).withColumn("_carried", F.last("_own", True).over(days))
    so_far = F.last("_anchor", True).over(day.rowsBetween(Window.unboundedPreceding, 0))
    df = of_bucket(df.withColumn("_anchor", so_far), ["domain"], carried, "_carried").withColumn("_anchor", F.coalesce("_anchor", "_carried"))
    deadline = F.col("_anchor.started_ns") + (F.col("_rank") - F.col("_anchor._rank")) * F.lit(target_ns).cast("long")
    return df.select(*sweeps.columns, deadline.alias("deadline_ns"))


def replay_gaps(traces: DataFrame) -> DataFrame:
    """``traces(mission_id, trace_index, at_ns)`` with the wait before each: never negative, none first."""
    df = with_previous(traces, ["mission_id"], ["trace_index"], ["at_ns"], INDEX_RANGE)
    return df.withColumn("gap_ns", F.coalesce(F.greatest(F.lit(0), F.col("at_ns") - F.col("_previous.at_ns")), F.lit(0))).drop("_previous")


def paced(traces: DataFrame, mode: str, acceleration: float = 1.0) -> DataFrame:
    """``replay_gaps`` by mode: ``per_trace`` (no waits), ``original_time``, or ``accelerated`` (gaps divided by more than 1)."""
    fits = 1 < acceleration < float("inf") if mode == "accelerated" else acceleration == 1
    if mode not in ("per_trace", "original_time", "accelerated") or not fits:
        raise ValueError("only the accelerated mode takes an acceleration, a finite one above 1")
    if mode == "per_trace":
        return traces.withColumn("gap_ns", F.lit(0).cast("long"))
    gaps = replay_gaps(traces)
    return gaps if mode == "original_time" else gaps.withColumn("gap_ns", F.floor(F.col("gap_ns") / F.lit(float(acceleration))).cast("long"))


def monotonic_violations(traces: DataFrame, column: str) -> DataFrame:
    """Rows whose value does not rise above that of the trace before."""
    df = with_previous(traces, ["mission_id"], ["record_position"], [column], INDEX_RANGE)
    return df.where(F.col(column) <= F.col(f"_previous.{column}")).drop("_previous")


def latency_metrics(rows: DataFrame, key: str, value: str, failed: str) -> DataFrame:
    """Exact linear percentiles, mean, maximum and error rate.

    Where all values of a group have at most 15 places, as recorded ones do, their sum is one of decimals: it doesn't
    hang on the order of rows, so a mean halfway between two roundings is always rounded the same way. Other groups' sums are of doubles.
    """
    ok = F.when(~F.col(failed), F.col(value))
    p = F.percentile(ok, [0.5, 0.95, 0.99])
    places = ok.try_cast("decimal(38,15)")
    places = F.when(places.cast("double") == ok, places)
    mean = F.when(F.count(places) == F.count(ok), F.try_sum(places).cast("double") / F.count(ok))
    out = rows.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col(failed)).alias("errors"), F.coalesce(mean, F.avg(ok)).alias("mean"), F.max(ok).alias("max"), p.alias("_p"))
    return out.select(key, "n", "errors", (F.col("errors") / F.col("n")).alias("error_rate"), "mean", "max", *(F.get("_p", F.lit(i)).alias(f"p{q}") for i, q in enumerate((50, 95, 99))))


def percentiles_of_large_groups(rows: DataFrame, key: str, value: str, quantiles: tuple[float, ...], *, ranges: int | None = None) -> DataFrame:
    """``(key, n, percentiles)``: exact linear percentiles of groups that no task could hold.

    Equal values are counted first, then parted into ranges of (key, value); a range's place in its group is the
    sum of the ranges before it, and only the values at the asked ranks leave their range. Null values don't count, a group without values has no row;
    NaN is above all numbers; a null key is a group. ``ranges`` is the number of ranges, that of the shuffle partitions by default.
    """
    if not quantiles or not all(0 <= q <= 1 for q in quantiles):
        raise ValueError("quantiles lie between 0 and 1")
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = rows.where(F.col(value).isNotNull()).groupBy(F.struct(F.col(key)).alias("_key"), F.col(value).cast("double").alias("_value")).agg(F.count("*").alias("_n"))
    # written, so that a range stays the same when a task runs again
    placed = cut(counted.repartitionByRange(n, "_key", "_value").withColumn("_range", F.spark_partition_id()))
    of_group = Window.partitionBy("_key")
    sums = placed.groupBy("_key", "_range").agg(F.sum("_n").alias("_sum"))
    sums = sums.select("_key", "_range", F.sum("_sum").over(of_group).alias("_total"), (F.sum("_sum").over(of_group.orderBy("_range")) - F.col("_sum")).alias("_before"))
    position = lambda q: F.lit(float(q)) * (F.col("_total") - 1)
    asked = F.array(*(F.struct(F.lit(i).alias("i"), position(q).alias("at"), edge(position(q)).cast("long").alias("rank")) for i, q in enumerate(quantiles) for edge in (F.floor, F.ceil)))
    up_to = F.sum("_n").over(Window.partitionBy("_key", "_range").orderBy("_value"))
    found = placed.withColumn("_end", up_to).join(sums, ["_key", "_range"]).withColumn("_end", F.col("_end") + F.col("_before"))
    found = found.select("_key", "_total", "_value", F.explode(F.filter(F.array_distinct(asked), lambda x: (x["rank"] < F.col("_end")) & (x["rank"] >= F.col("_end") - F.col("_n")))).alias("x"))
    low, high, part = F.min_by("_value", "x.rank"), F.max_by("_value", "x.rank"), F.first("x.at") - F.floor(F.first("x.at"))
    each = found.groupBy("_key", "_total", "x.i").agg(F.when(part == 0, low).otherwise((1 - part) * low + part * high).alias("p"))
    out = each.groupBy("_key", "_total").agg(F.array_sort(F.collect_list(F.struct("i", "p"))).alias("_p"))
    return out.select(F.col(f"_key.{key}").alias(key), F.col("_total").alias("n"), F.col("_p.p").alias("percentiles"))
