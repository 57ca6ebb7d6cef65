"""Capture sessions: which capture belongs to which step, and when a gate closes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import dsp


def reference_session(captures: DataFrame, *, session: str, order: str, per_step: int, steps: int = 6) -> DataFrame:
    """``captures`` with their ``step``: a step is full after ``per_step`` captures, and the gate closes after the last step."""
    if per_step < 1 or steps < 1:
        raise ValueError("a session has at least one step of one capture")
    n = F.row_number().over(Window.partitionBy(session).orderBy(order)) - 1
    return captures.withColumn("step", F.call_function("div", n, F.lit(per_step)).cast("long")).where(F.col("step") < steps)


def session_state(captures: DataFrame, *, session: str, order: str, per_step: int, steps: int = 6) -> DataFrame:
    """Per session: the step it stands at, captures that step has, and whether all steps are full."""
    got = captures.groupBy(session).agg(F.least(F.count("*"), F.lit(per_step * steps)).alias("n"))
    return got.select(session, F.call_function("div", F.col("n"), F.lit(per_step)).alias("step"), (F.col("n") % per_step).alias("captured"), (F.col("n") == per_step * steps).alias("complete"))


def background_session(samples: DataFrame, captures: int) -> DataFrame:
    """The mean of the first ``captures`` traces; a session with fewer traces gives no background and raises."""
    if captures < 1:
        raise ValueError("a background needs a capture")
    first = [r[0] for r in samples.select("trace_id").distinct().orderBy("trace_id").limit(captures).collect()]
    if len(first) < captures:
        raise ValueError(f"{len(first)} of {captures} captures")
    return dsp.coherent_mean(samples.where(F.col("trace_id") <= first[-1]))
