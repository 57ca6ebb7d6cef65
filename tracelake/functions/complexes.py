"""Complex arithmetic on ``struct<re: double, im: double>``; Spark has no complex type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cx(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def add(a: Column, b: Column) -> Column:
    return cx(a["re"] + b["re"], a["im"] + b["im"])


def sub(a: Column, b: Column) -> Column:
    return cx(a["re"] - b["re"], a["im"] - b["im"])


def mul(a: Column, b: Column) -> Column:
    return cx(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def scale(a: Column, k: Column) -> Column:
    return cx(a["re"] * k, a["im"] * k)


def power(a: Column) -> Column:
    return a["re"] * a["re"] + a["im"] * a["im"]


def magnitude(a: Column) -> Column:
    return F.sqrt(power(a))


def div(a: Column, b: Column) -> Column:
    """a / b; null where b is zero."""
    d = power(b)
    return F.when(d > 0, cx((a["re"] * b["re"] + a["im"] * b["im"]) / d, (a["im"] * b["re"] - a["re"] * b["im"]) / d))
