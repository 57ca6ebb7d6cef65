"""Reconcile two copies of a mission, trace by trace.

Each side's index view holds one row per index. A full outer join on the index gives every index its verdict; an
index that a conflict excludes on one side is a conflict where the other side has it, and appears nowhere where
the other side lacks or excludes it too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.views import identity_classes, index_view, uid_conflicts

KINDS = ("consistent", "missing", "extra", "conflict", "gnss_diff")
_KEY = ["mission_id", "trace_index"]


def diff_fields(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Names of the fields that differ, null-safe, comma-joined."""
    return F.array_join(F.array_compact(F.array(*(F.when(~a[k].eqNullSafe(b[k]), F.lit(k)) for k in a))), ", ")


def reconcile(air: DataFrame, ground: DataFrame, gnss: tuple[str, ...] = ("latitude",)) -> DataFrame:
    """``(mission_id, trace_index, kind, detail)``, pair verdicts in the order uid, hash, position."""
    cols = ["trace_uid", "hash", *gnss]
    side = lambda df, p: index_view(df.select(*_KEY, "record_position", *cols)).select(*_KEY, F.col("excluded").alias(f"{p}_out"), *(F.col(f"row.{c}").alias(f"{p}_{c}") for c in cols))
    both = side(air, "a").join(side(ground, "g"), _KEY, "full_outer")
    fields = diff_fields({c: F.col(f"a_{c}") for c in gnss}, {c: F.col(f"g_{c}") for c in gnss})
    none = lambda p: reduce(lambda x, y: x & y, [F.col(f"{p}_{c}").isNull() for c in gnss])
    differs = F.when(none("a") & none("g"), "").when(none("a"), "air has no match").when(none("g"), "ground has no match").otherwise(fields)
    a, g = (F.coalesce(~F.col(f"{p}_out"), F.lit(False)) for p in "ag")
    kind = (
        F.when(a & g & ((F.col("a_trace_uid") != F.col("g_trace_uid")) | (F.col("a_hash") != F.col("g_hash"))), "conflict")
        .when(a & g & (differs != ""), "gnss_diff").when(a & g, "consistent")
        .when(F.col("a_out") | F.col("g_out"), "conflict").when(a, "missing").otherwise("extra")
    )
    detail = (
        F.when(a & g & (F.col("a_trace_uid") != F.col("g_trace_uid")), "uid differs").when(a & g & (F.col("a_hash") != F.col("g_hash")), "hash differs")
        .when(a & g & (differs != ""), differs).when(a & g, F.lit(None).cast("string")).when(F.col("g_out") & a, "conflict within ground").when(F.col("a_out") & g, "conflict within air")
    )
    return both.where(a | g).select(*_KEY, kind.alias("kind"), detail.alias("detail"))


def summary(items: DataFrame, air: DataFrame, ground: DataFrame) -> DataFrame:
    """One row per mission: counts by kind and each side's duplicates and conflicts; a match may differ in position."""
    n = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    out = items.groupBy("mission_id").agg(n("consistent", "gnss_diff").alias("matched"), n("missing").alias("missing"), n("extra").alias("extra"), n("conflict").alias("conflicts"), n("gnss_diff").alias("gnss_diffs"))
    for name, df in (("air", air), ("ground", ground)):
        cls = identity_classes(df).groupBy("mission_id").agg(F.count("*").alias(f"{name}_traces"), F.count_if(F.col("verdict") == "duplicate").alias(f"{name}_duplicates"), F.count_if(F.col("verdict") == "conflict").alias("_c"))
        uid = uid_conflicts(df).groupBy("mission_id").agg(F.count("*").alias("_u"))
        cls = cls.join(uid, "mission_id", "left").withColumn(f"{name}_conflicts", F.col("_c") + F.coalesce("_u", F.lit(0))).drop("_c", "_u")
        out = out.join(cls, "mission_id", "left")
    return out


def page(items: DataFrame, number: int, size: int, kind: str | None = None) -> DataFrame:
    """One page by ascending index; ``has_more`` tells of a next one. Spark keeps only the first rows of each partition."""
    rows = items if kind is None else items.where(F.col("kind") == kind)
    rows = rows.orderBy("mission_id", "trace_index").offset(number * size).limit(size + 1)
    more = F.count("*").over(_all()) > size
    return rows.withColumn("has_more", more).orderBy("mission_id", "trace_index").limit(size)


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


def contract(a: DataFrame, b: DataFrame, fields: list[str]) -> DataFrame:
    """Field by field of two mission tables: (mission_id, field, match)."""
    long = lambda df, name: df.select("mission_id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields))).alias("x")).select("mission_id", "x.field", f"x.{name}")
    both = long(a, "a").join(long(b, "b"), ["mission_id", "field"], "full_outer")
    return both.select("mission_id", "field", F.col("a").eqNullSafe(F.col("b")).alias("match"))


def field_diff(requested: DataFrame, applied: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields whose applied value is not the requested one: (key, field, requested, applied)."""
    long = lambda df, name: df.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields))).alias("x")).select(key, "x.field", f"x.{name}")
    return long(requested, "requested").join(long(applied, "applied"), [key, "field"]).where(~F.col("requested").eqNullSafe(F.col("applied")))


def compatibility(checks: DataFrame) -> DataFrame:
    """Per subject of (subject, hard, match): a failed hard check is incompatible, a failed soft one a warning."""
    hard = F.bool_and(F.when(F.col("hard"), F.col("match")))
    soft = F.bool_and(F.when(~F.col("hard"), F.col("match")))
    return checks.groupBy("subject").agg(F.when(~F.coalesce(hard, F.lit(True)), "incompatible").when(~F.coalesce(soft, F.lit(True)), "warnings").otherwise("compatible").alias("verdict"))
