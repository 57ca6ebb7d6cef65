"""The row before, in the order of a key's rows, without a window over all rows of the key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(column: str, size: int) -> Column:
    """Number of the range of ``size`` values that an integer lies in."""
    return F.call_function("div", F.col(column) - F.pmod(F.col(column), F.lit(size)), F.lit(size))


def of_bucket(rows: DataFrame, key: list[str], per_bucket: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``column`` of their bucket in ``per_bucket(*key, _bucket, column)``; nulls are keys like any other."""
    other = per_bucket.select(*(F.col(k).alias(f"_of_{i}") for i, k in enumerate([*key, "_bucket"])), column)
    same = reduce(Column.__and__, (rows[k].eqNullSafe(other[f"_of_{i}"]) for i, k in enumerate([*key, "_bucket"])))
    return rows.join(other, same, "left").drop(*(f"_of_{i}" for i in range(len(key) + 1)))


def with_previous(rows: DataFrame, key: list[str], order: list[str], values: list[str], size: int) -> DataFrame:
    """``rows`` with ``_previous``, a struct of ``order`` and ``values`` of the row before within ``key``; null for the first.

    A key's rows are cut into ranges of ``size`` values of the first order column, and the last row of a range is carried
    into the next one that has rows: a task holds a range, and only one row a range is in a window over the key. Rows
    that are equal in ``order`` follow each other by ``values``.
    """
    row = F.struct(*order, *values)
    df = rows.withColumn("_bucket", bucket(order[0], size))
    last = df.groupBy(*key, "_bucket").agg(F.max(row).alias("_last"))
    last = last.withColumn("_carried", F.lag("_last").over(Window.partitionBy(*key).orderBy("_bucket")))
    within = F.lag(row).over(Window.partitionBy(*key, "_bucket").orderBy(*order, *values))
    return of_bucket(df, key, last, "_carried").withColumn("_previous", F.coalesce(within, "_carried")).drop("_bucket", "_carried")


def running(rows: DataFrame, key: list[str], order: list[str], size: int, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with running values along ``order`` within ``key``, the row itself left out.

    ``sums`` are sums of the rows before (0 for the first), ``lasts`` the last value before that is not null. A range of
    ``size`` values of the first order column has a summary, its sums and last values; summaries are associative, so what a range
    begins with is that of all ranges before it, one row a range, and a task holds a range only. Rows that are equal in
    ``order`` follow each other in an order of Spark's own.
    """
    sums, lasts = sums or {}, lasts or {}
    df = rows.withColumns({"_bucket": bucket(order[0], size)} | {f"_{n}": F.coalesce(c, F.lit(0)).cast("long") for n, c in sums.items()} | {f"_{n}": c for n, c in lasts.items()})
    place = F.struct(*order)
    per = df.groupBy(*key, "_bucket").agg(*(F.sum(f"_{n}").alias(n) for n in sums), *(F.max_by(f"_{n}", F.when(F.col(f"_{n}").isNotNull(), place)).alias(n) for n in lasts))
    before = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*key, "_bucket", F.struct(*(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums), *(F.last(n, True).over(before).alias(n) for n in lasts)).alias("_carried"))
    within = Window.partitionBy(*key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = of_bucket(df, key, per, "_carried")
    df = df.withColumns({n: F.coalesce(F.sum(f"_{n}").over(within), F.lit(0)) + F.col("_carried")[n] for n in sums} | {n: F.coalesce(F.last(f"_{n}", True).over(within), F.col("_carried")[n]) for n in lasts})
    return df.drop("_bucket", "_carried", *(f"_{n}" for n in [*sums, *lasts]))
