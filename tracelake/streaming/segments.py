"""One long byte stream in many tasks: ranges of bytes, and what a parser does with a range as a function of where it enters it.

A parser that jumps from unit to unit is known at a cut by one number: how far into the range the next unit begins. What
a range does is then a function from entry to exit. Such functions compose, and composition is associative, so ranges are
composed in groups, groups of groups and so on, and the entries are handed down the same tree: no task holds
more than a range or the functions of one group, however long a stream is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.checkpoints import cut
from ..sources.ordered import bucket, running

#: Functions that one task composes, and chunks that one task counts the bytes of.
FAN, CHUNKS = 64, 100_000
#: Rows that ``each_range`` hands on at once, after a whole range.
ROWS_OUT = 10_000


def byte_ranges(chunks: DataFrame, key: list[str], size: int, halo: int) -> DataFrame:
    """``chunks(*key, seq, data)`` to pieces ``(*key, r, start, data)``: range r has the bytes from ``r * size`` on, and ``halo`` bytes more."""
    placed = running(chunks.where(F.octet_length("data") > 0).select(*key, "seq", "data"), key, ["seq"], CHUNKS, {"start": F.octet_length("data")})
    end = F.col("start") + F.octet_length("data")
    div = lambda x: F.call_function("div", x, F.lit(size))
    touched = F.sequence(div(F.greatest(F.lit(0), F.col("start") - (halo - 1))), div(end - 1)) if halo else F.sequence(div(F.col("start")), div(end - 1))
    pieces = placed.select(*key, "start", "data", end.alias("end"), F.explode(touched).alias("r"))
    lo, hi = F.greatest("start", F.col("r") * size), F.least("end", (F.col("r") + 1) * size + halo)
    pieces = pieces.where(hi > lo)
    return pieces.select(*key, "r", lo.alias("start"), F.substring("data", (lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int")).alias("data"))


def joined(t: pa.Table) -> bytes:
    """The bytes of a range from its pieces."""
    return b"".join(t.sort_by("start")["data"].to_pylist())


def entries(functions: DataFrame, key: list[str], compose: Callable[[bytes, bytes], bytes], apply: Callable[[bytes, int], int], fan: int = FAN) -> DataFrame:
    """Where a parser that begins at 0 enters each range: ``functions(*key, r, f)`` to ``(*key, r, entry)``; ranges of a key are 0, 1, 2, ...

    Up: functions of ``fan`` neighbours are composed until one is left for a key. Down: the entry of a group is walked through its functions.
    """
    types = {f.name: f.dataType.simpleString() for f in functions.schema}
    same = ", ".join(f"`{k}` {types[k]}" for k in key)

    def up(t: pa.Table) -> pa.Table:
        t = t.sort_by("r")
        return pa.table({**{k: t[k][:1] for k in key}, "r": t["up"][:1], "f": pa.array([reduce(compose, t["f"].to_pylist())], pa.binary())})

    def down(t: pa.Table, at: pa.Table) -> pa.Table:
        t, entry, out = t.sort_by("r"), at["entry"][0].as_py(), []
        for f in t["f"].to_pylist():
            out.append(entry)
            entry = apply(f, entry)
        return pa.table({**{k: t[k] for k in key}, "r": t["r"], "entry": pa.array(out, pa.int64())})

    over = lambda df: df.withColumn("up", bucket("r", fan))
    levels = [functions]
    last = functions.agg(F.max("r")).first()[0] or 0
    while last > 0:
        levels.append(cut(over(levels[-1]).groupBy(*key, "up").applyInArrow(up, f"{same}, r long, f binary")))
        last //= fan
    at = levels[-1].select(*key, "r", F.lit(0).cast("long").alias("entry"))
    for level in reversed(levels[:-1]):
        at = over(level).groupBy(*key, "up").cogroup(at.withColumnRenamed("r", "up").groupBy(*key, "up")).applyInArrow(down, f"{same}, r long, entry long")
    return at


def each_range(pieces: DataFrame, entered: DataFrame, key: list[str], read: Callable[..., list[tuple]], fields: dict[str, tuple[str, pa.DataType]], more: tuple[str, ...] = ()) -> DataFrame:
    """``(*key, r, *fields)``: the rows that ``read(r, data, entry, *more)`` gives for each range, by its pieces and its entry, 0 where there is none.

    Ranges are told apart as they come by, one in memory at a time: most streams are short, and a group of Spark's own for
    each would take longer than to read it. ``fields`` are types by name, Spark's and Arrow's; ``more`` are columns that are equal in all pieces.
    """
    types, same = {f.name: f.dataType.simpleString() for f in pieces.schema}, [*key, "r"]
    ways_in = entered.select(*same, F.lit(-1).cast("long").alias("start"), "entry")
    rows = pieces.select(*same, "start", "data", *more).unionByName(ways_in, allowMissingColumns=True).select(*same, "start", "data", "entry", *more)
    n = len(same)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, out, held, at, data, entry, rest = [], [], 0, None, [], 0, ()

        def finish() -> None:
            nonlocal held
            got = read(at[-1], b"".join(data), entry, *rest)
            keys.extend([at] * len(got))
            out.extend(got)
            held += len(got) + sum(map(len, data)) // 1024

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*keys, strict=True)) + list(zip(*out, strict=True)) if out else [()] * (n + len(fields))
            return pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(columns, [*key_types, *(ty for _, ty in fields.values())], strict=True)], names=[*same, *fields])

        for batch in batches:
            key_types = [batch.schema.field(k).type for k in same]
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                here, (start, piece, way), others = row[:n], row[n : n + 3], row[n + 3 :]
                if here != at:
                    if at is not None:
                        finish()
                        if held >= ROWS_OUT:
                            yield batch_of()
                            keys, out, held = [], [], 0
                    at, data, entry, rest = here, [], 0, ()
                if start < 0:
                    entry = way
                else:
                    data.append(piece)
                    rest = others
        if at is not None:
            finish()
            yield batch_of()

    schema = ", ".join([*(f"`{k}` {types[k]}" for k in same), *(f"{f} {ty}" for f, (ty, _) in fields.items())])
    return rows.repartition(*same).sortWithinPartitions(*same, "start").mapInArrow(run, schema)


def numbered(rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows(*key, r, i, ...)`` with ``n``, their number within ``key`` by (r, i); i counts from 0 within r. Only counts of ranges meet in a window."""
    counts = rows.groupBy(*key, "r").agg(F.count("*").alias("_count"))
    before = running(counts, key, ["r"], CHUNKS, {"_before": F.col("_count")}).drop("_count")
    return rows.join(before, [*key, "r"]).withColumn("n", F.col("_before") + F.col("i")).drop("_before", "r", "i")
