"""Mixing sources to target weights along a time-varying curriculum.

Every source has a target of words: shares by weight of all words, but at most ``MOST_PASSES`` times what the
source holds; what is above is shared again by weight (``targets``, in closed form by one ordered sum over the
sources). A source is passed over in an order fixed by the hash of doc_id, as often as its target needs; the last
pass stops within a document, so the words taken make the target, rounded.

When a word is taken follows from the source's weight schedule over training time (0 to 1), a broken line: its
integral is the source's cumulative demand for words, and inverting it at a document's place in its source gives
the document's training position. Documents are range-sorted by position.

Cumulative sums run in two levels, over hash ranges of a source and within one range, so a source of any size is
spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .textops import IS_SPACE_WORD, byte_blocks, words

#: Sources by code point (null last) take these weights in turn; no document is taken more often (fixed values).
WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
#: Relative weight over training time, as (time, weight) knots, for each weight in turn: falling, even, rising.
SCHEDULES = (((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
#: Documents of a source in one hash range, about.
RANGE_ROWS = 100_000


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [np.diff(words(data, offs, IS_SPACE_WORD)[2]) for _, _, data, offs in byte_blocks(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(n) if n else [], pa.int64())], names=["doc_id", "source", "size"])


def sized(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size)``: the number of words of each text; null: 0."""
    return docs.select("doc_id", "source", "text").mapInArrow(_count, "doc_id long, source string, size long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """``(source, turn, source_size, target, quota)`` for each source; quota is the target in whole words."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    by = by.withColumn("turn", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights))
    by = by.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("turn") + 1)).withColumn("most", F.col("source_size") * most)
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    on = order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(on)
    by = by.withColumn("level", level)
    # the first source that its share does not fill sets the level of all from it on
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), F.col("level")))).over(Window.partitionBy())
    target = F.least(F.col("most").cast("double"), level["level"] * F.col("weight"))
    return by.select("source", "turn", "source_size", "rows", target.alias("target"), F.floor(target + 0.5).cast("long").alias("quota"))


def position_of(share: Column, turn: Column, schedules=SCHEDULES) -> Column:
    """The time at which a source has taken this share of its words: the inverse of its schedule's integral."""
    out = None
    for k, knots in enumerate(schedules):
        area, pieces = 0.0, []
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            pieces.append((area, t0, t1, w0, w1))
            area += (w0 + w1) / 2 * (t1 - t0)
        at = None
        for a0, t0, t1, w0, w1 in pieces:
            v = share * area - a0
            root = F.sqrt(F.greatest(F.lit(0.0), v * (2 * (w1 - w0) / (t1 - t0)) + w0 * w0)) + w0
            t = F.when(v > 0, F.least(F.lit(t1), v * 2 / root + t0)).otherwise(F.lit(t0))
            at = t if at is None else F.when(share * area < a0, at).otherwise(t)
        out = F.when(turn == k, at) if out is None else out.when(turn == k, at)
    return out


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, schedules=SCHEDULES, most: int = MOST_PASSES) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, source, size, source_size, target, taken, takes``, range-sorted by position.

    ``takes`` has a struct (pass, words, position) for each time the document is taken; position is the word of
    training around which it stands. Null and empty texts have size 0 and are never taken; a null source is a
    source, last by order. Repeated rows are documents of their own. An empty table gives an empty result.
    Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    sizes = scratch.keep(sized(docs), "sizes").withColumn("hash", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    by = scratch.keep(targets(sizes, weights, most), "targets")
    totals = by.agg(F.sum("rows"), F.sum("source_size")).first()
    digits = 1
    while (totals[0] or 0) >> (4 * digits) > RANGE_ROWS:
        digits += 1
    sizes = sizes.withColumn("range", F.substring("hash", 1, digits))
    ranges = sizes.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    ranges = ranges.withColumn("range_before", F.sum("range_size").over(Window.partitionBy("source").orderBy("range")) - F.col("range_size")).drop("range_size")
    within = Window.partitionBy("source", "range").orderBy("hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = sizes.withColumn("within", F.sum("size").over(within) - F.col("size"))
    rows = rows.join(ranges.withColumnRenamed("source", "s").withColumnRenamed("range", "r"), F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).drop("s", "r")
    rows = rows.join(by.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    before = F.col("within") + F.col("range_before")
    passes = F.when(F.col("source_size") > 0, F.expr("quota div source_size")).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("before", before).withColumn("passes", passes)
    rest = F.least(F.greatest(F.col("quota") - F.col("passes") * F.col("source_size") - F.col("before"), F.lit(0)), F.col("size"))
    rows = rows.withColumn("rest", rest).withColumn("taken", F.col("passes") * F.col("size") + F.col("rest"))

    def take(k: Column) -> Column:
        n = F.when(k < F.col("passes"), F.col("size")).otherwise(F.col("rest"))
        share = (k * F.col("source_size") + F.col("before") + n / 2.0) / F.col("quota")
        return F.struct(k.cast("int").alias("pass"), n.alias("words"), F.floor(position_of(share, F.col("turn"), schedules) * float(totals[1] or 0)).cast("long").alias("position"))

    numbers = F.sequence(F.lit(0).cast("long"), F.lit(most).cast("long"))
    wanted = F.filter(numbers, lambda k: (F.col("size") > 0) & ((k < F.col("passes")) | ((k == F.col("passes")) & (F.col("rest") > 0))))
    rows = rows.withColumn("takes", F.transform(wanted, take))
    out = rows.select("doc_id", "source", "size", "source_size", "target", "taken", "takes")
    first = F.get("takes", F.lit(0))["position"]
    return out.withColumn("position", first).repartitionByRange(F.col("position").asc_nulls_last(), F.col("doc_id")).sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


def training_order(mixed: DataFrame) -> DataFrame:
    """``(position, doc_id, source, pass, words)``: every take of a mix, range-sorted by training position."""
    takes = mixed.select("doc_id", "source", F.explode("takes").alias("t")).select("t.position", "doc_id", "source", "t.pass", "t.words")
    return takes.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id", "pass")


def mix_report(docs: DataFrame) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, position)``; position of the first take, null if never taken."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "position")
