"""Views of a trace table: committed window, physical and logical order, identity classes, holes, row issues.

A trace table has ``mission_id, trace_index, trace_uid, hash, record_position`` and any other columns. Missions
partition every window and join, so any number of missions spreads over the cluster.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import from_sentinel, unmask
from .ordered import with_previous

KEY = ["mission_id"]
#: Indices of a mission that one window may span.
INDEX_RANGE = 1_000_000


def committed(traces: DataFrame, missions: DataFrame) -> DataFrame:
    """Rows below their mission's committed count; a half-written tail is invisible."""
    window = missions.select("mission_id", "committed_record_count")
    return traces.join(window, "mission_id").where(F.col("record_position") < F.col("committed_record_count")).drop("committed_record_count")


def check_committed(traces: DataFrame, missions: DataFrame) -> DataFrame:
    """Missions that claim more committed rows than there are: fatal for a reader. One row each."""
    have = traces.groupBy("mission_id").agg((F.max("record_position") + 1).alias("rows"))
    return missions.join(have, "mission_id", "left").where(F.col("committed_record_count") > F.coalesce("rows", F.lit(0))).select("mission_id", "committed_record_count", F.coalesce("rows", F.lit(0)).alias("rows"))


def physical(traces: DataFrame) -> DataFrame:
    """Rows in commit order."""
    return traces.orderBy("mission_id", "record_position")


def identity_classes(traces: DataFrame) -> DataFrame:
    """Per (mission, index): rows, hashes, first position, verdict ``single``, ``duplicate`` or ``conflict``.

    Rows without a stored hash carry ``""`` and so are duplicates of each other.
    """
    by = traces.groupBy("mission_id", "trace_index").agg(F.count("*").alias("rows"), F.count_distinct(F.coalesce("hash", F.lit(""))).alias("hashes"), F.min("record_position").alias("first_position"))
    return by.withColumn("verdict", F.when(F.col("hashes") > 1, "conflict").when(F.col("rows") > 1, "duplicate").otherwise("single"))


def uid_conflicts(traces: DataFrame) -> DataFrame:
    """uids that stand at several indices."""
    return traces.groupBy("mission_id", "trace_uid").agg(F.count_distinct("trace_index").alias("indices")).where("indices > 1")


def index_view(traces: DataFrame) -> DataFrame:
    """Per (mission, index): ``row``, its first committed row, and ``excluded``, whether a conflict of hashes or of uids takes it out.

    One pass: a window over (mission, uid) tells uids that stand at several indices (a null uid conflicts with nothing),
    then one aggregate gives the rest.
    """
    uid = Window.partitionBy("mission_id", "trace_uid", F.when(F.col("trace_uid").isNull(), F.col("trace_index")))
    marked = traces.withColumn("_several", F.min("trace_index").over(uid) < F.max("trace_index").over(uid)).withColumn("_hash", F.coalesce("hash", F.lit("")))
    excluded = (F.min("_hash") < F.max("_hash")) | F.coalesce(F.bool_or("_several"), F.lit(False))
    return marked.groupBy("mission_id", "trace_index").agg(F.min_by(F.struct(*traces.columns), "record_position").alias("row"), excluded.alias("excluded"))


def first_of_duplicates(traces: DataFrame) -> DataFrame:
    """The first committed row of every index, conflicts or not."""
    return traces.groupBy("mission_id", "trace_index").agg(F.min_by(F.struct(*traces.columns), "record_position").alias("row")).select("row.*")


def stack(parts: list[DataFrame], contracts: list[DataFrame] | None = None, fields: tuple[str, ...] = ()) -> DataFrame:
    """Rows of all parts. Parts of other columns or types are refused, and so are missions whose ``fields`` differ between contracts."""
    types = [sorted((f.name, f.dataType.simpleString()) for f in p.schema.fields) for p in parts]
    if any(t != types[0] for t in types):
        raise ValueError("the parts have different columns")
    if contracts:
        said = reduce(DataFrame.unionAll, [c.select("mission_id", F.to_json(F.struct(*fields)).alias("c")) for c in contracts])
        bad = said.groupBy("mission_id").agg(F.count_distinct("c").alias("n")).where("n > 1").select("mission_id").first()
        if bad:
            raise ValueError(f"the contracts of {bad[0]} differ")
    return reduce(DataFrame.unionByName, parts)


def with_legacy(traces: DataFrame, legacy: DataFrame, version: int = 1) -> DataFrame:
    """Traces and those of an older table: what the older one lacks stays missing; a column that only it has is refused."""
    if extra := set(legacy.columns) - set(traces.columns):
        raise ValueError(f"unknown columns of a legacy table: {sorted(extra)}")
    return traces.unionByName(legacy.withColumn("version", F.lit(version)), allowMissingColumns=True)


def excluded_indices(traces: DataFrame) -> DataFrame:
    """(mission, index) that a conflict of hashes or of uids takes out of the logical view."""
    keys = traces.select("mission_id", "trace_index", "trace_uid", "hash", "record_position")
    return index_view(keys).where("excluded").select("mission_id", "trace_index")


def logical(traces: DataFrame) -> DataFrame:
    """The first committed row of every index that no conflict excludes.

    Exclusion and first position are found on the keys alone; rows with more than those are then looked up by position, so samples are shuffled once at most and never sorted.
    """
    keys = ["mission_id", "trace_index", "trace_uid", "hash", "record_position"]
    first = index_view(traces.select(*keys)).where("not excluded")
    if set(traces.columns) <= set(keys):
        return first.select(*(f"row.{c}" for c in traces.columns))
    return traces.join(first.select("row.mission_id", "row.trace_index", "row.record_position"), ["mission_id", "trace_index", "record_position"], "left_semi")


def by_index(traces: DataFrame, mission: str, index: int) -> DataFrame:
    """One logical trace; an excluded index and an absent one raise.

    The index's own rows are read by a pushed filter; of the rest of the mission only uids and indices are, to see whether one of these uids stands elsewhere.
    """
    of_mission = traces.where(F.col("mission_id") == mission)
    own = of_mission.where(F.col("trace_index") == index)
    rows, hashes = own.agg(F.count("*"), F.count_distinct(F.coalesce("hash", F.lit("")))).first()
    if not rows:
        raise LookupError(f"trace {index} of {mission} is absent")
    elsewhere = of_mission.where(F.col("trace_index") != index).select("trace_uid").join(own.select("trace_uid").distinct(), "trace_uid", "left_semi")
    if hashes > 1 or not elsewhere.isEmpty():
        raise LookupError(f"trace {index} of {mission} is excluded by a conflict")
    return own.orderBy("record_position").limit(1)


def missing_ranges(traces: DataFrame) -> DataFrame:
    """Holes in 0..max of each mission as (mission_id, low, high); only the neighbours of a hole are compared."""
    seen = with_previous(traces.select("mission_id", "trace_index").distinct(), KEY, ["trace_index"], [], INDEX_RANGE)
    low = F.coalesce(F.col("_previous.trace_index"), F.lit(-1).cast("long")) + 1
    return seen.where(F.col("trace_index") > low).select("mission_id", low.alias("low"), (F.col("trace_index") - 1).alias("high"))


def missing_indices(traces: DataFrame) -> DataFrame:
    """The holes one by one; a long hole is made in parts, so that no row holds all of it."""
    part = F.explode(F.sequence("low", "high", F.lit(INDEX_RANGE).cast("long"))).alias("from")
    holes = missing_ranges(traces).select("mission_id", "high", part)
    return holes.select("mission_id", F.explode(F.sequence("from", F.least("high", F.col("from") + (INDEX_RANGE - 1)))).alias("trace_index"))


def ranges(indices: DataFrame) -> DataFrame:
    """Islands [low, high] of consecutive indices.

    Islands are made within ranges of the index; only those that touch the edge of a range, two a range at most, are then joined.
    """
    start = F.col("trace_index") - F.pmod("trace_index", F.lit(INDEX_RANGE))
    seen = indices.select("mission_id", "trace_index", start.alias("start")).distinct()
    island = F.col("trace_index") - F.row_number().over(Window.partitionBy("mission_id", "start").orderBy("trace_index"))
    parts = seen.withColumn("island", island).groupBy("mission_id", "start", "island").agg(F.min("trace_index").alias("low"), F.max("trace_index").alias("high"))
    edge = (F.col("low") == F.col("start")) | (F.col("high") == F.col("start") + (INDEX_RANGE - 1))
    w = Window.partitionBy("mission_id").orderBy("low")
    new = F.coalesce(F.lag("high").over(w) + 1 < F.col("low"), F.lit(True))
    edges = parts.where(edge).withColumn("new", new).withColumn("n", F.sum(F.col("new").cast("int")).over(w))
    joined = edges.groupBy("mission_id", "n").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return parts.where(~edge).select("mission_id", "low", "high").union(joined.select("mission_id", "low", "high"))


def decode(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass all named checks, and (row, issue) for those that do not; nothing fails the job."""
    bad = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items())))
    marked = rows.withColumn("_issues", bad)
    return marked.where(F.size("_issues") == 0).drop("_issues"), marked.where(F.size("_issues") > 0).select(*rows.columns, F.explode("_issues").alias("issue"))


def decode_cells(rows: DataFrame, sentinels: list[str], masked: dict[str, int], mask: str = "present") -> DataFrame:
    """Stored cells to nullable values: sentinel integers, and values whose bit of the presence mask is clear."""
    out = {c: from_sentinel(F.col(c)) for c in sentinels} | {c: unmask(F.col(c), F.col(mask), bit) for c, bit in masked.items()}
    return rows.withColumns(out)


def validation_summary(traces: DataFrame) -> DataFrame:
    """Per mission: rows, distinct indices, duplicates, conflicts, holes, rows without hash."""
    cls = identity_classes(traces).groupBy("mission_id").agg(F.sum("rows").alias("rows"), F.count("*").alias("indices"), F.count_if(F.col("verdict") == "duplicate").alias("duplicates"), F.count_if(F.col("verdict") == "conflict").alias("conflicts"), (F.max("trace_index") + 1 - F.count("*")).alias("missing"))
    uid = uid_conflicts(traces).groupBy("mission_id").agg(F.count("*").alias("uid_conflicts"))
    unhashed = traces.groupBy("mission_id").agg(F.count_if(F.coalesce("hash", F.lit("")) == "").alias("unhashed"))
    return cls.join(unhashed, "mission_id").join(uid, "mission_id", "left").withColumn("uid_conflicts", F.coalesce("uid_conflicts", F.lit(0)))
