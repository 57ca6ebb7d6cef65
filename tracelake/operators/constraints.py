"""Constraints as named violations: a row that breaks a rule is reported, never a failed job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.ordered import with_previous
from ..sources.views import validation_summary

#: Positions of a scan that one task looks at.
POSITION_RANGE = 1_000_000


def violations(rows: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for every rule that does not hold; a rule that is null does not hold."""
    bad = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())))
    return rows.select(*key, F.explode(bad).alias("rule"))


def trace_rules() -> dict[str, Column]:
    """Of a trace's metadata: instants in order, an interval after the first trace, reasons that fit the status."""
    c = F.col
    return {
        "utc_order": (c("started_utc") <= c("midpoint_utc")) & (c("midpoint_utc") <= c("finished_utc")),
        "mono_order": (c("started_mono_ns") <= c("midpoint_mono_ns")) & (c("midpoint_mono_ns") <= c("finished_mono_ns")),
        "interval": (c("trace_index") == 0) | c("actual_interval_s").isNotNull(),
        "reasons": (c("quality_status") == "nominal") == (F.size("quality_reasons") == 0),
        "hash": c("hash").isNull() | c("hash").rlike("^[0-9a-f]{64}$"),
    }


def fix_rules() -> dict[str, Column]:
    """Of a fix: ranges, and coordinates exactly where it is valid."""
    c = F.col
    both = c("latitude").isNotNull() & c("longitude").isNotNull()
    return {
        "latitude": c("latitude").isNull() | c("latitude").between(-90, 90),
        "longitude": c("longitude").isNull() | c("longitude").between(-180, 180),
        "hdop": c("hdop").isNull() | c("hdop").between(0, 99.9),
        "satellites": c("satellites").isNull() | c("satellites").between(0, 99),
        "valid_has_position": c("valid") == both,
        "invalid_has_reason": c("valid") == c("invalid_reason").isNull(),
    }


def axis_gate(sweeps: DataFrame, planned: str, measured: str, tolerance: float = 1.0) -> DataFrame:
    """Sweeps whose axis has the planned length and no point farther off than the tolerance."""
    near = F.forall(F.zip_with(planned, measured, lambda a, b: F.abs(a - b)), lambda d: d <= tolerance)
    return sweeps.where((F.size(planned) == F.size(measured)) & F.coalesce(near, F.lit(False)))


def replay_refusals(traces: DataFrame, missions: DataFrame, digest: Column) -> DataFrame:
    """``(mission_id, reason)`` of the ``missions(mission_id)`` that a replay refuses, the first reason: conflicts, hashes, no rows.

    Conflicts are of indices or uids; ``hashes`` are missing ones and those that differ from ``digest``, which is computed from what a row holds.
    """
    wrong = traces.groupBy("mission_id").agg(F.count_if((F.col("hash") != "") & ~F.coalesce(F.col("hash") == digest, F.lit(False))).alias("wrong"))
    facts = missions.select("mission_id").distinct().join(validation_summary(traces), "mission_id", "left").join(wrong, "mission_id", "left")
    reason = F.when((F.col("conflicts") > 0) | (F.col("uid_conflicts") > 0), "conflicts").when((F.col("unhashed") > 0) | (F.col("wrong") > 0), "hashes").when(F.coalesce("rows", F.lit(0)) == 0, "no rows")
    return facts.select("mission_id", reason.alias("reason")).where("reason is not null")


def scan_violations(traces: DataFrame, scan: list[str]) -> DataFrame:
    """Rows that break a rule of one scan, by position: ``(*scan, record_position, rule)``.

    ``uid``: its uid came before; ``identity``: its mission and index did; ``mission``: not that of the scan's first row; ``order``: its index does
    not rise above that of the row before. Rows with the same uid or identity meet in a window, a scan's rows only range by range.
    """
    again = lambda *c: F.row_number().over(Window.partitionBy(*scan, *c).orderBy("record_position")) > 1
    first = traces.groupBy(*scan).agg(F.min_by("mission_id", "record_position").alias("_mission"))
    df = with_previous(traces.select(*scan, "record_position", "mission_id", "trace_index", "trace_uid"), scan, ["record_position"], ["trace_index"], POSITION_RANGE)
    df = df.join(first, scan).withColumns({"uid": again("trace_uid"), "identity": again("mission_id", "trace_index"), "mission": F.col("mission_id") != F.col("_mission"), "order": F.coalesce(F.col("trace_index") <= F.col("_previous.trace_index"), F.lit(False))})
    rules = F.array_compact(F.array(*(F.when(F.col(r), F.lit(r)) for r in ("uid", "identity", "mission", "order"))))
    return df.select(*scan, "record_position", F.explode(rules).alias("rule"))


def config_facts(missions: DataFrame, axis: str) -> DataFrame:
    """Step, unambiguous period and bandwidth of an axis."""
    first, last, n = F.get(axis, F.lit(0)), F.element_at(axis, -1), F.size(axis)
    step = (last - first) / F.when(n > 1, n - 1)
    return missions.withColumns({"step": step, "period": 1 / F.when(step > 0, step), "bandwidth": last - first})


def lookup(rows: DataFrame, column: str, registry: DataFrame, key: str, value: str, *, unknown: str | None = None) -> DataFrame:
    """``rows`` with ``value`` of the registry's row whose ``key`` is ``column``; a registry names each key once.

    An id that is not registered fails the job, unless ``unknown`` names the text to put there.
    """
    known = registry.select(F.col(key).alias("_key"), F.struct(F.col(value)).alias("_known"))
    missing = F.raise_error(F.concat(F.lit("unknown id "), F.coalesce(F.col(column).cast("string"), F.lit("null")))) if unknown is None else F.lit(unknown)
    found = F.when(F.col("_known").isNotNull(), F.col("_known")[value]).otherwise(missing)
    return rows.join(known, F.col(column) == F.col("_key"), "left").select(*rows.columns, found.alias(value))


def supported_version(major: Column, minor: Column, *, own: int, least: int, most: int) -> Column:
    """Whether a peer's version can be talked to: the own major number, and a minor one in the window, both ends included."""
    return F.coalesce((major == own) & minor.between(least, most), F.lit(False))
