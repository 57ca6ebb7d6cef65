"""Tables of the older format: what they hold, why one can't be migrated, and the migration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import uuid5
from ..operators.timing import INDEX_RANGE
from .ordered import with_previous


def inspect(table: DataFrame, catalogue: dict[str, tuple[str, bool]]) -> list[dict]:
    """Field by field against ``catalogue`` (name to type and whether it is required): ok, missing, absent (optional), type or unknown.

    Reads the schema alone.
    """
    have = {f.name: f.dataType.simpleString() for f in table.schema}
    told = []
    for name, (kind, required) in catalogue.items():
        want = T.StructType.fromDDL(f"x {kind}")[0].dataType.simpleString()
        state = ("missing" if required else "absent") if name not in have else "ok" if have[name] == want else "type"
        told.append({"field": name, "required": required, "type": have.get(name), "state": state})
    return told + [{"field": n, "required": False, "type": t, "state": "unknown"} for n, t in have.items() if n not in catalogue]


def refusals(traces: DataFrame, missions: DataFrame) -> DataFrame:
    """Missions that can't be migrated, each with the first reason that holds, in this order.

    ``traces(mission_id, trace_index, at_ns)``, ``missions(mission_id, created_ns, points, time_points)``. ``no trace time``: a
    trace without time, or no trace at all; ``no creation time``; ``time decreases``; ``time before creation``; ``time axis``:
    its length, where there is one, is not that of the frequency axis.
    """
    seen = with_previous(traces.select("mission_id", "trace_index", "at_ns"), ["mission_id"], ["trace_index"], ["at_ns"], INDEX_RANGE)
    facts = seen.groupBy("mission_id").agg(F.count_if(F.col("at_ns").isNull()).alias("untimed"), F.min("at_ns").alias("first_ns"), F.count_if(F.col("at_ns") < F.col("_previous.at_ns")).alias("falls"))
    df = missions.join(facts, "mission_id", "left")
    reason = (
        F.when(F.col("first_ns").isNull() | (F.col("untimed") > 0), "no trace time").when(F.col("created_ns").isNull(), "no creation time")
        .when(F.col("falls") > 0, "time decreases").when(F.col("first_ns") < F.col("created_ns"), "time before creation")
        .when(F.col("time_points") != F.col("points"), "time axis")
    )
    return df.select("mission_id", reason.alias("reason")).where("reason is not null")


def migrate(traces: DataFrame, missions: DataFrame, namespace_hex: str) -> DataFrame:
    """``traces`` in the newer form; any refusal raises before a row is written.

    uids are name-based on the ``source_digest`` of the mission, so that the same source always gives the same uids;
    the row's position is its index, monotonic times count from the mission's creation, and what is missing stays missing.
    """
    if bad := refusals(traces, missions).orderBy("mission_id").first():
        raise ValueError(f"mission {bad.mission_id} can't be migrated: {bad.reason}")
    df = traces.join(missions.select("mission_id", "created_ns", "source_digest"), "mission_id")
    uid = uuid5(namespace_hex, F.concat_ws(":", "source_digest", F.lit("trace"), F.col("trace_index").cast("string")))
    return df.select(*traces.columns, uid.alias("trace_uid"), F.col("trace_index").alias("record_position"), (F.col("at_ns") - F.col("created_ns")).alias("mono_ns"), F.lit(2).alias("version"))
