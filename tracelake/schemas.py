"""Schemas of the tables: missions, traces, samples, fixes, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COMPLEX = "struct<re: double, im: double>"
_CHANNEL = "struct<channel_id: string, polarization: string, s_parameter: string, display_name: string, note: string>"

_DDL = {
    "missions": f"mission_id string, device_id string, file_role string, lifecycle_state string, config_json string, config_sha256 string, channels array<{_CHANNEL}>, frequencies_hz array<double>, planned_trace_count long, committed_record_count long, last_trace_index long",
    "traces": "mission_id string, file_role string, record_position long, trace_index long, trace_uid string, started_utc timestamp, midpoint_utc timestamp, finished_utc timestamp, started_mono_ns long, midpoint_mono_ns long, finished_mono_ns long, target_interval_s double, actual_interval_s double, schedule_error_s double, connection_generation long, hash string, quality_status string, quality_reasons array<string>, latitude double, longitude double, raw binary",
    "samples": f"mission_id string, trace_index long, channel_pos int, values array<{_COMPLEX}>",
    "fixes": "source_id string, seq long, received_mono_ns long, received_utc timestamp, nmea_utc timestamp, latitude double, longitude double, altitude_msl_m double, fix_quality string, satellites int, hdop double, valid boolean, invalid_reason string",
    "history": "dataset_id string, ordinal int, stage string, stage_version string, parameters_json string, source string, target string, executed_utc timestamp, calibration_id string, background_id string",
}


def schema(name: str) -> T.StructType:
    """The contract of a table; readers pass it to ``spark.read.schema``, nothing is inferred."""
    return T.StructType.fromDDL(_DDL[name])


def contract_violations(have: T.StructType, name: str) -> list[str]:
    """Fields that a table lacks or holds with another type."""
    got = {f.name: f.dataType.simpleString() for f in have}
    return [f"{f.name}: {got.get(f.name, 'missing')}" for f in schema(name) if got.get(f.name) != f.dataType.simpleString()]


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A Parquet table under its contract: the contract's columns in its order; a field that is missing or of another type raises."""
    table = spark.read.parquet(path)
    if bad := contract_violations(table.schema, name):
        raise ValueError(f"{path} is no table of {name}: {', '.join(bad)}")
    return table.select(*schema(name).fieldNames())


def completed(df: DataFrame, name: str) -> DataFrame:
    """The contract's columns; those that ``df`` lacks are null, others of its own are left out."""
    return df.select(*(F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema(name)))


def probe(have: T.StructType) -> str | None:
    """The table whose contract a schema meets, None where none or several do."""
    fits = [name for name in _DDL if not contract_violations(have, name)]
    return fits[0] if len(fits) == 1 else None
