"""Headers of the eight message kinds: one VARIANT a header, typed fields, rules, a table for each kind.

A header is parsed once (``try_parse_json``); the type that JSON gave a field is read from the variant, so ``"1"`` or ``true`` is
no count and a null is not a missing field. Everything is a built-in expression, so it holds for batches and streams alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States of acquisition, results of an acknowledgement, error codes.
STATES = ("idle", "armed", "acquiring", "paused", "completed", "user_stopped", "fault_stopped")
RESULTS = ("persisted", "duplicate", "rejected", "conflict")
CODES = (
    "invalid_argument", "invalid_uuid", "shape_mismatch", "axis_mismatch", "duplicate_channel", "channel_contract_mismatch", "non_increasing_axis",
    "non_finite_axis", "dtype_mismatch", "naive_datetime", "time_domain_mix", "id_conflict", "config_digest_mismatch", "calibration_domain_mismatch",
    "gnss_unavailable", "unsupported_schema_version", "unsupported_protocol_version", "gnss_midpoint_mismatch", "non_uniform_axis", "out_of_range",
    "processing_domain_mismatch",
)

#: Fields of each kind with their rule; "?" marks those that may be null or missing.
FIELDS: dict[str, dict[str, str]] = {
    "hello": {"device_id": "uuid", "software_version": "text", "connection_generation": "count", "capabilities": "texts", "session_id": "text?", "mission_id": "uuid?"},
    "status": {"device_id": "uuid", "mission_id": "uuid", "connection_generation": "count", "acquisition_state": "state", "storage_writable": "flag", "pending_trace_count": "count", "last_error_code": "code?"},
    "command": {"command_id": "uuid", "operation": "text", "issued_utc": "utc", "mission_id": "uuid?", "payload_json": "json?"},
    "mission": {"config": "object"},
    "trace": {
        "mission_id": "uuid", "trace_uid": "uuid", "trace_index": "count", "device_id": "uuid", "config_sha256": "hash", "hash_domain": "text", "raw_trace_sha256": "hash", "channel_ids": "texts",
        "frequency_count": "count", "dtype": "text", "byte_order": "text", "shape": "counts", "frequency_start_hz": "number", "frequency_stop_hz": "number", "frequency_points": "count", "metadata": "object",
    },
    "ack": {"mission_id": "uuid", "trace_uid": "uuid", "trace_index": "count", "raw_trace_sha256": "hash", "result": "result", "received_utc": "utc"},
    "inventory": {"mission_id": "uuid", "device_id": "uuid", "first_index": "count", "last_index": "count", "count": "count", "hash_domain": "text", "xor_of_hashes": "hash", "missing_ranges": "ranges", "conflicts": "ranges", "complete": "flag"},
    "error": {"code": "code", "message": "ascii", "context": "object", "device_id": "uuid", "occurred_utc": "utc", "mission_id": "uuid?"},
}

_TYPES = {"count": "bigint", "counts": "array<bigint>", "number": "double", "flag": "boolean", "texts": "array<string>", "ranges": "array<array<bigint>>", "object": "variant", "utc": "timestamp"}
#: JSON types of a rule, as ``schema_of_variant`` names them; all others are strings.
_JSON = {"count": "BIGINT", "counts": "ARRAY<(BIGINT|VOID)>", "number": r"BIGINT|DOUBLE|DECIMAL\(.*\)", "flag": "BOOLEAN", "texts": "ARRAY<(STRING|VOID)>", "ranges": "ARRAY<(ARRAY<BIGINT>|VOID)>", "object": "OBJECT<.*>"}
_UUID = r"\A[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\z"
_UTC = r"\A\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d([.,]\d{1,9})?)?(Z|\+00:00)\z"


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a column that is worked out once a row: as a plain one, Spark would write it out wherever it is used, in filters too."""
    return rows.select("*", F.explode_outer(F.array(value)).alias(name))


def _raw(name: str, within: str = "_v") -> Column:
    return F.try_variant_get(within, f"$.{name}", "variant")


def _typed(name: str, rule: str) -> Column:
    value = F.try_variant_get("_v", f"$.{name}", "string" if rule == "utc" else _TYPES.get(rule, "string"))
    return F.try_to_timestamp(F.regexp_replace(F.regexp_replace(value, ",", "."), r"\+00:00$", "Z")) if rule == "utc" else value


def _good(name: str, rule: str) -> Column:
    """Whether a value of the right JSON type has a value that the rule allows."""
    value = _typed(name, rule)
    among = {"state": STATES, "result": RESULTS, "code": CODES}
    if rule in among:
        return value.isin(*among[rule])
    text = F.try_variant_get("_v", f"$.{name}", "string")
    rules = {
        "uuid": lambda: value.rlike(_UUID),
        "hash": lambda: value.rlike(r"\A[0-9a-f]{64}\z"),
        "text": lambda: value != "",
        "ascii": lambda: value.rlike(r"\A[\x00-\x7F]+\z"),
        "json": lambda: F.try_parse_json(value).isNotNull(),
        "utc": lambda: text.rlike(_UTC) & value.isNotNull(),
        "count": lambda: value >= 0,
        "counts": lambda: F.forall(value, lambda x: x >= 0),
        "number": lambda: ~F.isnan(value) & (F.abs(value) < float("inf")),
        "texts": lambda: F.forall(value, lambda x: x != ""),
        "ranges": lambda: F.forall(value, lambda x: (F.size(x) == 2) & (F.get(x, F.lit(0)) >= 0) & (F.get(x, F.lit(0)) <= F.get(x, F.lit(1)))),
    }
    return rules[rule]() if rule in rules else F.lit(True)


def _problem(name: str, rule: str) -> Column:
    """``name: missing``, ``name: type``, ``name: value``, or null."""
    bare, optional = rule.rstrip("?"), rule.endswith("?")
    json_type = F.schema_of_variant(_raw(name))
    absent = F.lit(None).cast("string") if optional else F.lit(f"{name}: missing")
    null = F.lit(None).cast("string") if optional else F.lit(f"{name}: type")
    fits = json_type.rlike(f"^({_JSON.get(bare, 'STRING')})$")
    return F.when(_raw(name).isNull(), absent).when(json_type == "VOID", null).when(~fits, f"{name}: type").when(~F.coalesce(_good(name, bare), F.lit(False)), f"{name}: value")


def _between_fields(kind: str, trace_domain: str, inventory_domain: str, payload: Column | None) -> dict[str, Column]:
    """What must hold between the fields of a header, each by name; asked only where the fields alone are right."""
    t = lambda n: _typed(n, FIELDS[kind][n])
    if kind == "inventory":
        return {"domain": t("hash_domain") == inventory_domain, "order": t("last_index") >= t("first_index"), "span": t("count") - 1 <= t("last_index") - t("first_index")}
    if kind != "trace":
        return {}
    inner = lambda n, ty="string": F.try_variant_get("_v", f"$.metadata.{n}", ty)
    channels, points = F.size(t("channel_ids")), t("frequency_points")
    rules = {
        "domain": t("hash_domain") == trace_domain,
        "channels": (channels > 0) & (F.size(F.array_distinct(t("channel_ids"))) == channels),
        "layout": (t("dtype") == "complex128") & (t("byte_order") == "little"),
        "shape": (F.size(t("shape")) == 2) & (F.get(t("shape"), F.lit(0)) == channels) & (F.get(t("shape"), F.lit(1)) == points) & (t("frequency_count") == points) & (points >= 1),
        "axis": t("frequency_stop_hz") > t("frequency_start_hz"),
        "identity": (inner("mission_id") == t("mission_id")) & (inner("trace_uid") == t("trace_uid")) & (inner("device_id") == t("device_id")) & (inner("trace_index", "bigint") == t("trace_index")) & (inner("raw_trace_sha256") == t("raw_trace_sha256")),
    }
    return rules if payload is None else rules | {"payload": F.octet_length(payload) == 16 * channels * points}


def check(frames: DataFrame, *, trace_domain: str, inventory_domain: str) -> DataFrame:
    """``frames(kind, header, ...)`` with ``violations``, an array of texts, empty where the header meets its kind's rules.

    ``trace_domain`` and ``inventory_domain`` are the tags that hashes of these kinds carry. A header that is no JSON object gives ``header: json``,
    an unknown or null kind ``kind: unknown``. Fields that a kind doesn't have are ignored. Rules between fields (``rule: <name>``) are asked
    where no field is wrong. With a column ``payload``, a trace's length is checked. Integers beyond 64 bits are no counts.
    """
    payload = F.col("payload") if "payload" in frames.columns else None
    by_kind = F.lit(None).cast("array<string>")
    for kind, fields in FIELDS.items():
        own = F.array_compact(F.array(*(_problem(n, r) for n, r in fields.items())))
        between = F.array_compact(F.array(F.lit(None).cast("string"), *(F.when(~F.coalesce(c, F.lit(False)), f"rule: {n}") for n, c in _between_fields(kind, trace_domain, inventory_domain, payload).items())))
        by_kind = F.when(F.col("kind") == kind, F.when(F.size(own) > 0, own).otherwise(between)).otherwise(by_kind)
    rows = _once(frames, "_v", F.try_parse_json("header"))
    known = F.coalesce(F.col("kind").isin(*FIELDS), F.lit(False))
    is_object = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    found = F.when(~known, F.array(F.lit("kind: unknown"))).when(~is_object, F.array(F.lit("header: json"))).otherwise(by_kind)
    return _once(rows, "violations", found).drop("_v")


def violations(checked: DataFrame) -> DataFrame:
    """A row for each violation: the columns but the header and payload, ``field`` and ``problem``."""
    kept = [c for c in checked.columns if c not in ("header", "payload", "violations")]
    # the outer form: of an inner one Spark makes filters, and the rules would run for each of them again
    rows = checked.select(*kept, F.explode_outer("violations").alias("_x")).where("_x is not null")
    return rows.select(*kept, F.substring_index("_x", ": ", 1).alias("field"), F.substring_index("_x", ": ", -1).alias("problem"))


def of_kind(checked: DataFrame, kind: str) -> DataFrame:
    """The table of one kind: frames without violations, their fields typed as ``h`` (times as timestamps, objects as VARIANT)."""
    fields = F.struct(*(_typed(n, r.rstrip("?")).alias(n) for n, r in FIELDS[kind].items()))
    rows = _once(checked.where((F.col("kind") == kind) & (F.size("violations") == 0)), "_v", F.parse_json("header"))
    return rows.withColumn("h", fields).drop("_v", "header", "violations")
