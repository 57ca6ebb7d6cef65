import json

import pytest

from tracelake.streaming import messages

U, V, H = "0123abcd-0000-4000-8000-00000000000a", "0123abcd-0000-4000-8000-00000000000b", "ab" * 32
META = {"mission_id": U, "trace_uid": V, "device_id": U, "trace_index": 3, "raw_trace_sha256": H}
GOOD = {
    "hello": {"device_id": U, "software_version": "1.2", "connection_generation": 0, "capabilities": [], "session_id": None},
    "status": {"device_id": U, "mission_id": V, "connection_generation": 2, "acquisition_state": "paused", "storage_writable": True, "pending_trace_count": 0, "last_error_code": "out_of_range"},
    "command": {"command_id": U, "operation": "start", "issued_utc": "2024-05-01T10:00:00.25Z", "mission_id": U, "payload_json": "{\"a\":1}"},
    "mission": {"config": {"a": 1}},
    "trace": {"mission_id": U, "trace_uid": V, "trace_index": 3, "device_id": U, "config_sha256": H, "hash_domain": "t", "raw_trace_sha256": H, "channel_ids": ["a", "b"], "frequency_count": 4, "dtype": "complex128", "byte_order": "little", "shape": [2, 4], "frequency_start_hz": 1, "frequency_stop_hz": 2.5, "frequency_points": 4, "metadata": META},
    "ack": {"mission_id": U, "trace_uid": V, "trace_index": 0, "raw_trace_sha256": H, "result": "conflict", "received_utc": "2024-05-01T10:00:00+00:00"},
    "inventory": {"mission_id": U, "device_id": V, "first_index": 2, "last_index": 5, "count": 4, "hash_domain": "i", "xor_of_hashes": H, "missing_ranges": [[0, 1], [3, 3]], "conflicts": [], "complete": False},
    "error": {"code": "id_conflict", "message": "no", "context": {}, "device_id": U, "occurred_utc": "2024-05-01T10:00:00Z", "mission_id": None},
}
#: Values that break a rule, by rule; the type first, then values.
WRONG_TYPE = {"uuid": 1, "text": 1, "ascii": ["a"], "json": 1, "utc": 5, "hash": None, "count": "1", "counts": [1.5], "number": "1", "flag": 1, "texts": ["a", 1], "ranges": [1], "object": [], "state": None, "result": 1, "code": True}
WRONG_VALUE = {"uuid": [U.upper(), "x"], "text": [""], "ascii": ["", "é"], "json": ["{"], "utc": ["2024-05-01T10:00:00", "2024-13-01T10:00:00Z", "2024-05-01T10:00:00+02:00"], "hash": [H.upper(), H + "\n", "ab"], "count": [-1], "counts": [[-1, 2]], "texts": [["a", ""]], "ranges": [[[1, 0]], [[1]], [[-1, 2]], [[1, 2, 3]]], "state": ["lost"], "result": ["lost"], "code": ["lost"]}
BETWEEN = [("inventory", {"hash_domain": "t"}, "domain"), ("inventory", {"last_index": 1, "count": 0}, "order"), ("inventory", {"count": 5}, "span"), ("trace", {"hash_domain": "i"}, "domain"), ("trace", {"channel_ids": ["a", "a"]}, "channels"), ("trace", {"dtype": "complex64"}, "layout"), ("trace", {"byte_order": "big"}, "layout"), ("trace", {"shape": [2, 4, 1]}, "shape"), ("trace", {"frequency_count": 5}, "shape"), ("trace", {"frequency_stop_hz": 1}, "axis"), ("trace", {"metadata": META | {"trace_index": 4}}, "identity"), ("trace", {"metadata": {}}, "identity")]


def cases():
    out = [(kind, json.dumps(h), []) for kind, h in GOOD.items()]
    for kind, fields in messages.FIELDS.items():
        for name, rule in fields.items():
            bare, optional = rule.rstrip("?"), rule.endswith("?")
            without = {k: v for k, v in GOOD[kind].items() if k != name}
            out.append((kind, json.dumps(without), [] if optional else [f"{name}: missing"]))
            out.append((kind, json.dumps(without | {name: None}), [] if optional else [f"{name}: type"]))
            if WRONG_TYPE[bare] is not None:
                out.append((kind, json.dumps(without | {name: WRONG_TYPE[bare]}), [f"{name}: type"]))
            out += [(kind, json.dumps(without | {name: v}), [f"{name}: value"]) for v in WRONG_VALUE.get(bare, [])]
    out += [(kind, json.dumps(GOOD[kind] | change), [f"rule: {rule}"]) for kind, change, rule in BETWEEN]
    out += [("ack", None, ["header: json"]), ("ack", "", ["header: json"]), ("ack", "[1]", ["header: json"]), (None, "{}", ["kind: unknown"]), ("other", "{}", ["kind: unknown"])]
    return out + [("hello", json.dumps(GOOD["hello"] | {"connection_generation": True}), ["connection_generation: type"]), ("hello", json.dumps(GOOD["hello"] | {"connection_generation": 10**25}), ["connection_generation: type"]), ("mission", "{}", ["config: missing"])]


@pytest.fixture(scope="module")
def checked(spark):
    rows = [(i, k, h, bytes(128)) for i, (k, h, _) in enumerate(cases())] + [(9999, "trace", json.dumps(GOOD["trace"]), bytes(127))]
    return messages.check(spark.createDataFrame(rows, "n long, kind string, header string, payload binary"), trace_domain="t", inventory_domain="i").cache()


def test_every_rule_has_a_row_that_it_rejects(checked):
    got = {r.n: r.violations for r in checked.select("n", "violations").collect()}
    bad = [(k, h, got[i], want) for i, (k, h, want) in enumerate(cases()) if got[i] != want]
    assert not bad and len(got) > 150
    assert got[9999] == ["rule: payload"]
    rejected = {(k, w.split(": ")[0]) for k, _, want in cases() for w in want}
    assert {(k, n) for k, fields in messages.FIELDS.items() for n in fields} <= rejected


def test_tables_of_kinds(checked):
    for kind, header in GOOD.items():
        rows = messages.of_kind(checked, kind)
        assert rows.count() == sum(k == kind and not want for k, _, want in cases())
        first = rows.orderBy("n").select("h.*").drop("config", "metadata", "context").first().asDict()
        assert {k: v for k, v in first.items() if not k.endswith("_utc")} == {k: v for k, v in ({n: None for n in messages.FIELDS[kind]} | header).items() if k in first and not k.endswith("_utc")}
    assert messages.of_kind(checked, "command").orderBy("n").select("h.issued_utc").first()[0].isoformat() == "2024-05-01T10:00:00.250000"
    assert messages.violations(checked).count() == checked.selectExpr("sum(size(violations))").first()[0]


def test_a_header_is_parsed_and_judged_once(spark):
    """Of plain columns Spark's filters take copies: the rules ran again for the filter on violations, and the header was made and parsed in each of them."""
    rows = spark.range(3).selectExpr("id as n", "'ack' as kind", "to_json(named_struct('trace_index', id)) as header")
    checked = messages.check(rows, trace_domain="t", inventory_domain="i")
    plan = messages.of_kind(checked, "ack").select("n", "h.trace_index", "h.result")._jdf.queryExecution().optimizedPlan().toString().lower()
    parsed = sum(plan.count(x) for x in ("parse_json", "parsejson"))
    assert parsed == 2 and plan.count("named_struct(trace_index") == 1, plan
