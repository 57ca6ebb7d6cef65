"""All queries of the library's own operators, with the SQL that each must agree with."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import schemas
from .functions import codecs, nmea
from .functions import complexes as C
from .functions import scalars as S
from .operators import constraints, match, reconcile, timing
from .plans import binding, capture, chain, dsp, provenance, reuse
from .sources import projections as P
from .sources import legacy, sinks, snapshots, tracefiles, views
from .sources.checkpoints import shared_dir
from .streaming import frames, ingest, messages, protocol, replay

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = re.sub(r'(?<!")\bat\b(?!")', '"at"', sql)  # a keyword of the oracle's dialect
        return f

    return add


def micro(c: Column) -> Column:
    """Millionths as an integer; -0.0 becomes 0."""
    return F.round(c * 1e6 + 0.0).cast("long")


def _m(x: str) -> str:
    return f"CAST(round(({x}) * 1e6 + 0.0) AS BIGINT)"


_AIR, _GROUND = P.side_sql("air"), P.side_sql("ground")
_AIRX, _GROUNDX = P.excluded_sql("air"), P.excluded_sql("ground")
_NS = 1_000_000_000
_BIG = "CAST(1000000000 AS BIGINT)"

# ---- scans and views


@_query("A2_committed_window", f"WITH {_AIR}, {P.MISSIONS_SQL} SELECT a.mission_id, trace_index, record_position FROM air a JOIN missions m ON a.mission_id = m.mission_id AND record_position < committed_record_count")
def a2(spark, d):
    return views.committed(P.side(spark, d, "air"), P.missions(spark, d)).select("mission_id", "trace_index", "record_position")


@_query("A3_physical_view", f"WITH {_AIR} SELECT mission_id, record_position, trace_index FROM air ORDER BY 1, 2")
def a3(spark, d):
    return views.physical(P.side(spark, d, "air")).select("mission_id", "record_position", "trace_index")


@_query("A4_logical_view", f"WITH {_AIR}, {_AIRX} SELECT mission_id, trace_index, trace_uid, hash, record_position FROM air_l")
def a4(spark, d):
    return views.logical(P.side(spark, d, "air")).select("mission_id", "trace_index", "trace_uid", "hash", "record_position")


@_query("A5_point_lookup", f"WITH {_AIR}, {_AIRX} SELECT mission_id, trace_index, hash FROM air_l WHERE trace_index = 12 AND mission_id = (SELECT mission_id FROM air WHERE trace_index = 12 LIMIT 1)")
def a5(spark, d):
    air = P.side(spark, d, "air")
    mission = air.where("trace_index = 12").select("mission_id").first()[0]
    return views.by_index(air, mission, 12).select("mission_id", "trace_index", "hash")


def _published(spark, d):
    """The air side as a published table in the shared folder."""
    rows = schemas.completed(P.side(spark, d, "air"), "traces")
    return tracefiles.publish(rows, f"{shared_dir(spark)}/published-{uuid.uuid4().hex}", role="air")


@_query("A1_published_scan", f"WITH {_AIR}, {_AIRX} SELECT mission_id, trace_index, trace_uid, hash, record_position, latitude, record_position = min(record_position) OVER (PARTITION BY mission_id, trace_index) AS first, (mission_id, trace_index) IN (SELECT (mission_id, trace_index) FROM air_x) AS excluded FROM air")
def a1(spark, d):
    return tracefiles.open_table(spark, _published(spark, d), columns=["mission_id", "trace_index", "trace_uid", "hash", "record_position", "latitude", "first", "excluded"])


@_query("A4_published_logical_view", f"WITH {_AIR}, {_AIRX} SELECT mission_id, trace_index, trace_uid, hash, record_position FROM air_l WHERE trace_index BETWEEN 500 AND 20000")
def a4_published(spark, d):
    """A range of the logical view; the range reaches the reader."""
    rows = tracefiles.logical(tracefiles.open_table(spark, _published(spark, d))).where("trace_index between 500 and 20000")
    return rows.select("mission_id", "trace_index", "trace_uid", "hash", "record_position")


@_query("A5_published_lookup", f"WITH {_AIR}, {_AIRX} SELECT mission_id, trace_index, hash FROM air_l WHERE trace_index = 12 AND mission_id = (SELECT mission_id FROM air WHERE trace_index = 12 LIMIT 1)")
def a5_published(spark, d):
    path = _published(spark, d)
    mission = tracefiles.open_table(spark, path, columns=["mission_id", "trace_index"]).where("trace_index = 12").first()[0]
    return tracefiles.lookup(spark, path, mission, 12, ["mission_id", "trace_index", "hash"])


def _checks():
    return {"priced": F.col("o_totalprice") > 1000, "dated": F.col("o_orderdate").isNotNull(), "ranked": F.col("o_orderpriority").rlike("^[1-3]-")}


@_query("A6_row_issues", "SELECT o_orderkey, unnest(list_filter([CASE WHEN NOT coalesce(o_totalprice > 1000, false) THEN 'priced' END, CASE WHEN o_orderdate IS NULL THEN 'dated' END, CASE WHEN NOT coalesce(regexp_matches(o_orderpriority, '^[1-3]-'), false) THEN 'ranked' END], lambda x: x IS NOT NULL)) AS issue FROM orders")
def a6(spark, d):
    return views.decode(P.table(spark, d, "orders"), _checks())[1].select("o_orderkey", "issue")


@_query("A9_cell_codec", "SELECT event_id, CASE WHEN user_id % 7 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 3 <> 0 THEN " + _m("value") + " END AS value FROM events")
def a9(spark, d):
    e = P.table(spark, d, "events").select("event_id", S.to_sentinel(F.when(F.col("user_id") % 7 != 0, F.col("user_id"))).alias("user_id"), "value", S.present_mask(F.lit(1), F.when(F.col("event_id") % 3 != 0, F.col("value"))).alias("present"))
    out = views.decode_cells(e, ["user_id"], {"value": 1})
    return out.select("event_id", "user_id", micro(F.col("value")).alias("value"))


@_query("A12_legacy_migration", "SELECT 'legacy' AS mission_id, trace_index, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST((instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1 AS INT), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS trace_uid FROM (SELECT event_id AS trace_index, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode('legacy:' || CAST(event_id AS VARCHAR))) AS h FROM events)")
def a12(spark, d):
    e = P.table(spark, d, "events")
    return e.select(F.lit("legacy").alias("mission_id"), F.col("event_id").alias("trace_index"), S.uuid5("6ba7b8129dad11d180b400c04fd430c8", F.concat(F.lit("legacy:"), F.col("event_id").cast("string"))).alias("trace_uid"))


@_query("A12_migration_refusals", f"""WITH {P.EVENTS_SQL}, t AS (SELECT domain, sweep_id, CASE WHEN domain = 0 AND sweep_id % 100 = 0 THEN NULL WHEN domain = 1 AND sweep_id % 50 = 0 THEN 0 ELSE started_ns END AS at FROM sweeps),
g AS (SELECT domain, coalesce(at < lag(at) OVER (PARTITION BY domain ORDER BY sweep_id), false) AS falls, at FROM t),
f AS (SELECT domain, count(*) FILTER (at IS NULL) AS untimed, count(*) FILTER (falls) AS n, min(at) AS lo FROM g GROUP BY 1)
SELECT domain AS mission_id, CASE WHEN untimed > 0 THEN 'no trace time' WHEN n > 0 THEN 'time decreases' WHEN domain = 2 THEN 'time before creation' ELSE 'time axis' END AS reason FROM f""")
def a12_refusals(spark, d):
    """Clock domains as missions: one lacks times, one has falling ones, one a late creation, one a time axis of another length."""
    s, n = P.sweeps(spark, d), F.col("sweep_id")
    at = F.when((F.col("domain") == 0) & (n % 100 == 0), None).when((F.col("domain") == 1) & (n % 50 == 0), 0).otherwise(F.col("started_ns"))
    t = s.select(F.col("domain").alias("mission_id"), n.alias("trace_index"), at.cast("long").alias("at_ns"))
    first = s.groupBy(F.col("domain").alias("mission_id")).agg(F.min("started_ns").alias("lo"))
    m = first.select("mission_id", (F.col("lo") + F.when(F.col("mission_id") == 2, 1).otherwise(0) - F.when(F.col("mission_id") == 1, F.col("lo")).otherwise(0)).alias("created_ns"), F.lit(16).alias("points"), F.when(F.col("mission_id") == 3, 15).alias("time_points"))
    return legacy.refusals(t, m)


@_query("A13_snapshot", f"WITH {_AIR} SELECT mission_id, trace_index, trace_uid, hash, record_position FROM (SELECT *, row_number() OVER (PARTITION BY mission_id, trace_index ORDER BY trace_index % 3 = 0, record_position) AS n FROM air) WHERE n = 1")
def a13(spark, d):
    """A table that got two thirds of the indices, then all rows again, and all once more: the last of its versions."""
    rows = P.side(spark, d, "air").drop("latitude")
    table = snapshots.shared_table(spark, "a13")
    for batch in (rows.where("trace_index % 3 <> 0"), rows, rows):
        table.append(batch)
    return table.read()


@_query("A14_append_classes", f"""WITH {_AIR}, {_GROUND}, st AS (SELECT mission_id, trace_index, arg_min(hash, record_position) AS old FROM air GROUP BY 1, 2),
r AS (SELECT g.*, st.old, row_number() OVER w AS n, first(g.hash) OVER w AS f FROM ground g LEFT JOIN st USING (mission_id, trace_index) WINDOW w AS (PARTITION BY mission_id, trace_index ORDER BY record_position)),
x AS (SELECT *, coalesce(old, CASE WHEN n > 1 THEN f END) AS against FROM r)
SELECT mission_id, trace_index, record_position, CASE WHEN against IS NULL THEN 'append' WHEN against = hash THEN 'duplicate' ELSE 'conflict' END AS action FROM x""")
def a14(spark, d):
    return sinks.classify(P.side(spark, d, "ground"), P.side(spark, d, "air")).select("mission_id", "trace_index", "record_position", "action")


@_query("A17_recovery_plan", f"""WITH {_AIR}, {P.MISSIONS_SQL} SELECT m.mission_id, committed_record_count, count(*) AS stored, greatest(0, max(record_position) + 1 - committed_record_count) AS tail_rows,
CASE WHEN max(record_position) + 1 >= committed_record_count THEN 'recover' ELSE 'refuse' END AS plan FROM missions m JOIN air USING (mission_id) GROUP BY 1, 2""")
def a17(spark, d):
    return sinks.recovery_plan(P.side(spark, d, "air"), P.missions(spark, d))


# ---- predicates and constraints


@_query("B3_receiver_plan", "SELECT vec_id, label, (label IN (1, 4)) AS ok FROM embeddings")
def b3(spark, d):
    e = P.table(spark, d, "embeddings")
    one = lambda desc: F.struct(F.lit(desc).alias("desc"), F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))
    both = F.when(F.col("label") == 1, F.array(one(0b00100001), one(0b00110000))).when(F.col("label") == 4, F.array(one(0b00100001))).when(F.col("label") == 2, F.array(one(0b00100001), one(0b00100001))).otherwise(F.array(one(0b01000010)))
    return e.select("vec_id", "label", frames.receiver_plan(both, 1, 1).alias("ok"))


_AXIS = "list_transform(range(16), lambda k: CAST(520000000 + k * 100000000 + CASE WHEN vec_id % 4 = 1 AND k = 3 THEN 50 WHEN vec_id % 4 = 2 AND k = 3 THEN 500 WHEN vec_id % 4 = 3 AND k = 5 THEN -200000000 ELSE 0 END AS DOUBLE))"


def _axes(spark, d):
    k = F.sequence(F.lit(0), F.lit(15))
    v = F.col("vec_id") % 4
    axis = F.transform(k, lambda i: (F.lit(520000000) + i * 100000000 + F.when((v == 1) & (i == 3), 50).when((v == 2) & (i == 3), 500).when((v == 3) & (i == 5), -200000000).otherwise(0)).cast("double"))
    return P.table(spark, d, "embeddings").select("vec_id", axis.alias("axis"))


@_query("B4_axis_valid", f"WITH a AS (SELECT vec_id, {_AXIS} AS x FROM embeddings) SELECT vec_id, len(list_filter(range(1, 16), lambda i: x[i + 1] <= x[i])) = 0 AS valid FROM a")
def b4(spark, d):
    return _axes(spark, d).select("vec_id", S.axis_valid(F.col("axis")).alias("valid"))


_STEPS = f"a AS (SELECT vec_id, {_AXIS} AS x FROM embeddings), s AS (SELECT vec_id, x, list_transform(range(1, 16), lambda i: x[i + 1] - x[i]) AS d FROM a), m AS (SELECT *, list_median(d) AS md, list_max(list_transform(d, lambda y: abs(y - list_median(d)))) AS er FROM s)"


@_query("B5_uniform_axis", f"WITH {_STEPS} SELECT vec_id, er <= greatest(1.0, abs(md) * 1e-6) AS uniform, er <= abs(md) * 1e-6 AS regular, len(list_filter(d, lambda y: abs(y - d[1]) > 1e-6 + abs(d[1]) * 1e-9)) = 0 AS like_first FROM m")
def b5(spark, d):
    a = F.col("axis")
    return _axes(spark, d).select("vec_id", S.axis_uniform(a).alias("uniform"), S.time_regular(a).alias("regular"), S.first_step_uniform(a).alias("like_first"))


@_query("B9_scan_constraints", f"WITH {_AIR}, p AS (SELECT mission_id, record_position, trace_index, lag(trace_index) OVER (PARTITION BY mission_id ORDER BY record_position) AS q FROM air) SELECT mission_id, record_position, trace_index FROM p WHERE trace_index <= q")
def b9(spark, d):
    return timing.monotonic_violations(P.side(spark, d, "air"), "trace_index").select("mission_id", "record_position", "trace_index")


_SCAN = "s AS (SELECT *, CASE WHEN mission_id = 'P' THEN 'O' ELSE mission_id END AS scan FROM air)"


@_query("B9_scan_violations", f"""WITH {_AIR}, {_SCAN}, r AS (SELECT scan, record_position, row_number() OVER (PARTITION BY scan, trace_uid ORDER BY record_position) > 1 AS uid, row_number() OVER (PARTITION BY scan, mission_id, trace_index ORDER BY record_position) > 1 AS identity,
mission_id <> first_value(mission_id) OVER w AS mission, trace_index <= lag(trace_index) OVER w AS rising FROM s WINDOW w AS (PARTITION BY scan ORDER BY record_position))
SELECT scan, record_position, rule FROM (SELECT scan, record_position, 'uid' AS rule FROM r WHERE uid UNION ALL SELECT scan, record_position, 'identity' FROM r WHERE identity UNION ALL SELECT scan, record_position, 'mission' FROM r WHERE mission UNION ALL SELECT scan, record_position, 'order' FROM r WHERE rising)""")
def b9_scans(spark, d):
    """Two of the missions lie in one scan."""
    scan = F.when(F.col("mission_id") == "P", "O").otherwise(F.col("mission_id"))
    return constraints.scan_violations(P.side(spark, d, "air").withColumn("scan", scan), ["scan"])


# ---- joins


@_query("C1_nearest_fix", f"""WITH {P.EVENTS_SQL}, s AS (SELECT *, (started_ns + finished_ns) // 2 AS at FROM sweeps),
f AS (SELECT domain, received_ns, min(fix_id) AS fix_id, arg_min(valid, seq) AS valid FROM fixes GROUP BY 1, 2),
b AS (SELECT s.domain, sweep_id, s.at, f.received_ns AS rt, f.fix_id, f.valid FROM s ASOF LEFT JOIN f ON s.domain = f.domain AND s.at >= f.received_ns),
n AS (SELECT b.*, f.received_ns AS nt, f.fix_id AS nf, f.valid AS nv FROM b ASOF LEFT JOIN f ON b.domain = f.domain AND b.at <= f.received_ns),
c AS (SELECT sweep_id, domain, CASE WHEN nt IS NULL OR at - rt <= nt - at THEN fix_id ELSE nf END AS fix_id, CASE WHEN nt IS NULL OR at - rt <= nt - at THEN at - rt ELSE nt - at END AS distance_ns, CASE WHEN nt IS NULL OR at - rt <= nt - at THEN valid ELSE nv END AS valid FROM n),
v AS (SELECT *, CASE WHEN fix_id IS NULL THEN 'no_fix' WHEN distance_ns > 600 * {_BIG} THEN 'out_of_range' WHEN NOT valid THEN 'invalid' WHEN distance_ns > 120 * {_BIG} THEN 'stale' END AS reason FROM c)
SELECT domain, sweep_id, fix_id, distance_ns, reason, reason IS NULL AS usable FROM v""")
def c1(spark, d):
    return match.nearest_fix(P.sweeps(spark, d), P.fixes(spark, d), stale_after_s=120, window_s=600).select("domain", "sweep_id", "fix_id", "distance_ns", "reason", "usable")


_RECONCILE = f"""{_AIR}, {_GROUND}, {_AIRX}, {_GROUNDX},
j AS (SELECT coalesce(a.mission_id, g.mission_id) AS mission_id, coalesce(a.trace_index, g.trace_index) AS trace_index, a.trace_uid AS au, g.trace_uid AS gu, a.hash AS ah, g.hash AS gh, a.latitude AS al, g.latitude AS gl, a.rn AS ha, g.rn AS hg
  FROM air_l a FULL JOIN ground_l g ON a.mission_id = g.mission_id AND a.trace_index = g.trace_index),
k AS (SELECT j.*, ax.trace_index AS xa, gx.trace_index AS xg FROM j LEFT JOIN air_x ax ON j.mission_id = ax.mission_id AND j.trace_index = ax.trace_index LEFT JOIN ground_x gx ON j.mission_id = gx.mission_id AND j.trace_index = gx.trace_index),
items AS (SELECT mission_id, trace_index, CASE WHEN ha = 1 AND hg = 1 AND (au <> gu OR ah <> gh) THEN 'conflict' WHEN ha = 1 AND hg = 1 AND al IS DISTINCT FROM gl THEN 'gnss_diff' WHEN ha = 1 AND hg = 1 THEN 'consistent'
  WHEN xa IS NOT NULL OR xg IS NOT NULL THEN 'conflict' WHEN ha = 1 THEN 'missing' ELSE 'extra' END AS kind,
  CASE WHEN ha = 1 AND hg = 1 AND au <> gu THEN 'uid differs' WHEN ha = 1 AND hg = 1 AND ah <> gh THEN 'hash differs' WHEN ha = 1 AND hg = 1 AND al IS NULL AND gl IS NOT NULL THEN 'air has no match' WHEN ha = 1 AND hg = 1 AND gl IS NULL AND al IS NOT NULL THEN 'ground has no match'
  WHEN ha = 1 AND hg = 1 AND al IS DISTINCT FROM gl THEN 'latitude' WHEN ha = 1 AND hg = 1 THEN NULL WHEN xg IS NOT NULL AND ha = 1 THEN 'conflict within ground' WHEN xa IS NOT NULL AND hg = 1 THEN 'conflict within air' END AS detail FROM k)"""


@_query("C2_reconcile", f"WITH {_RECONCILE} SELECT * FROM items")
def c2(spark, d):
    return reconcile.reconcile(P.side(spark, d, "air"), P.side(spark, d, "ground"))


@_query("C4_contract", "WITH a AS (SELECT n_regionkey, max(n_name) AS n, count(*) AS c FROM nation GROUP BY 1), b AS (SELECT n_regionkey, max(n_name) AS n, count(*) + CASE WHEN n_regionkey = 2 THEN 1 ELSE 0 END AS c FROM nation GROUP BY 1) SELECT CAST(a.n_regionkey AS VARCHAR) AS mission_id, unnest(['n', 'c']) AS field, unnest([a.n = b.n, a.c = b.c]) AS match FROM a JOIN b USING (n_regionkey)")
def c4(spark, d):
    a = P.table(spark, d, "nation").groupBy(F.col("n_regionkey").cast("string").alias("mission_id")).agg(F.max("n_name").alias("n"), F.count("*").alias("c"))
    b = a.withColumn("c", F.col("c") + F.when(F.col("mission_id") == "2", 1).otherwise(0))
    return reconcile.contract(a, b, ["n", "c"])


@_query("C5_calibration_binding", f"WITH {P.SAMPLES_SQL}, r AS (SELECT channel, k, avg(re) AS mre, avg(im) AS mim FROM s GROUP BY 1, 2) SELECT trace_id, channel, count(*) AS points FROM s JOIN r USING (channel, k) GROUP BY 1, 2")
def c5(spark, d):
    s = P.samples(spark, d)
    return dsp.bound(s, dsp.coherent_mean(s), "re", "im").select("trace_id", "channel", F.size("terms").cast("long").alias("points"))


@_query("C5_contract_mismatches", """WITH have AS (SELECT c_custkey AS channel, c_custkey * 2 AS position, 'S11' AS s_parameter, c_acctbal AS f FROM customer WHERE c_custkey % 13 <> 0),
want AS (SELECT c_custkey AS channel, c_custkey * 2 + CASE WHEN c_custkey % 17 = 0 THEN 1 ELSE 0 END AS position, CASE WHEN c_custkey % 11 = 0 THEN 'S22' ELSE 'S11' END AS s_parameter, c_acctbal + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS f FROM customer WHERE c_custkey % 19 <> 0)
SELECT coalesce(have.channel, want.channel) AS channel, CASE WHEN have.channel IS NULL THEN 'missing' WHEN want.channel IS NULL THEN 'unbound' WHEN have.position <> want.position THEN 'position' WHEN have.s_parameter <> want.s_parameter THEN 's_parameter' ELSE 'axis' END AS problem
FROM have FULL JOIN want ON have.channel = want.channel WHERE have.channel IS NULL OR want.channel IS NULL OR have.position <> want.position OR have.s_parameter <> want.s_parameter OR have.f <> want.f""")
def c5_mismatches(spark, d):
    """Contracts of a channel for each customer, of which the reference's differ at fixed moduli."""
    k, f = F.col("c_custkey"), F.col("c_acctbal").cast("double")
    off = lambda n, yes, no: F.when(k % n == 0, yes).otherwise(no)
    axis = lambda x: F.array(x, x + 1, x + 2)
    c = P.table(spark, d, "customer")
    have = c.where(k % 13 != 0).select(k.alias("channel"), (k * 2).alias("position"), F.lit("S11").alias("s_parameter"), axis(f).alias("axis"))
    want = c.where(k % 19 != 0).select(k.alias("channel"), (k * 2 + off(17, 1, 0)).alias("position"), off(11, F.lit("S22"), F.lit("S11")).alias("s_parameter"), axis(f + off(7, 1, 0)).alias("axis"))
    return binding.mismatches(have, want)


@_query("C7_last_before", f"""WITH {P.EVENTS_SQL}, r AS (SELECT domain, event_id AS id, at FROM ev WHERE event_type = 'purchase'), o AS (SELECT domain, at, max(CAST(event_id AS VARCHAR)) AS v FROM ev WHERE event_type = 'view' GROUP BY 1, 2)
SELECT r.domain, r.id, CASE WHEN r.at - o.at <= 60 * {_BIG} THEN o.v END AS view_id FROM r ASOF LEFT JOIN o ON r.domain = o.domain AND r.at >= o.at""")
def c7(spark, d):
    e = P._events(spark, d)
    others = e.where("event_type = 'view'").groupBy("domain", "at").agg(F.max(F.col("event_id").cast("string")).alias("view_id"))
    return match.last_before(e.where("event_type = 'purchase'").select("domain", F.col("event_id").alias("id"), "at"), others, "view_id", 60 * _NS).select("domain", "id", "view_id")


@_query("C9_missing_indices", f"WITH {_AIR}, m AS (SELECT mission_id, max(trace_index) AS hi FROM air GROUP BY 1), g AS (SELECT mission_id, unnest(range(hi + 1)) AS trace_index FROM m) SELECT mission_id, trace_index FROM g ANTI JOIN air USING (mission_id, trace_index)")
def c9(spark, d):
    return views.missing_indices(P.side(spark, d, "air"))


@_query("C10_registry_lookup", "SELECT l_orderkey, l_linenumber, coalesce(s_name, 'unknown') AS spec FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 5 <> 0) ON l_suppkey = s_suppkey")
def c10(spark, d):
    registry = P.table(spark, d, "supplier").where("s_suppkey % 5 <> 0")
    rows = P.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return constraints.lookup(rows, "l_suppkey", registry, "s_suppkey", "s_name", unknown="unknown").select("l_orderkey", "l_linenumber", F.col("s_name").alias("spec"))


@_query("C11_field_diff", "WITH r AS (SELECT p_partkey AS k, CAST(p_size AS VARCHAR) AS size, p_brand AS brand FROM part), a AS (SELECT p_partkey AS k, CAST(CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS VARCHAR) AS size, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand END AS brand FROM part) SELECT r.k, f AS field, CASE f WHEN 'size' THEN r.size ELSE r.brand END AS requested, CASE f WHEN 'size' THEN a.size ELSE a.brand END AS applied FROM r JOIN a USING (k), (SELECT unnest(['size', 'brand']) AS f) WHERE CASE f WHEN 'size' THEN r.size ELSE r.brand END IS DISTINCT FROM CASE f WHEN 'size' THEN a.size ELSE a.brand END")
def c11(spark, d):
    r = P.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size"), F.col("p_brand").alias("brand"))
    a = r.select("k", F.when(F.col("k") % 7 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(F.col("k") % 11 != 0, F.col("brand")).alias("brand"))
    return reconcile.field_diff(r, a, "k", ["size", "brand"])


# ---- aggregations


@_query("D1_identity_classes", f"WITH {_GROUND} SELECT mission_id, trace_index, count(*) AS rows, count(DISTINCT hash) AS hashes, min(record_position) AS first_position, CASE WHEN count(DISTINCT hash) > 1 THEN 'conflict' WHEN count(*) > 1 THEN 'duplicate' ELSE 'single' END AS verdict FROM ground GROUP BY 1, 2")
def d1(spark, d):
    return views.identity_classes(P.side(spark, d, "ground"))


@_query("D1_lineitem_identities", "SELECT l_orderkey, count(*) AS rows, count(DISTINCT sha256(CAST(l_suppkey % 3 AS VARCHAR))) AS hashes FROM lineitem GROUP BY 1")
def d1b(spark, d):
    li = P.table(spark, d, "lineitem").select(F.lit("m").alias("mission_id"), F.col("l_orderkey").alias("trace_index"), F.sha2((F.col("l_suppkey") % 3).cast("string"), 256).alias("hash"), F.col("l_linenumber").alias("record_position"))
    return views.identity_classes(li).select(F.col("trace_index").alias("l_orderkey"), "rows", "hashes")


@_query("D2_validation_summary", f"""WITH {_AIR}, c AS (SELECT mission_id, trace_index, count(*) AS n, count(DISTINCT hash) AS h FROM air GROUP BY 1, 2), u AS (SELECT mission_id, count(*) AS uid_conflicts FROM (SELECT mission_id, trace_uid FROM air GROUP BY ALL HAVING count(DISTINCT trace_index) > 1) GROUP BY 1)
SELECT c.mission_id, CAST(sum(n) AS BIGINT) AS rows, count(*) AS indices, count(*) FILTER (h = 1 AND n > 1) AS duplicates, count(*) FILTER (h > 1) AS conflicts, max(trace_index) + 1 - count(*) AS missing, 0 AS unhashed, coalesce(any_value(u.uid_conflicts), 0) AS uid_conflicts FROM c LEFT JOIN u ON c.mission_id = u.mission_id GROUP BY 1""")
def d2(spark, d):
    return views.validation_summary(P.side(spark, d, "air"))


@_query("D3_inventory_summary", f"""WITH {_RECONCILE}, i AS (SELECT mission_id, count(*) FILTER (kind IN ('consistent', 'gnss_diff')) AS matched, count(*) FILTER (kind = 'missing') AS missing, count(*) FILTER (kind = 'extra') AS extra, count(*) FILTER (kind = 'conflict') AS conflicts, count(*) FILTER (kind = 'gnss_diff') AS gnss_diffs FROM items GROUP BY 1),
ca AS (SELECT mission_id, count(*) AS air_traces, count(*) FILTER (h = 1 AND n > 1) AS air_duplicates, count(*) FILTER (h > 1) AS x FROM (SELECT mission_id, trace_index, count(*) AS n, count(DISTINCT hash) AS h FROM air GROUP BY 1, 2) GROUP BY 1),
cg AS (SELECT mission_id, count(*) AS ground_traces, count(*) FILTER (h = 1 AND n > 1) AS ground_duplicates, count(*) FILTER (h > 1) AS x FROM (SELECT mission_id, trace_index, count(*) AS n, count(DISTINCT hash) AS h FROM ground GROUP BY 1, 2) GROUP BY 1),
ua AS (SELECT mission_id, count(*) AS u FROM (SELECT mission_id, trace_uid FROM air GROUP BY ALL HAVING count(DISTINCT trace_index) > 1) GROUP BY 1), ug AS (SELECT mission_id, count(*) AS u FROM (SELECT mission_id, trace_uid FROM ground GROUP BY ALL HAVING count(DISTINCT trace_index) > 1) GROUP BY 1)
SELECT i.*, air_traces, air_duplicates, ca.x + coalesce(ua.u, 0) AS air_conflicts, ground_traces, ground_duplicates, cg.x + coalesce(ug.u, 0) AS ground_conflicts FROM i JOIN ca USING (mission_id) JOIN cg USING (mission_id) LEFT JOIN ua USING (mission_id) LEFT JOIN ug USING (mission_id)""")
def d3(spark, d):
    a, g = P.side(spark, d, "air"), P.side(spark, d, "ground")
    return reconcile.summary(reconcile.reconcile(a, g), a, g)


@_query("D4_coherent_mean", f"WITH {P.SAMPLES_SQL} SELECT channel, k, {_m('avg(re)')} AS re, {_m('avg(im)')} AS im, count(*) AS captures FROM s GROUP BY 1, 2")
def d4(spark, d):
    return dsp.coherent_mean(P.samples(spark, d)).select("channel", "k", micro(F.col("re")).alias("re"), micro(F.col("im")).alias("im"), "captures")


@_query("D5_capture_quality", f"WITH {P.SAMPLES_SQL}, r AS (SELECT channel, k, avg(re) AS a, avg(im) AS b FROM s GROUP BY 1, 2), e AS (SELECT channel, sqrt((re - a) * (re - a) + (im - b) * (im - b)) AS e FROM s JOIN r USING (channel, k)) SELECT channel, {_m('sqrt(avg(e * e))')} AS rms, {_m('max(e)')} AS worst, count(*) AS n FROM e GROUP BY 1")
def d5(spark, d):
    s = P.samples(spark, d)
    return dsp.capture_quality(s, dsp.coherent_mean(s)).select("channel", micro(F.col("rms")).alias("rms"), micro(F.col("worst")).alias("worst"), "n")


@_query("D6_latency_metrics", f"WITH m AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, avg(value) FILTER (event_type <> 'error') AS mean, max(value) FILTER (event_type <> 'error') AS max, quantile_cont(value, 0.5) FILTER (event_type <> 'error') AS p50, quantile_cont(value, 0.95) FILTER (event_type <> 'error') AS p95, quantile_cont(value, 0.99) FILTER (event_type <> 'error') AS p99 FROM events GROUP BY 1) SELECT user_id, n, errors, {_m('errors / n')} AS error_rate, {_m('mean')} AS mean, {_m('max')} AS max, {_m('p50')} AS p50, {_m('p95')} AS p95, {_m('p99')} AS p99 FROM m")
def d6(spark, d):
    e = P.table(spark, d, "events").withColumn("failed", F.col("event_type") == "error")
    m = timing.latency_metrics(e, "user_id", "value", "failed")
    return m.select("user_id", "n", "errors", *(micro(F.col(c)).alias(c) for c in ("error_rate", "mean", "max", "p50", "p95", "p99")))


@_query("D6_percentiles_of_large_groups", f"WITH g AS (SELECT event_type, round(value * 100) / 100 AS v FROM events UNION ALL SELECT 'all', round(value * 100) / 100 FROM events) SELECT event_type, count(v) AS n, {_m('quantile_cont(v, 0.5)')} AS p50, {_m('quantile_cont(v, 0.95)')} AS p95, {_m('quantile_cont(v, 0.99)')} AS p99 FROM g GROUP BY 1")
def d6_large(spark, d):
    """One group of all rows and one for each type."""
    e = P.table(spark, d, "events").select(F.explode(F.array("event_type", F.lit("all"))).alias("event_type"), (F.round(F.col("value") * 100) / 100).alias("v"))
    got = timing.percentiles_of_large_groups(e, "event_type", "v", (0.5, 0.95, 0.99))
    return got.select("event_type", "n", *(micro(F.get("percentiles", F.lit(i))).alias(c) for i, c in enumerate(("p50", "p95", "p99"))))


def _digest_sql(rows: str, by: str = "") -> str:
    """Columns ``rows`` and ``digest`` of digests ``d`` of a CTE: sums of 16 bits each, carries from the last one up."""
    group = f" GROUP BY {by}" if by else ""
    by = f"{by}, " if by else ""
    ctes = [f"l AS (SELECT {by}count(*) AS rows, " + ", ".join(f"CAST(sum(CAST('0x' || substr(d, {4 * i + 1}, 4) AS BIGINT)) AS BIGINT) AS w{i}" for i in range(16)) + f" FROM {rows}{group})", "t15 AS (SELECT *, w15 AS t15 FROM l)"]
    ctes += [f"t{i} AS (SELECT *, w{i} + (t{i + 1} >> 16) AS t{i} FROM t{i + 1})" for i in reversed(range(15))]
    return ", ".join(ctes) + f", digests AS (SELECT {by}rows, " + " || ".join(f"lpad(lower(hex(t{i} % 65536)), 4, '0')" for i in range(16)) + " AS digest FROM t0)"


def _framed_sql(*columns: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns) + ")"


@_query("D7_fingerprint", f"WITH d AS (SELECT {_framed_sql('l_orderkey', 'l_linenumber', 'l_partkey', 'l_returnflag')} AS d FROM lineitem), {_digest_sql('d')} SELECT rows, digest FROM digests")
def d7(spark, d):
    return provenance.fingerprint(P.table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")


_TREE = "SELECT trace_index // 256 AS range, " + _framed_sql("trace_index", "trace_uid", "hash") + " AS d"


@_query("G7_digest_tree", f"WITH {_AIR}, d AS (SELECT mission_id, range, d FROM ({_TREE}, mission_id FROM air)), {_digest_sql('d', 'mission_id, range')} SELECT mission_id, range, rows, digest FROM digests")
def g7_tree(spark, d):
    return provenance.digest_tree(P.side(spark, d, "air"), ["mission_id"], "trace_index", ["trace_index", "trace_uid", "hash"], 256)[0]


@_query("L8_differing_ranges", f"WITH {_AIR}, {_GROUND}, x AS (SELECT mission_id, trace_index // 256 AS r, list(trace_index || '/' || trace_uid || '/' || hash ORDER BY trace_index, trace_uid, hash) AS a FROM air GROUP BY 1, 2), y AS (SELECT mission_id, trace_index // 256 AS r, list(trace_index || '/' || trace_uid || '/' || hash ORDER BY trace_index, trace_uid, hash) AS b FROM ground GROUP BY 1, 2) SELECT mission_id, r * 256 AS low, r * 256 + 255 AS high FROM x FULL JOIN y USING (mission_id, r) WHERE a IS DISTINCT FROM b")
def l8_ranges(spark, d):
    """Where the two copies differ, found down two trees of digests."""
    return provenance.differing_ranges(P.side(spark, d, "air"), P.side(spark, d, "ground"), ["mission_id"], "trace_index", ["trace_index", "trace_uid", "hash"], 256, 8)


@_query("D8_missing_ranges", f"WITH {_AIR}, m AS (SELECT mission_id, max(trace_index) AS hi FROM air GROUP BY 1), g AS (SELECT mission_id, unnest(range(hi + 1)) AS t FROM m), x AS (SELECT g.* FROM g ANTI JOIN air a ON g.mission_id = a.mission_id AND g.t = a.trace_index), y AS (SELECT mission_id, t, t - row_number() OVER (PARTITION BY mission_id ORDER BY t) AS isl FROM x) SELECT mission_id, min(t) AS low, max(t) AS high FROM y GROUP BY mission_id, isl")
def d8(spark, d):
    return views.missing_ranges(P.side(spark, d, "air"))


@_query("D8_index_ranges", f"WITH {_AIR}, x AS (SELECT DISTINCT mission_id, trace_index AS t FROM air), y AS (SELECT mission_id, t, t - row_number() OVER (PARTITION BY mission_id ORDER BY t) AS isl FROM x) SELECT mission_id, min(t) AS low, max(t) AS high FROM y GROUP BY mission_id, isl")
def d8_ranges(spark, d):
    return views.ranges(P.side(spark, d, "air"))


@_query("D12_compatibility", "WITH c AS (SELECT l_suppkey AS subject, l_returnflag = 'R' AS hard, l_discount < 0.1 AS ok, l_linenumber FROM lineitem) SELECT subject, CASE WHEN NOT coalesce(bool_and(ok) FILTER (hard), true) THEN 'incompatible' WHEN NOT coalesce(bool_and(ok) FILTER (NOT hard), true) THEN 'warnings' ELSE 'compatible' END AS verdict FROM c GROUP BY 1")
def d12(spark, d):
    li = P.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("subject"), (F.col("l_returnflag") == "R").alias("hard"), (F.col("l_discount") < 0.1).alias("match"))
    return reconcile.compatibility(li)


# ---- windows


@_query("E1_flat_reflection", f"WITH {P.SAMPLES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY channel, k ORDER BY trace_id) - 1 AS n, count(*) OVER (PARTITION BY channel, k) AS t, sum(re) OVER w AS sr, sum(im) OVER w AS si, first(re) OVER a AS fr, first(im) OVER a AS fi, last(re) OVER a AS lr, last(im) OVER a AS li FROM s WINDOW w AS (PARTITION BY channel, k ORDER BY trace_id ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING), a AS (PARTITION BY channel, k ORDER BY trace_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT trace_id, channel, k, {_m('re - (sr + greatest(0, 50 - n) * fr + greatest(0, n + 50 - t + 1) * lr) / 101')} AS re, {_m('im - (si + greatest(0, 50 - n) * fi + greatest(0, n + 50 - t + 1) * li) / 101')} AS im FROM n")
def e1(spark, d):
    return dsp.flat(dsp.flat_reflection(P.samples(spark, d), 101)).select("trace_id", "channel", "k", micro(F.col("re")).alias("re"), micro(F.col("im")).alias("im"))


@_query("E2_dewow", f"WITH {P.SAMPLES_SQL}, l AS (SELECT trace_id, channel, list(re ORDER BY k) AS r, list(im ORDER BY k) AS i FROM s GROUP BY 1, 2), o AS (SELECT *, unnest(range(16)) AS k FROM l), m AS (SELECT *, list_transform(range(-2, 3), lambda j: CASE WHEN k + j < 0 THEN -(k + j) WHEN k + j > 15 THEN 30 - (k + j) ELSE k + j END + 1) AS ix FROM o) SELECT trace_id, channel, k, {_m('r[k + 1] - list_sum(list_transform(ix, lambda x: r[x])) / 5')} AS re, {_m('i[k + 1] - list_sum(list_transform(ix, lambda x: i[x])) / 5')} AS im FROM m")
def e2(spark, d):
    return dsp.flat(dsp.dewow(P.samples(spark, d), 5)).select("trace_id", "channel", "k", micro(F.col("re")).alias("re"), micro(F.col("im")).alias("im"))


@_query("E3_window_samples", "WITH x AS (SELECT p_partkey, p_size / 2.0 AS ratio FROM part), y AS (SELECT p_partkey, greatest(1, CAST(round_even(ratio, 0) AS BIGINT)) AS n FROM x) SELECT p_partkey, CASE WHEN n + (CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END) BETWEEN 3 AND 21 THEN n + (CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END) END AS samples FROM y")
def e3(spark, d):
    return P.table(spark, d, "part").select("p_partkey", S.window_samples(F.col("p_size") / 2.0, 21).alias("samples"))


@_query("E4_schedule", f"WITH {P.EVENTS_SQL} SELECT domain, sweep_id, started_ns - lag(started_ns) OVER w AS interval_ns, started_ns - lag(started_ns) OVER w - 60 * {_BIG} AS error_ns, greatest(0, finished_ns - started_ns - 60 * {_BIG}) AS overrun_ns FROM sweeps WINDOW w AS (PARTITION BY domain ORDER BY started_ns, sweep_id)")
def e4(spark, d):
    return timing.schedule(P.sweeps(spark, d), 60 * _NS).select("domain", "sweep_id", "interval_ns", "error_ns", "overrun_ns")


@_query("E6_deadlines", f"WITH {P.EVENTS_SQL}, s AS (SELECT *, sum(CASE WHEN sweep_id % 50 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY domain ORDER BY started_ns, sweep_id) AS seg FROM sweeps) SELECT domain, sweep_id, first(started_ns) OVER w + (row_number() OVER w - 1) * 60 * {_BIG} AS deadline_ns FROM s WINDOW w AS (PARTITION BY domain, seg ORDER BY started_ns, sweep_id)")
def e6(spark, d):
    return timing.deadlines(P.sweeps(spark, d).withColumn("resumed", F.col("sweep_id") % 50 == 0), 60 * _NS).select("domain", "sweep_id", "deadline_ns")


@_query("E7_replay_gaps", f"WITH {P.EVENTS_SQL} SELECT domain, sweep_id, coalesce(greatest(0, started_ns - lag(started_ns) OVER (PARTITION BY domain ORDER BY sweep_id)), 0) AS gap_ns FROM sweeps")
def e7(spark, d):
    s = P.sweeps(spark, d).select(F.col("domain").alias("mission_id"), F.col("sweep_id").alias("trace_index"), F.col("started_ns").alias("at_ns"))
    return timing.replay_gaps(s).select(F.col("mission_id").alias("domain"), F.col("trace_index").alias("sweep_id"), "gap_ns")


@_query("A21_paced_replay", f"WITH {P.EVENTS_SQL} SELECT domain, sweep_id, coalesce(greatest(0, started_ns - lag(started_ns) OVER (PARTITION BY domain ORDER BY sweep_id)), 0) // 4 AS gap_ns FROM sweeps")
def a21_paced(spark, d):
    s = P.sweeps(spark, d).select(F.col("domain").alias("mission_id"), F.col("sweep_id").alias("trace_index"), F.col("started_ns").alias("at_ns"))
    return timing.paced(s, "accelerated", 4.0).select(F.col("mission_id").alias("domain"), F.col("trace_index").alias("sweep_id"), "gap_ns")


@_query("A21_due_times", f"WITH {P.EVENTS_SQL}, g AS (SELECT domain, sweep_id, coalesce(greatest(0, started_ns - lag(started_ns) OVER (PARTITION BY domain ORDER BY sweep_id)), 0) AS gap FROM sweeps) SELECT domain, sweep_id, CAST(sum(gap) OVER (PARTITION BY domain ORDER BY sweep_id) AS BIGINT) AS due_ns FROM g")
def a21_due(spark, d):
    s = P.sweeps(spark, d).select(F.col("domain").alias("mission_id"), F.col("sweep_id").alias("trace_index"), F.col("started_ns").alias("at_ns"))
    return replay.due(s).select(F.col("mission_id").alias("domain"), F.col("trace_index").alias("sweep_id"), "due_ns")


_HISTORY = "h AS (SELECT o_custkey AS dataset_id, o_orderkey AS ordinal, CASE o_orderkey % 3 WHEN 0 THEN 'calibration' WHEN 1 THEN 'ifft' ELSE 'dewow' END AS stage, CASE o_orderkey % 3 WHEN 0 THEN 'frequency_raw' WHEN 1 THEN 'frequency_calibrated' ELSE 'time_base' END AS source, CASE o_orderkey % 3 WHEN 0 THEN 'frequency_calibrated' WHEN 1 THEN 'time_base' ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'frequency_raw' ELSE 'time_processed' END END AS target FROM orders)"


@_query("E10_history_violations", f"WITH {_HISTORY}, x AS (SELECT *, NOT (source, target) IN (('frequency_raw', 'frequency_calibrated'), ('frequency_calibrated', 'time_base'), ('time_base', 'time_processed')) AS bad, source <> coalesce(lag(target) OVER (PARTITION BY dataset_id ORDER BY ordinal), 'frequency_raw') AS broken, row_number() OVER (PARTITION BY dataset_id, stage ORDER BY ordinal) > 1 AS again FROM h) SELECT dataset_id, ordinal, CASE WHEN bad THEN 'illegal_hop' WHEN broken THEN 'broken_link' ELSE 'repeated_stage' END AS violation FROM x WHERE bad OR broken OR again")
def e10(spark, d):
    k = F.col("o_orderkey") % 3
    pick = lambda a, b, c: F.when(k == 0, a).when(k == 1, b).otherwise(c)
    h = P.table(spark, d, "orders").select(F.col("o_custkey").alias("dataset_id"), F.col("o_orderkey").alias("ordinal"), pick("calibration", "ifft", "dewow").alias("stage"), pick("frequency_raw", "frequency_calibrated", "time_base").alias("source"), pick(F.lit("frequency_calibrated"), F.lit("time_base"), F.when(F.col("o_orderkey") % 5 == 0, "frequency_raw").otherwise("time_processed")).alias("target"))
    return provenance.history_violations(h)


# ---- paging, caches, sets, digests


@_query("F1_page", f"WITH {_RECONCILE}, c AS (SELECT mission_id, trace_index FROM items WHERE kind = 'conflict' ORDER BY 1, 2 LIMIT 51 OFFSET 50) SELECT *, (SELECT count(*) FROM c) > 50 AS has_more FROM c ORDER BY 1, 2 LIMIT 50")
def f1(spark, d):
    return reconcile.page(reconcile.reconcile(P.side(spark, d, "air"), P.side(spark, d, "ground")), 1, 50, "conflict").select("mission_id", "trace_index", "has_more")


@_query("F4_bounded_cache", f"WITH {P.EVENTS_SQL}, n AS (SELECT max(received_ns) AS now FROM fixes), r AS (SELECT domain, fix_id, row_number() OVER (PARTITION BY domain ORDER BY received_ns DESC, seq DESC) AS k FROM fixes, n WHERE received_ns >= now - CAST(86400 AS BIGINT) * {_BIG}) SELECT domain, fix_id FROM r WHERE k <= 256")
def f4(spark, d):
    f = P.fixes(spark, d)
    now = f.agg(F.max("received_ns")).first()[0]
    return match.bounded_cache(f, now, max_age_s=86400).select("domain", "fix_id")


@_query("G1_union", f"WITH {_AIR}, {_GROUND} SELECT mission_id, trace_index, trace_uid FROM air UNION ALL SELECT mission_id, trace_index, trace_uid FROM ground")
def g1(spark, d):
    sides = [P.side(spark, d, name) for name in ("air", "ground")]
    contracts = [x.groupBy("mission_id").agg(F.min(F.length("hash")).alias("digest_length")) for x in sides]
    return views.stack(sides, contracts, ("digest_length",)).select("mission_id", "trace_index", "trace_uid")


@_query("G2_excluded", f"WITH {_AIR}, {_AIRX} SELECT DISTINCT mission_id, trace_index FROM air EXCEPT SELECT mission_id, trace_index FROM air_l")
def g2(spark, d):
    a = P.side(spark, d, "air")
    return a.select("mission_id", "trace_index").distinct().exceptAll(views.logical(a).select("mission_id", "trace_index"))


def _hx(s: str) -> str:
    return f"lpad(lower(printf('%x', {s})), 16, '0')"


@_query("G3_canonical_hash", "SELECT c_custkey, sha256(unhex(hex(encode('TRACELAKE-RAW')) || '0000000000000001' || lpad(printf('%x', octet_length(encode(c_name))), 16, '0') || hex(encode(c_name)) || lpad(printf('%x', octet_length(encode(c_mktsegment))), 16, '0') || hex(encode(c_mktsegment)) || lpad(printf('%x', c_custkey), 16, '0') || '0000000000000001' || '0000000000000002' || hex(encode('s1')) || '0000000000000004' || 'AABB' || 'CCDD')) AS hash FROM customer")
def g3(spark, d):
    c = P.table(spark, d, "customer")
    h = S.raw_trace_sha256("TRACELAKE-RAW", F.col("c_name"), F.col("c_mktsegment"), F.col("c_custkey"), F.array(F.lit("s1")), F.lit(4), F.unhex(F.lit("AABB")), F.unhex(F.lit("CCDD")))
    return c.select("c_custkey", h.alias("hash"))


@_query("G3_raw_hash", "WITH x AS (SELECT p_partkey, p_brand, p_size, '000000000000' || printf('%02x%02x', ((1023 + p_size) & 15) * 16, (1023 + p_size) >> 4) AS a, '000000000000' || printf('%02x%02x', ((1024 + p_size) & 15) * 16, (1024 + p_size) >> 4) AS b, '000000000000' || printf('%02x%02x', ((1023 - p_size) & 15) * 16, ((1023 - p_size) >> 4) + 128) AS c FROM part) SELECT p_partkey, sha256(unhex(hex(encode('TRACELAKE-RAW')) || '0000000000000001' || lpad(printf('%x', octet_length(encode(p_brand))), 16, '0') || hex(encode(p_brand)) || '0000000000000001' || hex(encode('u')) || lpad(printf('%x', p_partkey), 16, '0') || '0000000000000001' || '0000000000000002' || hex(encode('s1')) || '0000000000000002' || a || b || a || c || c || b)) AS hash FROM x")
def g3_raw(spark, d):
    """From an axis and complex samples (powers of two) to their bytes and digest."""
    t = P.table(spark, d, "part").withColumns({"a": F.pow(F.lit(2.0), F.col("p_size")), "b": F.pow(F.lit(2.0), F.col("p_size") + 1), "c": -F.pow(F.lit(2.0), -F.col("p_size"))})
    axis, raw = codecs.le_doubles(F.array("a", "b")), codecs.le_complex(F.array(C.cx(F.col("a"), F.col("c")), C.cx(F.col("c"), F.col("b"))))
    return t.select("p_partkey", S.raw_trace_sha256("TRACELAKE-RAW", F.col("p_brand"), F.lit("u"), F.col("p_partkey"), F.array(F.lit("s1")), F.lit(2), axis, raw).alias("hash"))


@_query("G5_config_digest", """SELECT p_partkey, sha256('{"brand":"' || p_brand || '","channels":[{"id":"s1","size":' || CAST(p_size AS VARCHAR) || '}],"offset":0.0,"zeta":null}') AS digest FROM part""")
def g5(spark, d):
    """Configurations as structs; -0.0 counts as 0.0, and what only describes is left out."""
    config = F.struct(F.lit(None).cast("string").alias("zeta"), F.col("p_brand").alias("brand"), F.array(F.struct(F.col("p_size").alias("size"), F.lit("s1").alias("id"))).alias("channels"), F.lit(-0.0).alias("offset"))
    return P.table(spark, d, "part").select("p_partkey", codecs.canonical_digest(config).alias("digest"))


def _profiles(spark, d, shift):
    """Profiles of a data set (an order): a position for each line, the digest that of its part."""
    lines = P.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"), F.min("l_partkey").alias("l_partkey"))
    return lines.select(F.col("l_orderkey").alias("dataset_id"), F.col("l_linenumber").alias("position"), F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("channel_id"), F.lit("s11").alias("s_parameter"), F.col("l_suppkey").cast("string").alias("profile_id"), F.sha2((F.col("l_partkey") + shift).cast("string"), 256).alias("content_sha256"))


_LINES_SQL = "(SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2)"
_SET_SQL = f"""SELECT l_orderkey AS dataset_id, sha256('[' || string_agg('{{"channel_id":"c' || CAST(l_linenumber AS VARCHAR) || '","content_sha256":"' || sha256(CAST(l_partkey AS VARCHAR)) || '","profile_id":"' || CAST(l_suppkey AS VARCHAR) || '"}}', ',' ORDER BY l_linenumber) || ']') AS set_sha256 FROM {_LINES_SQL} GROUP BY 1"""


@_query("G6_set_digest", _SET_SQL)
def g6(spark, d):
    return reuse.set_digest(_profiles(spark, d, F.lit(0)), "dataset_id")


# ---- scalar functions


def _lines(spark, d):
    e = P.table(spark, d, "events").select("event_id", F.col("event_id").alias("i"))
    i = F.col("i")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    body = F.concat_ws(",", F.lit("GPGGA"), F.concat(pad(i % 24, 2), pad(i % 60, 2), pad((i * 7) % 60, 2)), F.concat(pad(i % 90, 2), pad(i % 61, 2), F.lit(".5")), F.when(i % 2 == 0, "N").otherwise("S"), F.concat(pad(i % 180, 3), pad((i * 3) % 60, 2), F.lit(".25")), F.when(i % 13 == 0, "N").when(i % 3 == 0, "W").otherwise("E"), (i % 9).cast("string"), pad(i % 40, 2), F.lit("1.5"), F.lit("100.0"), F.lit("M"), F.lit("0.0"), F.lit("M"), F.lit(""), F.lit(""))
    line = F.concat(F.lit("$"), body, F.lit("*"), F.when(i % 17 == 0, "00").otherwise(nmea.checksum(body)))
    return e.select("event_id", line.alias("line"))


_LINES = """x AS (SELECT event_id, event_id AS i FROM events), b AS (SELECT event_id, i, concat_ws(',', 'GPGGA', lpad(CAST(i % 24 AS VARCHAR), 2, '0') || lpad(CAST(i % 60 AS VARCHAR), 2, '0') || lpad(CAST((i * 7) % 60 AS VARCHAR), 2, '0'), lpad(CAST(i % 90 AS VARCHAR), 2, '0') || lpad(CAST(i % 61 AS VARCHAR), 2, '0') || '.5', CASE WHEN i % 2 = 0 THEN 'N' ELSE 'S' END, lpad(CAST(i % 180 AS VARCHAR), 3, '0') || lpad(CAST((i * 3) % 60 AS VARCHAR), 2, '0') || '.25', CASE WHEN i % 13 = 0 THEN 'N' WHEN i % 3 = 0 THEN 'W' ELSE 'E' END, CAST(i % 9 AS VARCHAR), lpad(CAST(i % 40 AS VARCHAR), 2, '0'), '1.5', '100.0', 'M', '0.0', 'M', '', '') AS body FROM x),
c AS (SELECT *, list_reduce(list_transform(string_split(body, ''), lambda ch: ascii(ch)), lambda p, q: xor(p, q)) AS ck FROM b)"""


@_query("H1_nmea", f"""WITH {_LINES}, r AS (SELECT event_id, i, CASE WHEN i % 17 = 0 AND ck <> 0 THEN 'bad_checksum' WHEN i % 61 = 60 THEN 'out_of_range' WHEN i % 13 = 0 THEN 'malformed_field' WHEN i % 9 IN (3, 7) THEN 'unsupported_fix_quality' END AS reason FROM c)
SELECT event_id, reason, CASE WHEN reason IS NULL THEN 'GGA' END AS sentence, CASE WHEN reason IS NULL THEN ['invalid', 'gps_fix', 'dgps', NULL, 'rtk_fixed', 'rtk_float', 'estimated', NULL, 'simulated'][i % 9 + 1] END AS quality,
CASE WHEN reason IS NULL AND i % 9 <> 0 THEN {_m("(i % 90 + (i % 61 + 0.5) / 60) * CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END")} END AS latitude, CASE WHEN reason IS NULL AND i % 9 <> 0 THEN {_m("(i % 180 + ((i * 3) % 60 + 0.25) / 60) * CASE WHEN i % 3 = 0 THEN -1 ELSE 1 END")} END AS longitude, CASE WHEN reason IS NULL THEN CAST(i % 40 AS INT) END AS satellites FROM r""")
def h1(spark, d):
    return nmea.parse(_lines(spark, d)).select("event_id", "reason", "sentence", "quality", micro(F.col("latitude")).alias("latitude"), micro(F.col("longitude")).alias("longitude"), "satellites")


@_query("H2_checksum", f"WITH {_LINES} SELECT event_id, lpad(upper(printf('%x', ck)), 2, '0') AS checksum FROM c")
def h2(spark, d):
    return _lines(spark, d).select("event_id", nmea.checksum(F.expr("substring(line, 2, instr(line, '*') - 2)")).alias("checksum"))


@_query("H10_instants", "SELECT event_id, epoch_us(ts) * 1000 AS ns, epoch_us(ts) AS us FROM events")
def h10(spark, d):
    ns = S.ns_of(F.col("ts"))
    return P.table(spark, d, "events").select("event_id", ns.alias("ns"), F.unix_micros(S.ts_of(ns)).alias("us"))


@_query("H15_edge_window", f"WITH f AS (SELECT o_orderkey, round(o_totalprice * 100) * 50 AS f FROM orders) SELECT o_orderkey, {_m('CASE WHEN f < 5e8 OR f > 25e8 THEN 0 WHEN f < 1e9 THEN pow(sin(pi() / 2 * (f - 5e8) / 5e8), 2) WHEN f <= 15e8 THEN 1 ELSE pow(sin(pi() / 2 * (25e8 - f) / 1e9), 2) END')} AS w FROM f")
def h15(spark, d):
    return P.table(spark, d, "orders").select("o_orderkey", micro(S.edge_window(F.round(F.col("o_totalprice") * 100) * 50, (0.5e9, 1e9, 1.5e9, 2.5e9))).alias("w"))


@_query("H16_next_power", "SELECT p_partkey, CAST(pow(2, ceil(log2(p_partkey))) AS BIGINT) AS n FROM part WHERE p_partkey > 0")
def h16(spark, d):
    return P.table(spark, d, "part").where("p_partkey > 0").select("p_partkey", S.next_power_of_two(F.col("p_partkey")).alias("n"))


@_query("H17_ratio", f"WITH {P.SAMPLES_SQL}, z AS (SELECT a.trace_id, a.k, a.re AS ar, a.im AS ai, b.re AS br, b.im AS bi, b.re * b.re + b.im * b.im AS q FROM s a JOIN s b ON a.trace_id = b.trace_id AND a.k = b.k AND a.channel = 0 AND b.channel = 1) SELECT trace_id, k, CASE WHEN q > 0.0001 THEN CAST(round((ar * br + ai * bi) / q * 1e4 + 0.0) AS BIGINT) END AS re, CASE WHEN q > 0.0001 THEN CAST(round((ai * br - ar * bi) / q * 1e4 + 0.0) AS BIGINT) END AS im FROM z")
def h17(spark, d):
    s = P.samples(spark, d)
    a, b = (s.where(f"channel = {c}").select("trace_id", F.col("values").alias(f"v{c}")) for c in (0, 1))
    q = F.transform(F.arrays_zip("v0", "v1"), lambda z: F.when(C.power(z["v1"]) > 0.0001, C.div(z["v0"], z["v1"])))
    rows = a.join(b, "trace_id").select("trace_id", F.posexplode(q).alias("k", "r"))
    return rows.select("trace_id", "k", F.round(F.col("r.re") * 1e4 + 0.0).cast("long").alias("re"), F.round(F.col("r.im") * 1e4 + 0.0).cast("long").alias("im"))


@_query("H19_backoff", "SELECT p_partkey, least(0.5 * pow(2, p_size % 12), 30) AS wait FROM part")
def h19(spark, d):
    return P.table(spark, d, "part").select("p_partkey", S.backoff(F.col("p_size") % 12 + 1, 0.5, 2.0, 30.0).alias("wait"))


@_query("H20_quality_reasons", _SQL["C1_nearest_fix"].replace("SELECT domain, sweep_id, fix_id, distance_ns, reason, reason IS NULL AS usable FROM v", "SELECT sweep_id, CASE reason WHEN 'stale' THEN 'gnss_stale' WHEN 'invalid' THEN 'gnss_invalid' WHEN 'no_fix' THEN 'gnss_no_fix' WHEN 'out_of_range' THEN 'gnss_no_fix' END AS quality, CASE WHEN reason IS NULL THEN 'valid' WHEN reason IN ('stale', 'invalid') THEN reason ELSE 'no_fix' END AS health FROM v"))
def h20(spark, d):
    m = match.nearest_fix(P.sweeps(spark, d), P.fixes(spark, d), stale_after_s=120, window_s=600)
    return m.select("sweep_id", S.quality_reason(F.col("reason"), F.col("usable")).alias("quality"), S.health(F.col("reason"), F.col("usable")).alias("health"))


@_query("H23_quantize", "SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS start_hz, CAST(trunc(o_totalprice * 2) AS BIGINT) AS stop_hz, CAST(trunc(o_totalprice / 100) AS BIGINT) AS bandwidth_hz, CAST(round_even((o_totalprice % 100 - 50) * 100, 0) AS BIGINT) AS hundredths FROM orders")
def h23(spark, d):
    x = F.col("o_totalprice")
    q = S.quantized(x, x * 2, x / 100, x % 100 - 50)
    o = P.table(spark, d, "orders").select("o_orderkey", q.alias("q"))
    return o.select("o_orderkey", "q.start_hz", "q.stop_hz", "q.bandwidth_hz", F.round(F.col("q.power_dbm") * 100).cast("long").alias("hundredths"))


@_query("H24_timeout", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS DOUBLE) ELSE greatest(2.0, 501.0 * 2 / greatest(p_size, 1) * 0.1) END AS timeout_s FROM part")
def h24(spark, d):
    explicit = F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("double"))
    return P.table(spark, d, "part").select("p_partkey", S.sweep_timeout(explicit, F.lit(501.0), F.lit(2), F.col("p_size")).alias("timeout_s"))


# ---- signal processing


def _standards(spark, d):
    rows = dsp.flat(P.samples(spark, d)).where("trace_id < 3")
    name = F.element_at(F.array(F.lit("open"), F.lit("short"), F.lit("load")), (F.col("trace_id") + 1).cast("int"))
    ideal = F.element_at(F.array(*(C.cx(F.lit(x), F.lit(y)) for x, y in ((1.0, 0.1), (-1.0, 0.1), (0.0, 0.02)))), (F.col("trace_id") + 1).cast("int"))
    return rows.select("channel", "k", name.alias("standard"), F.struct("re", "im").alias("measured"), ideal.alias("actual"))


def _cplx(name: str, a: tuple[str, str], op: str, b: tuple[str, str]) -> str:
    """SQL of one complex operation as two columns."""
    (r, i), (x, y) = a, b
    q = f"({x} * {x} + {y} * {y})"
    re_, im_ = {"*": (f"{r} * {x} - {i} * {y}", f"{r} * {y} + {i} * {x}"), "-": (f"{r} - {x}", f"{i} - {y}"), "+": (f"{r} + {x}", f"{i} + {y}"), "/": (f"({r} * {x} + {i} * {y}) / {q}", f"({i} * {x} - {r} * {y}) / {q}")}[op]
    return f"{re_} AS {name}r, {im_} AS {name}i"


def _terms_sql() -> str:
    """By Cramer's rule on the three equations m = D + a E + a m S, stage by stage."""
    c = lambda x: (f"{x}r", f"{x}i")
    const = {"ao": ("1.0", "0.1"), "as": ("-1.0", "0.1"), "al": ("0.0", "0.02")}
    v = lambda x: const.get(x) or c(x)
    steps = [[("po", "ao", "*", "mo"), ("ps", "as", "*", "ms"), ("pl", "al", "*", "ml")]]
    pairs = (("o", "s"), ("s", "l"), ("l", "o"))
    steps.append([(f"{x}{a}{b}", f"{y}{a}", "*", f"{z}{b}") for x, y, z in (("u", "a", "p"), ("v", "m", "p"), ("w", "a", "m")) for a, b in (*pairs, *((b, a) for a, b in pairs))])
    steps.append([(f"{x}{a}{b}_", f"{x}{a}{b}", "-", f"{x}{b}{a}") for x in "uvw" for a, b in pairs])
    steps.append([(f"{x}1", f"{x}os_", "+", f"{x}sl_") for x in "uvw"] + [(f"y{a}", f"m{a}", "*", f"u{b}{d}_") for a, b, d in (("o", "s", "l"), ("s", "l", "o"), ("l", "o", "s"))])
    steps.append([(f"{x}2", f"{x}1", "+", f"{x}lo_") for x in "uvw"] + [("y1", "yo", "+", "ys")])
    steps.append([("y2", "y1", "+", "yl"), ("E", "v2", "/", "u2"), ("S", "w2", "/", "u2")])
    steps.append([("D", "y2", "/", "u2")])
    steps.append([("DS", "D", "*", "S")])
    steps.append([("T", "E", "+", "DS")])
    ctes = "".join(f", c{n + 1} AS (SELECT *, {', '.join(_cplx(name, v(a), op, v(b)) for name, a, op, b in ops)} FROM c{n})" for n, ops in enumerate(steps))
    base = "c0 AS (SELECT o.channel, o.k, o.re AS mor, o.im AS moi, h.re AS msr, h.im AS msi, l.re AS mlr, l.im AS mli FROM s o JOIN s h ON h.trace_id = 1 AND h.channel = o.channel AND h.k = o.k JOIN s l ON l.trace_id = 2 AND l.channel = o.channel AND l.k = o.k WHERE o.trace_id = 0)"
    out = ", ".join(f"{_m(x + p[0])} AS {x}_{p}" for x in "DTS" for p in ("re", "im"))
    return f"WITH {P.SAMPLES_SQL}, {base}{ctes} SELECT channel, k, true AS ok, {out} FROM c{len(steps)}"


@_query("I1_solve_terms", _terms_sql())
def i1(spark, d):
    t = dsp.solve_terms(_standards(spark, d))
    return t.select("channel", "k", "ok", *(micro(F.col(f"{x}.{p}")).alias(f"{x}_{p}") for x in "DTS" for p in ("re", "im")))


@_query("I2_calibration_round_trip", f"WITH {P.SAMPLES_SQL} SELECT channel, k, trace_id, true AS exact FROM s WHERE trace_id < 3")
def i2(spark, d):
    """Standards corrected by the terms solved from them are the ideal standards again."""
    st = _standards(spark, d)
    s = P.samples(spark, d).where("trace_id < 3")
    got = dsp.flat(dsp.apply_terms(s, dsp.solve_terms(st)))
    ideal = F.element_at(F.array(*(C.cx(F.lit(x), F.lit(y)) for x, y in ((1.0, 0.1), (-1.0, 0.1), (0.0, 0.02)))), (F.col("trace_id") + 1).cast("int"))
    return got.select("channel", "k", "trace_id", (C.magnitude(C.sub(F.struct("re", "im"), ideal)) < 1e-6).alias("exact"))


#: By cross ratios, without the terms: the corrected y is to the ideal standards as the sample is to the measured ones.
_APPLY_SQL = f"""WITH {P.SAMPLES_SQL}, x AS (SELECT s.*, s.re - o.re AS ar, s.im - o.im AS ai, h.re - l.re AS br, h.im - l.im AS bi, s.re - l.re AS cr, s.im - l.im AS ci, h.re - o.re AS er, h.im - o.im AS ei
FROM s JOIN s o ON o.trace_id = 0 AND o.channel = s.channel AND o.k = s.k JOIN s h ON h.trace_id = 1 AND h.channel = s.channel AND h.k = s.k JOIN s l ON l.trace_id = 2 AND l.channel = s.channel AND l.k = s.k),
p AS (SELECT *, -2 * (ar * br - ai * bi) AS nr, -2 * (ar * bi + ai * br) AS ni, cr * er - ci * ei AS pr, cr * ei + ci * er AS pi FROM x),
d AS (SELECT *, -pr - 0.08 * pi AS dr, 0.08 * pr - pi AS di FROM p),
u AS (SELECT *, dr - 0.1 * di + 0.02 * ni AS ur, di + 0.1 * dr - 0.02 * nr AS ui, dr - nr AS vr, di - ni AS vi FROM d), q AS (SELECT *, vr * vr + vi * vi AS q FROM u)
SELECT trace_id, channel, k, {_m('(ur * vr + ui * vi) / q')} AS re, {_m('(ui * vr - ur * vi) / q')} AS im FROM q"""


@_query("I2_apply_terms", _APPLY_SQL)
def i2_apply(spark, d):
    """All samples corrected by the terms of the three standards."""
    got = dsp.apply_terms(P.samples(spark, d), dsp.solve_terms(_standards(spark, d)))
    return dsp.flat(got).select("trace_id", "channel", "k", micro(F.col("re")).alias("re"), micro(F.col("im")).alias("im"))


@_query("I3_background", f"WITH {P.SAMPLES_SQL}, r AS (SELECT channel, k, avg(re) AS a, avg(im) AS b FROM s GROUP BY 1, 2) SELECT trace_id, channel, k, {_m('re - a')} AS re, {_m('im - b')} AS im FROM s JOIN r USING (channel, k)")
def i3(spark, d):
    s = P.samples(spark, d)
    return dsp.flat(dsp.subtract_background(s, dsp.coherent_mean(s))).select("trace_id", "channel", "k", micro(F.col("re")).alias("re"), micro(F.col("im")).alias("im"))


_WEIGHT = "CASE WHEN f < 5e8 OR f > 25e8 THEN 0 WHEN f < 1e9 THEN pow(sin(pi() / 2 * (f - 5e8) / 5e8), 2) WHEN f <= 15e8 THEN 1 ELSE pow(sin(pi() / 2 * (25e8 - f) / 1e9), 2) END"
_EDGES = (0.5e9, 1.0e9, 1.5e9, 2.5e9)


@_query("I4_bandpass", f"WITH {P.SAMPLES_SQL}, f AS (SELECT *, 520000000 + k * 1e8 AS f FROM s) SELECT trace_id, channel, k, {_m(f're * ({_WEIGHT})')} AS re, {_m(f'im * ({_WEIGHT})')} AS im FROM f")
def i4(spark, d):
    return dsp.flat(dsp.bandpass(P.samples(spark, d), P.F0, P.DF, _EDGES, P.POINTS)).select("trace_id", "channel", "k", micro(F.col("re")).alias("re"), micro(F.col("im")).alias("im"))


def _dft(source: str, n: int) -> str:
    """The inverse transform as a sum: bins from the first one on, and the ramp of the offset."""
    return f"""t AS (SELECT unnest(range({n})) AS j), e AS (SELECT trace_id, channel, j, sum(re * cos(2 * pi() * (k + 5) * j / {n}) - im * sin(2 * pi() * (k + 5) * j / {n})) / {n} AS re, sum(re * sin(2 * pi() * (k + 5) * j / {n}) + im * cos(2 * pi() * (k + 5) * j / {n})) / {n} AS im FROM {source}, t GROUP BY 1, 2, 3),
y AS (SELECT trace_id, channel, j AS k, re * cos(2 * pi() * 2e7 * j / ({n} * 1e8)) - im * sin(2 * pi() * 2e7 * j / ({n} * 1e8)) AS re, re * sin(2 * pi() * 2e7 * j / ({n} * 1e8)) + im * cos(2 * pi() * 2e7 * j / ({n} * 1e8)) AS im FROM e)"""


@_query("I5_ifft", f"WITH {P.SAMPLES_SQL}, {_dft('s', 64)} SELECT trace_id, channel, k, {_m('re')} AS re, {_m('im')} AS im FROM y")
def i5(spark, d):
    return dsp.flat(dsp.ifft(P.samples(spark, d), P.F0, P.DF, 2)).select("trace_id", "channel", "k", micro(F.col("re")).alias("re"), micro(F.col("im")).alias("im"))


@_query("B1_time_crop", f"WITH {P.SAMPLES_SQL}, {_dft('s', 64)} SELECT trace_id, channel, k - 7 AS k, {_m('re')} AS re FROM y WHERE k / (64 * 1e8) >= 1e-9 AND k / (64 * 1e8) <= 4e-9")
def b1(spark, d):
    x = dsp.ifft(P.samples(spark, d), P.F0, P.DF, 2)
    return dsp.flat(dsp.time_crop(x, 1 / (64 * P.DF), 1e-9, 4e-9, 64)).select("trace_id", "channel", "k", micro(F.col("re")).alias("re"))


def _chain_sql() -> str:
    """All stages one after the other: terms, correction, background, weights, transform as a sum, and the means over time and traces as windows."""
    terms, last = _terms_sql().split(" SELECT channel, k, true AS ok")[0], _terms_sql().rsplit("FROM ", 1)[1]
    both = lambda f: ", ".join(f"{f(x)} AS {x}" for x in ("re", "im"))
    mirror = "CASE WHEN g < 0 THEN -g WHEN g > 511 THEN 1022 - g ELSE g END"
    edge = lambda x: f"({x}_s + greatest(0, 50 - n) * {x}_f + greatest(0, n + 50 - t + 1) * {x}_l) / 101"
    return f"""{terms}, x AS (SELECT s.trace_id, channel, k, s.re - Dr AS xr, s.im - Di AS xi, Tr, Ti, Sr, Si FROM s JOIN {last} USING (channel, k)),
q AS (SELECT *, Tr + Sr * xr - Si * xi AS qr, Ti + Sr * xi + Si * xr AS qi FROM x), cal AS (SELECT trace_id, channel, k, (xr * qr + xi * qi) / (qr * qr + qi * qi) AS re, (xi * qr - xr * qi) / (qr * qr + qi * qi) AS im FROM q),
bg AS (SELECT channel, k, avg(re) AS a, avg(im) AS b FROM cal GROUP BY 1, 2), less AS (SELECT trace_id, channel, k, re - a AS re, im - b AS im, 520000000 + k * 1e8 AS f FROM cal JOIN bg USING (channel, k)),
band AS (SELECT trace_id, channel, k, re * ({_WEIGHT}) AS re, im * ({_WEIGHT}) AS im FROM less), {_dft("band", 512)},
wide AS (SELECT trace_id, channel, g, {both(lambda x: x)} FROM (SELECT unnest(range(-102, 614)) AS g) JOIN y ON y.k = {mirror}),
mean AS (SELECT trace_id, channel, g AS k, {both(lambda x: f"{x} - avg({x}) OVER w")} FROM wide WINDOW w AS (PARTITION BY trace_id, channel ORDER BY g ROWS BETWEEN 102 PRECEDING AND 102 FOLLOWING)),
dew AS (SELECT * FROM mean WHERE k BETWEEN 0 AND 511),
n AS (SELECT *, row_number() OVER (PARTITION BY channel, k ORDER BY trace_id) - 1 AS n, count(*) OVER (PARTITION BY channel, k) AS t, {", ".join(f"sum({x}) OVER w AS {x}_s, first({x}) OVER a AS {x}_f, last({x}) OVER a AS {x}_l" for x in ("re", "im"))} FROM dew
  WINDOW w AS (PARTITION BY channel, k ORDER BY trace_id ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING), a AS (PARTITION BY channel, k ORDER BY trace_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
flat AS (SELECT trace_id, channel, {both(lambda x: f"{x} - {edge(x)}")} FROM n)
SELECT trace_id, channel, count(*) AS samples, CAST(round(1000 * log10(sum(re * re + im * im))) AS BIGINT) AS millibels FROM flat GROUP BY 1, 2"""


@_query("I8_chain", _chain_sql())
def i8(spark, d):
    """The whole chain with calibration, background (of calibrated samples), band-pass, transform, dewow and flat reflection: each trace's energy."""
    s, terms = P.samples(spark, d), dsp.solve_terms(_standards(spark, d))
    p = chain.Profile(P.F0, P.DF, P.POINTS, _EDGES, 16, dewow_s=4e-9, traces=101)
    rows = chain.process(s, p, terms=terms, background=dsp.coherent_mean(dsp.apply_terms(s, terms))).rows
    energy = F.aggregate("values", F.lit(0.0), lambda a, v: a + v["re"] * v["re"] + v["im"] * v["im"])
    return rows.select("trace_id", "channel", F.size("values").cast("long").alias("samples"), F.round(1000 * F.log10(energy)).cast("long").alias("millibels"))


# ---- streams


@_query("J1_packets", "SELECT user_id AS stream, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS n, CAST(1 + event_id % 5 AS INT) AS kind, lower(hex(encode(event_type))) AS payload FROM events WHERE event_id % 20 <> 0")
def j1(spark, d):
    """A stream of packets for each user, between noise, each cut in two chunks; every twentieth has a broken checksum."""
    e = P.table(spark, d, "events").select("event_id", "user_id", "event_type")
    body = F.concat(F.unhex(F.lit("5A")), F.unhex(F.lpad(F.hex((F.length("event_type") + 8).cast("long")), 2, "0")), F.unhex(F.lit("00")), F.unhex(F.lpad(F.hex((F.col("event_id") % 5 + 1).cast("long")), 2, "0")), F.col("event_type").cast("binary"))
    crc = F.lpad(F.hex(F.crc32("b") + F.when(F.col("event_id") % 20 == 0, 1).otherwise(0)), 8, "0")
    flip = F.concat(*(F.substring("c", i, 2) for i in (7, 5, 3, 1)))
    rows = e.withColumn("b", body).withColumn("c", crc).withColumn("p", F.concat(F.unhex(F.lit("00FF")), F.col("b"), F.unhex(flip)))
    half = rows.select(F.col("user_id").alias("stream"), F.explode(F.array(F.struct((F.col("event_id") * 2).alias("seq"), F.expr("substring(p, 1, 7)").alias("data")), F.struct((F.col("event_id") * 2 + 1).alias("seq"), F.expr("substring(p, 8, 100)").alias("data")))).alias("x")).select("stream", "x.seq", "x.data")
    return frames.packets(half).select("stream", F.col("n").cast("int").alias("n"), "kind", F.lower(F.hex("payload")).alias("payload"))


_POINTS = "p AS (SELECT user_id AS stream, event_id AS n, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % 7 + CASE WHEN event_id % 31 = 0 THEN 1 ELSE 0 END AS point FROM events)"


@_query("J4_sweeps", f"WITH {_POINTS}, s AS (SELECT *, sum(CASE WHEN point = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY n) AS sweep FROM p), q AS (SELECT *, row_number() OVER (PARTITION BY stream, sweep ORDER BY n) - 1 AS at FROM s WHERE sweep > 0) SELECT stream, CAST(sweep AS BIGINT) AS sweep, min(n) AS first_n, count(*) AS points, count(*) >= 5 AND count(*) FILTER (at < 5 AND point <> at) = 0 AS complete FROM q GROUP BY 1, 2")
def j4(spark, d):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    p = P.table(spark, d, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("n"), (n % 7 + F.when(F.col("event_id") % 31 == 0, 1).otherwise(0)).alias("point"))
    return frames.sweeps(p, 5)


@_query("J7_health", """WITH e AS (SELECT user_id AS stream, epoch_us(ts) * 1000 AS at, event_id AS seq, CASE event_type WHEN 'signup' THEN 'connect' WHEN 'purchase' THEN 'valid' WHEN 'error' THEN 'invalid' WHEN 'view' THEN 'sentence' ELSE 'tick' END AS kind FROM events),
l AS (SELECT *, sum(CASE WHEN kind = 'connect' THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY at, seq) AS link FROM e),
f AS (SELECT *, max(CASE WHEN kind = 'valid' THEN at END) OVER w AS fix, last(CASE WHEN kind IN ('invalid', 'valid', 'sentence') THEN kind = 'invalid' END IGNORE NULLS) OVER w AS bad, max(CASE WHEN kind IN ('invalid', 'valid', 'sentence') THEN 1 ELSE 0 END) OVER w AS seen FROM l WHERE link > 0 WINDOW w AS (PARTITION BY stream, link ORDER BY at, seq))
SELECT stream, seq, CASE WHEN fix IS NOT NULL THEN CASE WHEN at - fix > CAST(36000 AS BIGINT) * 1000000000 THEN 'stale' ELSE 'valid' END WHEN bad THEN 'invalid' WHEN seen = 1 THEN 'no_fix' ELSE 'no_sentence' END AS state FROM f""")
def j7(spark, d):
    k = F.element_at(F.create_map(*(F.lit(x) for kv in (("signup", "connect"), ("purchase", "valid"), ("error", "invalid"), ("view", "sentence"), ("click", "tick")) for x in kv)), F.col("event_type"))
    e = P._events(spark, d).select(F.col("user_id").alias("stream"), "at", F.col("event_id").alias("seq"), k.alias("kind"))
    return frames.health(e, 36000 * _NS).select("stream", "seq", "state")


@_query("J14_capture_steps", "WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events) SELECT event_id, user_id, n // 5 AS step FROM r WHERE n // 5 < 6")
def j14(spark, d):
    return capture.reference_session(P.table(spark, d, "events").select("event_id", "user_id"), session="user_id", order="event_id", per_step=5)


@_query("J14_session_state", "WITH g AS (SELECT user_id, least(count(*), 30) AS n FROM events GROUP BY 1) SELECT user_id, n // 5 AS step, n % 5 AS captured, n = 30 AS complete FROM g")
def j14_state(spark, d):
    return capture.session_state(P.table(spark, d, "events"), session="user_id", order="event_id", per_step=5)


@_query("J16_publishable", "SELECT o_orderkey, o_custkey FROM orders JOIN (SELECT o_custkey, max(o_orderkey % 3) AS m FROM orders GROUP BY 1) USING (o_custkey) WHERE o_orderkey % 3 = m")
def j16(spark, d):
    o = P.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("dataset_id"), (F.col("o_orderkey") % 3).alias("revision"))
    return provenance.publishable(o, o).select("o_orderkey", F.col("dataset_id").alias("o_custkey"))


@_query("L9_metadata_upsert", "SELECT c_custkey AS trace_id, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 4 = 0 THEN 'new' END ELSE 'old' END AS hash, c_custkey % 3 <> 0 AND c_custkey % 4 = 0 AS refused FROM customer")
def l9(spark, d):
    c = P.table(spark, d, "customer")
    stored = c.select(F.col("c_custkey").alias("trace_id"), F.when(F.col("c_custkey") % 3 != 0, "old").alias("hash"), F.col("c_name").alias("fact"))
    new = c.where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("trace_id"), F.lit("new").alias("hash"), F.col("c_name").alias("fact"))
    return provenance.metadata_upsert(stored, new).select("trace_id", "hash", "refused")


# ---- more of the inventory


@_query("A10_legacy_union", "SELECT event_id AS trace_index, user_id AS generation, 2 AS version FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, NULL, 1 FROM events WHERE event_type = 'view'")
def a10(spark, d):
    """A legacy table lacks columns; they stay missing."""
    e = P.table(spark, d, "events")
    new = e.where("event_type = 'click'").select(F.col("event_id").alias("trace_index"), F.col("user_id").alias("generation"), F.lit(2).alias("version"))
    return views.with_legacy(new, e.where("event_type = 'view'").select(F.col("event_id").alias("trace_index")))


@_query("A16_partial_inspection", f"WITH {_AIR}, {P.MISSIONS_SQL} SELECT a.mission_id, count(*) AS stored, count(*) FILTER (record_position >= committed_record_count) AS tail_rows, max(record_position) AS last, max(record_position) + 1 - count(DISTINCT record_position) AS missing_positions FROM air a JOIN missions USING (mission_id) GROUP BY 1")
def a16(spark, d):
    return sinks.inspect_partial(P.side(spark, d, "air"), P.missions(spark, d))


@_query("A21_replay_gate", """WITH t AS (SELECT n_name AS mission_id, s_suppkey AS i, s_nationkey % 7 AS kind FROM supplier JOIN nation ON n_nationkey = s_nationkey), g AS (SELECT mission_id, min(kind) AS kind FROM t WHERE kind <> 6 GROUP BY 1)
SELECT n_name AS mission_id, CASE kind WHEN 1 THEN 'conflicts' WHEN 2 THEN 'hashes' WHEN 3 THEN 'hashes' WHEN 4 THEN 'conflicts' ELSE 'no rows' END AS reason FROM nation LEFT JOIN g ON mission_id = n_name WHERE kind IS NULL OR kind IN (1, 2, 3, 4)""")
def a21(spark, d):
    """A mission for each nation, of its suppliers: some have none, or rows that contradict each other, wrong hashes or none at all."""
    s = P.table(spark, d, "supplier").join(P.table(spark, d, "nation").select("n_name", F.col("n_nationkey").alias("s_nationkey")), "s_nationkey")
    kind = F.col("s_nationkey") % 7
    t = s.select(F.col("n_name").alias("mission_id"), F.col("s_suppkey").cast("long").alias("trace_index"), F.col("s_name").alias("raw"), F.sha2("s_name", 256).alias("right"), kind.alias("kind")).where("kind <> 6")
    copies = F.when(F.col("kind") == 1, F.array(F.lit(""), F.lit("other"))).when(F.col("kind") == 4, F.array(F.lit(""), F.lit("another"))).otherwise(F.array(F.lit("")))
    t = t.select("*", F.posexplode(copies).alias("copy", "mark")).withColumn("raw", F.concat("raw", "mark"))
    t = t.withColumn("hash", F.when(F.col("kind") == 2, F.reverse("right")).when(F.col("kind") != 3, F.sha2("raw", 256))).withColumns({"trace_uid": F.concat_ws("-", "mission_id", "trace_index"), "record_position": F.col("trace_index") * 2 + F.col("copy")})
    return constraints.replay_refusals(t, P.table(spark, d, "nation").select(F.col("n_name").alias("mission_id")), F.sha2("raw", 256))


@_query("B2_filter_kind", f"WITH {_RECONCILE} SELECT mission_id, trace_index FROM items WHERE kind = 'gnss_diff'")
def b2(spark, d):
    return reconcile.reconcile(P.side(spark, d, "air"), P.side(spark, d, "ground")).where("kind = 'gnss_diff'").select("mission_id", "trace_index")


@_query("B7_trace_constraints", "WITH t AS (SELECT o_orderkey AS k, o_orderkey % 7 = 0 AS utc, o_orderkey % 11 = 0 AS mono, o_orderkey % 13 = 0 AS iv, o_orderkey % 17 = 0 AS rs, o_orderkey % 19 = 0 AS hs FROM orders) SELECT k AS trace_index, 'utc_order' AS rule FROM t WHERE utc UNION ALL SELECT k, 'mono_order' FROM t WHERE mono UNION ALL SELECT k, 'interval' FROM t WHERE iv AND k <> 0 UNION ALL SELECT k, 'reasons' FROM t WHERE rs UNION ALL SELECT k, 'hash' FROM t WHERE hs")
def b7(spark, d):
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    off = lambda m: k % m == 0
    t = P.table(spark, d, "orders").select(
        k.alias("trace_index"), at.alias("started_utc"), F.when(off(7), at - F.expr("interval 1 second")).otherwise(at).alias("midpoint_utc"), at.alias("finished_utc"),
        k.alias("started_mono_ns"), (k + 1).alias("midpoint_mono_ns"), F.when(off(11), k).otherwise(k + 2).alias("finished_mono_ns"), F.when(~off(13), 1.0).alias("actual_interval_s"),
        F.lit("nominal").alias("quality_status"), F.when(off(17), F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("quality_reasons"), F.when(off(19), "zz").otherwise(F.sha2(k.cast("string"), 256)).alias("hash"),
    )
    return constraints.violations(t, ["trace_index"], constraints.trace_rules())


@_query("B8_fix_constraints", "WITH f AS (SELECT event_id, (event_id % 200) - 95.0 AS la, (event_id % 400) - 195.0 AS lo, event_type <> 'error' AS v FROM events) SELECT event_id, 'latitude' AS rule FROM f WHERE la NOT BETWEEN -90 AND 90 UNION ALL SELECT event_id, 'longitude' FROM f WHERE lo NOT BETWEEN -180 AND 180 UNION ALL SELECT event_id, 'valid_has_position' FROM f WHERE NOT v")
def b8(spark, d):
    i = F.col("event_id")
    f = P.table(spark, d, "events").select(i, (i % 200 - 95.0).alias("latitude"), (i % 400 - 195.0).alias("longitude"), F.lit(1.0).alias("hdop"), F.lit(5).alias("satellites"), (F.col("event_type") != "error").alias("valid"), F.when(F.col("event_type") == "error", "no_fix").alias("invalid_reason"))
    return constraints.violations(f, ["event_id"], constraints.fix_rules())


@_query("B11_axis_gate", f"WITH a AS (SELECT vec_id, {_AXIS} AS x FROM embeddings) SELECT vec_id FROM a WHERE list_max(list_transform(range(16), lambda i: abs(x[i + 1] - (520000000 + i * 1e8)))) <= 60")
def b11(spark, d):
    planned = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (F.lit(520000000) + i * 100000000).cast("double"))
    return constraints.axis_gate(_axes(spark, d).withColumn("planned", planned), "planned", "axis", 60.0).select("vec_id")


@_query("C8_visible_traces", f"WITH {_AIR}, {_AIRX} SELECT mission_id, trace_index, record_position FROM air ANTI JOIN air_x USING (mission_id, trace_index)")
def c8(spark, d):
    a = P.side(spark, d, "air")
    return a.join(views.excluded_indices(a), ["mission_id", "trace_index"], "left_anti").select("mission_id", "trace_index", "record_position")


@_query("C12_field_list", "SELECT a.c_custkey, array_to_string(list_filter([CASE WHEN a.c_name <> b.c_name THEN 'name' END, CASE WHEN a.c_mktsegment IS DISTINCT FROM b.c_mktsegment THEN 'segment' END], lambda x: x IS NOT NULL), ', ') AS fields FROM customer a JOIN (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE c_name END AS c_name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer) b USING (c_custkey)")
def c12(spark, d):
    c = P.table(spark, d, "customer")
    other = {"name": F.when(F.col("c_custkey") % 3 == 0, "x").otherwise(F.col("c_name")), "segment": F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment"))}
    return c.select("c_custkey", reconcile.diff_fields({"name": F.col("c_name"), "segment": F.col("c_mktsegment")}, other).alias("fields"))


@_query("D9_reader_counters", f"WITH {_LINES}, r AS (SELECT event_id % 10 AS reader, i % 17 = 0 AND ck <> 0 AS bad FROM c) SELECT reader, count(*) AS lines, count(*) FILTER (bad) AS bad_checksum FROM r GROUP BY 1")
def d9(spark, d):
    p = nmea.parse(_lines(spark, d)).withColumn("reader", F.col("event_id") % 10)
    return p.groupBy("reader").agg(F.count("*").alias("lines"), F.count_if(F.col("reason") == "bad_checksum").alias("bad_checksum"))


@_query("D10_config_facts", f"WITH a AS (SELECT vec_id, {_AXIS} AS x FROM embeddings) SELECT vec_id, (x[16] - x[1]) / 15 AS step, {_m('1e9 / ((x[16] - x[1]) / 15)')} AS period_ns, x[16] - x[1] AS bandwidth FROM a")
def d10(spark, d):
    f = constraints.config_facts(_axes(spark, d), "axis")
    return f.select("vec_id", "step", micro(F.col("period") * 1e9).alias("period_ns"), "bandwidth")


@_query("D11_step_facts", f"WITH {_STEPS} SELECT vec_id, md AS step, er AS worst FROM m")
def d11(spark, d):
    step, worst = S.step_error(F.col("axis"))
    return _axes(spark, d).select("vec_id", step.alias("step"), worst.alias("worst"))


@_query("E8_first_of_duplicates", f"WITH {_GROUND} SELECT mission_id, trace_index, min(record_position) AS record_position FROM ground GROUP BY 1, 2")
def e8(spark, d):
    return views.first_of_duplicates(P.side(spark, d, "ground")).select("mission_id", "trace_index", "record_position")


@_query("F5_argmin", "SELECT l_suppkey, arg_min({'o': l_orderkey, 'l': l_linenumber}, {'d': abs(l_quantity - 25), 'o': l_orderkey, 'l': l_linenumber}).o AS l_orderkey FROM lineitem GROUP BY 1")
def f5(spark, d):
    li = P.table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    return match.nearest(li, "l_suppkey", F.abs(F.col("l_quantity") - 25), ["l_orderkey", "l_linenumber"]).select("l_suppkey", "l_orderkey")


@_query("G9_manifest", "SELECT page_id, sha256(html) AS digest, strlen(html) AS bytes FROM pages")
def g9(spark, d):
    return sinks.manifest(P.table(spark, d, "pages"), "page_id", "html")


@_query("H7_combine_utc", "WITH x AS (SELECT event_id, CAST(date '2024-02-28' + CAST(event_id % 3 AS INT) AS DATE) AS dt, (event_id * 977) % 86400 AS r, (event_id * 4099) % 86400 AS g FROM events) SELECT event_id, epoch_us(dt + INTERVAL 1 DAY * CASE WHEN g - r < -43200 THEN 1 WHEN g - r > 43200 THEN -1 ELSE 0 END) + g * 1000000 AS us FROM x")
def h7(spark, d):
    i = F.col("event_id")
    day = F.date_add(F.lit("2024-02-28").cast("date"), (i % 3).cast("int"))
    return P.table(spark, d, "events").select(i, F.unix_micros(nmea.combine_utc(day, ((i * 977) % 86400).cast("double"), ((i * 4099) % 86400).cast("double"))).alias("us"))


_ODD_JSON = {5: "left(props, length(props) - 1)", 7: "'{\"a\": 1, \"b\": {\"k\": 1, \"k\": ' || props || '}}'", 11: "'{\"a\": NaN, \"b\": ' || props || '}'", 13: "'[' || props || ', \"k\", null]'"}
_JSON_CASE = "CASE " + " ".join(f"WHEN event_id % {n} = 0 THEN {t}" for n, t in _ODD_JSON.items()) + " ELSE props END"


@_query("H13_json", f"SELECT event_id, CASE WHEN event_id % 5 <> 0 AND event_id % 7 = 0 THEN false WHEN event_id % 5 <> 0 AND event_id % 11 = 0 THEN false ELSE json_valid(p) END AS valid FROM (SELECT event_id, {_JSON_CASE} AS p FROM events)")
def h13(spark, d):
    """Cut short, with a repeated key inside, with NaN, and valid texts."""
    return P.table(spark, d, "events").select("event_id", codecs.strict_json(F.expr(_JSON_CASE)).alias("valid"))


@_query("H22_midpoint", f"WITH {P.EVENTS_SQL} SELECT sweep_id, (started_ns + finished_ns) // 2 AS mid FROM sweeps")
def h22(spark, d):
    return P.sweeps(spark, d).select("sweep_id", S.midpoint(F.col("started_ns"), F.col("finished_ns")).alias("mid"))


@_query("J2_datapoints", "SELECT vec_id AS stream, 0 AS n, label AS point, 1000000 + vec_id AS frequency, label <> 9 AS whole, " + _m("embedding[1]") + " AS re, " + _m("embedding[2]") + " AS im FROM embeddings WHERE vec_id % 9 <> 0")
def j2(spark, d):
    """Payloads of one receiver made of ``embeddings``; label 9 has two; every ninth is cut short, and malformed ones are dropped."""
    import struct

    import pandas as pd

    def make(batches):
        for b in batches:
            p = [struct.pack("<QhH", 1_000_000 + i, 0, q) + (struct.pack("<ffffBB", e[0], e[2], e[1], e[3], 33, 34) if q == 9 else struct.pack("<ffB", e[0], e[1], 33)) for i, q, e in zip(b["vec_id"], b["label"], b["embedding"], strict=True)]
            yield pd.DataFrame({"stream": b["vec_id"], "n": 0, "payload": [x[:-1] if i % 9 == 0 else x for i, x in zip(b["vec_id"], p, strict=True)]})

    rows = P.table(spark, d, "embeddings").mapInPandas(make, "stream long, n long, payload binary")
    got = frames.datapoints(rows).where("not malformed")
    r = F.get("receivers", F.lit(0))
    return got.select("stream", F.col("n").cast("int").alias("n"), "point", "frequency", (F.size("receivers") == 1).alias("whole"), micro(r["re"].cast("double")).alias("re"), micro(r["im"].cast("double")).alias("im"))


@_query("J3_packet_counters", "SELECT user_id AS stream, count(*) AS packets, count(*) FILTER (event_id % 5 <> 0) AS ignored, count(*) FILTER (event_id % 5 = 0 AND event_id % 3 <> 0) AS malformed FROM events GROUP BY 1")
def j3(spark, d):
    """Every fifth packet is a datapoint, a third of them of the right length."""
    i = F.col("event_id")
    rows = P.table(spark, d, "events").select(F.col("user_id").alias("stream"), F.when(i % 5 == 0, frames.DATAPOINT).otherwise(3).alias("kind"), F.repeat(F.lit("x"), (F.lit(21) + i % 3).cast("int")).cast("binary").alias("payload"))
    return frames.packet_counters(rows)


@_query("J15_background_capture", f"WITH {P.SAMPLES_SQL} SELECT channel, k, {_m('avg(re)')} AS re, {_m('avg(im)')} AS im, count(*) AS captures FROM s WHERE trace_id < 12 GROUP BY 1, 2")
def j15(spark, d):
    """The reference is the mean of the first twelve captures."""
    return capture.background_session(P.samples(spark, d), 12).select("channel", "k", micro(F.col("re")).alias("re"), micro(F.col("im")).alias("im"), "captures")


@_query("A18_envelope_digest", "SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN sha256(text) END AS payload, CASE WHEN text IS NOT NULL THEN doc_id % 10 <> 0 END AS intact FROM documents")
def a18(spark, d):
    """A stored payload is used only if the digest recomputed from it holds; every tenth envelope was changed after it was sealed."""
    sealed = codecs.seal(F.col("text"))
    sealed = F.when(F.col("doc_id") % 10 == 0, F.regexp_replace(sealed, r'^\{"payload":"', '{"payload":"!')).otherwise(sealed)
    t = P.table(spark, d, "documents").select("doc_id", codecs.unseal(sealed).alias("e"))
    return t.select("doc_id", F.sha2("e.payload", 256).alias("payload"), F.col("e.intact").alias("intact"))


@_query("A24_snapshot_codec", f"WITH {P.SAMPLES_SQL} SELECT trace_id, channel, k, re, im FROM s WHERE trace_id % 7 <> 0")
def a24(spark, d):
    """Samples through the text of a snapshot and back; every seventh text claims a wrong shape and gives nothing."""
    text = codecs.pack_complex(F.col("values"))
    text = F.when(F.col("trace_id") % 7 == 0, F.replace(text, F.lit("[16]"), F.lit("[15]"))).otherwise(text)
    x = P.samples(spark, d).select("trace_id", "channel", codecs.unpack_complex(text).alias("values")).where("values is not null")
    return dsp.flat(x).select("trace_id", "channel", "k", "re", "im")


@_query("B14_version_window", "SELECT p_partkey, p_size % 2 = 1 AND p_size BETWEEN 10 AND 20 AS supported FROM part")
def b14(spark, d):
    return P.table(spark, d, "part").select("p_partkey", constraints.supported_version(F.col("p_size") % 2, F.col("p_size"), own=1, least=10, most=20).alias("supported"))


@_query("B15_capabilities", "SELECT p_partkey, 'points' AS rule FROM part WHERE p_size NOT BETWEEN 2 AND 45 UNION ALL SELECT p_partkey, 'power' FROM part WHERE p_retailprice > 1500")
def b15(spark, d):
    return constraints.violations(P.table(spark, d, "part"), ["p_partkey"], {"points": F.col("p_size").between(2, 45), "power": F.col("p_retailprice") <= 1500})


@_query("F3_fix_order", f"WITH {P.EVENTS_SQL} SELECT domain, fix_id, row_number() OVER (PARTITION BY domain ORDER BY received_ns, seq) AS place FROM fixes")
def f3(spark, d):
    """Places follow the order in which the sorted table comes out, whatever that is."""
    out = match.snapshot(P.fixes(spark, d)).withColumn("_out", F.monotonically_increasing_id())
    return out.select("domain", "fix_id", F.row_number().over(Window.partitionBy("domain").orderBy("_out")).alias("place"))


@_query("H8_rmc", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE " + _m("(event_id % 50 + 0.5) * 1852.0 / 3600.0") + " END AS speed, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(make_date(CAST(CASE WHEN event_id % 100 >= 80 THEN 1900 ELSE 2000 END + event_id % 100 AS INT), CAST(event_id % 12 + 1 AS INT), CAST(event_id % 28 + 1 AS INT)) AS VARCHAR) END AS day FROM events")
def h8(spark, d):
    """RMC sentences: knots to metres a second, the century of the date; status V has neither."""
    i = F.col("event_id")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    body = F.concat_ws(",", F.lit("GNRMC"), F.lit("120000"), F.when(i % 4 == 0, "V").otherwise("A"), F.lit("4807.038"), F.lit("N"), F.lit("01131.000"), F.lit("E"), F.concat((i % 50).cast("string"), F.lit(".5")), F.lit("84.4"), F.concat(two(i % 28 + 1), two(i % 12 + 1), two(i % 100)), F.lit(""), F.lit(""))
    e = P.table(spark, d, "events").select("event_id", F.concat(F.lit("$"), body, F.lit("*"), nmea.checksum(body)).alias("line"))
    return nmea.parse(e).select("event_id", micro(F.col("speed_mps")).alias("speed"), F.col("date").cast("string").alias("day"))


@_query("J6_lines", "SELECT user_id AS stream, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS n, event_type AS line FROM events WHERE event_id % 6 <> 0")
def j6(spark, d):
    """A stream of lines for each user, each in two chunks; every sixth line is too long and dropped, and so are empty lines after every fourth."""
    e = P.table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 6 == 0, F.rpad("event_type", 300, "x")).otherwise(F.col("event_type")).alias("t"))
    c = e.select(F.col("user_id").alias("stream"), F.explode(F.array(F.struct((F.col("event_id") * 2 + 1).alias("seq"), F.concat(F.expr("substring(t, 4)"), F.when(F.col("event_id") % 4 == 0, "\r\n\r\n\n").otherwise("\r\n")).alias("text")), F.struct((F.col("event_id") * 2).alias("seq"), F.substring("t", 1, 3).alias("text")))).alias("x")).select("stream", "x.seq", "x.text")
    return ingest.lines(c).select("stream", F.col("n").cast("int").alias("n"), "line")


@_query("J13_bound_decode", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'unknown_mission' WHEN o_orderkey % 41 = 0 THEN 'channels' WHEN o_orderkey % 37 = 0 THEN 'axis' WHEN o_orderkey % 43 = 0 THEN 'hash' ELSE 'accepted' END AS verdict FROM orders")
def j13(spark, d):
    """A trace is accepted if its mission is known, its channels and axis are the mission's, and its recomputed digest is the one it carries."""
    i, v = F.col("o_orderkey"), F.col("o_totalprice").cast("double")
    digest = lambda value: S.raw_trace_sha256("TRACELAKE-RAW", F.col("mission_id"), i.cast("string"), i, F.col("channels"), F.size("axis"), codecs.le_doubles(F.col("axis")), codecs.le_complex(F.array(C.cx(value, -value))))
    rows = P.table(spark, d, "orders").select(F.col("o_orderstatus").alias("mission_id"), i, v.alias("v"), F.array(F.when(i % 41 == 0, "s2").otherwise("s1")).alias("channels"), F.array(F.when(i % 37 == 0, 2.0).otherwise(1.0)).alias("axis"))
    sent = rows.withColumn("hash", digest(F.col("v") + F.when(i % 43 == 0, 1).otherwise(0)))
    known = spark.createDataFrame([(m, ["s1"], [1.0]) for m in "OF"], "mission_id string, channels array<string>, axis array<double>")
    return protocol.bound_decode(sent, known, digest(F.col("v"))).select("o_orderkey", "verdict")


@_query("L6_safe_reuse", f"""WITH w AS ({_SET_SQL}), l AS (SELECT DISTINCT l_orderkey AS id, l_linenumber AS n FROM lineitem), o AS (SELECT o_orderkey AS id, o_orderstatus AS st FROM orders),
m AS (SELECT id, list('positions[' || CAST(n AS VARCHAR) || '].' || CASE WHEN n = 1 AND id % 9 = 0 THEN 'content_sha256' ELSE 'not_recorded' END ORDER BY 'positions[' || CAST(n AS VARCHAR) || '].') AS m FROM l WHERE (n = 1 AND id % 9 = 0) OR (n = 2 AND id % 11 = 0) GROUP BY 1)
SELECT o.id AS dataset_id, x = '' AS reusable, x AS mismatches FROM o JOIN (SELECT o.id, CASE WHEN o.st = 'F' THEN 'not_calibrated' WHEN w.dataset_id IS NULL OR o.id % 13 = 0 OR (o.id % 11 = 0 AND o.id NOT IN (SELECT id FROM l WHERE n <> 2)) THEN 'no_provenance' ELSE concat_ws(',', array_to_string(m.m, ','), CASE WHEN o.id % 10 = 0 THEN 'set_sha256' END) END AS x FROM o LEFT JOIN w ON w.dataset_id = o.id LEFT JOIN m ON m.id = o.id) y ON y.id = o.id""".replace("concat_ws(',', array_to_string(m.m, ','), CASE", "concat_ws(',', nullif(array_to_string(m.m, ','), ''), CASE"))
def l6(spark, d):
    """Orders as data sets: some not calibrated, without a list, with another digest at a position, a position or the digest of the set missing."""
    want = _profiles(spark, d, F.lit(0))
    have = _profiles(spark, d, F.when((F.col("l_orderkey") % 9 == 0) & (F.col("l_linenumber") == 1), 1).otherwise(0)).where("dataset_id % 13 <> 0 and not (position = 2 and dataset_id % 11 = 0)")
    whole = reuse.set_digest(want, "dataset_id")
    o = P.table(spark, d, "orders").select(F.col("o_orderkey").alias("dataset_id"), F.when(F.col("o_orderstatus") == "F", "frequency_raw").otherwise("frequency_calibrated").alias("domain"))
    sets = o.join(whole, "dataset_id", "left").withColumn("set_sha256", F.when(F.col("dataset_id") % 10 != 0, F.col("set_sha256")))
    got = reuse.safe_reuse(sets, have, want)
    return got.select("dataset_id", "reusable", F.array_join("mismatches", ",").alias("mismatches"))


@_query("L3_reference_continuity", """WITH h AS (SELECT o_orderkey AS id, n, (o_custkey + n) AS s FROM orders, (SELECT unnest([1, 2, 3, 4]) AS n))
SELECT id AS dataset_id, n AS ordinal, 'calibration_missing' AS violation FROM h WHERE n = 1 AND id % 5 = 0
UNION ALL SELECT id, n, 'calibration_incompatible' FROM h WHERE n > 2 AND s % 7 = 0
UNION ALL SELECT id, n, 'calibration_changed' FROM h WHERE n = 2 AND (id % 3 = 0 OR (id % 2 = 0 AND id % 5 = 0))
UNION ALL SELECT id, n, 'background_missing' FROM h WHERE n = 2 AND s % 11 = 0""")
def l3(spark, d):
    """Orders as histories: calibration, background, then stages without references."""
    h = P.table(spark, d, "orders").select(F.col("o_orderkey").alias("dataset_id"), "o_custkey", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("ordinal")).withColumn("s", F.col("o_custkey") + F.col("ordinal"))
    n, i = F.col("ordinal"), F.col("dataset_id")
    source = F.when(n == 1, "frequency_raw").when(n == 2, "frequency_calibrated").when(n == 3, "frequency_background_applied").otherwise("time_base")
    target = F.when(n == 1, "frequency_calibrated").when(n == 2, "frequency_background_applied").otherwise("time_base")
    cal = F.when(n == 1, F.when(i % 5 != 0, "A")).when(n == 2, F.when(i % 3 == 0, "B").when(i % 2 == 0, "A")).otherwise(F.when(F.col("s") % 7 == 0, "A"))
    back = F.when((n == 2) & (F.col("s") % 11 != 0), "G")
    return reuse.reference_violations(h.select("dataset_id", "ordinal", source.alias("source"), target.alias("target"), cal.alias("calibration_id"), back.alias("background_id")))


@_query("L7_background_provenance", """SELECT o_orderkey AS dataset_id, m IS NULL AS compatible, m AS mismatch FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'not_calibrated' WHEN o_orderkey % 7 = 0 THEN 'reference_domain' WHEN o_orderkey % 5 = 0 THEN 'profile_id'
WHEN o_orderkey % 11 = 0 THEN 'no_provenance' WHEN o_custkey % 3 = 0 THEN 'content_sha256' WHEN o_custkey % 4 = 0 THEN 'channel_id' END AS m FROM orders)""")
def l7(spark, d):
    """Orders as data sets, customers as profiles; each order has a reference of its own."""
    o, i, c = P.table(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    digest = lambda x: F.sha2(x.cast("string"), 256)
    sets = o.select(i.alias("dataset_id"), F.when(F.col("o_orderstatus") == "F", "frequency_raw").otherwise("frequency_calibrated").alias("domain"), F.when(i % 5 == 0, c + 1).otherwise(c).cast("string").alias("calibration_id"), i.alias("reference_id"))
    have = o.where("o_orderkey % 11 <> 0").select(i.alias("dataset_id"), F.lit("c1").alias("channel_id"), c.cast("string").alias("profile_id"), digest(c).alias("content_sha256"))
    refs = o.select(i.alias("reference_id"), F.when(i % 7 == 0, "raw").otherwise("osl_calibrated").alias("reference_domain"), c.cast("string").alias("profile_id"))
    k = F.col("c_custkey")
    live = P.table(spark, d, "customer").select(k.cast("string").alias("profile_id"), F.when((k % 3 != 0) & (k % 4 == 0), "c2").otherwise("c1").alias("channel_id"), digest(F.when(k % 3 == 0, -k - 1).otherwise(k)).alias("content_sha256"))
    return reuse.background_verdicts(sets, have, refs, live)


_MAGIC = b"TLK1"


def _be(c: Column, n: int) -> Column:
    """The lowest n bytes of a number, the highest first."""
    return F.unhex(F.lpad(F.hex(c.cast("long")), 2 * n, "0"))


@_query("J11_frames", """WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
b AS (SELECT *, coalesce(max(CASE WHEN event_id % 17 = 0 THEN i END) OVER w, 0) AS broke, coalesce(max(CASE WHEN event_id % 5 = 0 THEN i END) OVER v, 0) AS reset FROM e WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), v AS (PARTITION BY user_id ORDER BY i)),
k AS (SELECT * FROM b WHERE reset > broke OR broke = 0)
SELECT user_id AS stream, CAST(row_number() OVER (PARTITION BY user_id ORDER BY i) - 1 AS INT) AS n, CASE WHEN event_id % 17 <> 0 THEN 'trace' END AS kind, CASE WHEN event_id % 17 <> 0 THEN '{"id":' || CAST(event_id AS VARCHAR) || '}' END AS header, CASE WHEN event_id % 17 <> 0 THEN event_type END AS payload, CASE WHEN event_id % 17 = 0 THEN 'unknown_kind' END AS error FROM k""")
def j11(spark, d):
    """A frame for each event, in two chunks; every seventeenth has an unknown kind and stops its stream, every fifth begins with a reset."""
    i = F.col("event_id")
    head = F.concat(F.lit('{"id":'), i.cast("string"), F.lit("}"))
    kind = F.when(i % 17 == 0, 99).otherwise(5)
    frame = F.concat(F.lit(_MAGIC), _be(F.lit(256), 2), _be(kind, 2), _be(F.lit(0), 2), _be(F.length(head), 4), _be(F.length("event_type"), 4), head.cast("binary"), F.col("event_type").cast("binary"))
    e = P.table(spark, d, "events").select("event_id", F.col("user_id").alias("stream"), frame.alias("f"))
    parts = F.array(F.struct((i * 2).alias("seq"), F.expr("substring(f, 1, 9)").alias("data"), (i % 5 == 0).alias("reset")), F.struct((i * 2 + 1).alias("seq"), F.expr("substring(f, 10)").alias("data"), F.lit(False).alias("reset")))
    got = protocol.frames(e.select("stream", F.explode(parts).alias("x")).select("stream", "x.*"), _MAGIC)
    return got.select("stream", F.col("n").cast("int").alias("n"), "kind", "header", F.col("payload").cast("string").alias("payload"), "error")


_BROKEN = ((11, "trace_index", "value"), (13, "result", "value"), (17, "mission_id", "missing"), (19, "raw_trace_sha256", "value"), (23, "received_utc", "value"))


def _acknowledgements(spark, d):
    """An acknowledgement for each order; of every 11th, 13th, 17th, 19th and 23rd key one field is wrong."""
    k, uuid_of = F.col("o_orderkey"), lambda c: F.regexp_replace(F.md5(c.cast("string")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    broken = lambda n, bad, good: F.when(k % n == 0, bad).otherwise(good)
    results, sha = F.array(*map(F.lit, messages.RESULTS)), F.sha2(k.cast("string"), 256)
    fields = {"mission_id": broken(17, F.lit(None), uuid_of(F.col("o_custkey"))), "trace_uid": uuid_of(k), "trace_index": broken(11, -k - 1, k), "raw_trace_sha256": broken(19, F.upper(sha), sha), "result": broken(13, F.lit("lost"), F.get(results, (k % 4).cast("int"))), "received_utc": F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00"), broken(23, F.lit(""), F.lit("Z")))}
    frames_ = P.table(spark, d, "orders").select(k.alias("n"), F.lit("ack").alias("kind"), F.to_json(F.struct(*(c.alias(n) for n, c in fields.items()))).alias("header"))
    return messages.check(frames_, trace_domain="t", inventory_domain="i")


@_query("J12_header_violations", " UNION ALL ".join(f"SELECT o_orderkey AS n, 'ack' AS kind, '{f}' AS field, '{p}' AS problem FROM orders WHERE o_orderkey % {m} = 0" for m, f, p in _BROKEN))
def j12_violations(spark, d):
    return messages.violations(_acknowledgements(spark, d))


@_query("J12_typed_headers", f"SELECT o_orderkey AS n, o_orderkey AS trace_index, md5(CAST(o_custkey AS VARCHAR)) AS mission, CASE o_orderkey % 4 WHEN 0 THEN 'persisted' WHEN 1 THEN 'duplicate' WHEN 2 THEN 'rejected' ELSE 'conflict' END AS result, epoch_ms(CAST(o_orderdate AS TIMESTAMP)) // 1000 AS received_s FROM orders WHERE {' AND '.join(f'o_orderkey % {m} <> 0' for m, _, _ in _BROKEN)}")
def j12_typed(spark, d):
    acks = messages.of_kind(_acknowledgements(spark, d), "ack")
    return acks.select("n", "h.trace_index", F.replace("h.mission_id", F.lit("-"), F.lit("")).alias("mission"), "h.result", F.unix_seconds("h.received_utc").alias("received_s"))


@_query("J12_message_kinds", "SELECT p_partkey, CASE p_size % 10 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in protocol.KINDS.items()) + " END AS kind FROM part")
def j12(spark, d):
    return P.table(spark, d, "part").select("p_partkey", protocol.kind_name(F.col("p_size") % 10).alias("kind"))


@_query("B13_wire_stamps", "SELECT p_partkey, p_size % 3 <> 0 AS even FROM part")
def b13(spark, d):
    """Axes of p_size + 1 points in steps of a quarter; in every third by size the last point is off."""
    n = F.col("p_size")
    axis = F.transform(F.sequence(F.lit(0), n), lambda i: F.lit(1.0) + i * F.lit(0.25) + F.when((i == n) & (n % 3 == 0), 0.125).otherwise(0.0))
    return P.table(spark, d, "part").select("p_partkey", codecs.wire_stamps(axis, F.lit(1.0), F.lit(1.0) + n * 0.25, n + 1).alias("even"))


@_query("J5_sweep_timeouts", "WITH x AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders) SELECT k AS stream, 1 AS sweep, 0 AS first_n, 1000 AS started_ms, 1000 + c % 30 + CASE WHEN c % 30 >= 20 THEN 0 WHEN 2 * (c % 30) >= 20 THEN c % 30 ELSE 2 * (c % 30) END AS last_ms FROM x WHERE CASE WHEN k % 2 = 0 THEN c % 30 >= 20 OR 2 * (c % 30) >= 20 OR 3 * (c % 30) >= 20 ELSE c % 30 >= 20 OR 2 * (c % 30) >= 20 END")
def j5(spark, d):
    """Sweeps of three points for each order, a step apart; even orders lack the last and have a tick instead; the deadline is 20 ms."""
    k, step = F.col("o_orderkey"), F.col("o_custkey") % 30
    rows = F.sequence(F.lit(0), F.lit(3))
    o = P.table(spark, d, "orders").select(k.alias("stream"), step.alias("step"), F.explode(rows).alias("n"))
    point = F.when(F.col("n") < F.when(F.col("stream") % 2 == 0, 2).otherwise(3), F.col("n"))
    p = o.select("stream", "n", (F.lit(1000) + F.col("n") * F.col("step")).alias("at_ms"), point.alias("point"))
    return frames.sweep_timeouts(p, 3, 20).select("stream", F.col("sweep").cast("int").alias("sweep"), "first_n", "started_ms", "last_ms")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
