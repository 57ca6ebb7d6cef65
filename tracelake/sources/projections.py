"""Domain shapes made from the driver tables; the SQL beside each is the same projection for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Frequency axis of the spectra: start, step, points.
F0, DF, POINTS = 0.52e9, 0.1e9, 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def side(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One copy of the missions in ``orders``: a mission per order status, with duplicates, conflicts, gaps and differences at fixed moduli."""
    air = name == "air"
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("mission_id"), F.col("o_orderkey").alias("i"), F.col("o_custkey").alias("c"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    o = o.where(F.col("i") % (101 if air else 97) != 0)
    copies = F.when(F.col("i") % (71 if air else 73) == 0, F.array(F.lit(""), F.lit(""))).when(F.col("i") % (67 if air else 61) == 0, F.array(F.lit(""), F.lit("c"))).otherwise(F.array(F.lit("")))
    o = o.select("*", F.posexplode(copies).alias("k", "v"))
    uid = F.concat(F.lit("t-"), F.col("i").cast("string"))
    uid = F.when(F.col("i") % 113 == 0, F.concat(F.lit("clash-"), F.floor(F.col("i") / 1000).cast("string"))).otherwise(uid) if air else F.when(F.col("i") % 79 == 0, F.concat(uid, F.lit("x"))).otherwise(uid)
    mark = F.col("v") if air else F.when(F.col("i") % 89 == 0, F.concat(F.col("v"), F.lit("g"))).otherwise(F.col("v"))
    lat = F.when(F.col("i") % 5 != 0, (F.col("c") % 1800) / 10.0 + (F.lit(0.0) if air else F.when(F.col("i") % 83 == 0, 0.5).otherwise(0.0)))
    return o.select("mission_id", F.col("i").alias("trace_index"), uid.alias("trace_uid"), F.sha2(F.concat_ws("|", F.col("i").cast("string"), F.col("cents").cast("string"), mark), 256).alias("hash"), lat.alias("latitude"), (F.col("i") * 4 + F.col("k")).alias("record_position"))


def side_sql(name: str) -> str:
    air = name == "air"
    uid = "CASE WHEN i % 113 = 0 THEN 'clash-' || CAST(i // 1000 AS VARCHAR) ELSE 't-' || CAST(i AS VARCHAR) END" if air else "CASE WHEN i % 79 = 0 THEN 't-' || CAST(i AS VARCHAR) || 'x' ELSE 't-' || CAST(i AS VARCHAR) END"
    mark = "v" if air else "CASE WHEN i % 89 = 0 THEN v || 'g' ELSE v END"
    shift = "0.0" if air else "CASE WHEN i % 83 = 0 THEN 0.5 ELSE 0.0 END"
    return f"""{name} AS (SELECT mission_id, i AS trace_index, {uid} AS trace_uid, sha256(CAST(i AS VARCHAR) || '|' || CAST(cents AS VARCHAR) || '|' || {mark}) AS hash,
      CASE WHEN i % 5 <> 0 THEN (c % 1800) / 10.0 + {shift} END AS latitude, i * 4 + k AS record_position
      FROM (SELECT o_orderstatus AS mission_id, o_orderkey AS i, o_custkey AS c, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, unnest(CASE WHEN o_orderkey % {71 if air else 73} = 0 THEN [{{'k': 0, 'v': ''}}, {{'k': 1, 'v': ''}}]
            WHEN o_orderkey % {67 if air else 61} = 0 THEN [{{'k': 0, 'v': ''}}, {{'k': 1, 'v': 'c'}}] ELSE [{{'k': 0, 'v': ''}}] END, recursive := true) FROM orders WHERE o_orderkey % {101 if air else 97} <> 0))"""


def excluded_sql(name: str) -> str:
    """Excluded indices and logical view of a side, as CTEs."""
    return f"""{name}_x AS (SELECT mission_id, trace_index FROM {name} GROUP BY ALL HAVING count(DISTINCT hash) > 1
      UNION SELECT DISTINCT mission_id, trace_index FROM {name} SEMI JOIN (SELECT mission_id, trace_uid FROM {name} GROUP BY ALL HAVING count(DISTINCT trace_index) > 1) USING (mission_id, trace_uid)),
    {name}_l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mission_id, trace_index ORDER BY record_position) AS rn FROM {name}) WHERE rn = 1 AND (mission_id, trace_index) NOT IN (SELECT (mission_id, trace_index) FROM {name}_x))"""


def missions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per mission a committed count that leaves the last tenth of positions out."""
    return side(spark, sf_dir, "air").groupBy("mission_id").agg(F.floor(F.max("record_position") * 0.9).cast("long").alias("committed_record_count"))


MISSIONS_SQL = "missions AS (SELECT mission_id, CAST(floor(max(record_position) * 0.9) AS BIGINT) AS committed_record_count FROM air GROUP BY 1)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 4).alias("domain"), "user_id", "event_type", "value", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("at"))


def sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks: a sweep lasts as many milliseconds as 100 times its value."""
    return _events(spark, sf_dir).where("event_type = 'click'").select("domain", F.col("event_id").alias("sweep_id"), F.col("at").alias("started_ns"), (F.col("at") + F.floor(F.col("value") * 100).cast("long") * 1_000_000).alias("finished_ns"))


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other events, errors invalid; times are cut to ten seconds, so that some coincide."""
    return _events(spark, sf_dir).where("event_type <> 'click'").select("domain", F.col("event_id").alias("fix_id"), (F.call_function("div", F.col("at"), F.lit(10_000_000_000)) * 10_000_000_000).alias("received_ns"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("valid"))


EVENTS_SQL = """ev AS (SELECT event_id, user_id % 4 AS domain, user_id, event_type, value, epoch_us(ts) * 1000 AS at FROM events),
sweeps AS (SELECT domain, event_id AS sweep_id, at AS started_ns, at + CAST(floor(value * 100) AS BIGINT) * 1000000 AS finished_ns FROM ev WHERE event_type = 'click'),
fixes AS (SELECT domain, event_id AS fix_id, at // 10000000000 * 10000000000 AS received_ns, event_id AS seq, event_type <> 'error' AS valid FROM ev WHERE event_type <> 'click')"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra from ``embeddings``: channel 0 holds floats 0 to 31, channel 1 the rest; a point is a pair of floats."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    point = lambda c, k: F.struct(F.get(e, F.lit(32 * c + 2 * k)).alias("re"), F.get(e, F.lit(32 * c + 2 * k + 1)).alias("im"))
    rows = F.array(*(F.struct(F.lit(c).alias("channel"), F.array(*(point(c, k) for k in range(POINTS))).alias("values")) for c in (0, 1)))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("trace_id"), F.explode(rows).alias("r")).select("trace_id", "r.channel", "r.values")


SAMPLES_SQL = """s AS (SELECT vec_id AS trace_id, c AS channel, k, CAST(embedding[32 * c + 2 * k + 1] AS DOUBLE) AS re, CAST(embedding[32 * c + 2 * k + 2] AS DOUBLE) AS im
FROM embeddings, (SELECT unnest(range(2)) AS c), (SELECT unnest(range(16)) AS k))"""
