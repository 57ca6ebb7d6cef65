"""Provenance of derived datasets: legal hops between domains, checked before a plan runs; revisions of results."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.checkpoints import cut

#: domain -> domains a stage may lead to (fixed values); raw data are never a result.
HOPS = {
    "frequency_raw": ("frequency_calibrated", "frequency_background_applied", "frequency_filtered", "time_base"),
    "frequency_calibrated": ("frequency_background_applied", "frequency_filtered", "time_base"),
    "frequency_background_applied": ("frequency_filtered", "time_base"),
    "frequency_filtered": ("time_base",),
    "time_base": ("time_processed",),
    "time_processed": ("time_processed",),
}


@dataclass(frozen=True)
class Step:
    stage: str
    source: str
    target: str
    parameters: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Dataset:
    """Rows with the steps that made them; every added step is checked first."""

    rows: DataFrame
    steps: tuple[Step, ...] = ()

    @property
    def domain(self) -> str:
        return self.steps[-1].target if self.steps else "frequency_raw"

    def then(self, stage: str, target: str, make, **parameters) -> Dataset:
        """The dataset after ``make(rows)``; an illegal hop, a repeated stage, or dewow after flat reflection raise."""
        if target not in HOPS[self.domain]:
            raise ValueError(f"{stage}: no hop from {self.domain} to {target}")
        if any(s.stage == stage for s in self.steps):
            raise ValueError(f"{stage} has been applied")
        if stage == "dewow" and any(s.stage == "flat_reflection" for s in self.steps):
            raise ValueError("dewow goes before flat reflection")
        return replace(self, rows=make(self.rows), steps=(*self.steps, Step(stage, self.domain, target, parameters)))


def history_violations(history: DataFrame) -> DataFrame:
    """Of ``history(dataset_id, ordinal, stage, source, target)``: rows whose hop is illegal, whose link to the row before is broken, or whose stage repeats."""
    from pyspark.sql import Window

    w = Window.partitionBy("dataset_id").orderBy("ordinal")
    hops = F.create_map(*(x for k, v in HOPS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    legal = F.coalesce(F.array_contains(F.element_at(hops, F.col("source")), F.col("target")), F.lit(False))
    linked = F.col("source") == F.coalesce(F.lag("target").over(w), F.lit("frequency_raw"))
    again = F.row_number().over(Window.partitionBy("dataset_id", "stage").orderBy("ordinal")) > 1
    df = history.withColumn("violation", F.when(~legal, "illegal_hop").when(~linked, "broken_link").when(again, "repeated_stage"))
    return df.where("violation is not null").select("dataset_id", "ordinal", "violation")


def publishable(results: DataFrame, revisions: DataFrame) -> DataFrame:
    """Results of the current revision of their dataset; those of superseded revisions are discarded."""
    current = revisions.groupBy("dataset_id").agg(F.max("revision").alias("revision"))
    return results.join(current, ["dataset_id", "revision"], "left_semi")


#: A digest is a sum modulo 2^256, kept as sums of 16 bits each: no overflow below 2^47 rows.
LIMBS = 16


def _framed(rows: DataFrame, columns: tuple[str, ...]) -> Column:
    """SHA-256 of a row's columns, each with its length before it and nulls told apart, so that no two rows have the same text."""
    types = {f.name: f.dataType.typeName() for f in rows.schema}
    text = lambda c: F.hex(c) if types[c] == "binary" else F.to_json(F.struct(c), {"ignoreNullFields": "false"}) if types[c] in ("array", "struct", "map") else F.col(c).cast("string")
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in columns)), 256)


def _sums(digest: str) -> list[Column]:
    return [F.sum(F.conv(F.substring(digest, 4 * i + 1, 4), 16, 10).cast("long")).alias(f"w{i}") for i in range(LIMBS)]


def _digest(df: DataFrame) -> DataFrame:
    """``digest`` instead of the limbs: carries go up, what leaves the top is dropped."""
    limbs = F.array(*(F.coalesce(f"w{i}", F.lit(0)).cast("long") for i in reversed(range(LIMBS))))
    add = lambda a, w: F.struct(F.shiftright(w + a["carry"], 16).alias("carry"), F.concat(F.lpad(F.lower(F.hex((w + a["carry"]) % 65536)), 4, "0"), a["text"]).alias("text"))
    text = F.aggregate(limbs, F.struct(F.lit(0).cast("long").alias("carry"), F.lit("").alias("text")), add, lambda a: a["text"])
    return df.select(*(c for c in df.columns if c not in {f"w{i}" for i in range(LIMBS)}), text.alias("digest"))


def fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """Count and digest of rows in any order: the sum modulo 2^256 of the SHA-256 of every row, so that repeats count and parts add up.

    Columns are framed by their lengths and nulls are values of their own; arrays and structs count as JSON.
    """
    return _digest(rows.select(_framed(rows, columns).alias("d")).agg(F.count("*").alias("rows"), *_sums("d")))


def digest_tree(rows: DataFrame, key: list[str], index: str, columns: list[str], size: int, fan: int = 16) -> list[DataFrame]:
    """Digests by ranges of ``index``: ``(*key, range, rows, digest)`` for ranges of ``size`` values, then of ``fan`` such ranges and so on up to a mission's.

    Only the leaves read the rows; a range above is the sum of those below.
    """
    part = lambda c, n: F.call_function("div", c - F.pmod(c, F.lit(n)), F.lit(n))
    level = rows.select(*key, part(F.col(index), size).alias("range"), _framed(rows, tuple(columns)).alias("d")).groupBy(*key, "range").agg(F.count("*").alias("rows"), *_sums("d"))
    level = cut(level)
    lo, hi = level.agg(F.min("range"), F.max("range")).first()
    levels = [level]
    while lo is not None and lo != hi:
        level = level.withColumn("range", part(F.col("range"), fan)).groupBy(*key, "range").agg(*(F.sum(c).alias(c) for c in ["rows", *(f"w{i}" for i in range(LIMBS))]))
        levels.append(level)
        lo, hi = lo // fan, hi // fan
        if (lo, hi) == (-1, 0):
            break
    return [_digest(x) for x in levels]


def differing_ranges(one: DataFrame, other: DataFrame, key: list[str], index: str, columns: list[str], size: int, fan: int = 16) -> DataFrame:
    """Where two copies differ: ``(*key, low, high)`` for every range of ``size`` indices with another digest, found from the top of the trees down."""
    trees = [digest_tree(x, key, index, columns, size, fan) for x in (one, other)]
    deepest = max(map(len, trees))
    trees = [t + [t[-1].limit(0)] * (deepest - len(t)) if len(t) < deepest else t for t in trees]
    found = None
    at = [*key, "range"]
    for a, b in zip(*map(reversed, trees), strict=True):
        if found is not None:  # only below what differs above
            up = F.call_function("div", F.col("range") - F.pmod(F.col("range"), F.lit(fan)), F.lit(fan))
            a, b = (x.withColumn("_up", up).join(found.withColumnRenamed("range", "_up"), [*key, "_up"], "left_semi").drop("_up") for x in (a, b))
        both = a.join(b.select(*at, F.col("rows").alias("_rows"), F.col("digest").alias("_digest")), at, "full_outer")
        differs = both.where(~(F.col("rows").eqNullSafe(F.col("_rows")) & F.col("digest").eqNullSafe(F.col("_digest")))).select(*at)
        found = differs
    return found.select(*key, (F.col("range") * size).alias("low"), (F.col("range") * size + size - 1).alias("high"))


def equal_data(one: DataFrame, other: DataFrame, *columns: str) -> bool:
    """Whether two tables hold the same rows, as often, in any order: what a safe replay asks for."""
    a, b = (fingerprint(x, *columns).first() for x in (one, other))
    return a == b


def metadata_upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows after an update: a missing hash may be filled in, once; a change of a hash or of a frozen fact is refused."""
    i = incoming.select("trace_id", F.col("hash").alias("new_hash"), F.col("fact").alias("new_fact"))
    j = stored.join(i, "trace_id", "left")
    refused = (F.col("hash").isNotNull() & F.col("new_hash").isNotNull() & (F.col("hash") != F.col("new_hash"))) | (F.col("new_fact").isNotNull() & (F.col("fact") != F.col("new_fact")))
    return j.select("trace_id", F.when(refused, F.col("hash")).otherwise(F.coalesce("hash", "new_hash")).alias("hash"), "fact", F.coalesce(refused, F.lit(False)).alias("refused"))
