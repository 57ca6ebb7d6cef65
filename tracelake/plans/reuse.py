"""When derived data and references may be used again: references along a history, profiles of a calibration, backgrounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codecs import canonical_digest

#: The domain that each kind of reference belongs to (fixed values).
DOMAIN_OF = {"calibration_id": "frequency_calibrated", "background_id": "frequency_background_applied"}
_PROFILE = ("channel_id", "s_parameter", "profile_id", "content_sha256")


def reference_violations(history: DataFrame) -> DataFrame:
    """Of ``history(dataset_id, ordinal, source, target, calibration_id, background_id)``: ``(dataset_id, ordinal, violation)``.

    A step into a reference's domain must name the reference (``missing``); a step that neither reads nor makes
    the domain must not (``incompatible``); a step that reads the domain may leave it out, but may not name
    another one than the step before (``changed``). Nulls are references that are left out.
    """
    w = Window.partitionBy("dataset_id").orderBy("ordinal")
    found = []
    for name, domain in DOMAIN_OF.items():
        own, before = F.col(name), F.lag(name).over(w)
        kind = name.removesuffix("_id")
        reads, makes = F.col("source") == domain, F.col("target") == domain
        found.append(F.when(makes & own.isNull(), f"{kind}_missing").when(own.isNotNull() & ~reads & ~makes, f"{kind}_incompatible").when(reads & own.isNotNull() & (F.lag("ordinal").over(w).isNull() | ~before.eqNullSafe(own)), f"{kind}_changed"))
    rows = history.select("dataset_id", "ordinal", F.array_compact(F.array(*found)).alias("v"))
    return rows.select("dataset_id", "ordinal", F.explode("v").alias("violation"))


def set_digest(profiles: DataFrame, *keys: str) -> DataFrame:
    """``(*keys, set_sha256)``: the digest of the ordered binding of channels to profiles; ``profiles`` has ``position``."""
    one = F.struct("position", "channel_id", "profile_id", "content_sha256")
    binding = F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(x["channel_id"].alias("channel_id"), x["profile_id"].alias("profile_id"), x["content_sha256"].alias("content_sha256")))
    return profiles.groupBy(*keys).agg(binding.alias("b")).select(*keys, canonical_digest(F.col("b")).alias("set_sha256"))


def safe_reuse(datasets: DataFrame, recorded: DataFrame, requested: DataFrame) -> DataFrame:
    """``(dataset_id, reusable, mismatches)`` for every row of ``datasets(dataset_id, domain, set_sha256)``.

    ``recorded`` and ``requested(dataset_id, position, channel_id, s_parameter, profile_id, content_sha256)`` are the
    profiles in a dataset's history and those of the calibration that is asked for. Data are reused only if they end
    calibrated, have a complete list, and agree at every position and in the digest of the whole set; every
    difference is named. A dataset without a recorded list is refused.
    """
    fields = [F.col(c) for c in _PROFILE]
    have = recorded.select("dataset_id", "position", F.struct(*fields).alias("have"))
    want = requested.select("dataset_id", "position", F.struct(*fields).alias("want"))
    at = F.concat(F.lit("positions["), F.col("position").cast("string"), F.lit("]."))
    same = lambda c: F.col(f"have.{c}").eqNullSafe(F.col(f"want.{c}"))
    each = [F.when(~same(c), F.concat(at, F.lit(c))) for c in _PROFILE]
    differs = F.when(F.col("have").isNull(), F.array(F.concat(at, F.lit("not_recorded")))).when(F.col("want").isNull(), F.array(F.concat(at, F.lit("not_requested")))).otherwise(F.array_compact(F.array(*each)))
    pairs = have.join(want, ["dataset_id", "position"], "full").select("dataset_id", differs.alias("m"), F.col("have").isNotNull().alias("h"))
    diff = pairs.groupBy("dataset_id").agg(F.array_sort(F.flatten(F.collect_list("m"))).alias("m"), F.max("h").alias("h"))
    whole = set_digest(requested, "dataset_id").withColumnRenamed("set_sha256", "want_set")
    j = datasets.join(diff, "dataset_id", "left").join(whole, "dataset_id", "left")
    found = (
        F.when(~F.col("domain").eqNullSafe("frequency_calibrated"), F.array(F.lit("not_calibrated"))).when(~F.coalesce("h", F.lit(False)), F.array(F.lit("no_provenance")))
        .otherwise(F.concat("m", F.when(F.col("set_sha256").eqNullSafe(F.col("want_set")), F.array().cast("array<string>")).otherwise(F.array(F.lit("set_sha256")))))
    )
    return j.select("dataset_id", (F.size(found) == 0).alias("reusable"), found.alias("mismatches"))


def background_verdicts(datasets: DataFrame, recorded: DataFrame, references: DataFrame, live: DataFrame) -> DataFrame:
    """``(dataset_id, compatible, mismatch)``: whether a background reference fits calibrated data.

    ``datasets(dataset_id, domain, calibration_id, reference_id)``; ``recorded(dataset_id, channel_id, profile_id,
    content_sha256)``, the profiles in the data's history; ``references(reference_id, reference_domain, profile_id)``;
    ``live(profile_id, channel_id, content_sha256)``, the profiles as they are now, with recomputed digests. The data
    must end calibrated, the reference must be of calibrated data and bound to the profile that the data name, the
    history must list it, and the live profile must have the same channel and digest. The first failure is named.
    """
    listed = recorded.groupBy("dataset_id", "profile_id").agg(F.min(F.struct("channel_id", "content_sha256")).alias("listed"), F.lit(True).alias("has"))
    known = recorded.select("dataset_id").distinct().withColumn("any", F.lit(True))
    ref = references.select("reference_id", "reference_domain", F.col("profile_id").alias("bound"))
    now = live.select(F.col("profile_id").alias("bound"), F.struct("channel_id", "content_sha256").alias("now"))
    j = datasets.join(ref, "reference_id", "left").join(now, "bound", "left").join(known, "dataset_id", "left")
    j = j.join(listed.withColumnRenamed("profile_id", "bound"), ["dataset_id", "bound"], "left")

    def first(*rules: tuple[Column, str]) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for ok, name in rules:
            out = out.when(~F.coalesce(ok, F.lit(False)), name)
        return out

    mismatch = first(
        (F.col("domain") == "frequency_calibrated", "not_calibrated"), (F.col("reference_domain") == "osl_calibrated", "reference_domain"), (F.col("bound").isNotNull(), "reference_unbound"), (F.col("bound") == F.col("calibration_id"), "profile_id"),
        (F.col("any"), "no_provenance"), (F.col("has"), "not_listed"), (F.length("listed.content_sha256") > 0, "no_digest"), (F.col("now").isNotNull(), "not_bound_now"),
        (F.col("listed.channel_id").isNull() | (F.col("listed.channel_id") == F.col("now.channel_id")), "channel_id"), (F.col("listed.content_sha256") == F.col("now.content_sha256"), "content_sha256"),
    )
    return j.select("dataset_id", mismatch.isNull().alias("compatible"), mismatch.alias("mismatch"))
