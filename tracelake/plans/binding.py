"""References at the point of use: a calibration or background is applied only to data of its own contract and provenance.

A contract has a row a channel: ``channel, position, s_parameter, axis``; so has the data, so has the reference. Both are small (a
row for each channel), and are compared before any sample is read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dsp import apply_terms, subtract_background

#: Domain of the data, and the kind of background that may be taken from it (fixed values).
BACKGROUNDS = {"frequency_raw": "raw", "frequency_calibrated": "osl_calibrated"}


class NotBound(ValueError):
    """A reference that does not belong to the data."""


@dataclass(frozen=True)
class Calibration:
    """Error terms ``(channel, k, D, T, S, ok)`` with their contract."""

    terms: DataFrame
    contract: DataFrame
    calibration_id: str
    sha256: str


@dataclass(frozen=True)
class Background:
    """Means ``(channel, k, re, im)`` with their contract; a calibrated one names the calibration that it went through."""

    means: DataFrame
    contract: DataFrame
    kind: str
    calibration_id: str | None = None
    calibration_sha256: str | None = None


def mismatches(have: DataFrame, want: DataFrame) -> DataFrame:
    """``(channel, problem)`` of the channels whose contracts differ, the first of missing, unbound, position, s_parameter, axis.

    ``missing``: the data lack the channel; ``unbound``: the reference does. Axes are equal value by value, without tolerance; nulls
    equal nulls only. A channel that a side names twice is ``repeated``.
    """
    side = lambda df, n: df.groupBy("channel").agg(F.count("*").alias(f"{n}_rows"), *(F.first(c).alias(f"{n}_{c}") for c in ("position", "s_parameter", "axis")))
    j = side(have, "have").join(side(want, "want"), "channel", "full")
    differ = lambda c: ~F.col(f"have_{c}").eqNullSafe(F.col(f"want_{c}"))
    problem = F.when(F.col("have_rows").isNull(), "missing").when(F.col("want_rows").isNull(), "unbound").when((F.col("have_rows") > 1) | (F.col("want_rows") > 1), "repeated")
    for c in ("position", "s_parameter", "axis"):
        problem = problem.when(differ(c), c)
    return j.select("channel", problem.alias("problem")).where("problem is not null")


def _require_bound(have: DataFrame, want: DataFrame) -> None:
    bad = mismatches(have, want).orderBy("channel").limit(5).collect()
    if bad:
        raise NotBound(", ".join(f"{r.channel}: {r.problem}" for r in bad))


def calibrate(samples: DataFrame, contract: DataFrame, domain: str, calibration: Calibration) -> DataFrame:
    """Raw samples through a calibration of the same contract; a point near a pole fails the job."""
    if domain != "frequency_raw":
        raise NotBound(f"{domain} is not calibrated")
    _require_bound(contract, calibration.contract)
    return apply_terms(samples, calibration.terms, refuse=True)


def without_background(samples: DataFrame, contract: DataFrame, domain: str, background: Background, calibration: Calibration | None = None) -> DataFrame:
    """Samples less a background of the same contract and kind; calibrated ones only with one that went through the same calibration, by id and digest."""
    if BACKGROUNDS.get(domain) != background.kind:
        raise NotBound(f"a background of kind {background.kind} is not taken from {domain}")
    if domain == "frequency_calibrated":
        if calibration is None:
            raise NotBound("calibrated data without their calibration")
        for name, own, its in (("id", calibration.calibration_id, background.calibration_id), ("digest", calibration.sha256, background.calibration_sha256)):
            if own != its:
                raise NotBound(f"the background's calibration has another {name}")
    elif background.calibration_id is not None or background.calibration_sha256 is not None:
        raise NotBound("a raw background names a calibration")
    _require_bound(contract, background.contract)
    return subtract_background(samples, background.means)
