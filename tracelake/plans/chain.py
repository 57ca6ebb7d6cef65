"""The fixed chain: calibration, background, band-pass, inverse transform, dewow, flat reflection; all but the transform optional."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from . import dsp
from .provenance import Dataset


@dataclass(frozen=True)
class Profile:
    f0: float
    df: float
    points: int
    edges: tuple[float, float, float, float] | None = (0.5e9, 1.0e9, 1.5e9, 2.5e9)
    oversampling: int = 16
    dewow_s: float | None = None
    traces: int | None = None


def process(samples: DataFrame, p: Profile, *, terms: DataFrame | None = None, background: DataFrame | None = None) -> Dataset:
    """Compose the chain lazily; every rule is checked before an action can run."""
    d = Dataset(samples)
    if terms is not None:
        d = d.then("calibration", "frequency_calibrated", lambda x: dsp.apply_terms(x, terms))
    if background is not None:
        d = d.then("background", "frequency_background_applied", lambda x: dsp.subtract_background(x, background))
    if p.edges is not None:
        d = d.then("bandpass", "frequency_filtered", lambda x: dsp.bandpass(x, p.f0, p.df, p.edges, p.points), edges=p.edges)
    n, _, _ = dsp.ifft_grid(p.f0, p.df, p.points, p.oversampling)
    d = d.then("ifft", "time_base", lambda x: dsp.ifft(x, p.f0, p.df, p.oversampling), size=n)
    if p.dewow_s is not None:
        w = dsp.window_samples(p.dewow_s, 1 / (n * p.df), n)
        d = d.then("dewow", "time_processed", lambda x: dsp.dewow(x, w), window=w)
    if p.traces is not None:
        d = d.then("flat_reflection", "time_processed", lambda x: dsp.flat_reflection(x, p.traces, samples, points=n), window=p.traces)
    return d
