"""Small expressions: instants, bit masks, windows, backoff, quality reasons, axis checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING_INT = -(2**63)


def ns_of(ts: Column) -> Column:
    """Exact nanoseconds since the epoch of a timestamp (its own resolution is a microsecond)."""
    return F.unix_micros(ts.cast("timestamp")) * 1000


def ts_of(ns: Column) -> Column:
    """The timestamp of nanoseconds; null unless they are whole microseconds."""
    return F.when(ns % 1000 == 0, F.timestamp_micros(F.call_function("div", ns, F.lit(1000))))


def present_mask(*columns: Column) -> Column:
    """Bit i is set where column i has a value."""
    out = F.lit(0).cast("long")
    for i, c in enumerate(columns):
        out = out + F.when(c.isNotNull(), F.lit(1 << i)).otherwise(F.lit(0))
    return out


def unmask(value: Column, mask: Column, bit: int) -> Column:
    return F.when(mask.bitwiseAND(F.lit(1 << bit).cast("long")) != 0, value)


def to_sentinel(value: Column) -> Column:
    return F.coalesce(value, F.lit(MISSING_INT))


def from_sentinel(value: Column) -> Column:
    return F.nullif(value, F.lit(MISSING_INT))


def midpoint(start: Column, finish: Column) -> Column:
    """Floor of the mean of two non-negative instants."""
    return F.shiftright(start + finish, 1)


def backoff(attempt: Column, initial: float, factor: float, most: float) -> Column:
    return F.least(F.lit(initial) * F.pow(F.lit(factor), attempt - 1), F.lit(most))


def edge_window(f: Column, edges: tuple[float, float, float, float]) -> Column:
    """A band-pass weight: 0 outside, 1 inside, squared sines on both slopes."""
    f1, f2, f3, f4 = map(float, edges)
    if not 0 <= f1 < f2 <= f3 < f4:
        raise ValueError("edges must satisfy 0 <= f1 < f2 <= f3 < f4")
    half = F.lit(3.141592653589793 / 2)
    rise, fall = F.pow(F.sin(half * (f - f1) / (f2 - f1)), 2), F.pow(F.sin(half * (f4 - f) / (f4 - f3)), 2)
    return F.when((f < f1) | (f > f4), 0.0).when(f < f2, rise).when(f <= f3, 1.0).otherwise(fall)


def next_power_of_two(n: Column) -> Column:
    return F.when(n <= 1, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n - 1))))


def steps(axis: Column) -> Column:
    """Differences of neighbours of an array."""
    return F.zip_with(F.slice(axis, 2, F.size(axis)), F.slice(axis, 1, F.greatest(F.size(axis) - 1, F.lit(0))), lambda a, b: a - b)


def median(values: Column) -> Column:
    s = F.array_sort(values)
    n = F.size(s)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def axis_valid(axis: Column) -> Column:
    """One dimension, not empty, finite and strictly increasing."""
    finite = F.forall(axis, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return axis.isNotNull() & (F.size(axis) > 0) & finite & F.forall(steps(axis), lambda d: d > 0)


def step_error(axis: Column) -> tuple[Column, Column]:
    """The median step of an axis and the largest deviation from it."""
    m = median(steps(axis))
    return m, F.array_max(F.transform(steps(axis), lambda d: F.abs(d - m)))


def axis_uniform(axis: Column, *, absolute: float = 1.0, relative: float = 1e-6) -> Column:
    """Steps equal to their median within the larger of both tolerances; two points at least, none negative."""
    m, e = step_error(axis)
    return (F.size(axis) >= 2) & (F.get(axis, F.lit(0)) >= 0) & (e <= F.greatest(F.lit(absolute), F.abs(m) * relative))


def time_regular(axis: Column, *, relative: float = 1e-6) -> Column:
    """As ``axis_uniform``, without an absolute tolerance."""
    m, e = step_error(axis)
    return (F.size(axis) >= 2) & (e <= F.abs(m) * relative)


def first_step_uniform(axis: Column, *, relative: float = 1e-9, absolute: float = 1e-6) -> Column:
    """Steps equal to the first one."""
    d = steps(axis)
    first = F.get(d, F.lit(0))
    return (F.size(axis) >= 2) & F.forall(d, lambda x: F.abs(x - first) <= F.lit(absolute) + F.abs(first) * relative)


#: What a match's reason means for the quality of a trace, and for its health (fixed values).
QUALITY_OF = {"no_fix": "gnss_no_fix", "clock_unavailable": "gnss_no_fix", "out_of_range": "gnss_no_fix", "stale": "gnss_stale", "invalid": "gnss_invalid"}


def quality_reason(reason: Column, usable: Column) -> Column:
    out = F.when(usable, F.lit(None).cast("string"))
    for k, v in QUALITY_OF.items():
        out = out.when(reason == k, v)
    return out.otherwise("gnss_missing")


def health(reason: Column, usable: Column) -> Column:
    return F.when(usable, "valid").when(reason == "stale", "stale").when(reason == "invalid", "invalid").otherwise("no_fix")


def uuid5(namespace_hex: str, name: Column) -> Column:
    """A name-based UUID (version 5) from SHA-1."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("long").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def raw_trace_sha256(magic: str, mission: Column, uid: Column, index: Column, channels: Column, n_freq: Column, axis_le: Column, raw_le: Column) -> Column:
    """The canonical digest of a trace: magic, version, length-framed ids, index, channels, and little-endian axis and samples."""
    u64 = lambda c: F.unhex(F.lpad(F.hex(c.cast("long")), 16, "0"))
    text = lambda c: F.concat(u64(F.octet_length(c)), c.cast("binary"))
    names = F.unhex(F.array_join(F.transform(channels, lambda c: F.hex(text(c))), ""))
    return F.sha2(F.concat(F.lit(magic).cast("binary"), u64(F.lit(1)), text(mission), text(uid), u64(index), u64(F.size(channels)), names, u64(n_freq), axis_le, raw_le), 256)


def window_samples(ratio: Column, n: Column | int) -> Column:
    """Samples of a window of ``ratio`` steps: rounded half to even, at least 1, then up to odd; null below 3 or beyond ``n``."""
    k = F.greatest(F.lit(1).cast("long"), F.bround(ratio).cast("long"))
    k = k + F.when(k % 2 == 0, 1).otherwise(0)
    return F.when(k.between(F.lit(3), n if isinstance(n, Column) else F.lit(n)), k)


def quantized(start_hz: Column, stop_hz: Column, bandwidth_hz: Column, power_dbm: Column) -> Column:
    """A device's whole values as a struct: hertz cut off, power to hundredths of a dBm, half to even."""
    whole = {"start_hz": start_hz, "stop_hz": stop_hz, "bandwidth_hz": bandwidth_hz}
    return F.struct(*(c.cast("long").alias(k) for k, c in whole.items()), (F.bround(power_dbm * 100) / 100).alias("power_dbm"))


def sweep_timeout(explicit: Column, points: Column, stages: Column, bandwidth_hz: Column, *, least_s: float = 2.0, factor: float = 0.1) -> Column:
    """Seconds until a sweep is given up: the explicit value, else ``points * stages / bandwidth * factor``, not below ``least_s``."""
    return F.coalesce(explicit, F.greatest(F.lit(least_s), points * stages / F.greatest(bandwidth_hz, F.lit(1)) * F.lit(factor)))
