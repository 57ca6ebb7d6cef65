"""Byte and text codecs that built-in functions lack: little-endian doubles, strict and canonical JSON and its digest."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _refuse(text: str) -> None:
    raise ValueError(f"{text} is no JSON number")


def _once(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a key repeats")
    return out


def parse_strict(text: str) -> object:
    """JSON without repeated keys, NaN or infinities; anything else raises ValueError."""
    return json.loads(text, parse_constant=_refuse, object_pairs_hook=_once)


def canonical_json(value: object) -> str:
    """Sorted keys at every level, no white space, ASCII; -0.0 is 0.0; NaN and infinities raise."""

    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, list | tuple):
            return [plain(v) for v in x]
        return 0.0 if isinstance(x, float) and x == 0 else x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False)


def config_digest(config: dict, descriptive: tuple[str, ...] = ("created_utc", "note")) -> str:
    """SHA-256 of a configuration's canonical JSON; descriptive fields do not count."""
    return hashlib.sha256(canonical_json({k: v for k, v in config.items() if k not in descriptive}).encode()).hexdigest()


@F.arrow_udf(T.BooleanType())
def _strict(texts: pa.Array) -> pa.Array:
    def ok(t):
        try:
            parse_strict(t)
        except (ValueError, RecursionError):
            return False
        return True

    return pa.array([None if t is None else ok(t) for t in texts.to_pylist()], pa.bool_())


def strict_json(text: Column) -> Column:
    """Whether a text is strict JSON; null for null."""
    return _strict(text)


@F.arrow_udf(T.StringType())
def _digest(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else hashlib.sha256(canonical_json(v).encode()).hexdigest() for v in values.to_pylist()], pa.string())


def canonical_digest(value: Column) -> Column:
    """SHA-256 of the canonical JSON of a struct or array column: profiles, references, ordered bindings, descriptions of runs.

    A binding of channels to profiles is an array in channel order, so swapped profiles change its digest.
    """
    return _digest(value)


@F.arrow_udf(T.BinaryType())
def _doubles(arrays: pa.Array) -> pa.Array:
    flat = np.asarray(arrays.flatten(), "<f8").tobytes()
    ends = 8 * np.cumsum(np.asarray(arrays.value_lengths().fill_null(0)))
    starts = np.concatenate([[0], ends[:-1]])
    return pa.array([flat[a:b] if ok else None for a, b, ok in zip(starts.tolist(), ends.tolist(), arrays.is_valid().to_pylist(), strict=True)], pa.binary())


def le_doubles(values: Column) -> Column:
    """The little-endian bytes of an array of doubles; null for null."""
    return _doubles(values)


def le_complex(values: Column) -> Column:
    """The little-endian bytes of an array of complex structs, real part first, in the array's order."""
    return _doubles(F.flatten(F.transform(values, lambda v: F.array(v["re"], v["im"]))))


@F.arrow_udf(T.BooleanType())
def _stamps(axis: pa.Array, start: pa.Array, stop: pa.Array, points: pa.Array) -> pa.Array:
    out = []
    for a, x, y, n in zip(axis.to_pylist(), start.to_pylist(), stop.to_pylist(), points.to_pylist(), strict=True):
        out.append(None not in (a, x, y, n) and len(a) == n > 0 and np.asarray(a, "<f8").tobytes() == np.linspace(x, y, n).astype("<f8").tobytes())
    return pa.array(out, pa.bool_())


def wire_stamps(axis: Column, start: Column, stop: Column, points: Column) -> Column:
    """Whether an axis is, byte for byte, the even grid that its start, stop and number of points declare; a null is not."""
    return _stamps(axis, start.cast("double"), stop.cast("double"), points.cast("long"))


def seal(payload: Column) -> Column:
    """An envelope around a JSON text: that text and its SHA-256. Null for null."""
    return F.when(payload.isNotNull(), F.to_json(F.struct(payload.alias("payload"), F.sha2(payload, 256).alias("sha256"))))


def unseal(envelope: Column) -> Column:
    """(``payload``, ``intact``) of an envelope; the payload is null unless the digest recomputed from it is the one it carries."""
    e = F.from_json(envelope, "payload string, sha256 string")
    intact = F.coalesce(F.sha2(e["payload"], 256) == e["sha256"], F.lit(False))
    return F.when(envelope.isNotNull(), F.struct(F.when(intact, e["payload"]).alias("payload"), intact.alias("intact")))


def pack_complex(values: Column) -> Column:
    """An array of complex structs as a JSON text of shape, dtype and base64 of the little-endian bytes."""
    return F.to_json(F.struct(F.array(F.size(values)).alias("shape"), F.lit("<c16").alias("dtype"), F.base64(le_complex(values)).alias("data")))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])))
def _complex(shapes: pa.Array, data: pa.Array) -> pa.Array:
    out = []
    for shape, b in zip(shapes.to_pylist(), data.to_pylist(), strict=True):
        z = np.frombuffer(b, "<c16") if b is not None and len(b) % 16 == 0 else None
        out.append(None if z is None or shape != [len(z)] else [{"re": x, "im": y} for x, y in zip(z.real.tolist(), z.imag.tolist(), strict=True)])
    return pa.array(out, pa.list_(pa.struct([("re", pa.float64()), ("im", pa.float64())])))


def unpack_complex(text: Column) -> Column:
    """The array of ``pack_complex``; null where the dtype is another one or the shape does not fit the bytes."""
    e = F.from_json(text, "shape array<long>, dtype string, data string")
    return _complex(e["shape"], F.when(e["dtype"] == "<c16", F.unbase64(e["data"])))
