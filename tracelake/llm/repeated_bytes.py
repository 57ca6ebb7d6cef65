"""Removal of long repeated byte strings: interval expansion on a Burrows-Wheeler transform, bounded by a length.

Every byte covered by a ``length``-byte string (a window) that also starts anywhere else is removed.

A transform of the whole corpus has no place on one machine, so the windows are dealt out by content. Each window
takes the leftmost least 32-byte gram in it as its anchor (so equal windows take the same one), and the string of
``core`` bytes that begins or ends with the anchor and lies in the window is its key; equal windows have equal
keys at equal offsets. Windows that share an occurrence of a key form one context: the core, at most ``reach``
bytes before it and at most as many after it.

* Equal contexts are counted by Spark; the windows of a context that occurs twice are all repeated, and a text
  copied any number of times is one context from there on.
* The different contexts of a key are the suffixes that start with its core, one interval of the transform.
  They are sorted by what follows, and their adjacent common prefixes found. Then all intervals are extended
  backward breadth first: the symbols of the transform (the bytes before the suffixes) part each interval,
  the order within is kept, and an interval of one suffix is closed. After e steps two neighbours share e bytes
  before the core, and are equal windows if they share ``reach`` - e bytes after it; since e rises by one at a
  time, windows come by increasing common prefix, and extension stops once core and prefix make ``length``.
* An interval of more than ``HOT`` different contexts (a core that very many texts wrap in other bytes) is no work for
  one task. Its extensions are parted into ranges of ``STEP``: within a range all windows that can be equal share the
  bytes before the core up to its first extension and those after it down to its last, so contexts cut to the range
  are grouped by these and go through the same two steps. A range that is still hot is parted into single
  extensions, whose contexts are single windows, and there counting settles all.

Matches never cross texts. Hashes choose and group; a window is found repeated by its bytes, or by the equal
128-bit hash of a context.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .passages import shared_words
from .scratch import Scratch
from .textops import byte_blocks, mix, prefix_hash, span_hash

#: Bytes of an anchor.
GRAM = 32
#: Contexts that one extension works on together.
TOGETHER = 60_000
#: Different contexts of one core beyond which its extensions are parted, and the extensions of a part.
HOT = 8_000
STEP = 14


def _geometry(length: int) -> tuple[int, int]:
    """Core and reach: core + reach = length, and a core fits beside any anchor of a window."""
    reach = (length - GRAM) // 2
    return length - reach, reach


def contexts_of_block(data: np.ndarray, offs: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """The contexts of a block of texts: row, key, two hashes, core start (in the text), least and most extension before it."""
    core, reach = _geometry(length)
    n = np.diff(offs)
    empty = {x: np.zeros(0, np.int64) for x in ("row", "key", "h1", "h2", "q", "lo", "hi")}
    if not (n >= length).any():
        return empty
    prefix = prefix_hash(data)
    at = np.arange(len(data) - GRAM + 1)
    least = (span_hash(prefix, at, at + GRAM) & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    width, done = length - GRAM + 1, 1
    while done < width:  # sliding minimum by doubling
        step = min(done, width - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    # windows that lie within their text
    valid = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True) if b - a >= length])
    pos = (least[valid] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    before = pos - valid  # bytes of the window before its anchor
    right = before < reach + (length - GRAM) % 2
    q = np.where(right, pos, pos - (core - GRAM))
    new = np.concatenate([[True], (q[1:] != q[:-1]) | (right[1:] != right[:-1]) | (valid[1:] != valid[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(valid)]]) - 1
    q0, hi, lo = q[first], q[first] - valid[first], q[first] - valid[last]
    row = np.searchsorted(offs, valid[first], "right") - 1
    key = span_hash(prefix, q0, q0 + core)
    whole = span_hash(prefix, q0 - hi, q0 + core + reach - lo)
    h1 = mix(whole ^ (hi.astype(np.uint64) << np.uint64(32)) ^ lo.astype(np.uint64))
    # a second prefix hash, over the bytes mapped otherwise
    other = prefix_hash(_OTHER[data])
    h2 = span_hash(other, q0 - hi, q0 + core + reach - lo)
    return {"row": row, "key": key.view(np.int64), "h1": h1.view(np.int64), "h2": h2.view(np.int64), "q": q0 - offs[row], "lo": lo, "hi": hi}


_OTHER = ((np.arange(256) * 167 + 89) ^ (np.arange(256) >> 3)).astype(np.uint8)


def _find(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, data, offs in byte_blocks(batch.column(2), 1 << 20):
                c = contexts_of_block(data, offs, length)
                row = pa.array(i + c["row"], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *(pa.array(c[x], pa.int64()) for x in ("key", "h1", "h2")), *(pa.array(c[x], pa.int32()) for x in ("q", "lo", "hi"))], names=["doc_id", "h", "key", "h1", "h2", "q", "lo", "hi"])

    return run


def expand(key: np.ndarray, left: np.ndarray, right: np.ndarray, lo: np.ndarray, hi: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Which contexts are repeated at which extension: (context, e) pairs.

    ``left[i, e]`` is the byte e + 1 before the core, ``right[i, :]`` the bytes after it; lo and hi bound the
    extensions at which context i has windows.
    """
    m = len(key)
    packed = np.zeros((m, 8 + reach), np.uint8)
    packed[:, :8] = key.astype(np.uint64).astype(">u8").view(np.uint8).reshape(m, 8)
    packed[:, 8:] = right
    order = np.argsort(packed.view(f"S{8 + reach}").ravel(), kind="stable")
    k, r = key[order], right[order]
    differs = r[1:] != r[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), reach) if reach else np.zeros(m - 1, np.int64)
    common[k[1:] != k[:-1]] = -1
    left, lo, hi = left[order], lo[order], hi[order]
    alive = np.arange(m)  # in suffix order within each interval
    group = np.cumsum(np.concatenate([[0], k[1:] != k[:-1]]))
    who, when = [], []
    for e in range(reach + 1):
        size = np.bincount(group, minlength=1)[group]
        keep = (size > 1) & (hi[alive] >= e)
        alive, group = alive[keep], group[keep]
        if not len(alive):
            break
        follows = np.cumsum(np.concatenate([[0], common < reach - e]))  # equal: so many bytes after the core are shared
        here = lo[alive] <= e
        a, g = alive[here], group[here]
        same = (g[1:] == g[:-1]) & (follows[a[1:]] == follows[a[:-1]])
        hit = a[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(a) else a
        who.append(order[hit])
        when.append(np.full(len(hit), e))
        if e < reach:  # one more byte before: the symbols of the transform part each interval
            symbol = group * 256 + left[alive, e]
            turn = np.argsort(symbol, kind="stable")
            alive, symbol = alive[turn], symbol[turn]
            group = np.cumsum(np.concatenate([[0], symbol[1:] != symbol[:-1]]))
    return (np.concatenate(who), np.concatenate(when)) if who else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _part(length: int, step: int):
    """Rows (doc_id, h, text, contexts) to the contexts cut to ranges of ``step`` extensions, as ``contexts_of_block`` gives them."""
    core, reach = _geometry(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            for i, j, data, offs in byte_blocks(batch.column(2)):
                flat = lists.slice(i, j - i).flatten()
                own = i + np.repeat(np.arange(j - i), np.asarray(lists.slice(i, j - i).value_lengths()))
                q, lo, hi = (np.asarray(flat.field(x)).astype(np.int64) for x in ("q", "lo", "hi"))
                which = np.arange(len(q)).repeat(hi // step - lo // step + 1)
                nth = np.arange(len(which)) - np.searchsorted(which, which, "left")
                first = (lo[which] // step + nth) * step
                last = np.minimum(first + step - 1, reach)
                at, low, high = q[which] + offs[own[which] - i], np.maximum(lo[which], first), np.minimum(hi[which], last)
                one, two = prefix_hash(data), prefix_hash(_OTHER[data])
                key = mix(span_hash(one, at - first, at + core + reach - last) ^ mix(first.astype(np.uint64)))
                h1 = mix(span_hash(one, at - high, at + core + reach - low) ^ (high.astype(np.uint64) << np.uint64(32)) ^ low.astype(np.uint64))
                h2 = span_hash(two, at - high, at + core + reach - low)
                row = pa.array(own[which], pa.int64())
                longs = (pa.array(x.view(np.int64)) for x in (key, h1, h2))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *longs, *(pa.array(x, pa.int32()) for x in (q[which], low, high))], names=["doc_id", "h", "key", "h1", "h2", "q", "lo", "hi"])

    return run


def _fetch(length: int):
    """Rows (doc_id, h, text, contexts) to the bytes of each context before and after its core."""
    core, reach = _geometry(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hs, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)
            out = {x: [] for x in ("doc_id", "h", "key", "q", "lo", "hi", "m", "bytes")}
            for i, j, data, offs in byte_blocks(batch.column(2)):
                data = data.tobytes()
                for r in range(i, j):
                    for c in lists[r].as_py():
                        a = int(offs[r - i]) + c["q"]
                        for x, v in (("doc_id", ids[r]), ("h", hs[r]), ("bytes", data[a - c["hi"] : a] + data[a + core : a + core + reach - c["lo"]]), *((x, c[x]) for x in ("key", "q", "lo", "hi", "m"))):
                            out[x].append(v)
            for a in range(0, len(out["key"]), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(v[a : a + 20_000], t) for v, t in zip(out.values(), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=list(out))

    return run


def _expand(length: int):
    """Contexts sorted by key to the spans of their repeated windows; whole keys are gathered until there are enough."""
    _, reach = _geometry(length)

    def spans(t: pa.Table) -> pa.RecordBatch:
        key, q, lo, hi, m = (t.column(x).to_numpy() for x in ("key", "q", "lo", "hi", "m"))
        raw = t.column("bytes").combine_chunks()
        offs = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
        data = np.frombuffer(raw.buffers()[2], np.uint8)
        start = offs[:-1] + hi  # of what follows the core
        steps = np.arange(reach)
        left = np.where(steps[None, :] < hi[:, None], data[np.maximum(start[:, None] - 1 - steps[None, :], 0)], 0).astype(np.uint8)
        right = np.where(steps[None, :] < (reach - lo)[:, None], data[np.minimum(start[:, None] + steps[None, :], len(data) - 1)], 0).astype(np.uint8)
        who, e = expand(key, left, right, lo, hi, reach)
        use = m[who] == 1  # of contexts that occur twice all windows are repeated anyhow
        who, e = who[use], e[use]
        order = np.lexsort((e, who))
        who, e = who[order], e[order]
        new = np.concatenate([[True], (who[1:] != who[:-1]) | (e[1:] != e[:-1] + 1)]) if len(who) else np.zeros(0, bool)
        a = np.flatnonzero(new)
        z = np.concatenate([a[1:], [len(who)]]) - 1 if len(a) else a
        w = who[a]
        doc, h = (t.column(x).combine_chunks().take(pa.array(w, pa.int64())) for x in ("doc_id", "h"))
        return pa.RecordBatch.from_arrays([doc, h, pa.array(q[w] - e[z], pa.int32()), pa.array(q[w] - e[a] + length, pa.int32())], names=["doc_id", "h", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n >= TOGETHER:
                t = pa.Table.from_batches(held)
                key = t.column("key").to_numpy()
                cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
                if cut:
                    yield spans(t.slice(0, cut))
                    held, n = t.slice(cut).to_batches(), t.num_rows - cut
        if held:
            yield spans(pa.Table.from_batches(held))

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = {x: [] for x in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans")}
        starts, ends = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for i, j, data, offs in byte_blocks(batch.column(1)):
            data = data.tobytes()
            for r in range(i, j):
                text, kept, at, removed, spans = data[offs[r - i] : offs[r - i + 1]], [], 0, 0, []
                for a, b in sorted(zip(starts[r] or (), ends[r] or (), strict=True)):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(b, spans[-1][1])
                    else:
                        spans.append([a, b])
                for a, b in spans:
                    kept.append(text[at:a])
                    at, removed = b, removed + b - a
                out = b"".join([*kept, text[at:]])
                for x, v in zip(rows, (len(text), removed, len(spans), hashlib.sha256(out).hexdigest(), out, [{"start": a, "end": b} for a, b in spans]), strict=True):
                    rows[x].append(v)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)), batch.column(4)], names=["doc_id", *rows, "n_shared_words"])


def remove_repeats(docs: DataFrame, *, length: int = 400, passage: int = 51) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, spans, n_shared_words)`` for every row of ``docs(doc_id, text)``.

    ``n_shared_words`` counts the words in runs of ``passage`` words that another document has too; such a run can be
    shorter than ``length`` bytes, and then nothing of it is removed. ``kept`` holds the remaining bytes and ``spans`` the maximal removed runs (end exclusive). Null texts are
    empty; texts shorter than ``length`` stay whole. Equal rows are separate texts, so both lose what they share;
    rows are told apart by doc_id and text, so a null or repeated doc_id is no matter. Other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).select("doc_id", "h", "text")
    passages = shared_words(docs, scratch, length=passage)
    whole, row, fields = ["key", "h1", "h2"], ["doc_id", "h"], "doc_id long, h long, key long, h1 long, h2 long, q int, lo int, hi int"

    def with_text(contexts: DataFrame) -> DataFrame:
        of = contexts.select("key", "m", "one.*").groupBy(*row).agg(F.collect_list(F.struct("key", "q", "lo", "hi", "m")).alias("contexts"))
        return _with(docs, of, ["contexts"], "inner").dropDuplicates(row)

    tables, copies, open_ = [scratch.keep(docs.mapInArrow(_find(length), fields), "contexts")], [], []
    for step in (STEP, 1, None):
        found = tables[-1]
        counted = found.groupBy(*whole).agg(F.count("*").alias("m"), F.min(F.struct("doc_id", "h", "q", "lo", "hi")).alias("one"))
        keys = counted.groupBy("key").agg(F.count("*").alias("c"), F.sum("m").alias("n")).where("n > 1")
        counted = scratch.keep(counted.join(keys, "key").select(*whole, "m", "c", "one"), "shared")
        copies.append(found.join(counted.where("m > 1").select(*whole), whole, "left_semi").select(*row, (F.col("q") - F.col("hi")).alias("start"), (F.col("q") - F.col("lo") + length).alias("end")))
        open_.append(counted.where((F.col("c") > 1) & (F.col("c") <= HOT)))
        hot = counted.where(F.col("c") > HOT)
        if step is None or hot.isEmpty():
            break
        tables.append(scratch.keep(with_text(hot).mapInArrow(_part(length, step), fields), "parts"))
    bytes_ = with_text(reduce(DataFrame.union, open_)).mapInArrow(_fetch(length), "doc_id long, h long, key long, q int, lo int, hi int, m long, bytes binary")
    near = bytes_.repartition("key").sortWithinPartitions("key").mapInArrow(_expand(length), "doc_id long, h long, start int, end int")
    parts = reduce(DataFrame.union, [*copies, near]).withColumn("n", F.lit(None).cast("long")).union(passages.select(*row, F.lit(None).cast("int"), F.lit(None).cast("int"), "n_shared_words"))
    spans = parts.groupBy(*row).agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"), F.max("n").alias("n"))
    spans = scratch.keep(spans, "spans")
    for found in tables:
        scratch.drop(found)
    joined = _with(docs, spans, ["starts", "ends", "n"], "left").select("doc_id", "text", "starts", "ends", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return joined.mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start: long, end: long>>, n_shared_words long")


def _with(docs: DataFrame, other: DataFrame, columns: list[str], how: str) -> DataFrame:
    """``docs(doc_id, h, text)`` joined with ``other(doc_id, h, *columns)``; a null doc_id meets a null doc_id."""
    other = other.select(F.col("doc_id").alias("id"), F.col("h").alias("of"), *columns)
    return docs.join(other, docs["doc_id"].eqNullSafe(other["id"]) & (docs["h"] == other["of"]), how).select("doc_id", "h", "text", *columns)
