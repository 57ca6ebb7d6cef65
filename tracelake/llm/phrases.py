"""Phrase collocations, mined by pivot: each text fragment goes to the rarest word of the phrases in it.

A first pass counts words into a sketch of fixed size, which never counts too low. It orders the words: by estimated
count, then by bits of their hash. A phrase is owned by its pivot, the leftmost of its rarest words, so an occurrence of a word needs
only the words around it that are not rarer (up to four on each side, all with enough occurrences to stand in a
phrase): that fragment goes to the word's bucket, where all phrases around the pivot are counted. No phrase is counted twice, and
none needs another bucket. The order need not be exact for that, so the sketch bounds what is broadcast, and only
exact counts decide.

Odd inputs: a null text is empty; a null lang is ``und``; null ids and repeated rows count like any other; columns
other than ``text`` and ``lang`` are not looked at; a table without words, or without phrases that often, gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .textops import LOWER, byte_blocks, mix, powers, prefix_hash, segments, span_hash, words

#: Cells of the sketch: 16 MB as numbers, whatever the input.
CELLS = 1 << 21
#: Bytes of text that a task works on at once, and rows of a batch that it gives.
BLOCK, CHUNK = 4 << 20, 200_000
#: Bytes of text whose numbers (hashes, positions) a task holds at once.
STEP = 1 << 18
#: Words of the corpus to a bucket of pivots, and occurrences of a pivot, by the sketch, from which its fragments are dealt out to several buckets.
BUCKET_WORDS, HEAVY = 1_000_000, 500_000
#: Words within a piece, and what ends a piece (fixed values).
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, 0x09, *b".,;:!?", *range(0x0A, 0x0E)]] = False
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_IN_FRAGMENT = np.ones(256, bool)
_IN_FRAGMENT[[0x20, 0x0A]] = False
_U = np.uint64


class _Block(NamedTuple):
    """Words of a block of texts, joined by single spaces in ``data``; ``key`` tells words of different languages apart."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    lang: np.ndarray
    key: np.ndarray


def _seeds(names: pa.Array) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names.to_pylist()], _U)


def _steps(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of consecutive spans of some ``STEP`` bytes; ``at``: where each begins, and the end of the last."""
    cuts = np.unique(np.searchsorted(at[:-1], np.arange(at[0], at[-1] + STEP, STEP))) if len(at) > 1 else np.zeros(0, np.int64)
    return zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)


def _gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans of ``data`` one after the other, and their offsets. A last byte beyond the end is left open."""
    offs = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offs[1:])
    out = np.empty(offs[-1], np.uint8)
    for x, y in _steps(offs):
        if y == x + 1:
            span = data[start[x] : start[x] + size[x]]
            out[offs[x] : offs[x] + len(span)] = span
        else:
            at = np.repeat(start[x:y] - offs[x:y], size[x:y]) + np.arange(offs[x], offs[y])
            out[offs[x] : offs[y]] = data[np.minimum(at, len(data) - 1)]
    return out, offs


def _word_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of words with one byte after each; ``at``: where each begins, and the end."""
    out = np.empty(len(at) - 1, _U)
    for x, y in _steps(at):
        out[x:y] = span_hash(prefix_hash(data[at[x] : at[y]]), at[x:y] - at[x], at[x + 1 : y + 1] - at[x] - 1)
    return out


def _blocks(texts: pa.Array, langs: pa.DictionaryArray) -> Iterator[_Block]:
    codes, seeds = langs.indices.to_numpy(zero_copy_only=False), _seeds(langs.dictionary)
    for i, j, data, offs in byte_blocks(texts, BLOCK):
        data = LOWER[data]
        start, end, ptr = words(data, offs, _IS_WORD)
        if not len(start):
            continue
        row, cuts = segments(ptr), np.cumsum(_ENDS[data], dtype=np.int32 if len(data) < 1 << 31 else np.int64)[start]
        piece = np.zeros(len(start), np.int64)
        np.cumsum((row[1:] != row[:-1]) | (cuts[1:] != cuts[:-1]), out=piece[1:])
        joined, at = _gathered(data, start, end - start + 1)
        joined[at[1:] - 1] = 0x20
        lang = codes[i:j][row]
        yield _Block(joined, at[:-1], at[1:] - 1, piece, lang, mix(_word_hashes(joined, at) ^ seeds[lang]))


def _columns(batch: pa.RecordBatch) -> tuple[pa.Array, pa.DictionaryArray]:
    return batch.column("text"), pc.fill_null(batch.column("lang"), "und").dictionary_encode()


def _sketch(docs: DataFrame) -> DataFrame:
    """Rows (lang, cell, n): words by cell of the sketch, with lang null, and words by lang, with cell null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, total = np.zeros(CELLS, np.int64), {}
        for batch in batches:
            texts, langs = _columns(batch)
            names = langs.dictionary.to_pylist()
            for b in _blocks(texts, langs):
                cells += np.bincount((b.key % _U(CELLS)).astype(np.int64), minlength=CELLS)
                for k, n in enumerate(np.bincount(b.lang, minlength=len(names)).tolist()):
                    total[names[k]] = total.get(names[k], 0) + n
        full = np.flatnonzero(cells)
        for at in range(0, len(full), CHUNK):
            part = full[at : at + CHUNK]
            yield pa.record_batch([pa.nulls(len(part), pa.string()), pa.array(part, pa.int32()), pa.array(cells[part])], ["lang", "cell", "n"])
        yield pa.record_batch([pa.array(list(total), pa.string()), pa.nulls(len(total), pa.int32()), pa.array(list(total.values()), pa.int64())], ["lang", "cell", "n"])

    return docs.select("text", "lang").mapInArrow(run, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


def _slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans [start, end) of ``data`` as strings."""
    body, offs = _gathered(data, start, end - start)
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offs), pa.py_buffer(body)]).cast(pa.string())


def _alike(h: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal (h, v) together, and where each group begins in it."""
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    if (same & (v[order][1:] != v[order][:-1])).any():
        order = np.lexsort((v, h))
    first = np.ones(len(h), bool)
    first[1:] = (h[order][1:] != h[order][:-1]) | (v[order][1:] != v[order][:-1])
    return order, np.flatnonzero(first)


_FRAGMENT = "bucket int, lang string, salted boolean, body binary"


def _packed(at: np.ndarray, n: np.ndarray, texts: bytes) -> bytes:
    """Fragments as bytes: how many, the pivots' positions, the counts, the texts with a line end after each."""
    body = np.uint32(len(at)).tobytes() + at.astype(np.uint8).tobytes() + n.astype(np.uint32).tobytes() + texts
    return b"z" + zstandard.ZstdCompressor(level=1).compress(body) if len(body) > 200 else b"-" + body


def _unpacked(body: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    body = zstandard.ZstdDecompressor().decompress(body[1:]) if body[:1] == b"z" else body[1:]
    m = int(np.frombuffer(body, np.uint32, 1)[0])
    return np.frombuffer(body, np.uint8, m, 4).copy(), np.frombuffer(body, np.uint32, m, 4 + m).copy(), body[4 + 5 * m :]


def _fragments(docs: DataFrame, sketch, least: int, longest: int, heavy: int, buckets: int) -> DataFrame:
    """The fragment around each word that may stand in a phrase, with the position of that word in it; equal ones of a block are counted, and those of one bucket packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for batch in batches:
            texts, langs = _columns(batch)
            names = langs.dictionary.to_pylist()
            for b in _blocks(texts, langs):
                estimate = counts[(b.key % _U(CELLS)).astype(np.int64)]
                often = estimate >= least
                rank = (np.minimum(estimate, (1 << 43) - 1) << 20) | (b.key >> _U(44)).astype(np.int64)
                i = np.flatnonzero(often)
                left, right = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
                on, more = np.ones(len(i), bool), np.ones(len(i), bool)
                for d in range(1, longest):
                    j = np.maximum(i - d, 0)
                    on &= (i >= d) & often[j] & (b.piece[j] == b.piece[i]) & (rank[j] > rank[i])
                    left += on
                    j = np.minimum(i + d, len(often) - 1)
                    more &= (i + d < len(often)) & often[j] & (b.piece[j] == b.piece[i]) & (rank[j] >= rank[i])
                    right += more
                sums, runs = np.zeros((2, len(often) + 1), _U)
                np.cumsum(b.key, out=sums[1:])
                np.cumsum(b.key * powers(len(often)), out=runs[1:])
                start, end = b.start[i - left], b.end[i + right]
                h = mix(span_hash(runs, i - left, i + right + 1) ^ b.key[i] ^ left.astype(_U))
                order, first = _alike(h, sums[i + right + 1] - sums[i - left])
                del on, more, runs
                one = order[first]
                n = np.diff(np.append(first, len(order)))
                salts = np.minimum(-(-estimate[i[one]] // heavy), 1 << 20)
                bucket = (mix(b.key[i[one]] + h[one] % salts.astype(_U)) % _U(buckets)).astype(np.int64)
                lang, salted = b.lang[i[one]], salts > 1
                order = np.lexsort((salted, lang, bucket))
                one, n, bucket, lang, salted = one[order], n[order], bucket[order], lang[order], salted[order]
                cuts = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (lang[1:] != lang[:-1]) | (salted[1:] != salted[:-1]))) if len(one) else np.zeros(0, np.int64)
                body, offs = _gathered(b.data, start[one], end[one] - start[one] + 1)
                body[offs[1:] - 1] = 0x0A
                spans = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(one)], strict=True))
                packed = [_packed(left[one[x:y]], n[x:y], body[offs[x] : offs[y]].tobytes()) for x, y in spans]
                columns = [pa.array(bucket[cuts].astype(np.int32)), pa.array([names[k] for k in lang[cuts].tolist()], pa.string()), pa.array(salted[cuts]), pa.array(packed, pa.binary())]
                yield pa.record_batch(columns, [x.split()[0] for x in _FRAGMENT.split(", ")])

    return docs.select("text", "lang").mapInArrow(run, _FRAGMENT)


def _mine(batches: Iterator[pa.RecordBatch], least: int, longest: int) -> Iterator[pa.RecordBatch]:
    """Phrases that the pivots of a bucket own, with counts: the frequent ones, and all of pivots that are dealt out to several buckets.

    The pivot stands at one place in a phrase, so the phrases with i words before it and j after it are counted apart, in
    fragments where those with a word less were frequent.
    """
    names, bodies, lang, whole = {}, [], [], []
    for batch in batches:
        for name, salted, body in zip(*(batch.column(c) for c in ("lang", "salted", "body")), strict=True):
            bodies.append(_unpacked(body.as_py()))
            lang.append(np.full(len(bodies[-1][0]), names.setdefault(name.as_py(), len(names)), np.int32))
            whole.append(np.full(len(bodies[-1][0]), not salted.as_py()))
    at, n, lang, whole = (np.concatenate(x) for x in ([x for x, _, _ in bodies], [x for _, x, _ in bodies], lang, whole))
    data = np.frombuffer(b"".join([x for _, _, x in bodies]), np.uint8)
    del bodies
    langs = pa.array(list(names), pa.string())
    seeds, stops = _seeds(langs), np.flatnonzero(~_IN_FRAGMENT[data])
    start, ends = np.append(0, stops + 1), np.flatnonzero(data[stops] == 0x0A) + 1
    del stops
    word = mix(_word_hashes(data, start))
    pivot = np.append(0, ends[:-1]) + at
    after = (ends - pivot - 1).astype(np.uint8)
    rows = np.arange(len(at))
    for i in range(longest):
        r = rows = rows[at[rows] >= i]
        for j in range(longest - i):
            r = r[after[r] >= j]
            lo = pivot[r] - i
            h, v = np.zeros((2, len(r)), _U)
            for k in range(i + j + 1):
                w = word[lo + k]
                h, v = h * _U(0x9FB21C651E98DF25) + w, v + w
            order, first = _alike(mix(h ^ seeds[lang[r]]), v)
            r, lo = r[order], lo[order]
            total = np.add.reduceat(n[r], first, dtype=np.int64)
            out = (total >= least) | ~whole[r[first]]
            one, total = first[out], total[out]
            for x in range(0, len(one), CHUNK):
                y = one[x : x + CHUNK]
                columns = [langs.take(pa.array(lang[r[y]])), _slices(data, start[lo[y]], start[lo[y] + i + j + 1] - 1), pa.array(np.full(len(y), i + j + 1, np.int32)), pa.array(total[x : x + CHUNK])]
                yield pa.record_batch(columns, ["lang", "phrase", "k", "f"])
            r = r[np.repeat(out, np.diff(np.append(first, len(r))))]
            rows = rows if j else r


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, heavy: int = HEAVY, bucket_words: int = BUCKET_WORDS, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to ``longest`` words with ``least`` occurrences in a lang, ``(lang, phrase, k, f)``, and words by lang, ``(lang, n)``.

    Pivots go to buckets by hash, as many as keep a bucket at some ``bucket_words`` words; the counts of a pivot that is
    dealt out to several buckets are summed afterwards.
    """
    spark: SparkSession = docs.sparkSession
    scratch = scratch or Scratch(spark, "phrases")
    counted = scratch.keep(_sketch(docs), "sketch")
    cells = counted.where("cell is not null").select("cell", "n").toArrow()
    table = np.zeros(CELLS, np.int64)
    table[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    sketch = spark.sparkContext.broadcast(table)

    totals = counted.where("cell is null").select("lang", "n")
    buckets = max(1, -(-(totals.agg(F.sum("n")).first()[0] or 0) // bucket_words))
    dealt = _fragments(docs, sketch, least, longest, heavy, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _mine(batches, least, longest)

    mined = dealt.groupBy("bucket").applyInArrow(run, "lang string, phrase string, k int, f long")
    frequent = mined.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return scratch.keep(frequent, "frequent"), totals


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, heavy: int = HEAVY, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """The ``top`` phrases of each lang by score: ``lang, rank, phrase, a, l, r, n, score``.

    The score of a phrase is floor(1000 a n / (l r)) at the cut where that is least. A phrase that a longer frequent
    one always comes with is left out; as counts never rise with length, the longer ones by one word tell.
    """
    frequent, totals = frequent_phrases(docs, least, longest, heavy, bucket_words)
    parts = F.split("phrase", " ")
    part = lambda a, n: F.array_join(F.slice(parts, a, n), " ")
    found = frequent.where("k >= 2")
    inner = found.where("k >= 3").select("lang", F.explode(F.array(part(F.lit(1), F.col("k") - 1), part(F.lit(2), F.col("k") - 1))).alias("phrase"), "f")
    found = found.join(inner, ["lang", "phrase", "f"], "left_anti")
    cuts = found.select("lang", "phrase", F.col("f").alias("a"), "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("first"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    for side, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(frequent.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side]).drop(side)
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n"), wide("l") * wide("r"))
    scored = cuts.join(totals, "lang").withColumn("score", score)
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best")).select("lang", "phrase", "a", "n", "best.l", "best.r", "best.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = Window.partitionBy("lang", F.pmod(F.hash("phrase"), F.lit(64))).orderBy(*order)  # the first of each part, then of all
    best = best.withColumn("_rank", F.row_number().over(some)).where(F.col("_rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
