"""Words in passages that another document has too: runs of a number of words, found by winnowed anchors.

A window is a run of ``length`` words. Its anchor is the leftmost least gram of ``GRAM`` words in it, so equal windows
have equal anchors, and a document has about two anchors for each ``length`` words. Anchors that only one document
has are settled by a count; windows around the others are counted by their 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .textops import IS_SPACE_WORD, byte_blocks, mix, powers, prefix_hash, span_hash, window_hash, words

#: Words of an anchor, half a window at most.
GRAM = 8
_U = np.uint64


def windows_of_block(data: np.ndarray, offs: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Every window of a block of texts: row, its first word in the text, its anchor, its hash."""
    start, end, ptr = words(data, offs, IS_SPACE_WORD)
    h = span_hash(prefix_hash(data), start, end)
    n = np.diff(ptr)
    if not (n >= length).any():
        return {"row": np.zeros(0, np.int64), "at": np.zeros(0, np.int64), "gram": np.zeros(0, _U), "hash": np.zeros(0, _U)}
    gram = max(1, min(GRAM, length // 2))
    grams = window_hash(h, gram)
    least = (grams & _U(0xFFFFFFFF00000000)) | np.arange(len(grams)).astype(_U)
    width, done = length - gram + 1, 1
    while done < width:  # sliding minimum by doubling
        step = min(done, width - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    valid = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True) if b - a >= length])
    sums = np.zeros(len(h) + 1, _U)
    np.cumsum(h * powers(len(h)), out=sums[1:])
    inverse = powers(len(h) + 1, _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64)))
    row = np.searchsorted(ptr, valid, "right") - 1
    return {"row": row, "at": valid - ptr[row], "gram": grams[(least[valid] & _U(0xFFFFFFFF)).astype(np.int64)], "hash": mix((sums[valid + length] - sums[valid]) * inverse[valid])}


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = batch.column(0).to_numpy()
            for i, _, data, offs in byte_blocks(batch.column(1)):
                w = windows_of_block(data, offs, length)
                gram, row = w["gram"].view(np.int64), w["row"]
                new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])]) if len(row) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array(gram[new]), pa.array(r[i + row[new]])], names=["gram", "r"])

    return run


def _windows(length: int):
    """Rows (r, text, grams) to the windows whose anchors are among ``grams``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = batch.column(0).to_numpy()
            lists = batch.column(2)
            of, grams = np.repeat(np.arange(len(r)), np.asarray(lists.value_lengths())), np.asarray(lists.flatten())
            for i, j, data, offs in byte_blocks(batch.column(1)):
                w = windows_of_block(data, offs, length)
                mine = (of >= i) & (of < j)
                # an anchor counts in its own text only
                have = np.unique(mix(grams[mine].view(_U) ^ mix((of[mine] - i).astype(_U) + _U(1))))
                use = np.flatnonzero(np.isin(mix(w["gram"] ^ mix(w["row"].astype(_U) + _U(1))), have))
                for a in range(0, len(use), 50_000):
                    k = use[a : a + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(w["hash"][k].view(np.int64)), pa.array(r[i + w["row"][k]]), pa.array(w["at"][k].astype(np.int32))], names=["w", "r", "at"])

    return run


def shared_words(docs: DataFrame, scratch: Scratch, *, length: int = 51) -> DataFrame:
    """``(doc_id, h, n_shared_words)`` of the texts of ``docs(doc_id, h, text)`` that share a run of ``length`` words with another.

    Rows that are equal in doc_id and h are one document; equal texts of different ids are different documents. Words
    are compared byte by byte.
    """
    docs = docs.withColumn("r", F.xxhash64("doc_id", "h"))
    grams = scratch.keep(docs.select("r", "text").mapInArrow(_anchors(length), "gram long, r long"), "grams")
    several = lambda t, key: scratch.keep(t.groupBy(key).agg(F.min("r").alias("lo"), F.max("r").alias("hi")).where("lo < hi").select(key), "several")
    open_ = grams.join(several(grams, "gram"), "gram", "left_semi").groupBy("r").agg(F.collect_set("gram").alias("grams"))
    texts = docs.select("r", "text").join(open_, "r").dropDuplicates(["r"])
    windows = scratch.keep(texts.select("r", "text", "grams").mapInArrow(_windows(length), "w long, r long, at int"), "windows")
    scratch.drop(grams)
    hit = windows.join(several(windows, "w"), "w", "left_semi").groupBy("r").agg(F.array_sort(F.collect_set("at")).alias("at"))
    # a start adds as many words as lie before the next one, a whole window at most
    steps = F.zip_with(F.slice("at", 2, F.size("at")), "at", lambda b, a: F.least(F.coalesce(b - a, F.lit(length)), F.lit(length)))
    counted = hit.select("r", F.aggregate(steps, F.lit(0).cast("long"), lambda x, y: x + y).alias("n_shared_words"))
    found = scratch.keep(docs.select("doc_id", "h", "r").distinct().join(counted, "r").select("doc_id", "h", "n_shared_words"), "passages")
    scratch.drop(windows)
    return found
