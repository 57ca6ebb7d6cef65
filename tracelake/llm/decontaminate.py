"""Benchmark decontamination: an FM-index over each shard of training words.

Words are the runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased. Test phrases are the
windows of ``window`` consecutive words of an item; an item of fewer words, but not none, is one phrase.

A shard is at most ``SHARD_WORDS`` consecutive words of the documents of an Arrow batch; a longer document
takes several, which overlap by a phrase. Its suffix order gives its Burrows-Wheeler transform, a wavelet matrix
over that answers ranks, all phrases are searched backward at once, and occurrences are located by walking to
sampled suffix positions. Hit words merge to removal spans. The index holds the shard's own words, so it
serves any benchmark.

The benchmark is read in blocks of bounded text (``BENCHMARK_BYTES``), one broadcast at a time; a block is its
word hashes, and the workers make its windows. One block takes one pass without a shuffle. For more, the indexes
are built once and kept with the documents, each block is searched in them, and only hits are written and joined.
Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch
from .textops import IS_ALNUM_WORD, LOWER, byte_blocks, prefix_hash, segments, span_hash, words

#: Benchmark text that is searched for (and broadcast) at once.
BENCHMARK_BYTES = 8 << 20
#: Words of a shard.
SHARD_WORDS = 1 << 18
#: Every so many text positions a suffix position is kept.
SAMPLE = 8


class WaveletMatrix:
    """Ranks over a sequence of small integers, one bit level after the other."""

    def __init__(self, values: np.ndarray, symbols: int) -> None:
        self.bits = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        for b in range(self.bits - 1, -1, -1):
            bit = (values >> b) & 1
            ones = np.zeros(len(values) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(values) - int(ones[-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each end."""
        start = np.zeros_like(end)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbol >> (self.bits - 1 - k)) & 1
            a, b = ones[start], ones[end]
            start = np.where(bit, zeros + a, start - a)
            end = np.where(bit, zeros + b, end - b)
        return end - start


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffixes of ``text`` in order, by prefix doubling; only suffixes that are still tied are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    s = text[order]
    head = np.concatenate([[True], s[1:] != s[:-1]])
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    k = 1
    while True:
        size = np.diff(np.concatenate([np.flatnonzero(head), [n]]))
        tied = np.flatnonzero(np.repeat(size > 1, size))
        if not len(tied):
            return order
        at = order[tied]
        second = np.where(at + k < n, rank[np.minimum(at + k, n - 1)] + 1, 0)
        sub = np.lexsort((second, rank[at]))
        at, second, first = at[sub], second[sub], rank[at][sub]
        order[tied] = at
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        head[tied] = new
        rank[at] = np.maximum.accumulate(np.where(new, tied, 0))
        k *= 2


class FMIndex:
    """Of the runs of symbols 1..symbols-1 that separators (0) end; ``order`` is the suffix order, if it is known."""

    def __init__(self, text: np.ndarray, symbols: int, order: np.ndarray | None = None) -> None:
        n, stop = len(text), text == 0
        if order is None:
            unique = text.astype(np.int64) + int(stop.sum())
            unique[stop] = np.arange(int(stop.sum()))  # each separator its own symbol: ties end there
            order = suffix_order(unique)
        self.order = order
        self.bwt = text[order - 1]
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.tree = WaveletMatrix(self.bwt, symbols)
        sampled = (order % SAMPLE == 0) | (self.bwt == 0)
        self.at = np.cumsum(sampled) - 1
        self.sampled, self.kept, self.n = sampled, order[sampled], n

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all rows of ``phrases`` at once: the interval of each."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for c in phrases.T[::-1]:
            lo, hi = self.less[c] + self.tree.rank(c, lo), self.less[c] + self.tree.rank(c, hi)
        return lo, np.maximum(lo, hi)

    def locate(self, ranks: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: step back until a sampled one."""
        steps, out, left = np.zeros(len(ranks), np.int64), np.empty(len(ranks), np.int64), np.arange(len(ranks))
        while len(left):
            here = self.sampled[ranks]
            out[left[here]] = self.kept[self.at[ranks[here]]] + steps[left[here]]
            left, ranks = left[~here], ranks[~here]
            steps[left] += 1
            c = self.bwt[ranks]
            ranks = self.less[c] + self.tree.rank(c, ranks)
        return out


def _word_hashes(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each block of texts: word hashes, where each text's begin, and the first and end byte of each word in its text."""
    for _, _, data, offs in byte_blocks(column):
        low = LOWER[data]
        start, end, ptr = words(low, offs, IS_ALNUM_WORD)
        yield span_hash(prefix_hash(low), start, end), ptr, start - offs[:-1][segments(ptr)], end - offs[:-1][segments(ptr)]


class Phrases:
    """The windows of a block of items, each different one once, with the items that have it."""

    def __init__(self, names: list[str], hashes: np.ndarray, ptr: np.ndarray, window: int) -> None:
        self.names, self.by = names, []
        self.vocab, code = np.unique(hashes, return_inverse=True)
        n = np.diff(ptr)
        size = np.minimum(n, window)
        for k in np.unique(size[n > 0]).tolist():
            items = np.flatnonzero(size == k)
            many = n[items] - k + 1
            starts = np.repeat(ptr[items] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            rows, which = np.unique(code[starts[:, None] + np.arange(k)], axis=0, return_inverse=True)
            owner = np.repeat(items, many)
            order = np.argsort(which.ravel(), kind="stable")
            self.by.append((k, rows, owner[order], np.concatenate([[0], np.cumsum(np.bincount(which.ravel(), minlength=len(rows)))])))


class Shard:
    """The index of words first to first + n - 1 of a block; ``at`` is the word at a text position."""

    def __init__(self, text: np.ndarray, vocab: np.ndarray, at: np.ndarray, order: np.ndarray | None = None) -> None:
        self.text, self.vocab, self.at = text, vocab, at
        self.index = FMIndex(text, len(vocab) + 1, order)

    def find(self, phrases: Phrases) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Length, phrase number and word position of every occurrence, and the number's items as (items, ptr)."""
        if not len(phrases.vocab):
            return
        k = np.minimum(np.searchsorted(self.vocab, phrases.vocab), len(self.vocab) - 1)
        symbol = np.where(self.vocab[k] == phrases.vocab, k + 1, 0)
        for size, rows, items, ptr in phrases.by:
            known = np.flatnonzero((symbol > 0)[rows].all(axis=1))  # a phrase with a word that the shard lacks is nowhere
            lo, hi = self.index.search(symbol[rows[known]])
            hit = np.flatnonzero(hi > lo)
            n = (hi - lo)[hit]
            if len(hit):
                ranks = np.repeat(lo[hit] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                yield size, np.repeat(known[hit], n), self.at[self.index.locate(ranks)], (items, ptr)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, text=self.text.astype(np.int32), vocab=self.vocab, at=self.at.astype(np.int32), order=self.index.order.astype(np.int32))
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> Shard:
        with np.load(io.BytesIO(blob)) as x:
            return cls(x["text"].astype(np.int64), x["vocab"], x["at"].astype(np.int64), x["order"].astype(np.int64))


def shards_of(h: np.ndarray, ptr: np.ndarray, overlap: int) -> Iterator[Shard]:
    """The shards of a block's word hashes: a separator ends each text, and a shard begins ``overlap`` words before the last one's end."""
    row = segments(ptr)
    for s in range(0, len(h), SHARD_WORDS):
        e = min(s + SHARD_WORDS + overlap, len(h))
        vocab, code = np.unique(h[s:e], return_inverse=True)
        place = np.arange(e - s) + np.concatenate([[0], np.cumsum(row[s + 1 : e] != row[s : e - 1])])
        text, at = np.zeros(place[-1] + 2, np.int64), np.zeros(place[-1] + 2, np.int64)
        text[place], at[place] = code + 1, np.arange(s, e)
        yield Shard(text, vocab, at)


def hits_of(shards: Iterator[Shard], ptr: np.ndarray, begin: np.ndarray, end: np.ndarray, phrases: Phrases) -> dict[int, tuple[list[tuple[int, int]], list[tuple[int, int]], set[str]]]:
    """For each text of a block that has hits: merged word spans that phrases cover, the same spans in bytes, items found."""
    row = segments(ptr)
    cover = np.zeros(len(row) + 1, np.int64)
    out: dict[int, tuple[list, list, set]] = {}
    for shard in shards:
        for size, phrase, word, (items, of) in shard.find(phrases):
            np.add.at(cover, word, 1)
            np.add.at(cover, word + size, -1)
            for p, r in np.unique(np.stack([phrase, row[word]]), axis=1).T.tolist():
                out.setdefault(r, ([], [], set()))[2].update(phrases.names[k] for k in items[of[p] : of[p + 1]].tolist())
    on = np.cumsum(cover)[:-1] > 0
    turn = row[1:] != row[:-1]
    first = np.flatnonzero(on & np.concatenate([[True], ~on[:-1] | turn])) if len(on) else []
    last = np.flatnonzero(on & np.concatenate([~on[1:] | turn, [True]])) if len(on) else []
    for a, z in zip(first, last, strict=True):
        r = int(row[a])
        out[r][0].append((int(a - ptr[r]), int(z - ptr[r]) + 1))
        out[r][1].append((int(begin[a]), int(end[z])))
    return out


def search_texts(texts: pa.Array, phrases: Phrases) -> list[tuple[int, list[tuple[int, int]], list[tuple[int, int]], set[str]]]:
    """For each text: words, merged word spans that phrases cover, the same spans in bytes, items found."""
    out: list = []
    overlap = max((size for size, *_ in phrases.by), default=1) - 1
    for h, ptr, begin, end in _word_hashes(texts):
        found = hits_of(shards_of(h, ptr, overlap), ptr, begin, end, phrases)
        out += [(int(n), *found.get(r, ([], [], set()))) for r, n in enumerate(np.diff(ptr))]
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ADDED = [T.StructField("n_words", T.LongType()), T.StructField("hit_words", _SPANS), T.StructField("hit_bytes", _SPANS), T.StructField("hit_items", T.ArrayType(T.StringType()))]
_ARROW = {"n_words": pa.int64(), "hit_words": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), "hit_items": pa.list_(pa.string())}
_ARROW["hit_bytes"] = _ARROW["hit_words"]


def _spans(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    return [{"start": a, "end": b} for a, b in spans]


_last: list = [None, None]


def _phrases(bench, window: int) -> Phrases:
    """The windows of a broadcast block; a worker keeps those of one block."""
    if _last[0] is not bench.value:
        _last[:] = [bench.value, Phrases(*bench.value, window)]
    return _last[1]


def _search(text_at: int, bench, window: int):
    """Documents to documents with what one block finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = search_texts(batch.column(text_at), _phrases(bench, window))
            new = {"n_words": [x[0] for x in found], "hit_words": [_spans(x[1]) for x in found], "hit_bytes": [_spans(x[2]) for x in found], "hit_items": [sorted(x[3]) for x in found]}
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, _ARROW[x]) for x, v in new.items())], names=[*batch.schema.names, *new])

    return run


_INDEX = "n_words long, block_ long, row_ int, shards_ array<binary>, words_ binary"


def _indexed(text_at: int, window: int):
    """Documents to documents with their number of words and place; the first of a block also has the block's indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            at = 0
            for h, ptr, begin, end in _word_hashes(batch.column(text_at)):
                n = len(ptr) - 1
                out = io.BytesIO()
                np.savez(out, ptr=ptr, begin=begin.astype(np.int32), end=end.astype(np.int32))
                none = [None] * (n - 1)
                new = [pa.array(np.diff(ptr), pa.int64()), pa.array([block] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([[s.dump() for s in shards_of(h, ptr, window - 1)], *none], pa.list_(pa.binary())), pa.array([out.getvalue(), *none], pa.binary())]
                yield pa.RecordBatch.from_arrays([*(c.slice(at, n) for c in batch.columns), *new], names=[*batch.schema.names, "n_words", "block_", "row_", "shards_", "words_"])
                at, block = at + n, block + 1

    return run


def _search_index(bench, window: int):
    """Kept indexes to the hits of one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {x: [] for x in ("block_", "row_", "hit_words", "hit_bytes", "hit_items")}
            for block, shards, blob in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                with np.load(io.BytesIO(blob.as_py())) as x:
                    found = hits_of((Shard.load(s.as_py()) for s in shards.values), x["ptr"], x["begin"], x["end"], _phrases(bench, window))
                for r, f in found.items():
                    for x, v in zip(rows, (block, r, _spans(f[0]), _spans(f[1]), sorted(f[2])), strict=True):
                        rows[x].append(v)
            types = (pa.int64(), pa.int32(), *(_ARROW[x] for x in ("hit_words", "hit_bytes", "hit_items")))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)], names=list(rows))

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans and items that several blocks found, merged; nulls are none."""
    for batch in batches:
        cols = dict(zip(batch.schema.names, batch.columns, strict=True))
        for x in ("hit_words", "hit_bytes"):
            cols[x] = pa.array([_spans(merged([(y["start"], y["end"]) for y in v or ()])) for v in cols[x].to_pylist()], _ARROW[x])
        cols["hit_items"] = pa.array([sorted(set(v or ())) for v in cols["hit_items"].to_pylist()], _ARROW["hit_items"])
        yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def hashed(items: list[tuple[str, str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names, word hashes, and where each item's begin."""
    hashes, size = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for h, ptr, _, _ in _word_hashes(pa.array([x[1] for x in items], pa.string())):
        hashes.append(h)
        size.append(np.diff(ptr))
    return [x[0] for x in items], np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(size))]).astype(np.int64)


def _block_of(benchmark: DataFrame, k: int, n: int):
    """One of n blocks of the benchmark, by the hash of the item's id."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    return hashed(sorted((r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect()))


def _number_of_blocks(benchmark: DataFrame) -> int:
    return 1 + int(benchmark.where("item_id is not null").agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BENCHMARK_BYTES


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 10) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_words`` and ``hit_bytes`` (merged spans, end exclusive) and ``hit_items`` (sorted as strings).

    Every column of ``docs`` is kept but those of these four names. Null and empty texts, and texts without
    words, have no words and no hits. Items without text, words or id are not searched for; equal items of
    several ids each count. Repeated rows give repeated results; empty tables an empty result or no hits.
    """
    docs, n = docs.drop(*(f.name for f in _ADDED)), _number_of_blocks(benchmark)
    text_at, sc = docs.columns.index("text"), docs.sparkSession.sparkContext
    if n == 1:
        return docs.mapInArrow(_search(text_at, sc.broadcast(_block_of(benchmark, 0, 1)), window), T.StructType([*docs.schema.fields, *_ADDED]))
    scratch = Scratch(docs.sparkSession, "contamination")
    packed = docs.select(F.struct(*docs.columns).alias("doc_"), "text")
    base = scratch.keep(packed.mapInArrow(_indexed(1, window), T.StructType([*packed.schema.fields, *T.StructType.fromDDL(_INDEX).fields])), "indexes")
    hits = None
    for k in range(n):
        bench = sc.broadcast(_block_of(benchmark, k, n))
        some = base.where("shards_ is not null").select("block_", "shards_", "words_").mapInArrow(_search_index(bench, window), T.StructType([T.StructField("block_", T.LongType()), T.StructField("row_", T.IntegerType()), *_ADDED[1:]]))
        some = scratch.keep(some, "hits")
        bench.destroy()
        hits = some if hits is None else hits.unionByName(some)
    hits = hits.groupBy("block_", "row_").agg(*(F.flatten(F.collect_list(f.name)).alias(f.name) for f in _ADDED[1:]))
    out = base.join(hits, ["block_", "row_"], "left").select("doc_", *(f.name for f in _ADDED))
    return out.mapInArrow(_merge, out.schema).select("doc_.*", *(f.name for f in _ADDED))


def contamination_report(docs: DataFrame, benchmark: DataFrame, *, window: int = 10) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)`` for every row of ``docs``."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark, window=window)
    hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda x, s: x + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the given byte spans."""
    data, at, kept = text.encode(), 0, []
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]]).decode()


def _cut(text_at: int, bench, window: int):
    """Cuts what the only block finds, until it finds nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, open_ = batch.column(text_at).to_pylist(), None
            while open_ is None or open_:
                rows = range(len(texts)) if open_ is None else open_
                found = search_texts(batch.column(text_at) if open_ is None else pa.array([texts[r] for r in rows], pa.string()), _phrases(bench, window))
                open_ = []
                for r, f in zip(rows, found, strict=True):
                    if f[2]:
                        texts[r] = without(texts[r], f[2])
                        open_.append(r)  # what now meets at a cut is searched again
            cols = list(batch.columns)
            cols[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return run


def _cut_found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t if not s else without(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_", "text"])


def remove_contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 10) -> DataFrame:
    """``docs`` with every hit span cut from ``text`` until no item of the whole benchmark is left; texts without hits stay as they are, byte by byte.

    What meets at a cut can be a new hit and is cut too. Null and empty texts stay, and so do repeated rows and all
    columns, whatever their names. An empty table gives an empty result; an empty benchmark cuts nothing.
    """
    n, columns = _number_of_blocks(benchmark), docs.columns
    if n == 1:
        return docs.mapInArrow(_cut(columns.index("text"), docs.sparkSession.sparkContext.broadcast(_block_of(benchmark, 0, 1)), window), docs.schema)
    scratch, done = Scratch(docs.sparkSession, "cuts"), None
    open_ = docs.select(F.struct(*columns).alias("doc_"), "text")
    while True:  # whoever lost something is searched again for all blocks
        found = scratch.keep(find_contamination(open_, benchmark, window=window).select("doc_", "text", "hit_bytes"), "found")
        clean = found.where(F.size("hit_bytes") == 0).select("doc_", "text")
        done = clean if done is None else done.unionAll(clean)
        hit = found.where(F.size("hit_bytes") > 0)
        if hit.isEmpty():
            return done.select(*(F.col("text") if c == "text" else F.col("doc_")[c].alias(c) for c in columns))
        open_ = hit.mapInArrow(_cut_found, open_.schema)
