"""Jaccard join of documents on word shingles: a size-aware heavy-light join.

Sets are the distinct ``words_per_shingle``-word shingles of a text. Two texts link when the
intersection is at least ``percent`` % of the union.

1. ``profile``: one pass over the texts counts, for every document, its shingles and how many of
   them occur in another different set. Blocks of documents send their distinct shingles to hash
   buckets (a shingle that several sets of a block share is sent once), and buckets send counts
   back. A document that has too few shared shingles for any partner is settled here.
2. Equal sets form a class; the smallest doc_id stands for it from here on.
3. Of the rest, shingles are ordered from rare to common. A set of n shingles needs a common part of
   a = ceil(percent * n / 100) at least, so two partners share at least c shingles among their first
   n - a + c. Small (light) sets enumerate all subsets of c = 2 of these; large (heavy) sets scan the
   inverted lists of single shingles (c = 1), and so do small sets that can be partners of a large
   one. The boundary is the size at which the summed cost of both is least (``boundary``).
4. Sets under one key form a list. Round by round, each list compares some of its sets (pivots) with
   the others that are not yet in their component; the pivots then leave the list. A list whose sets
   are all in one component is done. So a list costs about its length where its sets are copies, and
   no pair of a list in different components stays uncompared. Pivots grow eightfold by the round.

Candidates are verified on the whole sets (64-bit shingle hashes; two different shingles of a
corpus fall together with a chance of about n^2 / 2^65).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import joined_components
from .scratch import Scratch
from .textops import BLOCK_BYTES, IS_SPACE_WORD, LOWER, byte_blocks, mix, prefix_hash, segments, span_hash, window_hash, words

#: Text bytes for each hash bucket of the profile: about two million shingles.
BUCKET_BYTES = 12_000_000
#: Beyond so many buckets they grow instead, and blocks of documents with them, so that a message keeps several shingles.
MANY_BUCKETS, LARGE_BUCKET_BYTES = 4096, 48_000_000
#: Sets of each list that are compared with all others in the first round, and how many times more in each next one.
FIRST_PIVOTS, MORE_PIVOTS = 4, 16
#: Columns of a set's signature.
SIGNATURE = ("s0", "s1", "s2", "s3")


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text of a block, sorted within a text, and where each text's begin."""
    low = LOWER[data]
    start, end, ptr = words(low, offs, IS_SPACE_WORD)
    h = span_hash(prefix_hash(low), start, end)
    runs = window_hash(h, size)
    sets, n = [], []
    for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True):
        if b - a >= size:
            s = np.unique(runs[a : b - size + 1])
        elif b > a:
            s = window_hash(h[a:b], b - a)
        else:
            s = runs[:0]
        sets.append(s)
        n.append(len(s))
    return (np.concatenate(sets) if sets else runs[:0]), np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


def _digests(values: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit digest of each set, the same whatever the order."""
    sums = np.zeros((2, len(values) + 1), np.uint64)
    np.cumsum(mix(values ^ np.uint64(0x1B873593)), out=sums[0, 1:])
    np.cumsum(mix(values + np.uint64(0xCC9E2D51)), out=sums[1, 1:])
    one, two = sums[:, ptr[1:]] - sums[:, ptr[:-1]]
    return one, two


def _send(words_in: int, buckets: int, block: int):
    """Blocks of (doc_id, text) to messages for each hash bucket; one of a block's messages also holds its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, data, offs in byte_blocks(batch.column(1), block):
                values, ptr = shingle_sets(data, offs, words_in)
                n = np.diff(ptr)
                d1, d2 = _digests(values, ptr)
                row = segments(ptr)
                first = np.zeros(j - i, bool)
                first[np.unique(d1, return_index=True)[1]] = True  # one document of each class of the block
                use = first[row]
                v, r = values[use], row[use]
                order = np.argsort(v, kind="stable")
                sv = v[order]
                new = np.concatenate([[True], sv[1:] != sv[:-1]]) if len(sv) else np.zeros(0, bool)
                count = np.diff(np.concatenate([np.flatnonzero(new), [len(sv)]]))
                many = np.repeat(count > 1, count)
                local = np.bincount(r[order][many], minlength=j - i)
                shared = sv[new][count > 1]
                single = np.ones(len(v), bool)
                single[order[many]] = False
                v, r = v[single], r[single]
                to, to_shared = (v >> np.uint64(40)) % np.uint64(buckets), (shared >> np.uint64(40)) % np.uint64(buckets)
                order = np.argsort(to, kind="stable")
                v, r, to = (v[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32), r[order], to[order]
                order = np.argsort(to_shared, kind="stable")
                shared, to_shared = (shared[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32), to_shared[order]
                # within a bucket the shingles of one document follow each other
                at = np.flatnonzero(np.concatenate([[True], (to[1:] != to[:-1]) | (r[1:] != r[:-1])])) if len(v) else np.zeros(0, np.int64)
                doc, size, cls = r[at].astype(np.uint32), np.diff(np.concatenate([at, [len(v)]])).astype(np.uint32), d1[r[at]]
                home = (part * 1_000_003 + k) % buckets  # the bucket that brings the block's documents
                some = np.union1d(np.union1d(to[at], to_shared), np.array([home], np.uint64))
                cut, of, cut_shared = (np.searchsorted(x, np.append(some, np.uint64(buckets))) for x in (to, to[at], to_shared))
                rows = {x: [] for x in ("bucket", "block", "docs", "classes", "counts", "hashes", "shared", "head")}
                for m, bucket in enumerate(some.tolist()):
                    x, y = slice(cut[m], cut[m + 1]), slice(of[m], of[m + 1])
                    head = np.stack([ids[i:j].astype(np.int64), n.astype(np.int64), d1.view(np.int64), d2.view(np.int64), local.astype(np.int64)]).tobytes() if bucket == home else None
                    for name, value in (("bucket", bucket), ("block", part << 32 | k), ("docs", doc[y].tobytes()), ("classes", cls[y].tobytes()), ("counts", size[y].tobytes()), ("hashes", v[x].tobytes()), ("shared", shared[cut_shared[m] : cut_shared[m + 1]].tobytes()), ("head", head)):
                        rows[name].append(value)
                k += 1
                yield pa.RecordBatch.from_arrays([pa.array(rows["bucket"], pa.int32()), pa.array(rows["block"], pa.int64()), *(pa.array(rows[x], pa.binary()) for x in ("docs", "classes", "counts", "hashes", "shared", "head"))], names=list(rows))

    return run


def _tally(table: pa.Table) -> pa.Table:
    """In one bucket: how many shingles of each document are also in a different set."""
    t = table.to_pydict()
    counts = [np.frombuffer(x, np.uint32) for x in t["counts"]]
    hashes = [np.frombuffer(x, np.uint32) for x in t["hashes"]]
    classes = [np.repeat(np.frombuffer(c, np.uint64), n) for c, n in zip(t["classes"], counts, strict=True)]
    h, c = np.concatenate(hashes), np.concatenate(classes)
    shared = np.concatenate([np.frombuffer(x, np.uint32) for x in t["shared"]])
    order = np.argsort(h, kind="stable")
    sh, sc = h[order], c[order]
    common = np.zeros(len(h), bool)
    if len(sh):
        at = np.flatnonzero(np.concatenate([[True], sh[1:] != sh[:-1]]))
        differs = np.minimum.reduceat(sc, at) != np.maximum.reduceat(sc, at)
        shared = np.sort(shared)
        if len(shared):
            near = np.minimum(np.searchsorted(shared, sh[at]), len(shared) - 1)
            differs |= shared[near] == sh[at]
        common[order] = np.repeat(differs, np.diff(np.concatenate([at, [len(sh)]])))
    out, k = [], 0
    for n in counts:
        m = int(n.sum())
        out.append(np.bincount(np.repeat(np.arange(len(n)), n)[common[k : k + m]], minlength=len(n)).astype(np.uint32).tobytes())
        k += m
    return pa.table({"block": pa.array(t["block"], pa.int64()), "docs": pa.array(t["docs"], pa.binary()), "common": pa.array(out, pa.binary()), "head": pa.array(t["head"], pa.binary())})


def _total(table: pa.Table) -> pa.Table:
    """Of one block: its documents with their counts summed over the buckets."""
    t = table.to_pydict()
    ids, n, d1, d2, local = np.frombuffer(next(x for x in t["head"] if x is not None), np.int64).reshape(5, -1)
    common = local.copy()
    for docs, some in zip(t["docs"], t["common"], strict=True):
        common[np.frombuffer(docs, np.uint32)] += np.frombuffer(some, np.uint32)  # a document is once in a message
    # the copies of a class within a block have the counts of the first
    first, back = np.unique(d1, return_index=True, return_inverse=True)[1:]
    return pa.table({"doc_id": ids, "n": n, "d1": d1, "d2": d2, "common": common[first][back]})


def needed(n: Column, percent: int) -> Column:
    """The least common part of a set of n with any partner."""
    return F.ceil(n * percent / F.lit(100.0) - F.lit(1e-9)).cast("long")


def profile(docs: DataFrame, *, words_per_shingle: int = 5, buckets: int | None = None) -> DataFrame:
    """``(doc_id, n, d1, d2, common)`` for every row: set size, 128-bit set digest, shingles that another different set has too."""
    if buckets is None:
        total = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
        buckets = 1 + min(total // BUCKET_BYTES, MANY_BUCKETS + total // LARGE_BUCKET_BYTES)
    block = max(BLOCK_BYTES, 64 * buckets)
    sent = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_send(words_per_shingle, buckets, block), "bucket int, block long, docs binary, classes binary, counts binary, hashes binary, shared binary, head binary")
    back = sent.groupBy("bucket").applyInArrow(_tally, "block long, docs binary, common binary, head binary")
    return back.groupBy("block").applyInArrow(_total, "doc_id long, n long, d1 long, d2 long, common long")


def signatures(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Of each set, for 256 classes of its shingles, whether their number is odd: four 64-bit words.

    Two sets whose signatures differ in k bits have at least k shingles that are not common.
    """
    rows = len(ptr) - 1
    place = segments(ptr) * 256 + (mix(values ^ np.uint64(0x85EBCA6B)) >> np.uint64(56)).astype(np.int64)
    odd = (np.bincount(place, minlength=256 * rows) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(rows, 256), axis=1).view(np.int64).reshape(rows, len(SIGNATURE))


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in byte_blocks(batch.column(1)):
                values, ptr = shingle_sets(data, offs, size)
                tokens = pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(values.view(np.int64)))
                signs = signatures(values, ptr)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), tokens, *(pa.array(signs[:, k]) for k in range(len(SIGNATURE)))], names=["doc_id", "tokens", *SIGNATURE])

    return run


_SETS = "doc_id long, tokens array<long>, " + ", ".join(f"{c} long" for c in ("s0", "s1", "s2", "s3"))


def boundary(sets: DataFrame, subset: int = 2) -> int:
    """The set size from which scanning inverted lists is cheaper than enumerating subsets.

    ``sets`` has n, ``light`` (shingles that a subset can hold) and ``scan``: a list's length, or the number of sets that
    each of its sets is compared with where that is less. A subset costs two, for being made and for being grouped.
    Costs are summed by size class (powers of 1.25, so a bounded number of rows); the boundary is the size
    class at which the subsets of all smaller sets and the scans of all others are least together.
    """
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25))).cast("int")
    rows = sets.groupBy(step.alias("k")).agg(F.sum(F.col("light").cast("double") * (F.col("light") - 1)).alias("light"), F.sum("scan").alias("scan"), F.min("n").alias("n")).orderBy("k").collect()
    best, at = sum(r.scan for r in rows), 0
    for i in range(len(rows)):
        cost = sum(r.light for r in rows[: i + 1]) + sum(r.scan for r in rows[i + 1 :])
        if cost < best:
            best, at = cost, rows[i + 1].n if i + 1 < len(rows) else rows[i].n * 2
    return int(at)


def components_of(sets: DataFrame, scratch: Scratch, *, percent: int = 80) -> DataFrame:
    """``(node, component)`` of the different sets ``sets(doc_id, n, tokens, s0..s3)`` that have links; the component is its smallest node."""
    flat = sets.select("doc_id", "n", F.explode("tokens").alias("token"))
    df = flat.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    own = F.array_sort(F.collect_list(F.struct("df", "token")))
    first = F.col("n") - needed(F.col("n"), percent) - (F.col("n") - F.size("own"))  # of the shared ones, without the c more
    prefix = flat.join(df, "token").groupBy("doc_id", "n").agg(own.alias("own")).withColumn("p", first).where("p + 1 > 0")
    prefix = prefix.select("doc_id", "n", F.size("own").cast("long").alias("shared"), F.slice("own", 1, (F.col("p") + 2).cast("int")).alias("own"), "p")
    scan = F.aggregate(F.slice("own", 1, (F.col("p") + 1).cast("int")), F.lit(0).cast("long"), lambda x, y: x + F.least(y["df"], F.lit(FIRST_PIVOTS)))
    prefix = prefix.select("doc_id", "n", "p", "shared", F.transform("own", lambda x: x["token"]).alias("own"), F.size("own").cast("long").alias("light"), scan.alias("scan"))
    prefix = scratch.keep(prefix.join(sets.select("doc_id", *SIGNATURE), "doc_id"), "prefix")
    x = boundary(prefix)

    # ``left``: the most that two sets can have in common if this key is the first they share (position filter)
    before = F.col("n") - F.col("shared")
    single = F.posexplode(F.slice("own", 1, (F.col("p") + 1).cast("int"))).alias("i", "k1")
    heavy = prefix.where(F.col("n") * 100 >= x * percent).select(single, F.lit(0).cast("long").alias("k2"), "doc_id", "n", before.alias("u"), *SIGNATURE)
    heavy = heavy.select("k1", "k2", "doc_id", "n", (F.col("n") - F.col("u") - F.col("i")).alias("left"), *SIGNATURE)
    tail = F.transform("own", lambda a, i: F.transform(F.slice("own", i + 2, F.size("own")), lambda b, j: F.struct(a.alias("k1"), b.alias("k2"), (i + j + 1).alias("j"))))
    light = prefix.where((F.col("n") < x) & (F.col("n") > 1)).select(F.explode(F.flatten(tail)).alias("k"), "doc_id", "n", before.alias("u"), *SIGNATURE)
    light = light.select("k.k1", "k.k2", "doc_id", "n", (F.col("n") - F.col("u") - F.col("k.j") + 1).alias("left"), *SIGNATURE)
    lists = heavy.unionByName(light)
    key, row = ["k1", "k2"], ["k1", "k2", "doc_id", "n", "left", *SIGNATURE]
    size = lists.groupBy(*key).agg(F.count("*").alias("m"), F.max("left").alias("most"), F.min("n").alias("least")).where("m > 1")
    can = F.least("left", "most") * (100 + percent) >= (F.col("n") + F.greatest(F.col("least"), F.col("n") * percent / 100)) * percent
    lists = scratch.keep(lists.join(size, key).where(can).select(*row, F.col("doc_id").alias("component")), "lists")
    label = tested = None
    pivots = FIRST_PIVOTS
    while True:
        # one pivot of each of ``pivots`` parts of a list, so that no list is gathered
        part = F.pmod(F.xxhash64("doc_id"), F.lit(pivots))
        chosen = lists.groupBy(*key, part.alias("part")).agg(F.min(F.struct("doc_id", "n", "left", "component", *SIGNATURE)).alias("p"))
        chosen = chosen.select(*key, F.col("p.doc_id").alias("p"), F.col("p.n").alias("np"), F.col("p.left").alias("lp"), F.col("p.component").alias("cp"), *(F.col(f"p.{c}").alias(f"p{c}") for c in SIGNATURE))
        chosen = scratch.keep(chosen, "pivots")
        same = [lists[c] == chosen[c] for c in key]
        fits = (F.col("component") != F.col("cp")) & (F.least("left", "lp") * (100 + percent) >= (F.col("n") + F.col("np")) * percent)
        apart = functools.reduce(Column.__add__, (F.bit_count(F.col(c).bitwiseXOR(F.col(f"p{c}"))) for c in SIGNATURE))
        alike = apart * (100 + percent) <= (F.col("n") + F.col("np")) * (100 - percent)
        pairs = lists.join(chosen, [*same, fits, alike]).select(F.least("p", "doc_id").alias("a"), F.greatest("p", "doc_id").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = scratch.keep(pairs, "pairs")
        both = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("tb")), "b").join(sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("ta")), "a")
        common = F.size(F.array_intersect("ta", "tb"))
        new = scratch.keep(both.where(common * 100 >= (F.size("ta") + F.size("tb") - common) * percent).select("a", "b"), "links")
        label, tested = joined_components(label, new, scratch), pairs if tested is None else tested.union(pairs)
        # compared sets leave their lists; lists within one component are done
        rest = lists.join(chosen.select(*key, F.col("p").alias("doc_id")), [*key, "doc_id"], "left_anti").select(*row)
        rest = rest.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        rest = scratch.keep(rest.select(*row, "component"), "rest")
        open_ = rest.groupBy(*key).agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select(*key)
        lists = scratch.keep(rest.join(open_, key).select(*row, "component"), "lists")
        if lists.isEmpty():
            return label
        pivots *= MORE_PIVOTS


def jaccard_components(docs: DataFrame, *, words_per_shingle: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs(doc_id, text)``.

    Null and empty texts, and texts without words, have no shingles and are their own component. Repeated rows and
    equal texts share a component, and so do all rows of a doc_id; a doc_id that repeats should repeat its text. Rows
    with a null doc_id are linked with nothing; their component is null. An empty table gives an empty result. Other
    columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    nameless = docs.where("doc_id is null").mapInArrow(_sets(words_per_shingle), _SETS)
    docs = docs.where("doc_id is not null")
    all_ = scratch.keep(profile(docs, words_per_shingle=words_per_shingle), "profile")
    classes = all_.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.max("common").alias("common"))
    live = classes.where(F.col("common") >= needed(F.col("n"), percent)).select(F.col("rep").alias("doc_id"), "n")
    texts = docs.join(live.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets = texts.select("doc_id", "text").mapInArrow(_sets(words_per_shingle), _SETS)
    sets = scratch.keep(sets.select("doc_id", F.size("tokens").cast("long").alias("n"), "tokens", *SIGNATURE), "sets")
    label = components_of(sets, scratch, percent=percent)
    of = classes.select("n", "d1", "d2", "rep").join(label.withColumnRenamed("node", "rep"), "rep", "left")
    # a table of its own, so that Spark can split the rows of a class with many copies when they are joined with it
    of = scratch.keep(of.select("n", "d1", "d2", F.coalesce("component", "rep").alias("component_id")), "classes")
    out = all_.join(of, ["n", "d1", "d2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.unionAll(nameless.select("doc_id", F.size("tokens").cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))


def keep_one(docs: DataFrame, *, words_per_shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component, and those without doc_id; repeated rows stay."""
    of = jaccard_components(docs, words_per_shingle=words_per_shingle, percent=percent)
    others = of.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(docs.columns)
