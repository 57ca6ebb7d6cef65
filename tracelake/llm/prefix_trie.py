"""Conversations as a trie of their turns, kept as level-order (LOUDS) tries by prefix.

Conversations are rebuilt by joins; each turn gets a label, the hash of its role, text and position, and each prefix the
exclusive or of its labels, all 128 bits. A prefix below which more than a shard's rows lie is heavy. Heavy prefixes
are the upper levels, which Spark aggregates merge; every prefix right below them goes whole to one
shard, where numpy builds the trie in level order: a bit for each child and a zero for each node, labels beside. Parents
follow from the bits by rank and select, and rollups add children to parents in reverse level order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Turns below a prefix that one shard takes; a prefix with more is split at the next turn.
SHARD_TURNS = 20_000
#: Nodes of one output batch.
_ROWS = 50_000
NOTHING = hashlib.sha256(b"").hexdigest()


def rebuilt(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Turns ``(conv_id, d, len, h1, h2, words)`` of the rebuilt conversations, d from 1, and ``(conv_id, len)`` of all of them."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    own = conversations.where("conv_id is not null").select("conv_id", "turn", F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit("turn"), role, text).alias("t2"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    each = Window.partitionBy("conv_id")
    own = own.withColumns({"k": F.row_number().over(each.orderBy(F.asc_nulls_first("turn"), "t1", "t2")).cast("long"), "n": F.count("*").over(each)})
    own = scratch.keep(own.drop("turn"), "turns")
    base, h = F.col("conv_id") - F.col("conv_id") % 20, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    heads = own.where((F.col("conv_id") % 20 == 0) & (F.col("k") <= 3)).select(F.col("conv_id").alias("base"), F.col("k").alias("d"), F.col("n").alias("n_base"), "t1", "t2", "words")
    own = own.withColumns({"base": base, "h": h}).join(heads.where("d = 1").select("base", "n_base"), "base", "left")
    own = own.withColumn("m", F.least("h", F.coalesce("n_base", F.lit(0)))).withColumn("len", F.col("m") + F.greatest(F.lit(0), F.col("n") - F.col("h")))
    convs = own.where("k = 1").select("conv_id", "base", "m", "len")
    tail = own.where("k > h").select("conv_id", (F.col("m") + F.col("k") - F.col("h")).alias("d"), "len", "t1", "t2", "words")
    head = convs.join(heads.drop("n_base"), "base").where("d <= m").select("conv_id", "d", "len", "t1", "t2", "words")
    labels = F.xxhash64("t1", "t2", "d"), F.xxhash64(F.lit("label"), "t1", "t2", "d")
    return tail.unionByName(head).select("conv_id", "d", "len", labels[0].alias("h1"), labels[1].alias("h2"), "words"), convs.select("conv_id", "len")


def _unique(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by the keys, where each distinct one begins in it, and the number of each row's."""
    order = np.lexsort(keys[::-1])
    first = np.ones(len(order), bool)
    first[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(first) - 1
    return order, np.flatnonzero(first), of


_TRIE = "shard long, nodes long, bits binary, labels binary, words binary, convs binary, least binary, ending binary, ends binary, stubs binary"


def _louds(t: pa.Table) -> pa.Table:
    """The trie of a shard in level order: a root, then the heavy prefixes (stubs) above its rows, then the nodes."""
    col = {c: t[c].to_numpy() for c in ("conv_id", "d", "len", "h1", "h2", "words", "top", "p1", "p2")}
    conv_order, conv_first, conv = _unique(col["conv_id"])
    heads = conv_order[conv_first]
    stub_order, stub_first, at = _unique(col["top"][heads], col["p1"][heads], col["p2"][heads])
    stubs = heads[stub_order[stub_first]]
    level = col["d"] - col["top"]
    rows = np.lexsort((conv, level))
    cuts = np.searchsorted(level[rows], np.arange(int(level.max()) + 2))
    at = at.copy()  # the node that each conversation has come to
    degree, parts = [np.array([len(stubs)])], {c: [] for c in ("label", "words", "convs", "least", "ending", "ends")}
    above = len(stubs)
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        r = rows[lo:hi]
        order, first, of = _unique(at[conv[r]], col["h1"][r], col["h2"][r])
        lead = r[order[first]]
        degree.append(np.bincount(at[conv[lead]], minlength=above))
        parts["label"].append(np.stack([col["h1"][lead], col["h2"][lead]], axis=1))
        parts["words"].append(col["words"][lead])
        parts["convs"].append(np.diff(np.append(first, len(r))))
        parts["least"].append(np.minimum.reduceat(col["conv_id"][r[order]], first))
        last = col["len"][r] == col["d"][r]
        parts["ending"].append(np.bincount(of[last], minlength=len(first)))
        parts["ends"].append(col["conv_id"][r[last]][np.lexsort((col["conv_id"][r[last]], of[last]))])
        at[conv[r]] = of
        above = len(first)
    degree.append(np.zeros(above, np.int64))
    degree = np.concatenate(degree)
    bits = np.ones(int(degree.sum()) + len(degree), bool)
    bits[np.cumsum(degree + 1) - 1] = False
    whole = {c: np.ascontiguousarray(np.concatenate(x).astype(np.int64)) for c, x in parts.items()}
    blob = lambda x: pa.array([x.tobytes()], pa.binary())
    where = np.stack([col["top"][stubs] - 1, col["p1"][stubs], col["p2"][stubs]], axis=1).astype(np.int64)
    return pa.table({
        "shard": t["shard"][:1], "nodes": pa.array([len(degree)], pa.int64()), "bits": blob(np.packbits(bits)), "labels": blob(whole["label"]), "words": blob(whole["words"]), "convs": blob(whole["convs"]),
        "least": blob(whole["least"]), "ending": blob(whole["ending"]), "ends": blob(whole["ends"]), "stubs": blob(where),
    })


def parents(bits: np.ndarray) -> np.ndarray:
    """The parent of each node of a level-order trie but the root's: the zeros before its bit."""
    ones = np.flatnonzero(bits)
    return ones - np.arange(len(ones))


def rolled_up(parent: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Each value summed over the subtrees; ``parent`` of node 1, 2, ... in level order."""
    out, n = [v.copy() for v in values], len(parent) + 1
    starts, lo = [], 1
    while lo < n:  # a level ends where the parents reach it
        starts.append(lo)
        lo = 1 + int(np.searchsorted(parent, lo))
    for lo, hi in zip(reversed(starts), reversed([*starts[1:], n]), strict=True):
        for v in out:
            np.add.at(v, parent[lo - 1 : hi - 1], v[lo:hi])
    return out


_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, d long, p1 long, p2 long"


def trie_nodes(tries: DataFrame) -> DataFrame:
    """The nodes of the shards' tries with their rollups; those right below a heavy prefix have its depth and key instead of a parent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, (stubs, convs, words, least, ending, ends) = row["nodes"], (np.frombuffer(row[c], np.int64) for c in ("stubs", "convs", "words", "least", "ending", "ends"))
                stubs, skip = stubs.reshape(-1, 3), 1 + len(stubs) // 3
                parent = parents(np.unpackbits(np.frombuffer(row["bits"], np.uint8))[: 2 * n - 1])
                degree = np.bincount(parent, minlength=n)
                pad = lambda x, skip=skip: np.concatenate([np.zeros(skip, np.int64), x])
                leaf = degree == 0
                leaf[:skip] = False
                leaves, saved = rolled_up(parent, leaf.astype(np.int64), pad((convs - 1) * words))
                depth = np.concatenate([[0], stubs[:, 0], np.zeros(n - skip, np.int64)])
                lo = skip
                while lo < n:  # level by level
                    hi = 1 + int(np.searchsorted(parent, lo))
                    depth[lo:hi] = depth[parent[lo - 1 : hi - 1]] + 1
                    lo = hi
                text, stop = [NOTHING] * (n - skip), np.cumsum(ending)
                for i in np.flatnonzero(ending).tolist():
                    text[i] = hashlib.sha256(",".join(map(str, ends[stop[i] - ending[i] : stop[i]].tolist())).encode()).hexdigest()
                of = parent[skip - 1 :]
                top = of < skip
                up = np.where(top, 0, pad(least)[np.where(top, 0, of)])
                key = stubs[np.where(top, of - 1, 0)]
                columns = [pa.array(least), pa.array(depth[skip:]), pa.array(up, mask=top), pa.array(convs), pa.array(degree[skip:]), pa.array(leaves[skip:]), pa.array(saved[skip:]), pa.array(text, pa.string()), *(pa.array(key[:, k], mask=~top) for k in range(3))]
                whole = pa.record_batch(columns, [x.split()[0] for x in _NODE.split(", ")])
                for a in range(0, whole.num_rows, _ROWS):
                    yield whole.slice(a, _ROWS)

    return tries.mapInArrow(run, _NODE)


def _digests(ends: DataFrame) -> DataFrame:
    """``ends(d, k1, k2, conv_id)`` to the digest of each key's ids in order; ids stream past, no list is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        done = lambda: pa.record_batch([pa.array([x]) for x in (*key, digest.hexdigest())], ["d", "k1", "k2", "ends_sha256"])
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("d", "k1", "k2")], axis=1)
            cuts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))) if len(keys) else []
            for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                text = ",".join(map(str, batch.column("conv_id")[int(a) : int(b)].to_pylist())).encode()
                if (own := tuple(keys[a].tolist())) != key:
                    if key is not None:
                        yield done()
                    key, digest = own, hashlib.sha256(text)
                else:
                    digest.update(b"," + text)
        if key is not None:
            yield done()

    return ends.repartition("d", "k1", "k2").sortWithinPartitions("d", "k1", "k2", "conv_id").mapInArrow(run, "d long, k1 long, k2 long, ends_sha256 string")


def prefix_tries(conversations: DataFrame, shard_turns: int = SHARD_TURNS, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The tries below the heavy prefixes, a row a shard; the paths ``(conv_id, d, len, h1, h2, words, k1, k2)``; the heavy prefixes; ``(conv_id, len)``."""
    scratch = scratch or Scratch(conversations.sparkSession, "trie")
    turns, convs = rebuilt(conversations, scratch)
    along = Window.partitionBy("conv_id").orderBy("d")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    paths = scratch.keep(turns.withColumns({"k1": F.bit_xor("h1").over(upto), "k2": F.bit_xor("h2").over(upto)}), "paths")
    nodes = paths.groupBy("d", "k1", "k2").agg(F.sum(F.col("len") - F.col("d") + 1).alias("below"), F.count("*").alias("n"), F.min("conv_id").alias("least"), F.first("words").alias("words"), F.first("h1").alias("h1"), F.first("h2").alias("h2"))
    heavy = scratch.keep(nodes.where(F.col("below") > shard_turns).drop("below"), "heavy")
    marked = paths.join(heavy.select("d", "k1", "k2", F.lit(True).alias("heavy")), ["d", "k1", "k2"], "left")
    top = F.first(F.when(F.col("heavy").isNull(), F.struct(F.col("d").alias("top"), F.col("k1").bitwiseXOR(F.col("h1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("h2")).alias("p2"), "k1", "k2")), True).over(upto)
    shards = max(1, -(-paths.count() // shard_turns))
    below = marked.withColumn("_top", top).where("heavy is null").select("conv_id", "d", "len", "h1", "h2", "words", "_top.top", "_top.p1", "_top.p2", F.pmod(F.xxhash64("_top.k1", "_top.k2"), F.lit(shards)).cast("long").alias("shard"))
    return scratch.keep(below.groupBy("shard").applyInArrow(_louds, _TRIE), "tries"), paths, heavy, convs


def trie_report(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """A row per distinct prefix of the rebuilt conversations: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    A null role or text is empty. Turns of one conversation that are equal in ``turn`` follow each other by a hash of role and
    text; repeated rows are turns of their own. Rows without conv_id belong to no conversation. Other columns are not
    looked at; an empty table gives no rows, not even a root.
    """
    scratch = Scratch(conversations.sparkSession, "trie")
    tries, paths, heavy, convs = prefix_tries(conversations, shard_turns, scratch)
    low = scratch.keep(trie_nodes(tries), "nodes")
    key = ["d", "k1", "k2"]
    root = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("least")).where("n > 0")
    zero = F.lit(0).cast("long")
    upper = heavy.unionByName(root.select(zero.alias("d"), zero.alias("k1"), zero.alias("k2"), "n", "least", zero.alias("words"), zero.alias("h1"), zero.alias("h2")))
    upper = upper.withColumns({"p1": F.col("k1").bitwiseXOR(F.col("h1")), "p2": F.col("k2").bitwiseXOR(F.col("h2")), "pd": F.col("d") - 1}).drop("h1", "h2")
    under = low.where("d is not null").select("d", F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.lit(1).cast("long").alias("kids"), "n_leaves", "saved_tokens")
    under = under.unionByName(upper.where("d > 0").select(F.col("pd").alias("d"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.lit(1).cast("long").alias("kids"), zero.alias("n_leaves"), zero.alias("saved_tokens")))
    under = under.groupBy(*key).agg(F.sum("kids").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    some = lambda c: F.coalesce(c, zero)
    upper = upper.join(under, key, "left").select(*key, "n", "least", "pd", "p1", "p2", some("n_children").alias("n_children"), F.when(some("n_children") == 0, 1).otherwise(some("leaves")).alias("leaves"), (some("saved") + (F.col("n") - 1) * F.col("words")).alias("saved"))
    upper = scratch.keep(upper, "upper")
    # what lies below a heavy prefix is told to those above by its smallest conversation, which has them all on its path
    leads = upper.select(F.col("least").alias("conv_id")).distinct()
    steps = paths.select("conv_id", *key).unionByName(convs.select("conv_id", *(zero.alias(k) for k in key)))
    steps = steps.join(leads, "conv_id", "left_semi").join(upper.select(*key, "least", "leaves", "saved"), key)
    mine = lambda c: F.when(F.col("least") == F.col("conv_id"), F.col(c)).otherwise(0)
    deeper = Window.partitionBy("conv_id").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumns({"leaves": F.sum(mine("leaves")).over(deeper), "saved": F.sum(mine("saved")).over(deeper)})
    sums = steps.groupBy(*key).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ends = paths.where("d = len").select(*key, "conv_id").join(heavy.select(*key), key, "left_semi").unionByName(convs.where("len = 0").select(*(zero.alias(k) for k in key), "conv_id"))
    over = upper.select(F.col("d").alias("pd"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("least").alias("parent_conv_id"))
    top = upper.join(sums, key).join(_digests(ends), key, "left").join(over, ["pd", "p1", "p2"], "left")
    top = top.select(F.col("least").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
    low = low.withColumnRenamed("d", "pd").join(over.withColumnRenamed("parent_conv_id", "over_id"), ["pd", "p1", "p2"], "left")
    return low.select("conv_id", "depth", F.coalesce("parent_conv_id", "over_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").unionByName(top)
