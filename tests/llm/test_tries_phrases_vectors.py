"""Prefix tries, phrases and near vectors against brute force on small tables, with odd rows, hot keys and ties."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelake.llm import cover_tree, phrases, prefix_trie

CLASHING = ("n", "k", "d", "h", "len", "key", "uid", "node", "rank", "label", "least", "size", "a", "b")


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


# --- conversations ---------------------------------------------------------------------------------------------------


def trie(table):
    """Nodes of rebuilt conversations, by dictionaries; ``table``: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in table:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [t for _, t in sorted(x, key=lambda y: y[0])] for c, x in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - int(np.fmod(c, 20))
        full = tuple(own.get(base, [])[:h] + turns[h:])
        ends[full].append(c)
        for d in range(len(full) + 1):
            members[full[:d]].append(c)
    out = []
    for node, convs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = [x for x in below if len(x) == len(node) + 1]
        leaves = sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below) for x in below)
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in below if x)
        digest = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(kids), leaves, saved, digest))
    return sorted(map(repr, out))


@pytest.fixture(scope="module")
def conversations(spark):
    rnd = random.Random(3)
    table = [(c, t, rnd.choice(["user", "assistant"]), f"say {rnd.randrange(3)} {'x ' * rnd.randrange(3)}") for c in range(120) for t in range(rnd.randrange(1, 6))]
    table += [(c, t, "user", "hello hello") for c in range(200, 300) for t in range(4)]  # a third are alike
    table += [(400, t, "user", f"turn {t}") for t in range(60)]
    table += [(5, None, None, None), (7, None, "user", None), (-25, 0, "user", "a"), (-20, 1, "user", "b\x0bc"), (None, 0, "user", "nobody"), (61, 3, "x", "ß 漢字"), (500, 1, "user", "twice"), (500, 1, "user", "twice"), (520, 0, "user", " " * 5000)]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    return table, df.withColumns({c: F.lit(1) for c in CLASHING})


@pytest.mark.parametrize("shard_turns", [1, 7, 50, 20_000])
def test_trie_of_conversations(conversations, shard_turns):
    table, df = conversations
    assert rows(prefix_trie.trie_report(df, shard_turns)) == trie(table)


def test_trie_whatever_the_order_and_empty(conversations):
    table, df = conversations
    assert rows(prefix_trie.trie_report(df.repartition(5).orderBy(F.rand(1)), 40)) == trie(table)
    assert prefix_trie.trie_report(df.limit(0)).count() == 0


def test_louds_bits_give_the_tree_back():
    # a root with two children, the first of which has three
    assert prefix_trie.parents(np.array([1, 1, 0, 1, 1, 1, 0, 0, 0, 0, 0], bool)).tolist() == [0, 0, 1, 1, 1]
    assert prefix_trie.rolled_up(np.array([0, 0, 1, 1, 1]), np.array([0, 0, 1, 2, 3, 4]))[0].tolist() == [10, 9, 1, 2, 3, 4]


# --- phrases ---------------------------------------------------------------------------------------------------------


def mined(table, least, longest, top):
    count, n = defaultdict(Counter), Counter()
    for text, lang in table:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    count[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in count.items():
        often = {p: f for p, f in c.items() if f >= least}
        inside = {p[i : i + k] for p, f in often.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if f >= often[p[i : i + k]]}
        best = []
        for p, a in often.items():
            if len(p) >= 2 and p not in inside:
                score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(best)[:top])]
    return sorted(map(repr, out))


@pytest.fixture(scope="module")
def texts(spark):
    rnd = random.Random(5)
    table = [(" ".join(rnd.choice("The of and a cat dog é ß 漢 rare1 rare2".split()) for _ in range(rnd.randrange(30))).replace("dog", rnd.choice(["dog", "dog,", "dog.\n", "  dog\t"])), rnd.choice(["en", "de", None])) for _ in range(300)]
    table += [("the the the the the the", "en")] * 40 + [("one fixed passage of ten words that always comes along", "en")] * 200
    table += [(None, "en"), ("", None), (" \t\n.;", "fr"), ("x\x00y z", "en"), ("a b " * 20_000, "long")]
    df = spark.createDataFrame(table, "text string, lang string")
    return table, df.withColumns({c: F.lit(1) for c in CLASHING})


@pytest.mark.parametrize(("least", "longest", "top", "heavy", "bucket_words"), [(3, 5, 2000, 500_000, 1_000_000), (3, 5, 7, 50, 400), (10, 3, 2000, 500_000, 100), (100, 5, 2000, 1, 10_000)])
def test_phrases(texts, least, longest, top, heavy, bucket_words):
    table, df = texts
    assert rows(phrases.collocations(df, least, longest, top, heavy, bucket_words)) == mined(table, least, longest, top)


def test_phrases_of_no_texts(texts):
    _, df = texts
    assert phrases.collocations(df.limit(0)).count() == 0


def test_each_phrase_has_one_owner(texts):
    """Before any sum over partitions, a phrase comes from one pivot only."""
    table, df = texts
    frequent, totals = phrases.frequent_phrases(df, 3)
    assert frequent.count() == frequent.select("lang", "phrase").distinct().count()
    assert {r.lang for r in totals.collect()} == {lang or "und" for _, lang in table}


def peak(run):
    """What ``run`` gives, and the most bytes that it holds in Python and Numpy at once."""
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_bucket_is_mined_in_memory_in_proportion_to_its_text():
    """60,000 fragments of 2.5 MB: counts as by brute force, in at most 16 bytes for each of theirs (49 when all phrases were held at once)."""
    rnd = random.Random(7)
    fragments = [([f"common{rnd.randrange(40)}" for _ in range(rnd.randrange(5))], f"pivot{rnd.randrange(30)}", [f"other{rnd.randrange(40)}" for _ in range(rnd.randrange(5))], rnd.randrange(1, 4)) for _ in range(60_000)]
    salted = lambda k: k % 10 == 0
    want, packs, size = Counter(), [], 0
    for k in range(60):
        part = fragments[k * 1000 : k * 1000 + 1000]
        part = [(a, f"dealt{p}" if salted(k) else p, b, n) for a, p, b, n in part]
        for a, p, b, n in part:
            w = [*a, p, *b]
            for i in range(len(a) + 1):
                for j in range(min(len(b) + 1, 5 - i)):
                    want[("de" if k % 2 else "en", " ".join(w[len(a) - i : len(a) + j + 1]), i + j + 1)] += n
        text = "".join(" ".join([*a, p, *b]) + "\n" for a, p, b, _ in part).encode()
        size += len(text)
        packs.append((0, "de" if k % 2 else "en", salted(k), phrases._packed(np.array([len(x[0]) for x in part]), np.array([x[3] for x in part]), text)))
    table = pa.Table.from_arrays([pa.array(x) for x in zip(*packs, strict=True)], ["bucket", "lang", "salted", "body"])
    phrases._word_hashes(np.frombuffer(b"a ", np.uint8), np.array([0, 2]))  # tables of powers, held by the process
    got, most = peak(lambda: list(phrases._mine(iter(table.to_batches(max_chunksize=7)), 20, 5)))
    found = [tuple(r.values()) for batch in got for r in batch.to_pylist()]
    assert sorted(found) == sorted((*key, n) for key, n in want.items() if n >= 20 or " dealt" in f" {key[1]}")
    assert most < 16 * size


def test_a_block_is_cut_into_words_in_memory_in_proportion_to_its_text():
    """A block of 3.6 MB: at most 24 bytes for each of its text (43 when every byte had its position and hash at once)."""
    text = " ".join(f"Word{k % 9973}{'.' * (k % 11 == 0)}" for k in range(400_000))
    texts, langs = pa.array([text]), pa.array(["en"]).dictionary_encode()
    list(phrases._blocks(pa.array(["a b"]), langs))
    (b,), most = peak(lambda: list(phrases._blocks(texts, langs)))
    want = re.findall(r"[^ .]+", text.lower())
    assert b.data.tobytes() == (" ".join(want) + " ").encode()
    assert len(np.unique(b.key)) == 9973 and (b.key[:9973] == b.key[9973:19946]).all()
    assert most < 24 * len(text)


@pytest.mark.parametrize("step", [1, 7, 1 << 18])
def test_spans_are_gathered_and_hashed_alike_whatever_the_step(monkeypatch, step):
    monkeypatch.setattr(phrases, "STEP", step)
    data = np.frombuffer(b"a bb ccc a " + b"long" * 50 + b" bb ", np.uint8)
    at = np.append(0, np.flatnonzero(data == 0x20) + 1)
    h = phrases._word_hashes(data, at)
    assert h[0] == h[3] and h[1] == h[5] and len(set(h.tolist())) == 4
    got, offs = phrases._gathered(data, np.array([9, 2, 0, 5, 11]), np.array([1, 2, 0, 3, 200]))
    assert got.tobytes() == b"abbccc" + b"long" * 50 and offs.tolist() == [0, 1, 3, 3, 6, 206]


# --- vectors ---------------------------------------------------------------------------------------------------------


def near(ids, vectors, least=0.95):
    fine = [i for i, v in enumerate(vectors) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    name, n = list(range(len(ids))), [0] * len(ids)

    def find(x):
        while name[x] != x:
            x = name[x]
        return x

    for size in {len(vectors[i]) for i in fine}:
        of = [i for i in fine if len(vectors[i]) == size]
        m = np.array([vectors[i] for i in of], float)
        m /= np.abs(m).max(axis=1)[:, None]
        m /= np.linalg.norm(m, axis=1)[:, None]
        link = m @ m.T >= least
        np.fill_diagonal(link, False)
        for a, b in zip(*np.nonzero(link), strict=True):
            n[of[a]] += 1
            name[find(of[a])] = find(of[b])
    smallest = {}
    for i, v in enumerate(ids):
        if v is not None:
            smallest[find(i)] = min(v, smallest.get(find(i), v))
    return sorted(repr((ids[i], n[i], smallest.get(find(i)), ids[i] == smallest.get(find(i)))) for i in range(len(ids)))


def planted():
    rng = np.random.default_rng(1)
    g = rng.normal(size=8)
    out = [(g + rng.normal(size=8) * 0.12 * (k % 4)).tolist() for k in range(200)]  # near copies, some of them just too far
    out += rng.normal(size=(150, 8)).tolist() + [list(map(float, range(1, 9)))] * 100
    out += [[float(np.cos(x)), float(np.sin(x)), *[0.0] * 6] for x in np.linspace(0, 6, 200)]  # a chain
    return out + [None, [], [0.0] * 8, [1.0, None, *[0.0] * 6], [float("nan")] * 8, [float("inf")] * 8, [1e300] * 8, [1e-300] * 8, [1.0, 1.0], [2.0, 2.0], [3.0]]


@pytest.mark.parametrize("leaf_rows", [16, 100, 8192])
def test_near_vectors(spark, leaf_rows):
    vectors = planted()
    ids = list(range(len(vectors)))
    ids[5], ids[7] = None, 6
    df = spark.createDataFrame(list(zip(ids, vectors, strict=True)), "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in CLASHING})
    assert rows(cover_tree.near_vectors(df, leaf_rows=leaf_rows)) == near(ids, vectors)


def test_near_vectors_of_none_or_one(spark):
    schema = "vec_id long, embedding array<float>"
    assert cover_tree.near_vectors(spark.createDataFrame([], schema)).count() == 0
    assert rows(cover_tree.near_vectors(spark.createDataFrame([(4, [1.0, 2.0]), (3, None)], schema))) == ["(3, 0, 3, True)", "(4, 0, 4, True)"]


def test_leaf_trees_cover_their_rows():
    rng = np.random.default_rng(2)
    m = np.vstack([rng.normal(size=(300, 6)), rng.normal(size=6) + rng.normal(size=(200, 6)) * 0.05])
    m /= np.linalg.norm(m, axis=1)[:, None]
    leaf = cover_tree.grow(np.arange(500), m, np.arccos(0.95))
    assert sorted(leaf.uid.tolist()) == list(range(500)) and len(leaf.begin[-1]) == 500
    for begin, radius in zip(leaf.begin, leaf.radius, strict=True):
        for a, b, r in zip(begin, [*begin[1:], 500], radius, strict=True):
            assert np.arccos(np.clip(leaf.m[a:b] @ leaf.m[a], -1, 1)).max() <= r + 1e-6
    for upper, lower in zip(leaf.begin[:-1], leaf.begin[1:], strict=True):
        assert set(upper) <= set(lower)  # nested: a centre stays one
