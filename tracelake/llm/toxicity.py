"""Toxicity: a Levenshtein automaton walked along a lexicon trie, and scores of the windows around its hits.

``fit`` learns from at most ``LABELLED_ROWS`` labelled rows (those whose id hashes lowest): Spark counts in how many
toxic and clean texts each word and word beginning stands, and those whose log odds are high and surely above none
make the lexicon, whole words and stems, however small their share of the toxic texts. The lexicon is a trie; the automaton of a token's edits is walked along it,
as sets of (trie node, edits used) that are made deterministic as they are met. A token hits with no, one or two
edits, by the length of the term.

Every hit is judged in its window: quotation marks on both sides make it quoted, another hit or a word of
address makes it abuse. Counts of hits by kind and window are the features of a logistic regression.
Scoring is one pass over the texts with nothing shuffled; labels, lang, source and doc_id are no inputs.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch

#: Bound: labelled rows to learn from. It bounds the lexicon too.
LABELLED_ROWS = 20_000
#: A term needs this log odds ratio, so many toxic texts, and a ratio so many standard errors above none (one sided, 1 %).
LOG_ODDS, LEAST_TEXTS, ERRORS = 3.5, 3, 2.326
#: Tokens on each side of a hit that make its window.
WINDOW = 10
#: Tokens: runs of letters and digits; quotation marks count by themselves.
TOKEN = re.compile("[^\\W_]+|[\"“”„«»]")
QUOTES = frozenset("\"“”„«»")
#: Words of address in the four languages of the corpus (fixed values).
ADDRESS = frozenset("you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta vous votre usted tú ti vosotros eres".split())
#: Remembered tokens; when full, memory starts anew.
REMEMBERED = 150_000


def edits_for(length: int) -> int:
    return 0 if length < 5 else 1 if length < 9 else 2


class Lexicon:
    """A trie of terms and the lazily determinised automaton of all tokens within a few edits of one."""

    def __init__(self, terms: list[tuple[str, bool]]) -> None:
        self.terms, self.next, self.end, self.room = terms, [{}], [None], [0]
        for k, (term, _) in enumerate(terms):
            at = 0
            for c in term:
                self.room[at] = max(self.room[at], edits_for(len(term)))
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.end.append(None)
                    self.room.append(0)
                at = self.next[at][c]
            self.room[at] = max(self.room[at], edits_for(len(term)))
            self.end[at] = k
        self.ids: dict[frozenset, int] = {}
        self.sets: list[dict[int, int]] = []
        self.moves: list[dict[str, int]] = []
        self.best: list[tuple[tuple[int, int] | None, tuple[int, int] | None]] = []
        self.start = self._state({0: 0})
        self.dead = self._state({})

    def _state(self, nodes: dict[int, int]) -> int:
        """The state of these nodes with the least edits used, closed over letters that a token leaves out."""
        todo = list(nodes)
        while todo:
            at = todo.pop()
            e = nodes[at] + 1
            for child in self.next[at].values():
                if e <= self.room[child] and e < nodes.get(child, 9):
                    nodes[child] = e
                    todo.append(child)
        key = frozenset(nodes.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(nodes)
            self.moves.append({})
            ends = sorted((e, self.end[n]) for n, e in nodes.items() if self.end[n] is not None and e <= edits_for(len(self.terms[self.end[n]][0])))
            word = next((x for x in ends), None)
            stem = next((x for x in ends if self.terms[x[1]][1]), None)
            self.best.append((word, stem))
        return self.ids[key]

    def step(self, state: int, c: str) -> int:
        to = self.moves[state].get(c)
        if to is None:
            nodes: dict[int, int] = {}
            for at, e in self.sets[state].items():
                if e + 1 <= self.room[at]:  # an extra letter
                    nodes[at] = min(nodes.get(at, 9), e + 1)
                for x, child in self.next[at].items():
                    cost = e + (x != c)
                    if cost <= self.room[child]:
                        nodes[child] = min(nodes.get(child, 9), cost)
            to = self.moves[state][c] = self._state(nodes)
        return to

    def find(self, token: str) -> tuple[int, int] | None:
        """(edits, term) of the nearest term that the token is, or that it begins with if the term is a stem."""
        state, best = self.start, None
        for c in token:
            state = self.step(state, c)
            if state == self.dead:
                return best
            stem = self.best[state][1]
            if stem is not None and (best is None or stem < best):
                best = stem
        word = self.best[state][0]
        return word if word is not None and (best is None or word < best) else best


@dataclass
class Model:
    terms: list[tuple[str, bool]]
    weights: list[float]  # of the terms: log odds
    coef: list[float]  # of the features, the constant last


FEATURES = ("exact", "one", "two", "stem", "stem_near", "quoted", "abuse", "addressed", "close", "weight", "share", "any")


class Scorer:
    def __init__(self, model: Model) -> None:
        self.lexicon, self.model, self.known = Lexicon(model.terms), model, {}

    def hits(self, tokens: list[str]) -> list[tuple[int, int, int]]:
        known, find = self.known, self.lexicon.find
        if len(known) > REMEMBERED:
            known.clear()
        out = []
        for i, t in enumerate(tokens):
            try:
                h = known[t]
            except KeyError:
                h = known[t] = find(t)
            if h is not None:
                out.append((i, *h))
        return out

    def features(self, text: str | None) -> list[float]:
        tokens = TOKEN.findall((text or "").lower())
        hits = self.hits(tokens)
        if not hits:
            return [0.0] * len(FEATURES)
        n: dict[str, float] = defaultdict(float)
        at = [h[0] for h in hits]
        for k, (i, edits, term) in enumerate(hits):
            stem = self.model.terms[term][1]
            n[("stem" if edits == 0 else "stem_near") if stem else ("exact", "one", "two")[edits]] += 1
            before, after = tokens[max(0, i - WINDOW) : i], tokens[i + 1 : i + 1 + WINDOW]
            quoted = bool(QUOTES.intersection(before)) and bool(QUOTES.intersection(after))
            close = (k > 0 and i - at[k - 1] <= WINDOW) or (k + 1 < len(at) and at[k + 1] - i <= WINDOW)
            n["quoted"] += quoted
            n["abuse"] += not quoted and edits == 0
            n["close"] += close
            n["addressed"] += not ADDRESS.isdisjoint(before) or not ADDRESS.isdisjoint(after)
            n["weight"] += self.model.weights[term] / (1 + edits) ** 2
        n["share"] = 100 * len(hits) / len(tokens)
        n["any"] = np.e - 1
        return [float(np.log1p(n[x])) for x in FEATURES]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts of each label in which words (a trailing $) and beginnings of words stand, summed within a task."""
    toxic, clean = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch["text"], batch["toxic"], strict=True):
            seen = set(TOKEN.findall((text or "").lower()))
            terms = {w[:n] for w in seen for n in range(3, min(9, len(w) + 1))}
            (toxic if label else clean).update(terms | {w + "$" for w in seen if len(w) > 2})
    keys = list(toxic.keys() | clean.keys())
    for a in range(0, len(keys), 50_000):
        k = keys[a : a + 50_000]
        yield pd.DataFrame({"term": k, "bad": [toxic[x] for x in k], "good": [clean[x] for x in k]})


def choose_terms(rows: list[tuple[str, int, float]]) -> list[tuple[str, bool, float]]:
    """(term, stem, weight) from (term, toxic texts, log odds): a stem where it covers clearly more texts than what it begins."""
    bad = {t: (n, w) for t, n, w in rows}
    longest: dict[str, int] = defaultdict(int)  # toxic texts of the widest term that starts with a beginning
    for t, (n, _) in bad.items():
        body = t.rstrip("$")
        for k in range(3, len(body) + (t[-1] == "$")):
            longest[body[:k]] = max(longest[body[:k]], n)
    stems = {t for t, (n, _) in bad.items() if t[-1] != "$" and n >= 1.5 * longest[t]}
    inside = lambda body: any(body[:k] in stems for k in range(3, len(body)))
    out = [(t.rstrip("$"), t[-1] != "$", w, n) for t, (n, w) in bad.items() if (t in stems and not inside(t)) or (t[-1] == "$" and not (t[:-1] in stems or inside(t[:-1])))]
    out.sort(key=lambda x: (-x[3] * x[2], x[0]))
    return [x[:3] for x in out]


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients by Newton steps with a ridge; the constant, last, is free."""
    x = np.column_stack([x, np.ones(len(x))])
    ridge = np.diag([1.0] * (x.shape[1] - 1) + [1e-6])
    b = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from rows of ``labels(doc_id, toxic)`` that are not held out, at most ``LABELLED_ROWS`` of them.

    Rows with a null label or id are left out; of an id's several labels the largest counts. Without labels of
    both kinds the lexicon is empty and the score the share of toxic labels (0.5 without any).
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_ROWS).collect()
    y = {r.doc_id: r.toxic for r in chosen}
    n_bad = sum(y.values())
    if not 0 < n_bad < len(y):
        share = (n_bad + 0.5) / (len(y) + 1)
        return Model([], [], [0.0] * len(FEATURES) + [float(np.log(share / (1 - share)))])
    spark = docs.sparkSession
    known = F.broadcast(spark.createDataFrame(pd.DataFrame({"doc_id": list(y), "toxic": list(y.values())}), "doc_id long, toxic int"))
    texts = Scratch(spark, "toxicity").keep(docs.select("doc_id", "text").join(known, "doc_id"), "labelled")
    counts = texts.select("text", "toxic").mapInPandas(_terms, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (n_bad + 1)) - F.log((F.col("good") + 0.5) / (len(y) - n_bad + 1))
    error = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5) - 1 / (n_bad + 1) - 1 / (len(y) - n_bad + 1))
    found = counts.where(F.col("bad") >= LEAST_TEXTS).select("term", "bad", odds.alias("odds"), error.alias("error"))
    found = found.where((F.col("odds") >= LOG_ODDS) & (F.col("odds") >= ERRORS * F.col("error"))).orderBy(F.col("bad").desc(), "term").collect()
    terms = choose_terms([(r.term, r.bad, r.odds) for r in found])
    model = Model([t[:2] for t in terms], [t[2] for t in terms], [])

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "x": [scorer.features(t) for t in batch["text"]]})

    rows = texts.select("text", "toxic").mapInPandas(measure, "toxic int, x array<double>").toPandas()
    if not len(rows):
        return Model([], [], [0.0] * len(FEATURES) + [0.0])
    order = np.lexsort(np.stack(rows["x"]).T)  # the same sums whatever the order of rows
    model.coef = _logistic(np.stack(rows["x"])[order], rows["toxic"].to_numpy(float)[order]).tolist()
    return model


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a score (0 to 1); null and empty texts have the score of a text without hits. Every column but one of that name stays."""
    docs = docs.drop(name)
    coef = np.array(model.coef)

    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            x = np.array([scorer.features(t) for t in batch.column(text_at).to_pylist()]).reshape(batch.num_rows, len(FEATURES))
            score = 1 / (1 + np.exp(-np.clip(x @ coef[:-1] + coef[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``. Repeated rows have equal scores; a null doc_id is not held out."""
    scored = with_score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
