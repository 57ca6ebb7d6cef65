"""Secret scans by a trigram inverted index, in DataFrame operations alone.

Each rule is a regular expression. From it a Boolean query over trigrams is derived (``trigram_query``): what a
text must hold, in lower case, if the rule matches anywhere in it. The index holds postings (trigram, document)
for the trigrams of all queries; grouping the postings by document intersects them, and the rules whose query
holds are verified on the text. Rules without a mandatory trigram scan all texts.

Positions count code points. They follow from native functions: ``split`` gives what lies between the matches
of ``regexp_extract_all``, and running sums of both lengths give each match's start.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parse
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Strings that a part of an expression can stand for, before it counts as unknown.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """``pattern`` with the group whose value needs ``least`` characters (group 0: the whole match)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: Base kinds as their contract lists them (fixed values), then kinds of well-known public key formats.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)


def _needs(strings: frozenset[str]) -> object:
    """The query that one of these strings is in the text: True, a trigram, or ("and" | "or", queries)."""
    each = []
    for s in sorted(strings):
        s = s.lower()
        if len(s) < 3:
            return True
        each.append(_join("and", sorted({s[i : i + 3] for i in range(len(s) - 2)})))
    return _join("or", each)


def _join(how: str, parts: list) -> object:
    parts = list(dict.fromkeys(parts))
    if how == "and":
        parts = [p for p in parts if p is not True]
        if not parts:
            return True
    elif True in parts or not parts:
        return True
    return parts[0] if len(parts) == 1 else (how, tuple(parts))


def _strings(op, arg) -> frozenset[str] | None:
    """All strings that one piece stands for, if they are few; case is folded."""
    if op is sre.LITERAL:
        return frozenset([chr(arg).lower()])
    if op is sre.IN and arg[0][0] is not sre.NEGATE:
        chars = set()
        for kind, x in arg:
            if kind is sre.LITERAL:
                chars.add(chr(x).lower())
            elif kind is sre.RANGE and x[1] - x[0] < MOST_STRINGS:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return frozenset(chars) if len(chars) <= 8 else None
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] == 1 and arg[0] == 0:
        inner = _sequence(arg[2])[0]
        return None if inner is None else inner | {""}
    if op is sre.SUBPATTERN:
        return _sequence(arg[3])[0]
    if op is sre.BRANCH:
        each = [_sequence(x)[0] for x in arg[1]]
        return None if None in each else frozenset().union(*each)
    return None


def _sequence(pieces) -> tuple[frozenset[str] | None, object]:
    """Of a concatenation: all its strings, if few, and the query it needs."""
    exact, run, needs = True, frozenset([""]), []
    for op, arg in pieces:
        mine = _strings(op, arg)
        if mine is not None and len(mine) * len(run) <= MOST_STRINGS:
            run = frozenset(a + b for a, b in product(run, mine))
            continue
        needs.append(_needs(run))
        run = frozenset([""]) if mine is None else mine
        exact = False
        if mine is None:
            if op is sre.SUBPATTERN:
                needs.append(_sequence(arg[3])[1])
            elif op is sre.BRANCH:
                needs.append(_join("or", [_sequence(x)[1] for x in arg[1]]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                needs.append(_sequence(arg[2])[1])
    return (run if exact else None), _join("and", [*needs, _needs(run)])


def trigram_query(pattern: str) -> object:
    """The Boolean trigram query of a regular expression; True where nothing is mandatory."""
    return _sequence(sre_parse.parse(pattern))[1]


def _trigrams(query: object) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(_trigrams, query[1]))


def _holds(query: object, have: Column) -> Column:
    if isinstance(query, str):
        return F.array_contains(have, query)
    return reduce((lambda a, b: a & b) if query[0] == "and" else (lambda a, b: a | b), [_holds(q, have) for q in query[1]])


def build_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, doc_id, h) of ``docs(doc_id, h, text)`` for these trigrams, over lower-cased texts."""
    low = docs.select("doc_id", "h", F.lower("text").alias("low"))
    present = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)))
    return low.select(F.explode(present).alias("trigram"), "doc_id", "h")


def _verify(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Matches (doc_id, h, rule, start, end) of the rules named in ``rows(doc_id, h, text, rules)``."""
    size = lambda a: F.transform(a, lambda x: F.char_length(x))
    tried = [
        F.when(F.array_contains("rules", k), F.struct(
            F.lit(k).alias("rule"), size(F.split("text", r.pattern, -1)).alias("gaps"),
            size(F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))).alias("lens"),
            size(F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group))).alias("values"),
        ))
        for k, r in enumerate(rules)
    ]
    each = rows.select("doc_id", "h", F.explode(F.array_compact(F.array(*tried))).alias("t")).where(F.size("t.lens") > 0)
    each = each.select("doc_id", "h", "t.rule", F.posexplode(F.arrays_zip(F.slice("t.gaps", 1, F.size("t.lens")).alias("gap"), F.col("t.lens").alias("len"), F.col("t.values").alias("value"))).alias("i", "m"))
    until = Window.partitionBy("doc_id", "h", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.col("m.len")).over(until)
    each = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("m.len"))
    least = F.element_at(F.array(*(F.lit(r.least) for r in rules)), F.col("rule") + 1)
    return each.where(F.col("m.value") >= least).select("doc_id", "h", "rule", "start", "end")


def scan(docs: DataFrame, *, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """``(doc_id, h, rule, start, end)``: all matches, once for equal rows; ``h`` is the xxhash64 of the text, ``rule`` the rule's number."""
    queries = [trigram_query(r.pattern) for r in rules]
    full = [k for k, q in enumerate(queries) if q is True]
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = []
    if len(full) < len(rules):
        postings = build_index(docs, sorted(set().union(*map(_trigrams, queries))))
        have = postings.groupBy("doc_id", "h").agg(F.collect_set("trigram").alias("have"))
        named = F.array_compact(F.array(*(F.when(_holds(q, F.col("have")), F.lit(k)) for k, q in enumerate(queries) if q is not True)))
        candidates = have.select(F.col("doc_id").alias("id"), F.col("h").alias("of"), named.alias("rules")).where(F.size("rules") > 0)
        rows.append(docs.join(candidates, docs["doc_id"].eqNullSafe(candidates["id"]) & (docs["h"] == candidates["of"])).select("doc_id", "h", "text", "rules"))
    if full:
        hit = reduce(lambda a, b: a | b, [F.col("text").rlike(rules[k].pattern) for k in full])
        rows.append(docs.where(hit).select("doc_id", "h", "text", F.array(*map(F.lit, full)).alias("rules")))
    found = reduce(DataFrame.unionAll, [_verify(r.dropDuplicates(["doc_id", "h"]), rules) for r in rows])
    return found


def _joined(spans: Column, rules: tuple[Rule, ...], keep: int) -> Column:
    """kind:start:end, comma-joined, of the first ``keep`` rules."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    of = F.filter(spans, lambda s: s["rule"] < keep)
    return F.array_join(F.transform(of, lambda s: F.concat_ws(":", F.element_at(kinds, s["rule"] + 1), s["start"], s["end"])), ",")


def _with_spans(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``docs`` with ``spans``, sorted by start and then rule; empty where nothing is found."""
    found = scan(docs, rules=rules).groupBy(F.col("doc_id").alias("id"), F.col("h").alias("of")).agg(F.array_sort(F.collect_list(F.struct("start", "rule", "end"))).alias("spans"))
    docs = docs.withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = docs.join(found, docs["doc_id"].eqNullSafe(found["id"]) & (docs["h"] == found["of"]), "left").drop("id", "of", "h")
    return joined.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start: bigint, rule: int, end: bigint>>")))


def secret_report(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)`` for every row of ``docs(doc_id, text)``.

    Null texts are empty and hold nothing; equal rows have equal results; a null doc_id is a doc_id of its own.
    Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    rules = BASE_RULES + MORE_RULES
    found = _with_spans(docs.select("doc_id", "text"), rules)
    n = lambda k: F.size(F.filter("spans", lambda s: s["rule"] == k)).cast("long")
    base = _joined(F.col("spans"), rules, len(BASE_RULES))
    return found.select(
        "doc_id", *(n(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE_RULES)),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans"), rules, len(rules)).alias("spans"),
    )


def redact(docs: DataFrame, *, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mask`` (overlapping spans by one); other texts and columns stay."""
    keep = docs.columns
    others = [c for c in keep if c not in ("doc_id", "text")]
    found = _with_spans(docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *others).alias("row")), BASE_RULES + MORE_RULES)
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    piece = lambda a, s: F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mask))).otherwise(a["out"])
    cut = F.aggregate("spans", start, lambda a, s: F.struct(piece(a, s).alias("out"), F.greatest(a["at"], s["end"]).alias("at")))
    text = F.when(F.size("spans") == 0, F.col("text")).otherwise(F.concat(cut["out"], F.substring(F.col("text"), (cut["at"] + 1).cast("int"), F.char_length("text"))))
    return found.select("doc_id", text.alias("text"), "row").select(*(F.col(c) if c in ("doc_id", "text") else F.col(f"row.`{c}`") for c in keep))
