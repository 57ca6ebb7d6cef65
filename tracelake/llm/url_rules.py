"""URL filters: given host and path rules, then association rules mined by FP-growth.

Where one of the given rules fits, the longest decides. The urls they decide are also the labelled ones: a url is
a transaction of tokens (all host labels and their parts, path segments, extension, query keys) with its verdict, and
FP-growth, dealt out by the rarest token of a combination, mines those that go with a verdict. Rules of enough support
and confidence stay, less those that hold a smaller rule of the same verdict and no less confidence. Growth ends where
only such rules could follow: where one verdict is left, and at tokens that all urls of a combination have (of a path
and its beginnings one is grown), so urls need not be cut. An inverted index holds each
rule under its rarest token; a url looks up its tokens there and keeps the rules all of whose tokens it has. The
most confident of them decides, then the larger support, then the larger combination; without any, the url is allowed.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, start of the path), fixed values.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
SUPPORT, CONFIDENCE = 0.005, 0.9
#: A combination needs this many urls, however few there are.
LEAST_URLS = 8
#: An index of the rules up to this size is broadcast; a larger one is joined by shuffles.
BROADCAST_CHARS = 8 << 20


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def given_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a url, each marked with where it stands."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    parts = F.filter(F.flatten(F.transform(labels, lambda x: F.split(x, "[-_]"))), lambda x: F.length(x) > 1)
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    dirs = F.transform(segments, lambda x, i: F.concat(F.lit("dir"), i, F.lit(":"), F.regexp_replace(x, "[0-9]+", "0")))
    kind = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("key:"), F.substring_index(x, "=", 1)))
    mark = lambda c, m: F.transform(c, lambda x: F.concat(F.lit(m), x))
    return F.array_distinct(F.concat(mark(F.reverse(labels), "host:"), mark(F.reverse(parts), "part:"), dirs, F.when(kind != "", F.array(F.concat(F.lit("kind:"), kind))).otherwise(F.array().cast("array<string>")), keys))


def grow(item: int, rows: list[tuple[tuple[int, ...], str, int]], least: int, confidence: float) -> list[tuple[tuple[int, ...], str, int, int]]:
    """(combination, verdict, urls of both, urls of the combination) of those whose rarest token is ``item``.

    ``rows`` are the urls that have it: their more frequent tokens (lower numbers, ascending), verdict, and how many they are.
    """
    out = []

    def visit(found: tuple[int, ...], rows: list[tuple[tuple[int, ...], str, int]], best: dict[str, float]) -> None:
        by: Counter = Counter()
        for _, v, n in rows:
            by[v] += n
        total, best = by.total(), dict(best)
        for v, n in by.items():
            if n >= least and n / total >= confidence and n / total > best.get(v, 0):
                best[v] = n / total
                out.append((found, v, n, total))
        if len(by) == 1:
            return
        counts: dict[int, Counter] = defaultdict(Counter)
        for items, v, n in rows:
            for x in items:
                counts[x][v] += n
        grown = {x for x, c in counts.items() if max(c.values()) >= least and c.total() < total}
        for x in grown:
            within: Counter = Counter()
            for items, v, n in rows:
                if x in items:
                    within[tuple(y for y in items if y < x and y in grown), v] += n
            visit((x, *found), [(*k, n) for k, n in within.items()], best)

    visit((item,), rows, {})
    return out


def mine(labelled: DataFrame, *, support: float = SUPPORT, confidence: float = CONFIDENCE) -> list[tuple[tuple[str, ...], str, float, float]]:
    """Pruned rules (tokens, verdict, confidence, support) of ``labelled(tokens, verdict)``."""
    return mine_counted(labelled, support, confidence)[0]


def mine_counted(labelled: DataFrame, support: float, confidence: float) -> tuple[list[tuple[tuple[str, ...], str, float, float]], dict[str, int]]:
    """The rules, and in how many labelled urls each of their tokens stands.

    Their number is bounded by the support, not by the rows. Tokens that stand in every labelled url say nothing
    and are left out first, and so are those rarer than the support. A token of a single verdict is a rule that no larger one betters.
    """
    n = labelled.count()
    if n < LEAST_URLS:
        return [], {}
    least = max(LEAST_URLS, math.ceil(support * n))
    counts = labelled.select("verdict", F.explode("tokens").alias("t")).groupBy("t", "verdict").count()
    counts = counts.groupBy("t").agg(F.sum("count").alias("n"), F.max("count").alias("most"), F.max_by("verdict", "count").alias("verdict")).where((F.col("most") >= least) & (F.col("n") < n))
    often = counts.collect()  # at most tokens-per-url / support many
    raw = [(frozenset([r.t]), r.verdict, 1.0, r.n / n) for r in often if r.most == r.n]
    names = [r.t for r in sorted(often, key=lambda r: (-r.n, r.t)) if r.most < r.n]
    if names:
        number = {t: k for k, t in enumerate(names)}

        def patterns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """The mixed tokens of each url by number, summed within a task."""
            for batch in batches:
                seen = Counter((tuple(sorted(number[t] for t in tokens if t in number)), v) for tokens, v in zip(batch["tokens"], batch["verdict"], strict=True))
                yield pd.DataFrame({"items": [list(k[0]) for k in seen], "verdict": [k[1] for k in seen], "n": list(seen.values())})

        def combinations(part: pd.DataFrame) -> pd.DataFrame:
            found = grow(int(part["item"].iloc[0]), [(tuple(i), v, k) for i, v, k in zip(part["before"], part["verdict"], part["n"].tolist(), strict=True)], least, confidence)
            return pd.DataFrame(found, columns=["need", "verdict", "n", "total"])

        seen = labelled.select("tokens", "verdict").mapInPandas(patterns, "items array<int>, verdict string, n long").groupBy("items", "verdict").agg(F.sum("n").alias("n"))
        seen = seen.select("verdict", "n", "items", F.posexplode("items").alias("at", "item")).select("item", F.slice("items", 1, F.col("at")).alias("before"), "verdict", "n")
        seen = seen.groupBy("item", "before", "verdict").agg(F.sum("n").alias("n"))
        found = seen.groupBy("item").applyInPandas(combinations, "need array<int>, verdict string, n long, total long")
        raw += [(frozenset(names[k] for k in r.need), r.verdict, r.n / r.total, r.n / n) for r in found.collect()]
    raw.sort(key=lambda r: (len(r[0]), sorted(r[0]), r[1]))
    kept: dict[str, list[tuple[frozenset, str, float, float]]] = defaultdict(list)  # by a token of theirs
    for r in raw:
        if not any(k[1] == r[1] and k[0] <= r[0] and k[2] >= r[2] for t in r[0] for k in kept.get(t, ())):
            kept[min(r[0])].append(r)
    return [(tuple(sorted(a)), v, c, s) for rules in kept.values() for a, v, c, s in rules], {r.t: r.n for r in often}


def judge(urls: DataFrame, mined: list[tuple[tuple[str, ...], str, float, float]], counts: dict[str, int] | None = None) -> DataFrame:
    """``urls(url, tokens)`` with the verdict of the mined rules, null without one, by an inverted index of the rules.

    A rule is listed under its token of the least count, whichever that is without ``counts``.
    """
    counts = counts or {}
    spark = urls.sparkSession
    if not mined:
        return urls.select("url", F.lit(None).cast("string").alias("mined"))
    index = spark.createDataFrame([(min(a, key=lambda t: (counts.get(t, 0), t)), list(a), v, c, s) for a, v, c, s in mined], "token string, need array<string>, verdict string, confidence double, support double")
    if sum(len(t) + 16 for a, *_ in mined for t in a) <= BROADCAST_CHARS:
        index = F.broadcast(index)
    found = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    found = found.where(F.forall("need", lambda x: F.array_contains(F.col("tokens"), x)))
    best = F.max_by("verdict", F.struct("confidence", "support", F.size("need"), F.when(F.col("verdict") == "block", 1).otherwise(0)))
    return found.groupBy("url").agg(best.alias("mined"))


def url_verdicts(pages: DataFrame, *, rules=RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row of ``pages(page_id, url)``.

    A null url, and one without ``://``, has an empty host and path, no tokens, and is allowed. Equal urls have equal
    verdicts; repeated rows stay. An empty table gives an empty result. Other columns are ignored.
    """
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = given_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("given"))
    urls = rows.where("host <> ''").select("url", "host", "path", "given").withColumn("tokens", tokens_of(F.col("url"), F.col("host"), F.col("path")))
    mined, counts = mine_counted(urls.where("given is not null").select("tokens", F.col("given").alias("verdict")), support, confidence)
    judged = judge(urls.where("given is null").select("url", "tokens").dropDuplicates(["url"]), mined, counts)
    return rows.join(judged, "url", "left").select("page_id", "host", "path", "rule", F.coalesce("given", "mined", F.lit("allow")).alias("verdict"))
