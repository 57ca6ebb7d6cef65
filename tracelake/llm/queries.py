"""The queries ``opN_<name>`` with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .cover_tree import near_vectors
from .decontaminate import contamination_report
from .html_text import main_texts
from .jaccard_join import jaccard_components
from .media_chunks import media_report
from .mixing import mix_report
from .phrases import collocations
from .prefix_trie import trie_report
from .repeated_bytes import remove_repeats
from .secret_scan import secret_report
from .toxicity import toxicity_report
from .url_rules import url_verdicts
from .warc import archive_round_trip

Query = Callable[[SparkSession, str], DataFrame]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_report(_docs(spark, sf_dir))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_docs(spark, sf_dir), words_per_shingle=5, percent=80)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_docs(spark, sf_dir), length=400).drop("kept", "spans")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(_docs(spark, sf_dir))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(_docs(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_docs(spark, sf_dir), least=100, longest=5, top=2000)


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.95)


#: Words are lower-cased over A-Z alone; windows are joined by a byte that no word holds.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP8_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS p
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS p FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT dw.r, dw.n, dw.i, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.p = bw.p),
cov AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(cov.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(cov.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov ON d.r = cov.r LEFT JOIN its ON d.r = its.r
"""


_ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
#: kind, pattern, group of the value, least length of it; positions are sums of the lengths between and of the matches.
_RULES = [
    ("assign", _ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1), ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1), ("google", "AIza[A-Za-z0-9_-]{35}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1), ("pem", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 1),
]
OP10_SQL = (
    "WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), m AS ("
    + " UNION ALL ".join(
        f"SELECT r, {k} AS k, '{kind}' AS kind, regexp_split_to_array(t, '{p}') AS g, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {group}) AS v, {least} AS least FROM d WHERE regexp_matches(t, '{p}')"
        for k, (kind, p, group, least) in enumerate(_RULES)
    )
    + """),
e AS (SELECT r, k, kind, least, unnest(range(1, len(m) + 1)) AS i, g, m, v FROM m),
p AS (SELECT r, k, kind, sum(length(g[i]) + length(m[i])) OVER (PARTITION BY r, k ORDER BY i) AS e, length(m[i]) AS n, length(v[i]) AS vn, least FROM e),
s AS (SELECT r, k, kind, CAST(e - n AS BIGINT) AS a, kind || ':' || CAST(CAST(e - n AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(e AS BIGINT) AS VARCHAR) AS x FROM p WHERE vn >= least),
a AS (SELECT r, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2,
      string_agg(x, ',' ORDER BY a, k) FILTER (k < 3) AS base, string_agg(x, ',' ORDER BY a, k) AS spans FROM s GROUP BY r)
SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a ON d.r = a.r
"""
)


OP7_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) END AS least FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > least THEN least END AS refers_to
FROM f
"""

OP3_SQL = r"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
b AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn FROM s GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][turn + 1] AS DOUBLE) AS weight, source_size * 3 AS most FROM b),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w),
m AS (SELECT arg_min(lv, most / weight) FILTER (lv * weight <= most) AS level, CAST(sum(source_size) AS DOUBLE) AS total FROM l),
t AS (SELECT source, turn, source_size, least(CAST(most AS DOUBLE), level * weight) AS target, CAST(floor(least(CAST(most AS DOUBLE), level * weight) + 0.5) AS BIGINT) AS quota, total FROM l, m),
d AS (SELECT s.*, t.turn, t.source_size, t.target, t.quota, t.total, CAST(sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS BIGINT) AS before,
      CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS passes FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, least(greatest(quota - passes * source_size - before, 0), size) AS rest FROM d),
f AS (SELECT *, passes * size + rest AS taken, CASE WHEN size > 0 AND (passes > 0 OR rest > 0) THEN (before + (CASE WHEN passes > 0 THEN size ELSE rest END) / 2.0) / quota END AS u FROM r),
k AS (SELECT *, CASE turn WHEN 0 THEN CASE WHEN u < 0.625 THEN u * 2 / (sqrt(u * -2.0 + 2.25) + 1.5) ELSE (u - 0.625) * 2 / (sqrt((u - 0.625) * -2.0 + 1.0) + 1.0) + 0.5 END
      WHEN 1 THEN u WHEN 2 THEN CASE WHEN u < 0.375 THEN u * 2 / (sqrt(u * 2.0 + 0.25) + 0.5) ELSE (u - 0.375) * 2 / (sqrt((u - 0.375) * 2.0 + 1.0) + 1.0) + 0.5 END END AS moment FROM f)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken, CAST(floor(moment * total) AS BIGINT) AS position FROM k
"""


#: The checksum of the decimal id byte by byte; a prefix is the text of its turns' digests, 32 letters each.
OP11_SQL = r"""
WITH o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n,
            md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS t, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS words FROM conversations WHERE conv_id IS NOT NULL),
bytes AS (SELECT c, n, c - c % 20 AS base, list_transform(range(1, length(CAST(c AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(c AS VARCHAR), i, 1)) AS BIGINT)) AS b FROM o WHERE k = 1),
crc AS (SELECT c, n, base, xor(list_reduce(b, lambda x, y: xor(x >> 8, list_reduce(range(8), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(x, y) & 255)), CAST(4294967295 AS BIGINT)), 4294967295) % 4 AS h FROM bytes),
v AS (SELECT crc.c, crc.base, crc.h, least(crc.h, coalesce(b.n, 0)) AS m, least(crc.h, coalesce(b.n, 0)) + greatest(0, crc.n - crc.h) AS len FROM crc LEFT JOIN crc AS b ON b.c = crc.base),
r AS (SELECT v.c, o.k AS d, o.t, o.words FROM v JOIN o ON o.c = v.base AND o.k <= v.m UNION ALL SELECT v.c, v.m + o.k - v.h, o.t, o.words FROM v JOIN o ON o.c = v.c AND o.k > v.h),
p AS (SELECT c, d, words, string_agg(t, '') OVER (PARTITION BY c ORDER BY d) AS key FROM r UNION ALL SELECT c, 0, 0, '' FROM v),
nd AS (SELECT p.key, p.d, count(*) AS n, min(p.c) AS c, any_value(words) AS words, sha256(coalesce(string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) FILTER (v.len = p.d), '')) AS ends FROM p JOIN v ON v.c = p.c GROUP BY p.key, p.d),
kid AS (SELECT substr(key, 1, length(key) - 32) AS key, count(*) AS n FROM nd WHERE d > 0 GROUP BY 1),
own AS (SELECT nd.*, coalesce(kid.n, 0) AS kids, (nd.n - 1) * words AS saved FROM nd LEFT JOIN kid ON kid.key = nd.key),
up AS (SELECT substr(key, 1, 32 * i) AS key, CASE WHEN kids = 0 THEN 1 ELSE 0 END AS leaf, saved FROM (SELECT *, unnest(range(0, d + 1)) AS i FROM own)),
su AS (SELECT key, sum(leaf) AS leaves, sum(saved) AS saved FROM up GROUP BY key)
SELECT own.c AS conv_id, CAST(own.d AS BIGINT) AS depth, par.c AS parent_conv_id, CAST(own.n AS BIGINT) AS n_convs, CAST(own.kids AS BIGINT) AS n_children, CAST(su.leaves AS BIGINT) AS n_leaves, CAST(su.saved AS BIGINT) AS saved_tokens, own.ends AS ends_sha256
FROM own JOIN su ON su.key = own.key LEFT JOIN nd AS par ON own.d > 0 AND par.key = substr(own.key, 1, length(own.key) - 32)
"""

OP12_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) AS ks(k) WHERE len(w) >= k)),
f AS (SELECT lang, phrase, CAST(k AS INTEGER) AS k, count(*) AS f FROM g GROUP BY lang, phrase, k HAVING count(*) >= 100),
s AS (SELECT *, string_split(phrase, ' ') AS w FROM f),
kept AS (SELECT * FROM s WHERE k >= 2 AND NOT EXISTS (SELECT 1 FROM s AS o WHERE o.lang = s.lang AND o.k > s.k AND o.f >= s.f AND contains(' ' || o.phrase || ' ', ' ' || s.phrase || ' '))),
c AS (SELECT lang, phrase, f, w, k, unnest(range(1, k)) AS cut FROM kept),
sc AS (SELECT c.lang, c.phrase, c.f AS a, c.cut, x.f AS l, y.f AS r, n.n, (CAST(1000 AS HUGEINT) * c.f * n.n) // (CAST(x.f AS HUGEINT) * y.f) AS score
       FROM c JOIN n ON n.lang = c.lang JOIN f AS x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(c.w, 1, c.cut), ' ')
       JOIN f AS y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(c.w, c.cut + 1, c.k), ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS best FROM sc),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE best = 1)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 2000
"""


def queries() -> dict[str, Query]:
    all_ = (op1_media_chunks, op2_jaccard_join, op3_mixing, op4_toxicity, op5_repeated_bytes, op6_url_rules, op7_warc, op8_decontaminate, op9_html_text, op10_secret_scan, op11_prefix_trie, op12_phrases, op13_near_vectors)
    return {f.__name__: f for f in all_}


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": OP3_SQL, "op7_warc": OP7_SQL, "op8_decontaminate": OP8_SQL, "op10_secret_scan": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op12_phrases": OP12_SQL}
