"""The operators on pages: urls, archives, main text."""

import hashlib
import struct

import pytest
import zstandard
from pyarrow import fs

from tracelake.llm import html_text, url_rules, warc
from tracelake.llm.scratch import Scratch

SCHEMA = "page_id long, url string, html string, digest string, rule string, tokens string"
BIG = "<p>" + "x" * 200 + "</p>"
PAGES = [
    (5, "http://a.example.org/es/1", BIG), (3, "http://B.Example.ORG/en/12?x#y", BIG), (9, "https://com/fr/", BIG), (9, "https://com/fr/", BIG), (1, None, None), (2, "no scheme", ""), (4, "http://x.com/de/1", "short"), (6, "http://y.com/de/2", "short"),
    (None, "http://net", BIG), (None, None, "é" * 60), (7, "ftp://U:p@h.net:8080?q=://z", "é" * 60), (8, "http://example.org", "<p>" + "y" * 300_000), (10, "a\r\nb://c d/e", "z"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "d", "r", "t") for p in PAGES], SCHEMA)


def test_archives(spark, pages):
    got = sorted(repr(tuple(r)) for r in warc.archive_round_trip(pages).collect())
    least = {}
    for i, _, h in PAGES:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            least[b] = min(i, least.get(b, i))
    want = []
    for i, _, h in PAGES:
        b = (h or "").encode()
        again = i is not None and b in least and i > least[b]
        want.append(repr((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", least[b] if again else None)))
    assert got == sorted(want)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_archive_form(spark, pages):
    manifest = warc.write_archives(pages.coalesce(1), Scratch(spark, "form"))
    (row,) = manifest.collect()
    store, place = fs.FileSystem.from_uri(row.path)
    raw = store.open_input_stream(place).read()
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == 0x184D2A5D and size > 0 and row.records == len(PAGES) and row.bytes == len(raw) - 8 - size
    d, at, n = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size])), 8 + size, 0
    while at < len(raw):  # each record is a frame of its own
        o = d.decompressobj()
        assert o.decompress(raw[at:]).startswith(b"WARC/1.1\r\n")
        at, n = len(raw) - len(o.unused_data), n + 1
    assert n == len(PAGES)


def test_archives_lie_where_hadoop_says(spark, pages, tmp_path):
    """A folder without scheme is one of the default file system, not of each executor's own disk."""
    manifest = warc.write_archives(pages, Scratch(spark, "there"), folder=f"{tmp_path}/w")
    assert all(r.path.startswith(f"file://{tmp_path}/w/") for r in manifest.collect())
    assert warc.read_archives(manifest).count() == pages.count()
    with pytest.raises(Exception, match="nowhere"):
        warc._qualified(spark, "nowhere://host/w")
    assert warc._qualified(spark, "/w") == "file:///w" and warc._qualified(spark, "file:/w") == "file:///w"


def test_urls(spark, pages):
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_rules.url_verdicts(pages).collect()}
    assert {
        (5, "a.example.org", "/es/1", "example.org/es/", "block"), (3, "b.example.org", "/en/12", "example.org/en/1", "block"), (9, "com", "/fr/", "com/fr/", "allow"), (1, "", "", None, "allow"), (2, "", "", None, "allow"), (4, "x.com", "/de/1", "com/de/", "block"),
        (None, "net", "", None, "allow"), (7, "U:p@h.net:8080".lower(), "", None, "allow"), (8, "example.org", "", None, "allow"), (10, "c d", "/e", None, "allow"),
    } <= got
    assert url_rules.url_verdicts(pages).count() == len(PAGES) and url_rules.url_verdicts(pages.limit(0)).count() == 0


def test_mined_rules_match_as_a_scan_does(spark, monkeypatch):
    rows = [(k, f"http://{h}.example.com/de/{k}") for k, h in enumerate(("pills-x", "shop") * 20)] + [(100 + k, f"http://{h}.example.com/fr/{k}") for k, h in enumerate(("news", "daily") * 20)]
    rows += [(200, "http://pills-x.example.net/en/1"), (201, "http://news.example.net/en/2"), (202, "http://other.net/")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    from pyspark.sql import functions as F

    t = df.select("page_id", "url", url_rules.host_of(F.col("url")).alias("host"), url_rules.path_of(F.col("url")).alias("path"))
    rule, verdict = url_rules.given_rule(F.col("host"), F.col("path"))
    t = t.select("*", verdict.alias("given"), url_rules.tokens_of(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    mined = url_rules.mine(t.where("given is not null").select("tokens", F.col("given").alias("verdict")))
    assert mined and all(c >= url_rules.CONFIDENCE for _, _, c, _ in mined)
    got = {r.url: r.mined for r in url_rules.judge(t.where("given is null").select("url", "tokens"), mined).collect()}
    monkeypatch.setattr(url_rules, "BROADCAST_CHARS", 0)
    assert got == {r.url: r.mined for r in url_rules.judge(t.where("given is null").select("url", "tokens"), mined, {"host:com": 9, "host:example": 8}).collect()}
    for r in t.where("given is null").collect():
        fit = [(c, s, len(a), v == "block", v) for a, v, c, s in mined if set(a) <= set(r.tokens)]
        assert got.get(r.url) == (max(fit)[-1] if fit else None)
    verdicts = {r.page_id: r.verdict for r in url_rules.url_verdicts(df).collect()}
    assert (verdicts[200], verdicts[201], verdicts[202]) == ("block", "allow", "allow")


def test_urls_are_mined_and_matched_whole(spark):
    """Telling tokens at the sixth segment, the fifth query key, the fifth host label; long paths in both verdicts cost no more."""
    path = "/".join(f"s{k}" for k in range(40))
    rows = [(k, f"http://n{k}.com/{('de', 'fr')[k % 2]}/{k}/a/b/c/{('casino', 'garden')[k % 2]}?a=1&b=2&c=3&d=4&{('win', 'read')[k % 2]}=5") for k in range(60)]
    rows += [(100 + k, f"http://{('bets', 'bees')[k % 2]}.r.q.p.com/{('de', 'fr')[k % 2]}/{path[: 20 + k]}") for k in range(100)]
    rows += [(300, "http://o.net/z/y/x/w/v/casino"), (301, "http://o.net/z/y/x/w/v/garden"), (302, "http://o.net/?z=1&y=2&x=3&w=4&win=5"), (303, "http://bets.w.x.y.net/"), (304, "http://o.net/z/y/x/w/v/u")]
    got = {r.page_id: r.verdict for r in url_rules.url_verdicts(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert [got[k] for k in range(300, 305)] == ["block", "allow", "block", "block", "allow"]


def test_mined_rules_are_all_rules(spark):
    import itertools
    import random

    rng = random.Random(5)
    rows = []
    for _ in range(400):
        t = {x for x in "abcdefg" if rng.random() < 0.6}
        t |= {"h"} if "a" in t else set()
        rows.append((sorted(t), "block" if len(t & {"a", "b", "c"}) + (rng.random() < 0.1) > 2 else "allow"))
    counts = lambda need, v=None: sum(need <= set(t) and v in (None, w) for t, w in rows)
    want = []
    for m in range(1, 9):
        for need in map(frozenset, itertools.combinations("abcdefgh", m)):
            n = counts(need)
            for v in ("allow", "block"):
                c = counts(need, v)
                if c >= 20 and c / n >= 0.9 and n < len(rows) and not any(a <= need and w == v and x >= c / n for a, w, x, _ in want):
                    want.append((need, v, c / n, c / len(rows)))
    got = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), support=0.05)
    assert want and any(len(a) > 2 for a, _, _, _ in want)
    assert sorted(got) == sorted((tuple(sorted(a)), v, c, s) for a, v, c, s in want)


def test_marginals_against_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    parent, depth, kind = np.array([-1, 0, 0, 1, 1, 2, -1, 6]), np.array([0, 1, 1, 2, 2, 2, 0, 1]), np.array([3, 2, 1, 0, 1, 2, 3, 1])
    x = rng.normal(size=(8, 5))
    m = html_text.Model(rng.normal(size=5), rng.normal(size=4))
    score, total = x @ m.node, np.zeros(8)
    whole = 0.0
    for y in itertools.product((-1, 1), repeat=8):
        y = np.array(y)
        w = np.exp((score * y / 2).sum() + sum(m.edge[kind[i]] * y[i] * y[parent[i]] for i in range(8) if parent[i] >= 0))
        whole += w
        total += w * (y > 0)
    assert np.allclose(html_text.marginals(x, parent, depth, kind, m), total / whole)


def test_main_text(spark, pages):
    model = html_text.train()
    held = html_text.labelled_pages(120, 99)
    right = sum(html_text.extract([p], model)[0] == " ".join(sorted(keep, key=p.index)) for p, keep in held)
    assert right >= 0.85 * len(held)
    page = '<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="ad">Buy</div><article><h1>Head &amp; shoulders</h1><p><b>One\n two.<br><p>Three&nbsp;&lt;four&gt; <a href="x">five</a>.</p></article><div class="comments"><p>First!</p></div><footer>&copy; me</footer></body></html>'
    assert html_text.extract([page, None, ""], model) == ["Head & shoulders One two. Three <four> five.", "", ""]
    assert html_text.extract(["<" * 5000, "<p " * 3000, '<p class="a>b'], model) == ["", "", "b"]
    hard = '<body><header><nav><a href="/">Home</a></nav></header><div id="cookie"><p>We use cookies.</p></div><article><header><h1>Title</h1></header><p>Body one.</p><aside class="related"><p>See also</p></aside><p>Body two with <a href="x">a link</a> inside.</p><form><input><button>Send</button></form></article><section id="comments"><h2>Comments</h2><p>Nice post</p></section><aside><p>Side</p></aside><footer><p>Foot</p></footer></body>'
    assert html_text.extract([hard], model) == ["Title Body one. Body two with a link inside."]
    got = html_text.main_texts(pages)
    assert got.count() == len(PAGES) and html_text.main_texts(pages.limit(0)).count() == 0
    assert all(r.n_chars == len(r.text) for r in got.collect())


def test_main_text_around_icons_formulas_and_deep_nests():
    model = html_text.train()
    page = "<body><nav><ul><li><a href='/'>{}Home</a></li></ul></nav><article><h1>Title</h1><p>Body {} one of some words.</p><p>Body two of some words.</p></article><footer><p>Foot</p></footer></body>"
    text = "Title Body one of some words. Body two of some words."
    for part in ('<svg class="icon"/>', "<svg><use href='#a'/>", "<svg><text>no</text><svg/><svg><g/></svg><text>no</text></svg>", "<math/>", "<object>", "<canvas>", "<svg-icon></svg-icon>", "<template><object></template>", "<noscript><p>no</p></noscript>"):
        for where in ((part, ""), ("", part)):
            assert html_text.extract([page.format(*where)], model) == [text], where
    assert html_text.extract([page.format("", "<math><mi>x</mi><mo>=</mo><mn>1</mn></math>")], model) == [text.replace("Body one", "Body x=1 one")]
    t = html_text.parse("<main>" + "<div>" * 1000 + "deep" + "</div>" * 1000 + "<p>after</p></main><p>last</p>")
    at = {text: t.tag[e] if t.tag[e] != "p" else (t.tag[t.parent[e]], t.depth[e]) for e, _, text in t.pieces}
    assert at == {"deep": "div", "after": ("main", 2), "last": ("html", 1)}


PLAIN = '<nav><ul><li><a href="/">Home</a></li></ul></nav><article><h1>A title</h1><p>First words of the text.</p><ul><li>One item<li>Two</ul><p>Last words.</p></article><footer><p>Imprint</p></footer>'


@pytest.mark.parametrize("depth", [0, 10, 399, 401, 5000])
def test_text_does_not_depend_on_depth(depth):
    model = html_text.train()
    for tag in ("div", "section"):
        page = "<body>" + f"<{tag}>" * depth + PLAIN + f"</{tag}>" * depth + "</body>"
        assert html_text.extract([page], model) == ["A title First words of the text. One item Two Last words."], tag
    inner = PLAIN.replace("First", "<b>" * depth + "First" + "</b>" * depth)
    assert html_text.extract([f"<body>{inner}</body>"], model) == ["A title First words of the text. One item Two Last words."]


def test_deep_pages_take_time_in_proportion():
    """Open elements are found by tag, not by walking the stack."""
    import time

    took = []
    for n in (20_000, 80_000):
        began = time.process_time()
        html_text.parse("<p><b><i>x" * n + "<div><li>y" * n + "</section></b>" * n)
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 1


def test_given_pages(spark):
    import re
    from html import unescape

    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_text.main_texts(df).collect()}
    for r in df.collect():
        a = re.search(r"(?s)<article>(.*?)</article>", r.html)[1].replace("<b>", "").replace("</b>", "")
        assert got[r.page_id] == " ".join(x for x in (" ".join(unescape(p).split()) for p in re.split("</?(?:p|h1|br)>", a)) if x)
