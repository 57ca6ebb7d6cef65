"""Main text of web pages: a tree-structured graphical model over the DOM.

Every element is content or not. Its own evidence (tag, words of class and id, text and link density under it) gives
a node potential, and each parent-child edge a potential for agreeing, by the kind of the child; both are learned
together from labelled pages, by greatest likelihood. Sum-product
messages go upward from the leaves and downward from the root, which on a tree yields exact marginals. Text of an
element whose marginal says content is kept, block by block in page order. Messages of a whole batch of pages are
computed together, depth by depth.

No table holds labelled pages, so ``labelled_pages`` makes them: seeded page layouts whose content is known.
"""

from __future__ import annotations

import bisect
import functools
import html
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts of a page: what has no text, scripts and styles (without end tag: to the end of the page, as in HTML), tags, text (tag names: fixed values of HTML).
_PART = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(script|style)(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*?>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)>|([^<]+|<)",
    re.S | re.I,
)
#: Elements whose content is left out up to their end tag (without one only the start tag goes); those that may hold their like.
LEFT_OUT = frozenset("template noscript iframe svg canvas object title".split())
NESTED = frozenset("template svg canvas object".split())
_TAG_NAMED = {x: re.compile(rf"<(/?){x}(?=[\s/>])([^>]*)>", re.I) for x in LEFT_OUT}
_ATTR = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var"
                   " math mi mn mo ms mtext mspace mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd mlabeledtr mstyle mpadded mphantom menclose mfenced merror mmultiscripts mprescripts none semantics annotation annotation-xml".split())  # fmt: skip
#: An opening tag ends an open one: tag -> what it closes; where the search for it stops.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "body": {"head"}}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "option": {"select"}, "body": {"html"}}
SILENT = frozenset("head select textarea option datalist button".split())

CONTAINERS = frozenset("html body main article section div nav header footer aside form fieldset table ul ol dl menu dialog center".split())
TAGS = ("article", "main", "section", "div", "p", "heading", "list", "li", "table", "quote", "pre", "figure", "nav", "header", "footer", "aside", "form", "a", "body", "html", "inline", "other")
_TAG_OF = {**{f"h{k}": "heading" for k in range(1, 7)}, "ul": "list", "ol": "list", "dl": "list", "dt": "li", "dd": "li", "tr": "table", "td": "table", "th": "table", "tbody": "table", "thead": "table", "blockquote": "quote", "figcaption": "figure", "menu": "nav", "dialog": "form", "fieldset": "form", "input": "form", "address": "footer", **{t: "inline" for t in INLINE if t != "a"}}
#: Words of class, id and role that speak against or for content.
AGAINST = re.compile(r"(?:^|[^a-z])(?:ads?|adverts?\w*|sponsor\w*|promo\w*|banner\w*|nav\w*|menu\w*|breadcrumbs?|pag(?:er|ination)|foot\w*|header|masthead|topbar|side\w*|aside|widget\w*|cookie\w*|consent|notices?|notification\w*|alert\w*|popup|modal|overlay|newsletter|subscri\w*|signup|login|search\w*|form\w*|social|shar\w*|related|recommend\w*|comments?|commentlist|respond|repl(?:y|ies)|disqus|discussion|copyright|legal|skip\w*|toolbar|tags?|meta|byline|contentinfo|navigation|complementary)(?:$|[^a-z])")
FOR = re.compile(r"(?:^|[^a-z])(?:article\w*|content|main\w*|post|entry\w*|story\w*|body|text|articlebody)(?:$|[^a-z])")
N_FEATURES = len(TAGS) + 10


@dataclass
class Tree:
    """Elements in page order: parent, depth, tag, marks; text pieces by element; blocks that pieces belong to."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    marks: list[str] = field(default_factory=list)
    silent: list[bool] = field(default_factory=list)
    pieces: list[tuple[int, int, str]] = field(default_factory=list)  # element, block, text


def _end_of(page: str, name: str, at: int, without: set[tuple[str, str]]) -> int:
    """Where the left out element ends whose start tag ends at ``at``; ``without`` keeps what a page lacks, so no search is made twice in vain."""
    if ("end", name) not in without:
        depth, first = 1, None
        for m in _TAG_NAMED[name].finditer(page, at):
            if m[1]:
                depth, first = depth - 1, first or m.end()
                if not depth or name not in NESTED or ("balance", name) in without:
                    return m.end()
            elif not (name == "svg" and m[2].endswith("/")):
                depth += 1
        without.add(("balance" if first else "end", name))
        if first:
            return first
    return at


def parse(page: str | None) -> Tree:
    t = Tree([-1], [0], ["html"], [""], [False])
    stack, block = [0], 0
    open_: defaultdict[str, list[int]] = defaultdict(list)  # places on the stack by tag, and of those that aren't inline; so no search walks the stack, however deep
    blocks: list[int] = []

    def close(upto: int) -> None:
        nonlocal block
        if blocks and blocks[-1] >= upto:
            block += 1
        for e in stack[upto:]:
            open_[t.tag[e]].pop()
        while blocks and blocks[-1] >= upto:
            blocks.pop()
        del stack[upto:]

    def lowest(ends: set[str], scope: frozenset[str] | set[str]) -> int | None:
        """The outermost open element within the scope that the new one ends; a paragraph alone only if nothing but inline elements is open in it."""
        above = max((open_[x][-1] for x in scope if open_[x]), default=0)
        if ends == {"p"}:
            top = next((k for k in reversed(blocks) if t.tag[stack[k]] != "head"), 0)
            if top <= above or t.tag[stack[top]] != "p":
                return None
        found = [open_[x][k] for x in ends if (k := bisect.bisect_right(open_[x], above)) < len(open_[x])]
        return min(found, default=None)

    page, pos, without = page or "", 0, set()
    while pos < len(page):
        m = _PART.match(page, pos)
        pos = m.end()
        _, slash, name, attrs, text = m.groups()
        if text is not None:
            t.pieces.append((stack[-1], block, text))
        elif name is None:
            continue
        elif slash:
            name = name.lower()
            if open_[name] and not (name in INLINE and blocks and blocks[-1] > open_[name][-1]):  # an inline end tag closes nothing beyond its block
                close(open_[name][-1])
        else:
            name = name.lower()
            if name == "html":
                continue
            if name in LEFT_OUT:
                if not (name == "svg" and attrs.endswith("/")):
                    pos = _end_of(page, name, pos, without)
                continue
            if name in VOID:
                if name == "br":
                    t.pieces.append((stack[-1], block, " "))
                elif name == "hr":
                    block += 1
                continue
            ends, scope = CLOSES.get(name, frozenset()), SCOPES.get(name, frozenset())
            if name not in INLINE:
                ends = {*ends, "p"}
            if ends and (end := lowest(ends, scope)) is not None:
                close(end)
            if name not in INLINE:
                block += 1
            found = _ATTR.findall(attrs) if attrs else ()
            t.parent.append(stack[-1])
            t.depth.append(len(stack))
            t.tag.append(name)
            t.marks.append(" ".join("".join(x) for x in found).lower())
            t.silent.append(t.silent[stack[-1]] or name in SILENT)
            if not attrs.rstrip().endswith("/"):
                open_[name].append(len(stack))
                if name not in INLINE:
                    blocks.append(len(stack))
                stack.append(len(t.parent) - 1)
    return t


def _features(t: Tree) -> np.ndarray:
    n = len(t.parent)
    own, linked, in_link = np.zeros(n), np.zeros(n), [False] * n
    for e in range(1, n):  # parents come first
        in_link[e] = t.tag[e] == "a" or (t.tag[e] in INLINE and in_link[t.parent[e]])
    for e, _, text in t.pieces:
        size = len(text.strip())
        own[e] += size
        linked[e] += size * in_link[e]
    for e in range(n - 1, 0, -1):  # children come after their parents
        own[t.parent[e]] += own[e]
        linked[t.parent[e]] += linked[e]
    x = np.zeros((n, N_FEATURES))
    for e in range(n):
        tag = _TAG_OF.get(t.tag[e], t.tag[e])
        x[e, TAGS.index(tag) if tag in TAGS else len(TAGS) - 1] = 1
        if marks := t.marks[e]:
            x[e, len(TAGS)] = bool(AGAINST.search(marks))
            x[e, len(TAGS) + 1] = bool(FOR.search(marks)) and not x[e, len(TAGS)]
        up = max(t.parent[e], 0)
        within = x[up, len(TAGS) + 2]  # an article or what is marked as one, and what speaks against it, above or here
        x[e, len(TAGS) + 2] = within or tag in ("article", "main") or x[e, len(TAGS) + 1]
        x[e, len(TAGS) + 3] = x[up, len(TAGS) + 3] or x[e, len(TAGS)] or tag in ("nav", "footer", "aside", "form") or (tag == "header" and not within)
    holds = np.array([x in ("div", "section", "center") for x in t.tag])  # elsewhere the length of a text says little
    x[:, -6] = np.log1p(own) / 5 * holds
    x[:, -5] = linked / np.maximum(own, 1)
    x[:, -4] = (own > 80) & holds
    x[:, -3] = own == 0
    x[:, -2] = (x[:, -5] > 0.5) & (own > 0)
    x[:, -1] = 1
    return x


def kinds(t: Tree) -> np.ndarray:
    """Of an element: 0 inline, 1 a block of text, 2 a container, 3 whatever stands right under the page's body."""
    return np.array([3 if p < 0 or t.tag[p] in ("html", "body") else 0 if x in INLINE else 2 if x in CONTAINERS else 1 for x, p in zip(t.tag, t.parent, strict=True)])


@dataclass
class Model:
    node: np.ndarray  # weights of the features
    edge: np.ndarray  # by kind of the child: log potential of agreeing with the parent, its negative of differing


def sum_product(x: np.ndarray, parent: np.ndarray, depth: np.ndarray, kind: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """P(content) of every node of a forest (parent -1: a root), and how far each agrees with its parent (-1 to 1)."""
    score = x @ model.node
    total = np.stack([-score / 2, score / 2], axis=1)  # a node's own potential with all messages it has
    up = np.zeros_like(total)  # its message to its parent
    agree, along_parent = model.edge[kind], np.zeros(len(x))
    levels = np.argsort(depth, kind="stable")
    bounds = np.searchsorted(depth[levels], np.arange(depth.max() + 2))

    def along(state: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The message along an edge: summed over the states at its near end."""
        m = np.stack([np.logaddexp(state[:, 0] + j, state[:, 1] - j), np.logaddexp(state[:, 0] - j, state[:, 1] + j)], axis=1)
        return m - m.max(axis=1, keepdims=True)

    for d in range(len(bounds) - 2, 0, -1):  # upward
        at = levels[bounds[d] : bounds[d + 1]]
        up[at] = along(total[at], agree[at])
        np.add.at(total, parent[at], up[at])
    for d in range(1, len(bounds) - 1):  # downward
        at = levels[bounds[d] : bounds[d + 1]]
        rest, j = total[parent[at]] - up[at], agree[at]  # the parent without what this child said
        same = np.logaddexp(rest[:, 0] + total[at, 0], rest[:, 1] + total[at, 1]) + j
        other = np.logaddexp(rest[:, 0] + total[at, 1], rest[:, 1] + total[at, 0]) - j
        along_parent[at] = np.tanh((same - other) / 2)
        total[at] += along(rest, j)
    return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -40, 40))), along_parent


def marginals(x: np.ndarray, parent: np.ndarray, depth: np.ndarray, kind: np.ndarray, model: Model) -> np.ndarray:
    return sum_product(x, parent, depth, kind, model)[0]


def labelled_pages(n: int = 400, seed: int = 7) -> list[tuple[str, set[str]]]:
    """Pages of seeded layouts with the texts that are their content."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("an", "er", "on", "th", "el", "io", "sta", "re")) for _ in range(rng.randint(1, 4)))
    count = 0

    def say(lo: int, hi: int) -> str:
        nonlocal count
        count += 1
        return f"{' '.join(word() for _ in range(rng.randint(lo, hi)))} n{count}."

    out = []
    for _ in range(n):
        keep: set[str] = set()

        def content(tag: str, lo: int, hi: int) -> str:
            parts = [say(lo, hi)]
            if tag == "p" and rng.random() < 0.25:  # with a link inside
                parts += [say(1, 3), say(2, 10)]
            keep.update(parts)
            return f"<{tag}>{parts[0]}" + (f' <a href="/{word()}">{parts[1]}</a> {parts[2]}' if len(parts) > 1 else "") + f"</{tag}>"

        links = lambda k: "<ul>" + "".join(f'<li><a href="/{word()}">{say(1, 3)}</a></li>' for _ in range(k)) + "</ul>"
        pick = lambda p, x: [x] if rng.random() < p else []

        def junk(names: str, inner: str = "") -> str:
            tag, name, mark = rng.choice(("div", "section", "aside", "div")), rng.choice(names.split()), rng.choice(("class", "class", "id"))
            head = f"<h{rng.randint(2, 4)}>{say(1, 4)}</h{rng.randint(2, 4)}>" if rng.random() < 0.4 else ""
            inner = inner or rng.choice(("".join(f"<p>{say(2, 40)}</p>" for _ in range(rng.randint(1, 3))), say(2, 12), links(3)))
            return f'<{tag} {mark}="{name}">{head}{inner}</{tag}>'

        def comments() -> str:
            each = rng.choice(('<div class="comment"><p>{}</p></div>', "<p>{}</p>", '<article class="comment"><p>{}</p></article>', '<li class="comment">{}</li>'))
            return junk("comments comment-list respond", "".join(each.format(say(2, 40)) for _ in range(rng.randint(1, 4))))

        form = lambda: f'<form action="/x"><label>{say(1, 4)}</label>{rng.choice((f"<p>{say(2, 12)}</p>", ""))}<input name="q"><button>{say(1, 2)}</button></form>'
        title = content("h1", 2, 8)
        body = [rng.choice((title, title, f"<header>{title}</header>"))] if rng.random() < 0.8 else []
        for _ in range(rng.randint(1, 8)):
            kind = rng.random()
            if kind < 0.58:
                body.append(content("p", 1, 60))
            elif kind < 0.68:
                body.append("<ul>" + "".join(content("li", 1, 12) for _ in range(rng.randint(2, 4))) + "</ul>")
            elif kind < 0.74:
                body.append(content("h2", 1, 6))
            elif kind < 0.8:
                body.append("<blockquote>" + content("p", 5, 30) + "</blockquote>")
            elif kind < 0.84:
                body.append("<div>" + content("p", 1, 40) + content("p", 1, 10) + "</div>")
            elif kind < 0.92:
                body.append(junk("ad advert promo share related newsletter-signup notice sidebar"))
            elif kind < 0.94:
                body.append(form())
            elif kind < 0.96:
                body.append(f"<aside>{rng.choice((links(2), f'<p>{say(1, 20)}</p>'))}</aside>")
            else:
                body.append("<table><tr>" + content("td", 1, 5) + content("td", 1, 5) + "</tr></table>")
        keep -= {x for x in keep if not any(x in y for y in body)}
        frame = rng.choice(("<article>{}</article>", "<article>{}</article>", '<div class="content">{}</div>', "<main><article>{}</article></main>", '<div id="main-content"><div class="post">{}</div></div>', '<section class="story-body">{}</section>', "<main>{}</main>", '<div class="article-body">{}</div>', "{}"))
        nav = f"<nav>{links(rng.randint(3, 7))}</nav>"
        before = pick(0.7, nav) + pick(0.4, f"<header>{rng.choice((f'<p>{say(1, 6)}</p>', nav, f'<h2>{say(1, 4)}</h2>'))}</header>") + pick(0.3, junk("menu navbar topbar breadcrumbs", links(4))) + pick(0.5, junk("ad banner cookie-notice notice alert"))
        after = pick(0.4, f"<aside>{links(3)}<p>{say(2, 20)}</p></aside>") + pick(0.4, junk("sidebar widget related ad promo")) + pick(0.5, comments()) + pick(0.3, form()) + pick(0.8, f"<footer>{rng.choice((say(2, 12), f'<p>{say(2, 12)}</p>', links(3)))}</footer>")
        out.append((f"<html><head><title>{say(2, 5)}</title></head><body>{''.join(before)}{frame.format(''.join(body))}{''.join(after)}</body></html>", keep))
    return out


def _forest(trees: list[Tree]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, parents, depths and kinds of all trees as one forest, and where each tree begins."""
    base = np.concatenate([[0], np.cumsum([len(t.parent) for t in trees])])
    parent = np.concatenate([np.array(t.parent) + np.where(np.array(t.parent) >= 0, b, 0) for t, b in zip(trees, base, strict=False)])
    return np.concatenate([_features(t) for t in trees]), parent, np.concatenate([t.depth for t in trees]), np.concatenate([kinds(t) for t in trees]), base


@functools.lru_cache(maxsize=1)
def train(steps: int = 400) -> Model:
    """Node and edge weights of greatest likelihood on the labelled pages: what is seen less what sum-product expects is the gradient."""
    trees, ys = [], []
    for page, keep in labelled_pages():
        t = parse(page)
        good, size = np.zeros(len(t.parent)), np.zeros(len(t.parent))
        for e, _, text in t.pieces:
            size[e] += len(text)
            good[e] += len(text) * (text.strip() in keep)
        for e in range(len(t.parent) - 1, 0, -1):
            good[t.parent[e]] += good[e]
            size[t.parent[e]] += size[e]
        y = (good > 0.5 * size).astype(float)
        y[[x in ("html", "body") for x in t.tag]] = 0  # of a page's frame nothing follows for its parts
        trees.append(t)
        ys.append(y)
    x, parent, depth, kind, _ = _forest(trees)
    y = np.concatenate(ys)
    child = np.flatnonzero(parent >= 0)
    agrees = np.zeros(len(y))
    agrees[child] = (2 * y[child] - 1) * (2 * y[parent[child]] - 1)
    w, mean, square = np.zeros(x.shape[1] + 4), 0.0, 0.0
    for k in range(1, steps + 1):
        p, e = sum_product(x, parent, depth, kind, Model(w[:-4], w[-4:]))
        g = np.concatenate([x.T @ (y - p), np.bincount(kind[child], (agrees - e)[child], 4)]) - 0.5 * w
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g  # Adam
        w = w + 0.1 * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
    return Model(w[:-4], w[-4:])


def extract(pages: list[str | None], model: Model) -> list[str]:
    """The main text of each page."""
    trees = [parse(p) for p in pages]
    if not trees:
        return []
    x, parent, depth, kind, base = _forest(trees)
    p = marginals(x, parent, depth, kind, model)
    out = []
    for t, b in zip(trees, base, strict=False):
        blocks: list[str] = []
        last, text = None, []
        of = [0] * len(t.parent)  # inline text stands with its block, and so does a link's with what is around the link
        for e in range(1, len(of)):
            of[e] = of[t.parent[e]] if t.tag[e] in INLINE else e
        for e, block, piece in t.pieces:
            if block != last:
                if text:
                    blocks.append("".join(text))
                last, text = block, []
            if not t.silent[e] and p[b + of[e]] >= 0.5:
                text.append(piece)
        if text:
            blocks.append("".join(text))
        out.append(" ".join(x for x in (" ".join(html.unescape(s).split()) for s in blocks) if x))
    return out


def main_texts(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages(page_id, url, html)``.

    A null or empty html has an empty text. Repeated rows have equal texts; an empty table gives an empty result.
    Other columns are ignored.
    """
    model = model or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(extract(part.column(2).to_pylist(), model), pa.string())], names=["page_id", "url", "text"])

    rows = pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")
    return rows.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
