"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree: block elements are inner nodes, their runs of text are
leaves. Every node is content or not. Log-linear potentials score a node by its
tag, attribute words and text, and a parent-child pair by agreement. Two
sweeps of sum-product messages, upward and downward, give exact marginals; the
text of leaves that are likelier content than not is the main text.

The potentials are trained by maximum a posteriori from labelled pages: pages
that mark their main text with one article element. Each labelled tree is also
learnt from in altered forms (another tag or class on the article, boilerplate
moved into it or given its text), so that no single mark decides.

The marks' prior is strong: a part that goes by the name of navigation, comments, a
form and the like is not content whatever its text, nor is a header inside the
article; training decides about everything that isn't marked, or marked otherwise.

Parsing and inference run row by row in one Arrow pass; no shuffle.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from math import exp, log1p
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm import graph  # noqa: F401  ships this package's code with the tasks

# Fixed lists of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object canvas select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"},
         "thead": {"table"}, "tbody": {"table"}}

# Fixed lists of marks that pages use for parts.
CONTENT_TAGS = frozenset("article main".split())
OTHER_TAGS = frozenset("nav header footer aside form menu dialog button fieldset".split())
OUTER_TAGS = frozenset("#page html body".split())
PROSE_TAGS = frozenset("p blockquote pre figcaption".split())
LIST_TAGS = frozenset("ul ol li dl dt dd table tr td th thead tbody".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTENT_WORDS = frozenset("article content main post story entry body text prose articlebody maincontent".split())
OTHER_WORDS = frozenset("""nav navbar navigation menu header masthead banner footer sidebar aside widget related recommended cookie cookies
consent gdpr notice alert ad ads advert adverts advertisement sponsor sponsored promo promotion comment comments reply replies discussion respond
disqus form search login signup signin subscribe subscription newsletter share sharing social breadcrumb breadcrumbs pagination pager popup modal
overlay toolbar topbar copyright legal disclaimer tags meta byline""".split())
BOILER_TEXT = re.compile(r"©|\(c\)\s*\d{4}|all rights reserved|cookies?\b|privacy policy|terms of (?:use|service)|subscribe|sign up|log in", re.I)

# A value in quotes after an equals sign may hold anything but its quote, other quotes are letters like any.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/><]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^<>])*+)>|<[!?][^>]*(?:>|\Z)""", re.S)
ATTR = re.compile(r"""(class|id|role|itemprop|aria-label|data-role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORD = re.compile(r"[A-Za-z][a-z]*")
#: Class names that say what an article is about, not what a part is for.
TOPIC = re.compile(r"(?:tag|category|cat|topic|type|format|status|author|post)-\S")

NAMES = ["element", "other tag", "content tag", "other word", "content word", "prose", "heading", "list", "hidden", "outer",
         "text", "link share", "length", "sentence", "short", "boiler text", "only differs below content", "only differs below other"]
#: Prior means of the weights: log-odds for content, then two for pairs.
PRIOR = np.array([0.0, -20.0, 14.0, -20.0, 9.0, 0.2, 0.0, 0.0, -20.0, -3.0,
                  0.0, -2.0, 0.3, 0.3, -0.2, -1.5, -2.0, -6.0])
N_ELEMENT, N_UNARY = NAMES.index("text"), len(NAMES) - 2

#: Texts of a page up to which its unmarked nodes count in full.
EVEN = 1.5
#: Most pages to train on and their longest html, altered forms of each, steps,
#: and the strength of the prior.
SAMPLE, LONGEST, FORMS, STEPS, STRENGTH = 80, 60_000, 3, 25, 0.02


class Tree:
    """Nodes in page order; a node's parent stands before it."""

    __slots__ = ("parent", "tag", "marks", "text", "links")

    def __init__(self) -> None:
        self.parent, self.tag, self.marks, self.text, self.links = [-1], ["#page"], [frozenset()], [None], [0]

    def add(self, parent: int, tag: str, marks: frozenset, text: str | None = None, links: int = 0) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.marks.append(marks)
        self.text.append(text)
        self.links.append(links)
        return len(self.parent) - 1


def _marks(attrs: str, tag: str) -> frozenset:
    """Words of the names that a part goes by. Names of an article's topics don't
    count, and an article or main part that goes by a content name isn't
    something else because of another of its names."""
    found, names = set(), []
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            found.add("#hidden")
        elif name not in ("hidden", "aria-hidden", "style"):
            names += [set(WORD.findall(n)) for n in value.split() if not TOPIC.match(n)]
    if tag in CONTENT_TAGS and any(n & CONTENT_WORDS and not n & OTHER_WORDS for n in names):
        names = [n for n in names if not n & OTHER_WORDS]
    return frozenset(found.union(*names))


def parse(page: str) -> Tree:
    """The tree of a page. Markup errors are mended as browsers commonly do:
    open paragraphs and items end where the next block or item begins, stray end
    tags are ignored, what is left open ends with the page. Where a name is open is
    looked up, so the time is linear in the page however deep it is."""
    tree, stack, run, links, in_link = Tree(), [(0, "#page")], [], 0, False
    depth: dict[str, list[int]] = {}  # where in the stack each name is open

    def close(k: int):
        for _, name in stack[k:]:
            depth[name].pop()
        del stack[k:]

    def flush():
        nonlocal links
        if run:
            text = " ".join("".join(run).split())
            if text:
                tree.add(stack[-1][0], "#text", frozenset(), text, min(links, len(text)))
            run.clear()
        links = 0

    def say(raw: str):
        nonlocal links
        text = _html.unescape(raw) if "&" in raw else raw
        run.append(text)
        if in_link:
            links += len(text.strip())

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at:m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag, closing = tag.lower(), m[1]
        if tag in RAW and not closing:
            if m[3].endswith("/"):
                continue
            end = re.compile(f"</{re.escape(tag)}[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            if tag not in ("title", "textarea", "script", "style", "template"):
                run.append(" ")
            continue
        if tag == "br":
            run.append(" ")
            continue
        if tag in VOID or tag in RAW:
            if tag == "hr":
                flush()
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = not closing
            continue
        flush()
        if closing:
            if depth.get(tag):
                close(depth[tag][-1])
                in_link = False
            continue
        if stack[-1][1] == "p":
            close(len(stack) - 1)
        elif tag in CLOSES:
            nearest = max((depth[t][-1] for t in CLOSES[tag] if depth.get(t)), default=0)
            if nearest > max((depth[t][-1] for t in SCOPE.get(tag, ()) if depth.get(t)), default=0):
                close(nearest)
        if stack[-1][1] in HEADINGS and tag in HEADINGS:
            close(len(stack) - 1)
        depth.setdefault(tag, []).append(len(stack))
        stack.append((tree.add(stack[-1][0], tag, _marks(m[3], tag) if m[3] else frozenset()), tag))
    flush()
    return tree


def evenness(tree: Tree) -> float:
    """What unmarked nodes count: less on pages with many texts, so that a long
    list of them doesn't outvote the mark of the part they stand in."""
    return min(1.0, EVEN / max(1, len(tree.text) - tree.text.count(None)))


def node_features(s: float, tag: str, marks: frozenset, text: str | None, links: int) -> list[float]:
    if text is None:
        return [s, float(tag in OTHER_TAGS), float(tag in CONTENT_TAGS and OTHER_WORDS.isdisjoint(marks)), float(not OTHER_WORDS.isdisjoint(marks)),
                float(not CONTENT_WORDS.isdisjoint(marks) and OTHER_WORDS.isdisjoint(marks)), s * (tag in PROSE_TAGS), s * (tag in HEADINGS),
                s * (tag in LIST_TAGS), float("#hidden" in marks), float(tag in OUTER_TAGS), 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    n = len(text)
    return [0.0] * N_ELEMENT + [s, s * links / n, s * min(1.5, log1p(n) / 5), s * (text[-1] in ".!?…。" or ". " in text), s * (n < 25),
                                s * (n < 300 and BOILER_TEXT.search(text) is not None)]


def _log_sum(a: float, b: float) -> float:
    return a + log1p(exp(b - a)) if a > b else b + log1p(exp(a - b))


def marginals(parent: list[int], odds: list[float], below_content: float, below_other: float):
    """Sum-product on a tree: each node's log-odds of being content, and the
    upward sums and messages, from the nodes' own log-odds.

    A child of a content parent differs from it with odds e^below_content, one
    of another parent with odds e^below_other, so a child without evidence says
    nothing. Upward, a child tells its parent the log-odds its subtree prefers;
    downward, a parent tells a child what all but that child's subtree prefers.
    """
    n = len(parent)
    up, msg = odds[:], [0.0] * n
    silent = _log_sum(below_content, 0.0) - _log_sum(0.0, below_other)
    for i in range(n - 1, 0, -1):
        u = up[i]
        msg[i] = d = _log_sum(below_content, u) - _log_sum(0.0, u + below_other) - silent
        up[parent[i]] += d
    full = up[:]
    for i in range(1, n):
        v = full[parent[i]] - msg[i] - silent
        full[i] = up[i] + _log_sum(below_other, v) - _log_sum(0.0, v + below_content)
    return full, up, msg


def _expected(parent, x, weights):
    """Expected features of a tree under its marginals, and the expected pairs
    below content and below other."""
    c, o = float(weights[-2]), float(weights[-1])
    full, up, msg = marginals(parent, (x @ weights[:N_UNARY]).tolist(), c, o)
    below = [0.0, 0.0]
    silent = _log_sum(c, 0.0) - _log_sum(0.0, o)
    p = 1 / (1 + np.exp(-np.clip(full, -50, 50)))
    out = np.zeros(len(weights))
    out[:N_UNARY] = p @ x
    for i in range(1, len(parent)):
        v, u = full[parent[i]] - msg[i] - silent, up[i]
        top = max(v + c, v + u, u + o, 0.0)
        a, b, d, e = exp(v + c - top), exp(v + u - top), exp(u + o - top), exp(-top)
        z = a + b + d + e
        out[-2] += a / z
        out[-1] += d / z
        below[0] += (a + b) / z
        below[1] += (d + e) / z
    return out, np.array(below)


def _observed(parent, x, y):
    out = np.zeros(len(NAMES))
    out[:N_UNARY] = y @ x
    up = y[parent[1:]]
    out[-2] = (up * (1 - y[1:])).sum()
    out[-1] = ((1 - up) * y[1:]).sum()
    return out, np.array([up.sum(), (1 - up).sum()])


def labelled(tree: Tree) -> np.ndarray | None:
    """1 for the nodes of the page's only article, 0 for others; None without one."""
    roots = [i for i, t in enumerate(tree.tag) if t == "article"]
    if len(roots) != 1:
        return None
    y = np.zeros(len(tree.tag))
    y[roots[0]] = 1
    for i in range(roots[0] + 1, len(y)):
        y[i] = y[tree.parent[i]] and float(tree.tag[i] not in OTHER_TAGS and OTHER_WORDS.isdisjoint(tree.marks[i]))
    return y


def altered(tree: Tree, y: np.ndarray, rng: np.random.Generator) -> tuple[Tree, np.ndarray]:
    """The tree with another mark on its article, other marks on the boilerplate,
    some of it inside the article, and some of it with the article's text."""
    root = tree.tag.index("article")
    tops = [i for i in range(1, len(y)) if not y[i] and tree.text[i] is None and tree.tag[tree.parent[i]] in ("#page", "html", "body") and tree.tag[i] not in ("html", "head", "body")]
    prose = [t for t, c in zip(tree.text, y) if t and c]
    out, place, label = Tree(), {0: 0}, [0.0]
    moved = {i for i in tops if rng.random() < 0.6}

    def copy(i: int, parent: int) -> None:
        tag, marks, text, links = tree.tag[i], tree.marks[i], tree.text[i], tree.links[i]
        if i == root:
            tag, marks = [("article", marks), ("main", marks), ("div", frozenset([sorted(CONTENT_WORDS)[rng.integers(len(CONTENT_WORDS))]])),
                          ("div", frozenset())][rng.choice(4, p=[0.3, 0.15, 0.25, 0.3])]
        elif i in tops and rng.random() < 0.7:
            tag, marks = (("div", frozenset([sorted(OTHER_WORDS)[rng.integers(len(OTHER_WORDS))]])) if rng.random() < 0.5
                          else (sorted(OTHER_TAGS)[rng.integers(len(OTHER_TAGS))], frozenset()))
        elif text and not y[i] and prose and rng.random() < 0.4:
            text, links = prose[rng.integers(len(prose))], 0
        elif y[i] and tag == "p" and rng.random() < 0.3:
            tag = ("li", "td", "div", "blockquote", "h2")[rng.integers(5)]
        elif y[i] and text and rng.random() < 0.2:
            text = text[:int(rng.integers(3, 30))]
        place[i] = out.add(parent, tag, marks, text, links)
        label.append(float(y[i]))

    inside_moved: dict[int, bool] = {}
    order = [i for i in range(1, len(y)) if not _under(tree, i, moved, inside_moved)]
    for i in order:
        copy(i, place[tree.parent[i]])
    for top in sorted(moved):
        for _ in range(int(rng.integers(1, 4))):
            for i in range(top, len(y)):
                if _top_of(tree, i, top):
                    copy(i, place[root] if i == top else place[tree.parent[i]])
    # Reader comments and the like: much prose under a mark, beside or inside the article.
    for _ in range(int(rng.integers(0, 3)) if prose else 0):
        mark = rng.integers(len(OTHER_WORDS) + len(OTHER_TAGS))
        tag, marks = ("div", frozenset([sorted(OTHER_WORDS)[mark]])) if mark < len(OTHER_WORDS) else (sorted(OTHER_TAGS)[mark - len(OTHER_WORDS)], frozenset())
        top = out.add(place[root] if rng.random() < 0.6 else 0, tag, marks)
        label.append(0.0)
        for _ in range(int(rng.integers(1, 25))):
            item = out.add(top, ("p", "li", "div")[rng.integers(3)], frozenset())
            out.add(item, "#text", frozenset(), prose[rng.integers(len(prose))])
            label += [0.0, 0.0]
    return out, np.array(label)


def _under(tree: Tree, i: int, tops: set, known: dict[int, bool]) -> bool:
    known[i] = i in tops or known.get(tree.parent[i], False)
    return known[i]


def _top_of(tree: Tree, i: int, top: int) -> bool:
    while i > top:
        i = tree.parent[i]
    return i == top


def fit(trees: list[tuple[Tree, np.ndarray]]) -> np.ndarray:
    """Weights by gradient steps (RMS scaled) on the trees' log-likelihood with a
    Gaussian prior around ``PRIOR``; without trees, the prior means."""
    data = [(t.parent, np.array([node_features(evenness(t), *z) for z in zip(t.tag, t.marks, t.text, t.links)]), y) for t, y in trees]
    weights, scale = PRIOR.copy(), np.zeros(len(PRIOR))
    if not data:
        return weights
    observed, below = (sum(x) / len(data) for x in zip(*(_observed(np.array(p), x, y) for p, x, y in data)))
    for step in range(STEPS):
        expected, now = (sum(x) / len(data) for x in zip(*(_expected(p, x, weights) for p, x, _ in data)))
        slope = observed - expected - STRENGTH * (weights - PRIOR)
        slope[-2:] -= (below - now) / (1 + np.exp(-weights[-2:]))
        scale = 0.9 * scale + 0.1 * slope ** 2
        weights = weights + 0.15 * slope / (np.sqrt(scale / (1 - 0.9 ** (step + 1))) + 1e-6) / np.sqrt(1 + step / 5)
    return weights


def main_text(page: str, weights: np.ndarray) -> str:
    tree = parse(page)
    w, s = weights.tolist(), evenness(tree)
    known: dict[tuple, float] = {}
    odds = []
    for tag, marks, text, links in zip(tree.tag, tree.marks, tree.text, tree.links):
        if text is not None:
            odds.append(sum(map(mul, w[N_ELEMENT:], node_features(s, tag, marks, text, links)[N_ELEMENT:])))
            continue
        if (tag, marks) not in known:
            known[tag, marks] = sum(map(mul, w, node_features(s, tag, marks, None, 0)))
        odds.append(known[tag, marks])
    full, _, _ = marginals(tree.parent, odds, w[-2], w[-1])
    return "\n".join(t for t, f in zip(tree.text, full) if t is not None and f > 0)


def train(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE) -> np.ndarray:
    """Weights from at most ``sample`` different pages with one article, those of
    the pages under ``LONGEST`` characters with the smallest hashes."""
    text = F.col(html_col).cast("string")
    fit_for = pages.select(text.alias("html")).where(
        F.col("html").isNotNull() & (F.length("html") < LONGEST) & F.lower("html").contains("<article")).withColumn("draw", F.xxhash64("html"))
    # Hashes alone are ranked; of the pages only the chosen ones, each once, reach the driver.
    least = [r.draw for r in fit_for.select("draw").distinct().orderBy("draw").limit(sample).collect()]
    picked = fit_for.where(F.col("draw").isin(least)).groupBy("draw").agg(F.first("html").alias("html")).orderBy("draw").collect()
    rng = np.random.default_rng(5)
    trees = []
    for r in picked:
        tree = parse(r.html)
        y = labelled(tree)
        if y is not None and len(y) < 2000:
            trees.append((tree, y))
            trees += [altered(tree, y, rng) for _ in range(FORMS)]
    return fit(trees)



def extract_text(pages: DataFrame, weights: np.ndarray, html_col: str = "html") -> DataFrame:
    """``pages`` with ``html_col`` replaced by ``text`` and ``n_chars``, its code points.

    The text's blocks stand in page order, white space in a block is one space,
    blocks are joined by a line feed. Null, empty and content-free pages have an
    empty text. Pages of any length and depth are handled whole; repeated rows
    are extracted each; other columns pass through, except columns that are
    already named ``text`` or ``n_chars``, which are replaced. An empty table
    gives no rows.
    """
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    source = pages.select(*kept, F.col(html_col).cast("string").alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py() or "", weights) for p in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(texts, pa.string())],
                                             names=[*kept, "text"])

    return source.mapInArrow(rows, source.schema).withColumn("n_chars", F.length("text").cast("long"))
