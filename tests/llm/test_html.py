import itertools
import math
import re
import time
from html.parser import HTMLParser

import numpy as np
import pytest

from faultlens.llm import html_extract as H

NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About</a></li></ul></nav>'
COMMENTS = "".join(f"<div><p>User {i} says something rather long here. And goes on, with more words.</p></div>" for i in range(40))


def brute(parent, odds, c, o):
    """Marginal log-odds by summing over all assignments."""
    n, mass = len(parent), np.zeros((len(parent), 2))
    for x in itertools.product((0, 1), repeat=n):
        s = sum(v * odd for v, odd in zip(x, odds))
        for i in range(1, n):
            if x[parent[i]]:
                s += (0 if x[i] else c) - math.log1p(math.exp(c))
            else:
                s += (o if x[i] else 0) - math.log1p(math.exp(o))
        for i, v in enumerate(x):
            mass[i, v] += math.exp(s)
    return np.log(mass[:, 1] / mass[:, 0])


def test_messages_give_exact_marginals():
    rng = np.random.default_rng(0)
    for _ in range(20):
        n = int(rng.integers(1, 10))
        parent = [-1] + [int(rng.integers(0, i)) for i in range(1, n)]
        odds = rng.normal(0, 3, n).tolist()
        c, o = rng.normal(-2, 1, 2).tolist()
        full, _, _ = H.marginals(parent, odds, c, o)
        assert np.allclose(full, brute(parent, odds, c, o))


def test_gradient_is_that_of_the_likelihood():
    page = "<body><nav><a>x</a></nav><article><p>One is. Two.</p><p>b</p></article></body>"
    tree = H.parse(page)
    y = H.labelled(tree)
    x = np.array([H.node_features(H.evenness(tree), *z) for z in zip(tree.tag, tree.marks, tree.text, tree.links)])

    def loglik(w):
        n, total, at = len(y), 0.0, None
        for a in itertools.product((0, 1), repeat=n):
            s = float(np.array(a) @ x @ w[:H.N_UNARY])
            for i in range(1, n):
                up, own = a[tree.parent[i]], a[i]
                s += ((0 if own else w[-2]) - math.log1p(math.exp(w[-2]))) if up else ((w[-1] if own else 0) - math.log1p(math.exp(w[-1])))
            total += math.exp(s)
            if list(a) == y.tolist():
                at = s
        return at - math.log(total)

    w = np.random.default_rng(1).normal(0, 0.5, len(H.NAMES))
    (seen, below), (mean, now) = H._observed(np.array(tree.parent), x, y), H._expected(tree.parent, x, w)
    slope = seen - mean
    slope[-2:] -= (below - now) / (1 + np.exp(-w[-2:]))
    for k in range(len(w)):
        d = np.zeros(len(w))
        d[k] = 1e-5
        assert slope[k] == pytest.approx((loglik(w + d) - loglik(w - d)) / 2e-5, abs=1e-4)


@pytest.fixture(scope="module")
def weights(spark):
    return H.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


PAGES = [
    (f'<html><head><title>t</title><style>p{{}}</style></head><body><header><h1>Site</h1>{NAV}</header><div class="cookie-notice"><p>We use cookies. Accept.</p></div>'
     '<main><h2>Title &amp; more</h2><p>First with a\n long&nbsp;sentence.</p><ul><li>one</li><li>two</li></ul><aside><p>Read also.</p></aside>'
     '<p>Second.</p><form><label>Mail</label></form></main><footer>&copy; 2020</footer></body></html>',
     "Title & more\nFirst with a long sentence.\none\ntwo\nSecond."),
    (f'<body>{NAV}<div class="ad">Buy.</div><article><h1>A</h1>loose<p>b<p>c<div class="ad"><p>Buy this thing now. It is cheap.</p></div><p>d</article><footer>x</footer>',
     "A\nloose\nb\nc\nd"),
    (f'<body><article><h2>T</h2><p>text here.</p><section class="comments">{COMMENTS}</section><aside>side</aside></article></body>', "T\ntext here."),
    (f'<body><article><p>short</p></article><section id="comments">{COMMENTS}</section></body>', "short"),
    ('<body><article><p>x < y &lt; z &#228;</p><!-- c --><script>if(a<b){"</p>"}</script><p title="a > b">un<b>clos</b>ed<br>line</article>',
     "x < y < z ä\nunclosed line"),
    ("", ""), (None, ""), ("<!-- only", ""), ("<body></body>", "")]


@pytest.mark.parametrize("k", range(len(PAGES)))
def test_main_text(weights, k):
    page, text = PAGES[k]
    assert H.main_text(page or "", weights) == text


class Article(HTMLParser):
    """The article's blocks by the standard library's parser: nothing of this package."""

    APART = {"nav", "header", "footer", "aside", "form", "script", "style", "button"}
    INLINE = {"a", "b", "i", "em", "strong", "span", "code", "small", "u", "sub", "sup"}
    VOID = {"br", "img", "hr", "input", "meta", "link"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.blocks, self.run = [], [], []

    def inside(self):
        return "article" in [t for t, _ in self.open] and not any(apart for _, apart in self.open)

    def flush(self):
        text = " ".join("".join(self.run).split())
        self.blocks += [text] if text else []
        self.run = []

    def handle_starttag(self, tag, attrs):
        if tag not in self.INLINE:
            self.flush() if tag != "br" else self.run.append(" ")
        if tag in self.VOID:
            return
        name = (dict(attrs).get("class") or "") + " " + (dict(attrs).get("id") or "")
        self.open.append((tag, tag in self.APART or bool(re.search("comment|related|share|cookie|promo|advert|newsletter", name))))

    def handle_endtag(self, tag):
        if tag not in self.INLINE:
            self.flush()
        if tag in [t for t, _ in self.open]:
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if self.inside():
            self.run.append(data)


def test_articles_of_pages(spark, weights):
    """Pages of the table mark their article; its blocks, as another parser sees
    them, are the expected text."""
    rows = H.extract_text(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html", "url"), weights)
    html = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = rows.collect()
    assert len(got) == len(html) and rows.columns == ["page_id", "url", "text", "n_chars"]
    for r in got:
        reader = Article()
        reader.feed(html[r.page_id])
        reader.close()
        reader.flush()
        assert r.text == "\n".join(reader.blocks) and r.n_chars == len(r.text)


def test_training_beats_the_prior_on_altered_pages(spark, weights):
    """Marks of held-out pages are changed at random; trained weights judge their
    texts better than the prior means do."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("page_id >= 2000").limit(60).collect()
    rng = np.random.default_rng(11)
    wrong = {"prior": 0, "trained": 0}
    for r in pages:
        tree = H.parse(r.html)
        y = H.labelled(tree)
        for t, label in [H.altered(tree, y, rng) for _ in range(2)] if y is not None else []:
            x = np.array([H.node_features(H.evenness(t), *z) for z in zip(t.tag, t.marks, t.text, t.links)])
            for name, w in (("prior", H.PRIOR), ("trained", weights)):
                full, _, _ = H.marginals(t.parent, (x @ w[:H.N_UNARY]).tolist(), w[-2], w[-1])
                wrong[name] += sum((f > 0) != (c > 0) for f, c, text in zip(full, label, t.text) if text is not None)
    assert 0 < wrong["trained"] < 0.85 * wrong["prior"]


def test_names_of_topics_do_not_make_an_article_something_else(weights):
    body = "<p>One is. Two.</p><p>b</p>"
    for name in ("post tag-legal category-social", "hentry post-12 format-comment", "story share-enabled"):
        assert H.main_text(f'<body>{NAV}<article class="{name}">{body}</article></body>', weights) == "One is. Two.\nb"
    comments = "".join(f'<article class="comment post-{k}">{body}</article>' for k in range(6))
    assert H.main_text(f"<body><article><p>text.</p></article>{comments}</body>", weights) == "text."


def test_markup_in_quoted_values_stays_markup(weights):
    for page in ('<article><p title="a < b">Hello there.</p></article>', "<article><p data-x='<b>' title=\"x > y\">Hello there.</p></article>",
                 '<article><p title=un"quoted>Hello there.</p></article>'):
        assert H.main_text(page, weights) == "Hello there."


def test_broken_pages_take_linear_time():
    pages = ["<div>" * 20000 + "</p>" * 20000, "<ul><li><ul>" + "<div>" * 20000 + "<li></li>" * 20000, "<table><tr><td>" * 3000 + "<td>" * 20000, '<p a="' * 20000]
    for page in pages:
        t = time.process_time()
        H.parse(page)
        assert time.process_time() - t < 5


def test_deep_pages_clashes_and_empty_tables(spark, weights):
    deep = "<div>" * 20000 + "<p>x</p>"
    df = spark.createDataFrame([(1, deep, "old"), (None, None, None)], "page_id long, html string, text string")
    assert [r.n_chars is not None for r in H.extract_text(df, weights).collect()] == [True, True]
    assert H.extract_text(df.limit(0), weights).collect() == []
    assert H.train(df.limit(0)).tolist() == H.PRIOR.tolist()
