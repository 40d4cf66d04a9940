"""Main-text extraction: gradient-boosted trees score DOM nodes, and a hierarchical decoding picks the text.

A page's block elements are scored by trees over their tag, attribute words, depth, subtree densities and sibling
statistics. The trees are trained with Spark's GBTClassifier on ``TRAINING_PAGES`` labelled pages that this module
lays out in several ways (with and without ``article``; menus, headers, sidebars, notices, adverts, forms and
comments around the text); no page of the input is learned from. Decoding makes every element all main text, all
boilerplate, or mixed, where only a mixed element's children may differ; of all such choices it takes the one with
the largest sum of log-odds, by one pass up and one pass down the tree. So a choice never contradicts one above it.

Character references are decoded, white space in a block becomes one space, and blocks are joined by one space in
page order. Null and empty pages, and pages without main text, give an empty text. Every row gives one row, repeated rows
too; an empty table gives none. Extra columns pass through, but for ``text`` and ``n_chars``, which are replaced. A page is
held whole by its task, in time and memory linear in its length.
"""

from __future__ import annotations

import json
import random
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import dom

TRAINING_PAGES = 2400
TREES, DEPTH = 30, 5
KEPT = Path(__file__).with_name("html_trees.json")
#: Log-odds that an element must gain by being mixed.
MIXED_COST = 0.05


def training_page(seed: int) -> str:
    """A laid-out page; ``data-main`` marks the elements whose text is the article's."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeiourstlnmdchpgbfvéüñ") for _ in range(r.randint(1, 10)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    stop = r.choice([".", ".", ".", "!", " ###", "%%%", " |"])
    brief = r.random() < 0.2  # an article of a few words
    sentence = lambda a=1, b=18: words(a, min(b, 3) if brief else b).capitalize() + stop
    prose = lambda: " ".join(sentence() for _ in range(r.choice([1, 1, 2] if brief else [1, 1, 2, 4, 9])))
    links = lambda a, b: "".join(f'<li><a href="/{word()}">{words(1, 2)}</a></li>' for _ in range(r.randint(a, b)))
    maybe = lambda p, x: x() if r.random() < p else ""
    name = lambda *x: r.choice(x)
    advert = lambda: f'<div class="{name("ad", "ads banner", "sponsored", "promo box", "advert")}">{r.choice([sentence, prose])()}</div>'
    notice = lambda: f'<div {name("class", "id")}="{name("cookie-notice", "consent", "newsletter", "alert gdpr", "popup")}"><p>{prose()}</p><a href="#">{words(1, 2)}</a></div>'
    plain = lambda a, b: "".join(f"<li>{words(1, 2)}</li>" for _ in range(r.randint(a, b)))
    menu = lambda: name(f"<nav><ul>{links(3, 9)}</ul></nav>", f"<nav>{name(words(1, 1), words(1, 12), f'<ul>{plain(1, 9)}</ul>', f'<div>{words(1, 6)}</div>', f'<p>{words(1, 4)}</p>')}</nav>", f'<div class="{name("menu", "navbar", "breadcrumbs")}"><ul>{name(links, plain)(3, 9)}</ul></div>')
    header = lambda: name(f"<header><div class='{name('logo', 'masthead', 'site-title')}'>{words(1, 5)}</div>{maybe(0.5, menu)}</header>", f"<header>{name(words(1, 5), f'<p>{words(1, 9)}</p>', f'<div>{words(1, 6)}</div>')}{maybe(0.4, menu)}</header>")
    footer = lambda: name(f"<footer>&copy; {word()}.example.com &middot; {prose()}</footer>", f'<div id="footer"><ul>{links(2, 6)}</ul><p>{sentence()}</p></div>', f"<footer><p>{prose()}</p><p>{sentence()}</p></footer>", f"<footer>{words(1, 8)}</footer>")
    side = lambda: name("<aside>{}</aside>", '<div class="sidebar widget">{}</div>', '<div id="related">{}</div>').format(f"<h3>{words(1, 4)}</h3>" + name(f"<ul>{links(2, 8)}</ul>", f"<p>{prose()}</p>", f"<p>{prose()}</p><p>{prose()}</p>", f"<ul>{plain(1, 8)}</ul>")) if r.random() < 0.8 else f"<aside>{words(1, 12)}</aside>"
    form = lambda: f'<form><label>{words(1, 3)}</label><input name="q"><button>{word()}</button></form>'
    remark = lambda: f'<div class="{name("comment", "reply", "comment-body")}"><b>{word()}</b><p>{prose()}</p></div>'
    remarks = lambda: name('<div class="comments">{}</div>', '<section id="comments">{}</section>', "<ul class='comment-list'>{}</ul>").format(f"<h3>{words(1, 3)}</h3>" + "".join(remark() for _ in range(r.randint(1, 6))))
    share = lambda: f'<div class="{name("share", "social follow", "byline meta")}"><a href="#">{word()}</a> <a href="#">{word()}</a></div>'
    broken = r.random() < 0.4
    style = r.choice(["p", "p", "p", "p", "p", "div", "div", "bare"])  # what holds the article's paragraphs

    def paragraph() -> str:
        kind = r.random()
        if style != "p" and kind < 0.78:
            inner = prose() + maybe(0.2, lambda: f' <a href="/{word()}">{words(1, 4)}</a> {sentence()}')
            return f"<div data-main=1>{inner}</div>" if style == "div" else f"{inner}<br><br>"
        if kind < 0.78:
            inner = prose()
            if r.random() < 0.2:
                inner += f' <a href="/{word()}">{words(1, 4)}</a> {sentence()}'
            return f"<p data-main=1><b>{inner}<br>" if broken and r.random() < 0.3 else f"<p data-main=1>{inner}</p>"
        if kind < 0.86:
            return f"<h{r.randint(2, 4)} data-main=1>{words(1, 7)}</h2>"
        if kind < 0.92:
            return "<ul>" + "".join(f"<li data-main=1>{sentence()}</li>" for _ in range(r.randint(2, 6))) + "</ul>"
        if kind < 0.96:
            return f"<blockquote data-main=1>{prose()}</blockquote>"
        return "<table>" + "".join(f"<tr><td data-main=1>{words(1, 4)}</td><td data-main=1>{words(1, 4)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>"

    parts = [paragraph() for _ in range(r.choice([1, 1, 2, 3]) if brief else r.choice([1, 2, 3, 5, 8, 14, 30]))]
    brief = False
    if r.random() < 0.35:
        parts.insert(r.randint(0, len(parts)), r.choice([advert, side, share, notice])())
    title = maybe(0.8, lambda: f"<h1 data-main=1>{words(1, 9)}{maybe(0.2, lambda: stop)}</h1>")
    if r.random() < 0.15:
        title = f"<header>{title}</header>"
    shell = r.choice(["<article>{}</article>", "<article>{}</article>", "<article>{}</article>", "<main>{}</main>", '<div class="post-content">{}</div>', '<div id="main"><div class="entry">{}</div></div>', '<section class="story"><div class="article-body">{}</div></section>', "<main><article>{}</article></main>", '<div class="text">{}</div>', "<div>{}</div>", '<div id="content">{}</div>', "{}"])
    if style == "bare" and shell != "{}":  # the text is the innermost shell's own
        head, hole, tail = shell.partition(">{}")
        shell = f"{head} data-main=1{hole}{tail}"
    body = shell.format(title + maybe(0.2, share) + "".join(parts) + maybe(0.15, share) + maybe(0.15, remarks))
    before = [header] * (r.random() < 0.4) + [menu] * (r.random() < 0.8) + [notice] * (r.random() < 0.25) + [advert] * (r.random() < 0.5) + [side] * (r.random() < 0.15) + [form] * (r.random() < 0.2)
    after = [advert] * (r.random() < 0.2) + [remarks] * (r.random() < 0.4) + [side] * (r.random() < 0.35) + [notice] * (r.random() < 0.1) + [footer] * (r.random() < 0.85)
    wrap = r.choice(["{}", "{}", '<div id="page">{}</div>', '<div class="container"><div class="row">{}</div></div>', '<form id="aspnetForm"><div>{}</div></form>'])
    if r.random() < 0.12:  # nothing but the article, or its parts
        if style != "bare" and r.random() < 0.6:
            body = title + "".join(parts)
        return r.choice(["{}", "<body>{}</body>"]).format(body) if style != "bare" else f"<body data-main=1>{body}</body>"
    return f"<html><head><title>{words(2, 6)}</title></head><body{' data-main=1' * (style == 'bare' and shell == '{}')}>{wrap.format(''.join(f() for f in before) + body + ''.join(f() for f in after))}</body></html>"


def labelled(seeds: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features and label of each node with text on the training pages."""
    for batch in seeds:
        xs, ys = [], []
        for seed in batch.column(0).to_pylist():
            page = training_page(seed)
            nodes, _ = dom.parse(page)
            own = {id(n): n.own * n.label for n in nodes}
            for n in reversed(nodes):
                if n.parent:
                    own[id(n.parent)] += own[id(n)]
            for n, x in zip(nodes, dom.features(nodes, len(page))):
                if n.chars:
                    xs.append(x)
                    ys.append(float(2 * own[id(n)] > n.chars))
        yield pa.RecordBatch.from_arrays([pa.array(xs, pa.list_(pa.float64())), pa.array(ys, pa.float64())], ["x", "label"])


class Trees:
    """Boosted trees as arrays: by tree and node, the feature, threshold and children (leaves point to themselves) and value."""

    def __init__(self, trees: list[list[list[float]]]) -> None:
        self.nodes = trees
        self.depth, self.parts = 0, []
        for tree in trees:
            feature, threshold, left, right, value = (np.array(x) for x in zip(*tree))
            self.parts.append((feature.astype(int), threshold, left.astype(int), right.astype(int), value))
            depth = [0] * len(tree)
            for i, (_, _, a, b, _) in enumerate(tree):  # children come after their node
                for c in {a, b} - {i}:
                    depth[c] = depth[i] + 1
            self.depth = max(self.depth, *depth)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, threshold, left, right, value in self.parts:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
            out += value[at]
        return 2 * out  # the loss is log(1 + exp(-2 y f))


def train(spark: SparkSession, pages: int = TRAINING_PAGES) -> Trees:
    rows = spark.range(0, pages, 1, 4).mapInArrow(labelled, "x array<double>, label double").select(array_to_vector("x").alias("features"), "label").cache()
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=11, maxBins=64).fit(rows)
    rows.unpersist()

    def flat(node, weight: float, out: list[list[float]]) -> int:
        me = len(out)
        out.append([0, 0.0, me, me, weight * node.prediction()])
        if node.subtreeDepth() > 0:
            split = node.split()
            out[me] = [split.featureIndex(), split.threshold(), flat(node.leftChild(), weight, out), flat(node.rightChild(), weight, out), 0.0]
        return me

    trees: list[list[list[float]]] = []
    for tree, weight in zip(model.trees, model.treeWeights):
        trees.append([])
        flat(tree._call_java("rootNode"), weight, trees[-1])
    return Trees(trees)


def kept_trees() -> Trees:
    """The trees that ``train`` gave for this module's pages."""
    return Trees(json.loads(KEPT.read_text()))


def decode(nodes: list[dom.Node], odds: list[float]) -> list[bool]:
    """Whether each node's own text is main text."""
    n = len(nodes)
    place = {id(x): i for i, x in enumerate(nodes)}
    s = [o if x.chars else 0.0 for x, o in zip(nodes, odds)]
    main, other, mixed = list(s), [-v for v in s], [abs(v) if x.own else -MIXED_COST for x, v in zip(nodes, s)]
    for i in range(n - 1, 0, -1):
        p = place[id(nodes[i].parent)]
        main[p] += main[i]
        other[p] += other[i]
        mixed[p] += max(main[i], other[i], mixed[i])
    state, out = [""] * n, [False] * n
    for i, x in enumerate(nodes):
        above = state[place[id(x.parent)]] if i else "mixed"
        state[i] = above if above != "mixed" else "mixed" if i == 0 else max((main[i], "main"), (other[i], "other"), (mixed[i], "mixed"))[1]
        out[i] = state[i] == "main" or state[i] == "mixed" and s[i] > 0
    return out


def extract(pages: DataFrame, trees: Trees, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` in place of the html."""
    names = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    schema = T.StructType([*[pages.schema[n] for n in names], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, max(1, batch.num_rows), 256):
                part = batch.slice(start, 256)
                parsed = [dom.parse(h or "") for h in part.column(html_col).to_pylist()]
                sizes = [len(h or "") for h in part.column(html_col).to_pylist()]
                rows = [x for (nodes, _), size in zip(parsed, sizes) for x in dom.features(nodes, size)]
                odds = trees.log_odds(np.array(rows)).tolist() if rows else []
                texts, at = [], 0
                for nodes, segments in parsed:
                    keep = decode(nodes, odds[at : at + len(nodes)])
                    at += len(nodes)
                    texts.append(" ".join(t for i, t in segments if keep[i]))
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    return pages.select(*names, html_col).mapInArrow(run, schema)


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages, kept_trees()).select("page_id", "url", "text", F.col("n_chars"))


if __name__ == "__main__":
    session = SparkSession.builder.master("local[4]").getOrCreate()
    KEPT.write_text("[\n" + ",\n".join(json.dumps(t) for t in train(session).nodes) + "\n]\n")
