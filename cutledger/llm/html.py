"""Main text of web pages: boosted trees over the nodes of the page, decoded from the top down."""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutledger.llm import dom
from cutledger.llm.common import stored, text_of

#: Pages whose texts the training pages are filled with (chosen by a hash of the id), training
#: pages made of each, trees and their depth.
SAMPLE, MADE, TREES, DEPTH = 200, 10, 24, 5
SEED = 11


@dataclass
class Trees:
    """Boosted trees as arrays, one row per tree: feature (-1: leaf), threshold, children, value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for f, t, left, right, v in zip(self.feature, self.threshold, self.left, self.right, self.value, strict=True):
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                go = x[rows, np.maximum(f[at], 0)] <= t[at]
                at = np.where(f[at] < 0, at, np.where(go, left[at], right[at]))
            total += v[at]
        return 2 * total


def _trees(model) -> Trees:
    """The fitted model's nodes, read once on the driver: at most TREES times 2^(DEPTH+1)."""
    size = 2 ** (DEPTH + 1)
    out = Trees(np.full((len(model.trees), size), -1), *(np.zeros((len(model.trees), size), kind) for kind in (float, int, int, float)), DEPTH)
    for k, (tree, weight) in enumerate(zip(model.trees, model.treeWeights, strict=True)):
        todo, n = [(tree._java_obj.rootNode(), 0)], 1
        while todo:
            node, i = todo.pop()
            if node.subtreeDepth() == 0:
                out.value[k, i] = weight * node.prediction()
                continue
            out.feature[k, i], out.threshold[k, i] = node.split().featureIndex(), node.split().threshold()
            out.left[k, i], out.right[k, i] = n, n + 1
            todo += [(node.leftChild(), n), (node.rightChild(), n + 1)]
            n += 2
    return out


def made_page(texts: list[str], rng: random.Random) -> str:
    """A page in one of many layouts, filled with `texts`; data-main tells what is main text.

    What it teaches is how parts of pages are usually marked up and placed, not what they say.
    """
    names = lambda *x: rng.choice(["", *(f' class="{n}"' for n in x), *(f' id="{n}"' for n in x)])
    named = lambda *x: rng.choice([f' {a}="{n}"' for n in x for a in ("class", "id")])
    some = lambda n: " ".join(rng.choice(texts).split()[: rng.randint(1, n)])
    long = lambda: rng.choice(texts)
    links = lambda n: "".join(f'<li><a href="#">{some(4)}</a></li>' for _ in range(rng.randint(2, n)))
    inline = lambda t: t if rng.random() < 0.6 else rng.choice([f"<b>{t}", f'{t} <a href="#">{some(3)}</a>', f"<em>{t}</em>", f"{t}<br>{some(8)}", f"<b>{t}<br>"])

    def main() -> str:
        parts = [f'<h1 data-main="1">{some(12)}</h1>'] if rng.random() < 0.8 else []
        if parts and rng.random() < 0.2:
            parts = [f"<header>{parts[0]}</header>"]
        for _ in range(rng.choice([1, 2, 4, 8, 16, 40])):
            kind = rng.random()
            if kind < 0.7:
                parts.append(f'<p data-main="1">{inline(long() if rng.random() < 0.7 else some(6))}' + "</p>" * (rng.random() < 0.8))
            elif kind < 0.78:
                parts.append(f'<h{rng.randint(2, 4)} data-main="1">{some(8)}</h2>')
            elif kind < 0.86:
                parts.append("<ul>" + "".join(f'<li data-main="1">{some(20)}</li>' for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.91:
                parts.append(f'<blockquote data-main="1"><p data-main="1">{long()}</p></blockquote>')
            elif kind < 0.95:
                parts.append("<table>" + "".join(f'<tr><td data-main="1">{some(4)}</td><td data-main="1">{some(8)}</td></tr>' for _ in range(3)) + "</table>")
            else:
                parts.append(f'<div data-main="1">{long()}</div>')
            if rng.random() < 0.06:
                parts.append(rng.choice([advert, share, notice, form])())
        body = "".join(parts)
        box = rng.choice(["article", "article", "main", "div", "section", "td", "both"])
        near = named("content", "main-content", "post-body", "entry-content", "article-text", "story", "text", "page-content")
        if box == "both":
            return f"<main><article{names('post', 'entry')}>{body}</article></main>"
        if box == "td":
            return f"<table><tr><td{near}>{body}</td></tr></table>"
        return f"<{box}{near if box in ('div', 'section') and rng.random() < 0.8 else names('post', 'article')}>{body}</{box}>"

    def nav() -> str:
        return rng.choice([f"<nav><ul>{links(8)}</ul></nav>", f"<div{named('menu', 'nav', 'navbar', 'top-menu', 'breadcrumbs')}><ul>{links(9)}</ul></div>", f"<nav{names('main-nav')}>" + " | ".join(f'<a href="#">{some(3)}</a>' for _ in range(5)) + "</nav>"])

    def header() -> str:
        return f"<header{names('site-header', 'masthead')}><div>{some(4)}</div><p>{some(9)}</p></header>" if rng.random() < 0.6 else f"<div{named('header', 'top', 'masthead', 'topbar')}><h1>{some(4)}</h1><p>{some(8)}</p></div>"

    def footer() -> str:
        inside = rng.choice([f"&copy; {some(4)} &middot; {some(12)}", f"<p>&copy; {some(3)}</p><ul>{links(6)}</ul>", f"<p>{long()}</p><p>Copyright {some(4)}</p>", f"{some(3)} &middot; {long()}"])
        return f"<footer{names('footer')}>{inside}</footer>" if rng.random() < 0.65 else f"<div{named('footer', 'site-footer', 'bottom', 'copyright')}>{inside}</div>"

    def side() -> str:
        inside = rng.choice([f"<h3>{some(4)}</h3><ul>{links(7)}</ul>", f"<h2>{some(3)}</h2><p>{long()}</p>", f"<div><h4>{some(3)}</h4><p>{some(15)}</p></div><ul>{links(4)}</ul>", f"<p>{long()}</p><p>{some(30)}</p>"])
        return f"<aside{names('sidebar', 'related')}>{inside}</aside>" if rng.random() < 0.5 else f"<div{named('sidebar', 'side-column', 'widget', 'related-posts', 'recommended', 'tags')}>{inside}</div>"

    def advert() -> str:
        inside = rng.choice([long(), f"<p>{long()}</p>", some(12), f'<a href="#">{some(10)}</a>', f"<p>{some(20)}</p><p>{some(9)}</p>"])
        return f"<{(box := rng.choice(['div', 'div', 'section', 'aside']))}{named('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'banner-ad', 'ad-box')}>{inside}</{box}>"

    def notice() -> str:
        return f"<div{named('cookie-notice', 'cookie-banner', 'notice', 'alert', 'consent', 'gdpr', 'popup', 'warning')}><p>{rng.choice([long(), some(25), 'We use cookies. ' + some(15)])}</p></div>"

    def form() -> str:
        return f"<form{names('newsletter', 'search', 'login', 'signup')}><label>{some(4)}</label><input name=q><p>{rng.choice([long(), some(15)])}</p><button>{some(2)}</button></form>"

    def share() -> str:
        return f"<div{named('share', 'social', 'share-buttons')}>" + "".join(f'<a href="#">{some(2)}</a> ' for _ in range(3)) + "</div>"

    def comments() -> str:
        each = lambda: rng.choice([f'<div{named("comment", "reply")}><p>{long()}</p><p>{some(20)}</p></div>', f"<li{names('comment')}><b>{some(2)}</b><p>{long()}</p></li>", f"<article{named('comment')}><h4>{some(2)}</h4><p>{long()}</p></article>"])
        box = rng.choice(["div", "section", "ol"])
        return f"<{box}{named('comments', 'comment-list', 'discussion', 'responses-comments', 'reader-comments')}><h3>{some(3)}</h3>{''.join(each() for _ in range(rng.randint(1, 6)))}</{box}>"

    before = [x() for x in rng.sample([nav, header, advert, notice, side, form], rng.randint(0, 5))]
    after = [x() for x in rng.sample([comments, share, side, advert, notice, form], rng.randint(0, 5))]
    if rng.random() < 0.85:
        after.append(footer())
    rng.random() < 0.7 and before.insert(0, nav())
    middle = main()
    if rng.random() < 0.3:
        middle = f"<div{names('wrapper', 'container', 'page')}>{middle}{side() if rng.random() < 0.5 else ''}</div>"
    page = "".join([*before, middle, *after])
    return f"<html><body>{f'<div{names('wrapper', 'page', 'site')}>{page}</div>' if rng.random() < 0.3 else page}</body></html>"


def labelled(root: dom.Node) -> tuple[list[dom.Node], list[int]]:
    """Nodes and whether they hold main text."""
    nodes = dom.walk(root)
    holds: dict[int, int] = {}
    for v in reversed(nodes):
        holds[id(v)] = int(v.parent.mark == 1) if v.text is not None else int(any(holds[id(c)] for c in v.children))
    return nodes, [holds[id(v)] for v in nodes]


def _training(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        xs, ys = [], []
        for key, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            texts = [v.text for v in dom.walk(dom.parse(page)) if v.text and len(v.text) > 15] or ["text"]
            rng = random.Random(f"{SEED}|{key}")
            for _ in range(MADE):
                some = rng.sample(texts, min(len(texts), 40))
                nodes, y = labelled(dom.parse(made_page([" ".join(t.split()[: rng.choice([12, 60, 120, 100_000])]) for t in some], rng)))
                xs += dom.features(nodes)
                ys += y
        yield pa.RecordBatch.from_arrays([pa.array(xs, pa.list_(pa.float64())), pa.array(ys, pa.float64())], names=["x", "label"])


def learn(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> Trees | None:
    """Trees learned from made pages, filled with the texts of about `sample` given ones.

    No given page is labelled. None if there are no pages.
    """
    n = pages.count()
    if not n:
        return None
    rows = pages.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), text_of(html_col).alias("html"))
    chosen = rows.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < 1_000_000 * min(1.0, sample / n)).repartition(2, "key").sortWithinPartitions("key", "html")
    made = stored(chosen.mapInArrow(_training, "x array<double>, label double"), "nodes")
    if made.select("label").distinct().count() < 2:
        return learn(pages, id_col, html_col, 2 * n) if sample < n else None
    data = made.select(array_to_vector("x").alias("features"), "label")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=SEED, maxBins=32).fit(data)
    return _trees(model)


def extracted(pages: list[str], trees: Trees | None) -> list[str]:
    """The main text of each page: its blocks joined by line feeds."""
    trees_of = [dom.walk(dom.parse(p)) for p in pages]
    rows = [r for nodes in trees_of for r in dom.features(nodes)]
    scores = trees.log_odds(np.array(rows)) if trees is not None else np.ones(len(rows))
    out, at = [], 0
    for nodes in trees_of:
        out.append("\n".join(dom.decode(nodes, scores[at : at + len(nodes)].tolist())))
        at += len(nodes)
    return out


def _extract(trees: Trees | None, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            texts = extracted(part.column(2).to_pylist(), trees)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame, trees: Trees | None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text for every row; a null or empty page has an empty text. Other columns are
    ignored, ids and urls stay as they are, null or repeated."""
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_of(html_col).alias("html"))
    return rows.mapInArrow(partial(_extract, trees), "page_id bigint, url string, text string")


def query(pages: DataFrame) -> DataFrame:
    got = extract(pages, learn(pages))
    return got.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
