"""Language, quality and page models: brute force on small input, accuracy on held-out rows."""

import math
import random

import numpy as np
import pytest
from oracle import DATA
from pyspark.sql import functions as F

from cutledger.llm import dom, html, language, quality

SF = f"{DATA}/sf0.001"
PATH = language.vocabulary_path()


def brute(word, table):
    """Sum over all segmentations, one by one."""
    if not word:
        return 1.0
    total = 0.0
    for n in range(1, min(len(word), language.LONGEST) + 1):
        head = word[:n]
        p = table.get(head, 0.0)
        if n == 1:
            p = max(p, language.UNKNOWN)
        total += p * brute(word[n:], table) if p else 0.0
    return total


@pytest.fixture(scope="module")
def vocabulary():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    return [x for x in (model.id_to_piece(i) for i in range(model.get_piece_size())) if 0 < len(x) <= language.LONGEST]


def test_forward_sums_all_segmentations(vocabulary):
    hashes, lengths = language.pieces(PATH)
    rng = np.random.default_rng(3)
    p = rng.random((len(lengths), 2))
    p /= p.sum(axis=0)
    place = {int(h): i for i, h in enumerate(hashes)}
    code = lambda x: int(language._prefix_sums(language._codes([x], len(x)))[0, -1])
    words = ["▁the", "▁nation", "▁", "▁über", "▁xyzzyq", "▁日本", "▁thenation", "▁a1b2"]
    got = language.log_likelihoods(PATH, words, p)
    for k in range(2):
        table = {x: p[place[code(x)], k] for x in vocabulary if code(x) in place}
        for i, w in enumerate(words):
            assert got[i, k] == pytest.approx(math.log(brute(w, table)), rel=1e-9)


def test_expected_counts_cover_every_character():
    _, lengths = language.pieces(PATH)
    p = np.full(len(lengths), 1 / len(lengths))
    words, counts = ["▁the", "▁nation", "▁the"], np.array([2.0, 1.0, 3.0])
    assert (language.expected(PATH, words, counts, p) * lengths).sum() == pytest.approx(sum(len(w) * c for w, c in zip(words, counts, strict=True)))


def test_scorer_with_a_small_memory_gives_the_same():
    _, lengths = language.pieces(PATH)
    p = np.random.default_rng(0).random((len(lengths), 3))
    texts = [" ".join(f"w{i}{k}" for i in range(k)) for k in (0, 3, 30, 90)] + ["x" * 1000]
    for a, b in zip(language.Scorer(PATH, p)(texts), language.Scorer(PATH, p, most=20)(texts), strict=True):
        assert a == pytest.approx(b)


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.query(docs.withColumn("score", F.lit("mine"))).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and held and all(0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)


ODD = "doc_id bigint, text string, lang string"


def test_language_of_odd_rows(spark):
    rows = [(i, t, "en") for i, t in enumerate(["the house and the garden", "and so it was that he went", "this is the one"] * 10)]
    rows += [(i + 50, t, "de") for i, t in enumerate(["das haus und der garten", "und so ging er nicht", "das ist nicht schön"] * 10)]
    odd = [(100, None, "en"), (101, "", None), (102, "123 --- !!", "en"), (103, "der garten und das haus " * 9000, None), (None, "the garden and the house", None), (104, "the one", None), (104, "the one", None)]
    got = language.query(spark.createDataFrame(rows + odd, ODD)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) + len(odd)
    assert [by[k].lang_pred for k in (100, 101, 102, 103, None, 104)] == ["und", "und", "und", "de", "en", "en"]
    assert by[100].score == 0


def test_language_without_labels_or_rows(spark):
    nothing = spark.createDataFrame([], ODD)
    assert language.query(nothing).collect() == []
    assert [(r.lang_pred, r.score) for r in language.query(spark.createDataFrame([(1, "text", None)], ODD)).collect()] == [("und", 0.0)]


def test_votes_of_the_nearest_against_plain_loops():
    rng = np.random.default_rng(5)
    n, rank = 60, 6
    vectors = rng.normal(size=(n, rank))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    model = quality.Model(np.ones(quality.TERMS), rng.normal(size=(quality.TERMS, rank)), vectors.astype(np.float32), rng.integers(0, 2, n), rng.random(n) + 0.5)
    counts = rng.poisson(0.05, (8, quality.TERMS)).astype(float)
    for c, got in zip(counts, model.score(counts), strict=True):
        v = np.log1p(c)
        v = v / np.linalg.norm(v) @ model.space
        cos = model.vectors @ (v / np.linalg.norm(v))
        top = sorted(range(n), key=lambda i: -cos[i])[: quality.NEIGHBOURS]
        votes = [max(cos[i], 0) ** quality.SHARPNESS * model.worth[i] for i in top]
        assert got == pytest.approx(sum(x * model.labels[i] for x, i in zip(votes, top, strict=True)) / sum(votes), rel=1e-3)


def test_quality_on_held_out_rows(spark):
    sf = f"{DATA}/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.query(docs, labels)
    assert got.count() == docs.count()
    held = got.join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in held)


def test_quality_of_odd_rows(spark):
    docs = [(i, "good plain words in a line " * 3, None) for i in range(30)] + [(i, "BAD!!! ### $$$ BAD!!! " * 3, None) for i in range(30, 60)]
    docs += [(70, None, None), (71, "", None), (None, "x", None), (72, "y " * 60_000, None), (72, "y", None)]
    labels = [(i, int(i < 30), 0) for i in range(60)] + [(5, 1, 0), (None, 1, 0), (6, None, 0), (999, 1, 0)]
    d, y = spark.createDataFrame(docs, ODD).withColumn("label", F.lit(1)), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = quality.query(d, y).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == int(r.doc_id < 30) for r in got if r.doc_id is not None and r.doc_id < 60)
    assert [r.score for r in quality.query(d.limit(1), y.where("false")).collect()] == [0.5]
    assert quality.query(d.where("false"), y).collect() == []


PAGES = "page_id bigint, url string, html string, text string"


@pytest.fixture(scope="module")
def trees(spark):
    return html.learn(spark.read.parquet(f"{SF}/pages.parquet"))


def test_pages_of_the_table(spark, trees):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html.extract(pages, trees).collect()}
    for r in pages.collect():
        root = dom.parse(r.html)
        article = next(v for v in dom.walk(root) if v.tag == "article")
        assert got[r.page_id] == "\n".join(v.text for v in dom.walk(article) if v.text is not None)


LONG = "Words of a sentence that goes on for a while, as sentences in an article do, with a comma here and there. " * 4
LAYOUTS = {
    "div": f'<div class="menu"><ul><li><a href=#>Home</a></li><li><a href=#>News</a></li><li><a href=#>About</a></li></ul></div><div id="main-content"><h1>The title of it</h1><p>{LONG}</p><p>{LONG}</p></div><div class="sidebar"><h3>Links</h3><ul><li><a href=#>One</a></li><li><a href=#>Two</a></li></ul></div><div class="footer">Copyright Us</div>',
    "comments": f'<nav><ul><li><a href=#>Home</a></li><li><a href=#>News</a></li></ul></nav><article><h1>The title of it</h1><p>{LONG}</p><p>{LONG}</p></article><section class="comments"><h3>Comments</h3><div class="comment"><p>{LONG}I do not agree.</p></div></section><footer>&copy; Us</footer>',
    "notice": f'<div class="cookie-notice"><p>We use cookies. {LONG}</p></div><header><div>Site</div><p>Its motto</p></header><main><article><h1>The title of it</h1><p>{LONG}<p>{LONG}</article></main><aside><p>{LONG}aside</p></aside><form><label>Mail</label><input><button>Go</button></form>',
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_other_layouts(trees, name):
    want = "\n".join(["The title of it", LONG.strip(), LONG.strip()])
    assert html.extracted([f"<html><body>{LAYOUTS[name]}</body></html>"], trees) == [want]


def test_blocks_and_markup():
    page = "<!doctype html><title>T</title><p>a &amp; b&nbsp;c<b> d<br>e <p>f<!-- x --><script>var t='</p>';</script>g<style>p{}</style><div>h<p>i</div>&lt;j&gt; &eacute;&am <a href='x>y'>k</a><ul><li>l<li>m</ul><img alt=n><p title="
    texts = [v.text for v in dom.walk(dom.parse(page)) if v.text is not None]
    assert texts == ["a & b c d e", "fg", "h", "i", "<j> é&am k", "l", "m"]
    assert [v.text for v in dom.walk(dom.parse("")) if v.text] == [] == [v.text for v in dom.walk(dom.parse("<div><p> \n</p>")) if v.text]
    assert [v.text for v in dom.walk(dom.parse("x <b>y")) if v.text] == ["x y"]
    assert len(dom.walk(dom.parse("<div>" * 5000 + "deep"))) == 5002


def test_decoding_equals_the_best_consistent_choice():
    rng = random.Random(2)

    def grow(parent, depth):
        for _ in range(rng.randint(0, 3)):
            v = dom.Node("div", parent)
            parent.children.append(v)
            if depth and rng.random() < 0.6:
                grow(v, depth - 1)
            if not v.children:
                v.text = f"t{rng.random()}"

    for _ in range(60):
        root = dom.Node("html", None)
        grow(root, 2)
        nodes = dom.walk(root)
        if len(nodes) > 13:
            continue
        scores = [rng.gauss(0, 1) for _ in nodes]
        best = (-1.0, None)
        place = {id(v): i for i, v in enumerate(nodes)}
        for bits in range(1 << len(nodes)):
            on = lambda v: bits >> place[id(v)] & 1  # noqa: E731, B023
            if not on(root) or any(on(v) and not on(v.parent) for v in nodes[1:]):
                continue
            total = sum(s for v, s in zip(nodes[1:], scores[1:], strict=True) if on(v))
            if total > best[0]:
                best = (total, [v.text for v in nodes if v.text is not None and on(v)])
        assert dom.decode(nodes, scores) == (best[1] or [])


def test_odd_pages(spark, trees):
    rows = [(1, "u", None, ""), (2, None, "", ""), (None, "u", "<p>", ""), (3, "u", "plain words, no markup", ""), (3, "u", "plain words, no markup", ""), (4, "u", "<article>" + f"<p>{LONG}" * 800, "")]
    got = html.extract(spark.createDataFrame(rows, PAGES), trees).collect()
    assert len(got) == len(rows) and all(r.text is not None for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[2] == by[None] == "" and by[4].count("\n") == 799
    assert html.query(spark.createDataFrame([], PAGES)).collect() == []
