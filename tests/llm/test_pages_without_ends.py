"""Pages that leave out the end of their head or of an unseen element keep their text."""

import time

import pytest

from cutledger.llm import dom

CASES = {
    "<head><title>x</title><article><p>a<p>b</article>": ["a", "b"],
    "<html><head><meta charset=utf-8><link href=x><style>s</style><p>a</p></html>": ["a"],
    "<head><title>x</title>plain <b>a</b>": ["plain a"],
    "<head><title>x</title>only text": ["only text"],
    "<head><noscript><link href=x></head><body><p>a</body>": ["a"],
    "<head><noscript><link href=x><body><p>a<noscript>no</noscript>": ["a"],
    "<head><noscript><img src=x><p>no</p></noscript><title>t</title></head><body><p>a": ["a"],
    "<head><template><p>no</p></template></head>\n<p>a": ["a"],
    "<body><button>no<p>a<p>b</body>": ["a", "b"],
    "<div><select><option>no<option>no</div>a<p>b": ["a", "b"],
    "<body><select><option>no<hr><option>no<p>a": ["a"],
    "<object data=x><param name=y><p>a</p>": ["a"],
    "<noscript>no<h1>a</h1><div>b <button>no</button></div>": ["a", "b"],
    "<div><button>no</div><p>a</p><button>no<div>no</div></button>b": ["a", "b"],
    "<button><object>no</button>a": ["a"],
    "<p><button>no<p>no</p></button>a<noscript><p>no</p></noscript>b": ["ab"],
    "<ul><li><button>no<li>a</ul>": ["a"],
    "<select><option>no</select>a<svg><title>no</title></svg>": ["a"],
}


@pytest.mark.parametrize("page", CASES)
def test_texts(page):
    assert [v.text for v in dom.walk(dom.parse(page)) if v.text is not None] == CASES[page]


@pytest.mark.parametrize("page", ["<ul>" * 100_000 + "x" + "</div>" * 100_000, "<p>a" * 50_000 + "<li><ul>" + "<section>" * 50_000 + "<li>b</li>" * 50_000, "<button>" * 60_000 + "</svg>" * 60_000 + "y", "<table><tr><td>" * 40_000])
def test_deep_and_unmatched_markup_takes_time_in_proportion(page):
    start = time.time()
    nodes = dom.walk(dom.parse(page))
    assert len(nodes) > 0 and time.time() - start < 20


def test_formulas_and_drawn_text_stay():
    page = "<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><svg><title>t</title><style>a</style><text>label</text></svg></article>"
    assert [v.text for v in dom.walk(dom.parse(page)) if v.text is not None] == ["so x=2 holds", "label"]
