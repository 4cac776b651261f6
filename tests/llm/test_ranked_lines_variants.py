"""Ranked search, line dedup and spelling variants against plain loops."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutledger.llm import lines, queries, ranked, variants

WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# Ranked search.


def ranks(docs, items, k=50):
    terms = [TERM.findall((t or "").translate(LOWER)) for _, t in docs]
    n_docs, n_terms = sum(bool(t) for t in terms), sum(map(len, terms))
    df = Counter(x for t in terms for x in set(t))
    out = []
    for item, text in items:
        scored = []
        for at, ((doc, _), t) in enumerate(zip(docs, terms)):
            tf, score = Counter(t), 0
            for x in set(TERM.findall((text or "").translate(LOWER))):
                if tf[x]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1)))
                    m = 100 - 50 + 50 * len(t) * n_docs // n_terms
                    score += w * (1_000_000_000 * tf[x] // (1000 * tf[x] + 20 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, at))
        for r, (score, none, doc, _) in enumerate(sorted(scored)[:k], 1):
            out.append((item, r, None if none else doc, -score))
    return sorted(out, key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["naïve", "Straße", "ÀB", "x1"]
    odds = [1 / (i + 1) for i in range(len(vocabulary))]
    text = lambda m: " ".join(rng.choices(vocabulary, odds, k=m)).replace("w1 ", "W1, ")
    docs = [(i * 7 % 1009, text(rng.choice([1, 3, 20, 60, 200]))) for i in range(n)]
    docs += [(2000 + i, docs[3][1]) for i in range(70)]  # equal scores beyond the k best
    docs += [(3000, None), (3001, ""), (3002, " .,;\x7f"), (3003, "w0 " * 5000)]
    items = [(i, text(rng.choice([1, 4, 30]))) for i in range(12)] + [(20, None), (21, "unknown words"), (22, "w3 W3 w3")]
    return docs, items


@pytest.mark.parametrize(("k", "item_terms", "postings"), [(50, 200_000, 1_000_000), (5, 15, 40)])
def test_ranks_equal_full_scoring(spark, rows, k, item_terms, postings):
    docs, items = corpus(1, 300)
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"score": F.lit("mine"), "rank": F.lit(1)}).repartition(3)
    i = spark.createDataFrame(items, "item_id bigint, text string")
    got = ranked.search(d, i, k=k, item_terms=item_terms, postings=postings)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect()), key=repr) == ranks(docs, items, k)


def test_ranks_with_null_and_repeated_ids(spark):
    docs = [(None, "aa bb"), (None, "aa bb"), (5, "aa"), (5, "aa"), (4, "aa cc"), (9, "dd")]
    items = [(None, "aa"), (1, "bb"), (1, "bb")]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert sorted(map(tuple, ranked.search(d, i).collect()), key=repr) == ranks(docs, items)


def test_ranks_of_empty_tables(spark):
    d, i = spark.createDataFrame([(1, "aa")], "doc_id bigint, text string"), spark.createDataFrame([(1, "aa")], "item_id bigint, text string")
    assert ranked.search(d.where("false"), i).collect() == []
    assert ranked.search(d, i.where("false")).collect() == []
    assert ranked.search(spark.createDataFrame([(1, None)], "doc_id bigint, text string"), i).collect() == []


def test_lists_are_read_only_as_far_as_needed():
    rng = np.random.default_rng(3)
    n, m = 20_000, 4
    impacts = (1e6 / (1 + np.arange(n * m) // m % 5000) ** 0.7).astype(np.int64) + rng.integers(0, 50, n * m)
    lists = ranked.Lists(np.full(n, m), np.tile(np.arange(m), n), impacts, m)
    docs, scores = lists.search(np.arange(m), 10, np.zeros(0, np.int64))
    total = impacts.reshape(n, m).sum(axis=1)
    best = np.sort(total)[-10]
    assert lists.accessed < n / 20
    assert set(docs.tolist()) == set(np.flatnonzero(total >= best).tolist()) and (total[docs] == scores).all()


# Line dedup.


def line_rows(docs, shortest=10, least=2):
    key = lambda x: x.strip(WHITE).translate(LOWER)
    split = [(t or "").split("\n") for _, t in docs]
    holders = defaultdict(set)
    for at, ls in enumerate(split):
        for x in ls:
            if len(key(x)) >= shortest:
                holders[key(x)].add((docs[at][0] is None, docs[at][0] or 0, at))
    out = []
    for at, ls in enumerate(split):
        stay = [x for x in ls if len(holders.get(key(x), ())) < least or min(holders[key(x)])[2] == at]
        out.append((docs[at][0], len(ls), len(ls) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return out


def line_docs():
    rng = random.Random(12)
    pool = [f"line number {i} of all" for i in range(40)] + ["short", "ÄÖ not ascii line", "äö not ascii line", "K kelvin sign here", "", "  ", "123456789", "0123456789"]
    docs = []
    for i in range(120):
        ls = [rng.choice(["", " ", "\t"]) + (x.upper() if rng.random() < 0.2 else x) + rng.choice(["", "\r", "\x0b "]) for x in rng.choices(pool, k=rng.choice([1, 2, 8, 40]))]
        docs.append((i * 37 % 1000, "\n".join(["  THE one Line of a third " if i % 3 else "own line of " + str(i), *ls, f"only here {i}", f"only here {i}"])))
    return [*docs, (2000, None), (2001, ""), (2002, "\n\n"), (2003, "\n".join(f"a long text of many lines {i % 9000}" for i in range(20_000)))]


def test_lines_equal_a_plain_loop(spark, rows):
    docs = line_docs()
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    assert rows(lines.query(df)) == sorted(line_rows(docs))
    df = df.withColumns({"drop": F.lit("mine"), "_row_key": F.lit(7), "a.b": F.lit(1), "lines": F.lit(2)})
    kept = lines.dedup(df, least=3)
    assert kept.columns == df.columns and kept.where("drop = 'mine' AND _row_key = 7 AND lines = 2").count() == len(docs)
    assert {(r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in kept.collect()} == {(r[0], r[3]) for r in line_rows(docs, least=3)}


def test_lines_with_null_and_repeated_ids(spark):
    text = "a line that all of them hold\nmine"
    docs = [(None, text), (None, text), (7, text), (7, text)]
    got = sorted((str(r.doc_id), r.n_dropped) for r in lines.query(spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)).collect())
    assert got == [("7", 0), ("7", 1), ("None", 1), ("None", 1)]


def test_lines_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert lines.query(df).collect() == [] and lines.dedup(df).columns == df.columns


def test_no_python_worker_on_lines(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    assert "Python" not in lines.query(df)._jdf.queryExecution().executedPlan().toString().replace("PythonRDD", "")


# Spelling variants.


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variant_rows(counts):
    form, out = {}, []
    close = {w: [v for v in counts if near(w, v)] for w in counts}
    for w, ns in close.items():
        best = min(ns, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(close[w]), counts[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def made_words(seed=13, n=500):
    rng = random.Random(seed)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 8))): rng.choice([3, 4, 6, 12, 24, 50, 100, 200]) for _ in range(n)}
    return words | {"aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 12, "aaaaaaaa": 24, "z" * 3000: 5, "z" * 3001: 10, "ünter": 7, "unter": 7}


@pytest.mark.parametrize("parts", [1, 7])
def test_variants_equal_all_comparisons(spark, parts):
    words = made_words()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", parts == 1)
    try:
        df = spark.createDataFrame(list(words.items()), "word string, n bigint").repartition(4)
        got = variants.grouped(df)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert sorted(map(tuple, got.collect()), key=repr) == variant_rows(words)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trie_numbers_a_prefix_once_across_parts(spark):
    rng = random.Random(5)
    # So many words share a long beginning that their nodes reach over several parts.
    words = sorted({"commonbeginning" * rng.randint(0, 2) + "".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(900)})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = variants.trie(spark.createDataFrame([(w,) for w in words], "w string"), "w").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.part for r in got}) > 4 and [r.word for r in sorted(got, key=lambda r: (r.part, r.at))] == words
    node = {}
    for r in got:
        assert len(r.path) == len(r.word) + 1
        for i, x in enumerate(r.path):
            assert node.setdefault(r.word[:i], x) == x
    assert len(set(node.values())) == len(node)


def test_words_are_counted_after_thinning(spark, rows):
    rng = random.Random(4)
    pool = ["Haus", "Häuser", "naïve", "PLANETS", "planets", "x×y÷zz", "abcdefgh"] + [f"word{c}{d}" for c in "abcdefgh" for d in "stuvwxyz"]
    docs = [(i, " ".join(rng.choices(pool, k=80)) + "9") for i in range(120)] + [(None, "planets, planets"), (500, None), (501, ""), (502, "q" * 50_000)]
    want = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += len(run) >= 5
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("n", F.lit("mine")).repartition(3)
    want = {w: n for w, n in want.items() if n >= 3}
    assert rows(variants.word_counts(df)) == sorted(want.items()) and any(w.startswith("wor") and len(w) == 5 for w in want)
    assert sorted(map(tuple, variants.query(df).collect()), key=repr) == variant_rows(want)


def test_variants_of_an_empty_table(spark):
    assert variants.query(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_line_dedup"])
def test_oracles(spark, name):
    from oracle import DATA, compare, duck

    sf = f"{DATA}/sf0.001"
    assert compare(queries.QUERIES[name](spark, sf), duck(sf), queries.ORACLES[name]) is None
