"""Near duplicates against brute force, with crowds, chains, ties and odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutledger.llm import near
from cutledger.llm.common import keyed
from cutledger.llm.components import components
from cutledger.llm.shingles import shingle_set, word_hashes

DOCS = "doc_id bigint, text string, component string"


def brute(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for k, text in rows:
        w = (text or "").translate(lower).encode().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k), find(k) == k) for k in keys}


def family(rng, n, words, change):
    base = [f"b{rng.randint(0, 10**6)}" for _ in range(words)]
    for _ in range(n):
        yield " ".join(f"n{rng.randint(0, 10**9)}" if rng.random() < change else w for w in base)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    texts = [t for n, words, change in ((40, 120, 0.01), (60, 60, 0.03), (40, 300, 0.02), (30, 12, 0.04), (80, 200, 0.035)) for t in family(rng, n, words, change)]
    passage = " ".join(f"p{i}" for i in range(70))
    texts += [passage + " " + " ".join(f"u{rng.randint(0, 10**9)}" for _ in range(rng.randint(5, 90))) for _ in range(80)]
    chain = [f"c{i}" for i in range(400)]
    texts += [" ".join(chain[i : i + 100]) for i in range(0, 300, 12)]
    texts += ["Exactly The SAME text, here\nand there"] * 30 + ["exactly  the same text, here and there"]
    texts += ["", None, " \n", "one", "one", "one two three", "one two  three", "x " * 3000, "x " * 2000, "É a b c d e", "é a b c d e"]
    return list(enumerate(texts))


@pytest.mark.parametrize("crowd", [near.CROWD, 16])
def test_against_brute_force(spark, rows, crowd, monkeypatch):
    monkeypatch.setattr(near, "CROWD", crowd)
    df = spark.createDataFrame([(*r, "mine") for r in rows], DOCS)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near.query(df).collect()}
    assert got == brute(rows)


def test_dedup_keeps_one_row_of_each_component_and_all_columns(spark, rows):
    df = spark.createDataFrame([(*r, "mine") for r in rows], DOCS)
    out = near.dedup(df)
    assert out.columns == df.columns
    assert {r.doc_id for r in out.collect()} == {k for k, v in brute(rows).items() if v[2]}


def test_repeated_and_null_ids(spark):
    text = "one two three four five six"
    df = spark.createDataFrame([(1, text, ""), (1, text, ""), (None, text, ""), (None, "other", "")], DOCS)
    assert sorted(map(tuple, near.dedup(df).collect()), key=str) == [(1, text, ""), (None, "other", "")]


def test_empty_table(spark):
    assert near.query(spark.createDataFrame([], DOCS)).collect() == []


def test_components_of_chains_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(100)] + [(500, i) for i in range(501, 700)] + [(900, 901), (901, 902), (902, 900), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert got == {**dict.fromkeys(range(101), 0), **dict.fromkeys(range(500, 700), 500), **dict.fromkeys([900, 901, 902], 900)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_sketch_estimates_high_similarities_within_its_slack():
    rng = np.random.default_rng(1)
    for size in (30, 300, 3000, 30000):
        for j in (0.5, 0.7, 0.8, 0.95):
            both = rng.integers(0, 1 << 63, int(size * 2 * j / (1 + j)), np.uint64) * np.uint64(2)
            sets = [np.unique(np.concatenate((both, rng.integers(0, 1 << 63, size - len(both), np.uint64)))) for _ in range(2)]
            n, bits = zip(*(near.sketch_of(s) for s in sets), strict=True)
            b = near._Bucket(np.arange(2), np.array([len(s) for s in sets]), np.array(n), bits, np.arange(2))
            may, sure, _ = b.compare(0, np.array([1]), 75)
            true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
            assert may[0] or true < 0.75
            assert not sure[0] or true >= 0.75


def test_long_texts_hash_the_same_in_steps(monkeypatch):
    text = ("lorem ipsum dolor sit amet " * 500).encode()
    whole = word_hashes(text)
    monkeypatch.setattr("cutledger.llm.shingles._STEP", 17)
    assert (word_hashes(text) == whole).all() and len(whole) == 2500
    assert len(shingle_set(text)) == 5


def test_keyed_rows_carry_their_columns(spark):
    df = spark.createDataFrame([(1, "a", "c")], DOCS).withColumn("rep", F.lit(1))
    assert near.decide(keyed(df)).count() == 1
