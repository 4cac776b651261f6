"""The pipeline's stages, each against a plain version on its own input."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import DATA, compare, duck
from test_near import brute

import __spark_entry__ as entry
import corpus_pipeline
from cutledger.llm import mix, queries, rules, tokens
from cutledger.llm.common import stored

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(stored(stage(spark, docs[-1], SF), name))
    return docs


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def by_sql(con, df, sql):
    con.register("documents_now", df.toPandas())
    return con.sql(sql.replace("FROM documents)", "FROM documents_now)")).fetchall()


def test_columns_stay_until_the_last(steps):
    assert all(x.columns == steps[0].columns for x in steps[:-1])


def test_rules(steps):
    con = duck(SF)
    assert ids(steps[1]) == {r[0] for r in con.sql(f"SELECT doc_id FROM ({rules.SQL}) WHERE kept").fetchall()}


def test_exact(steps):
    groups = defaultdict(list)
    for r in steps[1].collect():
        groups["".join(r.text.split(" ")).translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r")))].append((-len(r.text), r.doc_id))
    assert ids(steps[2]) == {min(g)[1] for g in groups.values()}


def test_near(steps):
    want = brute([(r.doc_id, r.text) for r in steps[2].collect()])
    assert ids(steps[3]) == {k for k, v in want.items() if v[2]}


def test_mix(steps):
    want = {r[0]: r[4] for r in by_sql(duck(SF), steps[3], mix.SQL)}
    got = Counter()
    for r in steps[4].collect():
        got[r.doc_id] += len(r.text.split())
    assert got == {k: v for k, v in want.items() if v}


def test_pack(steps):
    encode = tokens.encoder(tokens.vocabulary_path())
    want, got = Counter(), Counter()
    for r in steps[4].collect():
        i = np.append(np.frombuffer(encode([r.text])[0], encode.dtype), 0)
        want[r.doc_id, len(i)] += len(i)
    pieces = steps[5].collect()
    for r in pieces:
        got[r.doc_id, r.doc_tokens] += r.length
    assert got == want
    size = Counter()
    for r in pieces:
        size[r.sequence_id] += r.length
    assert max(size.values()) <= 1024


def test_run_gives_the_last_stage(spark, steps):
    assert corpus_pipeline.run(spark, SF).count() == steps[-1].count()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), duck(SF), queries.ORACLES[name]) is None


def test_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries()) and len(queries.QUERIES) == 13
