"""One show holds most of the rows and blocks are tiny: results must not change."""

import shutil

import duckdb
import pytest
from oracle import DATA, TABLES, compare, duck

import __spark_entry__ as entry
from cutledger.operators import ordered
from cutledger.plans import derive


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    base = tmp_path_factory.mktemp("skewed")
    for t in TABLES:
        shutil.copy(f"{DATA}/sf0.001/{t}.parquet", base / f"{t}.parquet")
    (base / "lineitem.parquet").unlink()
    duckdb.connect().sql(
        f"COPY (SELECT * REPLACE (CASE WHEN l_orderkey % 5 < 2 THEN 3 ELSE l_suppkey END AS l_suppkey, CASE WHEN l_partkey % 3 = 0 THEN 7 ELSE l_partkey END AS l_partkey) FROM '{DATA}/sf0.001/lineitem.parquet') TO '{base}/lineitem.parquet' (FORMAT parquet)"
    )
    return str(base)


@pytest.fixture
def tiny_blocks(monkeypatch):
    monkeypatch.setattr(derive, "ORDER_STEP", 40)
    monkeypatch.setattr(ordered.block, "__defaults__", (50,))
    monkeypatch.setattr(ordered.ordinal_by, "__defaults__", (100, 20, None))


@pytest.mark.parametrize("name", ["e05_running_start", "c05_assignment", "e07_shots_from_scores", "e10_board_order", "e08_overlapping_chunks", "i01_split", "c25_matched_and_new"])
def test_hot_show(spark, skewed, tiny_blocks, name):
    assert compare(entry.queries()[name](spark, skewed), duck(skewed), entry.oracle_sql()[name]) is None
