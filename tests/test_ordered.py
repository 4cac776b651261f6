"""Ordinals, running sums and neighbours over cut-up groups, with one group far larger."""

import random

from pyspark.sql import functions as F

from cutledger.operators import ordered


def data(n=400, seed=1):
    rng = random.Random(seed)
    pos = rng.sample(range(5000), n)
    return [("hot" if rng.random() < 0.6 else rng.choice("abc"), p, rng.randrange(9), rng.randrange(4)) for p in pos]


def test_running_and_ordinal(spark):
    raw = data()
    df = spark.createDataFrame(raw, "k string, p bigint, v bigint, t bigint")
    got = ordered.running(df, ["k"], ["p"], {"s": F.col("v"), "n": F.lit(1)}, [ordered.block("p", 100)])
    for r in got.collect():
        before = [x for x in raw if x[0] == r["k"] and x[1] < r["p"]]
        assert r["n"] == len(before) and r["s"] == sum(x[2] for x in before)


def test_ordinal_by_spreads_equal_lead_values(spark):
    raw = data(seed=2)
    df = spark.createDataFrame(raw, "k string, p bigint, v bigint, t bigint")
    for limit in (10, 10**6):
        got = ordered.ordinal_by(df, ["k"], "t", "p", "n", lead_step=2, limit=limit)
        for r in got.collect():
            assert r["n"] == 1 + sum(1 for x in raw if x[0] == r["k"] and (x[3], x[1]) < (r["t"], r["p"]))


def test_neighbours_cross_blocks(spark):
    raw = data(seed=3)
    df = spark.createDataFrame(raw, "k string, p bigint, v bigint, t bigint")
    for ahead in (False, True):
        got = ordered.neighbour(df, ["k"], ["p"], ["p", "v"], "near", ahead, [ordered.block("p", 70)])
        for r in got.collect():
            same = sorted((x[1], x[2]) for x in raw if x[0] == r["k"])
            i = same.index((r["p"], r["v"])) + (1 if ahead else -1)
            assert (tuple(r["near"]) if r["near"] else None) == (same[i] if 0 <= i < len(same) else None)


def test_lookup_keeps_every_row(spark):
    left = spark.createDataFrame([(i % 3, i) for i in range(300)], "k bigint, i bigint")
    right = spark.createDataFrame([(0, "x"), (1, "y")], "k bigint, w string")
    got = ordered.salted_lookup(left, right, ["k"], ["i"]).collect()
    assert len(got) == 300
    assert all(r["w"] == {0: "x", 1: "y"}.get(r["k"]) for r in got)


def test_no_window_holds_a_whole_group(spark):
    """Every window of the ranking is partitioned by the block as well."""
    df = spark.range(100).select(F.lit(1).alias("k"), F.col("id").alias("p"))
    got = ordered.ordinal(df, ["k"], ["p"], "n")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    on_rows = [l for l in plan.splitlines() if "Window [" in l and "_l_" in l]
    assert on_rows and all("_b0" in l for l in on_rows)


def test_the_size_check_of_a_lookup_counts_the_repeats(spark, tmp_path):
    """A table that would be broadcast alone, but not once per salt, goes by shuffles."""
    path = str(tmp_path / "right")
    spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 7).alias("w")).coalesce(1).write.parquet(path)
    size = sum(f.stat().st_size for f in (tmp_path / "right").glob("*.parquet"))
    left = spark.range(5000).select((F.col("id") % 3).alias("k"), F.col("id").alias("i"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size * 3)
    try:
        got = ordered.salted_lookup(left, spark.read.parquet(path), ["k"], ["i"])
        assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got.filter("w = k * 7").count() == 5000
