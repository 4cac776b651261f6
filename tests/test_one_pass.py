"""Operators that read sorted rows once, or skip what cannot count: walks, runs of starts, top similar, near pairs, notes."""

import random

import numpy as np
from pyspark.sql import functions as F

from cutledger.operators import audit, changes, dialogue, vision, wall

K = "show_id bigint, cut_id bigint"


def plain_walk(vectors, threshold):
    col, total, n, out = 0, None, 0, []
    for v in vectors:
        if total is not None:
            mean = total / n
            if float(mean @ v) / ((np.linalg.norm(mean) or 1) * (np.linalg.norm(v) or 1)) >= threshold:
                total, n = total + v, n + 1
            else:
                col, total, n = col + 1, v.copy(), 1
        else:
            total, n = v.copy(), 1
        out.append(col)
    return out


def test_walk_in_ranges_equals_one_walk(spark):
    rng = np.random.default_rng(2)
    vectors = np.concatenate([np.repeat(rng.normal(size=(60, 4)), rng.integers(1, 9, 60), axis=0) + rng.normal(size=(1, 4)) * 0.02, np.ones((90, 4)), rng.normal(size=(50, 4))])
    rows = [(1, 1, f"c{i}", i * 2, v.tolist()) for i, v in enumerate(vectors)] + [(2, 1, "x", 5, [1.0, 0.0, 0.0, 0.0]), (2, 1, "y", 999, [0.0, 1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, f"{K}, code string, order bigint, vec array<double>").repartition(3)
    want = plain_walk(vectors, 0.8)
    for size in (20, 64, 1 << 17):
        got = wall.walk(df, 0.8, size).collect()
        assert [r["column"] for r in sorted((r for r in got if r.show_id == 1), key=lambda r: r.order)] == want
        assert sorted((r.code, r["column"]) for r in got if r.show_id == 2) == [("x", 0), ("y", 1)]


def test_a_long_cut_is_walked_in_few_jobs(spark):
    n = 200_000
    df = spark.range(n).select(
        F.lit(1).cast("bigint").alias("show_id"), F.lit(1).cast("bigint").alias("cut_id"), F.col("id").cast("string").alias("code"), F.col("id").alias("order"),
        F.expr("array(cos(floor(id / 7)), sin(floor(id / 7)))").alias("vec"),
    )
    got = wall.walk(df, 0.9)
    assert got.agg(F.max("column")).first()[0] == (n - 1) // 7 and got.count() == n
    assert got.filter(F.col("column") != F.floor(F.col("order") / 7)).count() == 0


def test_starts_along_a_run_of_any_length(spark):
    n = 300_000
    d = spark.range(n).select(F.lit(1).cast("bigint").alias("show_id"), F.lit(1).cast("bigint").alias("cut_id"), (F.col("id") * 3).alias("start_frame"))
    t = d.withColumn("start_frame", F.col("start_frame") + 1).filter("start_frame % 2 = 0")
    got = audit.score_boundaries(d, t, 2).first()
    assert (got.n_detected, got.n_truth, got.n_hit) == (n, n // 2, n // 2)
    again = spark.createDataFrame([(1, 1, x) for x in (10, 20, 21, 30)], f"{K}, start_frame bigint")
    other = spark.createDataFrame([(1, 1, x) for x in (8, 12, 22, 40)], f"{K}, start_frame bigint")
    assert audit.score_boundaries(again, other, 2).first().n_hit == 2


def test_top_similar_skips_blocks_that_cannot_count(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16)) * 4
    b = np.concatenate([c + rng.normal(size=(40, 16)) * 0.05 for c in centres])
    a = np.concatenate([c + rng.normal(size=(10, 16)) * 0.05 for c in centres])
    schema = "g bigint, id bigint, pos bigint, vec array<double>"
    da = spark.createDataFrame([(1, i, i, v.tolist()) for i, v in enumerate(a)], schema)
    db = spark.createDataFrame([(1, i, i, v.tolist()) for i, v in enumerate(b)], schema)
    s = ((a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T).round(12)
    want = {(i, int(j), r) for i in range(len(a)) for r, j in enumerate(np.lexsort((np.arange(len(b)), -s[i]))[:5], 1)}
    tallies = []
    got = {(r.proposer, r.item, r["rank"]) for r in vision.top_similar(da, db, ["g"], 5, block=20, tallies=tallies).collect()}
    assert got == want
    met, every = tallies[0]
    assert met < every / 2


def test_a_crowded_bucket_is_cut_until_it_is_not(spark):
    """All share the first 30 bits, so that one bucket, and one of its first cuts, holds all."""
    rng = random.Random(6)
    n, rows = 5000, []
    for i in range(n):
        words = [(rng.getrandbits(64) >> 30) << 30, rng.getrandbits(64), rng.getrandbits(64)]
        if i % 50 == 49:  # near the one before
            words = list(rows[-1][1:])
            for _ in range(5):
                words[1] ^= 1 << rng.randrange(64)
        rows.append((i, *words))
    sign = lambda w: w - 2**64 if w >= 2**63 else w
    df = spark.createDataFrame([(r[0], *map(sign, r[1:])) for r in rows], "shot bigint, h_start bigint, h_mid bigint, h_end bigint")
    _, pairs = vision.near_duplicates(df)
    assert {(r.a_shot, r.b_shot) for r in pairs.collect()} == {(i - 1, i) for i in range(49, n, 50)}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_misspelt_words_equal_all_distances(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 9)))
    known, tried = {word() for _ in range(60)}, {word() for _ in range(120)}
    for most in (1, 2):
        w = spark.createDataFrame([(1, x) for x in tried] + [(2, "abab")], "id bigint, word string")
        k = spark.createDataFrame([(1, x) for x in known], "id bigint, word string")
        got = {(r.id, r.word) for r in changes.misspelt(w, k, ["id"], most).collect()}
        assert got == {(1, x) for x in tried if any(edits(x, y) <= most for y in known)}


def test_notes_of_many_words(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    words = [word() for _ in range(20_000)]
    typos = [w[:4] + "#" + w[5:] for w in words]
    old = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words))], "id bigint, note string")
    new = spark.createDataFrame([(1, " ".join(typos), False), (2, " ".join([*typos, "1234567890"]), False)], "id bigint, note string, shaky boolean")
    got = {r.id: r.status for r in changes.reconcile_notes(old, new, ["id"]).collect()}
    assert got == {1: "held", 2: "changed"}


def test_names_grow_without_a_window_that_collects(spark):
    t = spark.createDataFrame([(1, 1, f"{i:03d}", i, f"Hey, {n}!") for i, n in enumerate(["Anna", "Bert", "Anna", "Carl", "Dora", "Bert"])], f"{K}, tcid string, seq bigint, dialogue string")
    chunks = t.select("show_id", "cut_id", "tcid", "seq", F.floor(F.col("seq") / 2).alias("chunk"))
    got = dialogue.known_names(chunks, t)
    names = {r.chunk: list(r.names) for r in got.collect()}
    assert all(set(names[c]) <= set(names[c + 1]) for c in range(2))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not any("collect" in line and "windowspec" in line for line in plan.splitlines())


def test_a_note_with_a_clearly_new_word_leaves_no_words_to_look_at(spark, monkeypatch):
    looked, plain = [], changes.misspelt
    monkeypatch.setattr(changes, "misspelt", lambda words, *a: looked.append(words.select("id", "word").collect()) or plain(words, *a))
    old = spark.createDataFrame([(1, "smoke over water"), (2, "smoke over water")], "id bigint, note string")
    new = spark.createDataFrame([(1, "smoke over castles", False), (2, "smoke over watxr", False)], "id bigint, note string, shaky boolean")
    got = {r.id: r.status for r in changes.reconcile_notes(old, new, ["id"]).collect()}
    assert got == {1: "changed", 2: "held"}
    assert [tuple(r) for r in looked[0]] == [(2, "WATXR")]


def test_pieces_of_words_are_not_broadcast(spark, tmp_path):
    path = str(tmp_path / "words")
    spark.createDataFrame([(1, "water")], "id bigint, word string").write.parquet(path)
    w = spark.read.parquet(path)
    met = changes.misspelt(w, w, ["id"])
    assert "BroadcastHashJoin" not in met._jdf.queryExecution().sparkPlan().toString()
    assert [tuple(r) for r in met.collect()] == [(1, "water")]
