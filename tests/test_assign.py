"""Assignment against a plain loop, and the hand cases."""

import random

import numpy as np
import pytest

from cutledger.operators import assign as A


def tables(spark, new, master):
    n = spark.createDataFrame([(1, t, c, i) for i, (t, c) in enumerate(new)], "show_id bigint, tcid string, code string, input_pos bigint")
    m = spark.createDataFrame(
        [(1, r, c, v, i) for i, (r, c, v) in enumerate(master)], "show_id bigint, row bigint, code string, revision string, input_pos bigint"
    )
    return n, m


def parse(code):
    p = (code or "").split("_")
    ok = len(p) == 4 and all(x.isdigit() for x in p[1:])
    return tuple(int(x) for x in p[1:]) if ok else None


def loop(new, master, sim=None):
    """The rules as one loop over lists."""
    taken, out = set(), {}
    rows_of = {}
    for r, c, _ in master:
        if c:
            rows_of[c] = r
    for t, c in new:
        if c in rows_of and rows_of[c] not in taken:
            out[t] = (rows_of[c], "EXACT-CODE")
            taken.add(rows_of[c])
    for width, tier in ((2, "ORDINAL"), (1, "SLATE-ORDINAL")):
        def groups(items, free):
            g = {}
            for i, (k, c) in enumerate(items):
                p = parse(c)
                if free(k) and p and p[0]:
                    g.setdefault(p[:width], []).append((p[2], i, k))
            return {k: [x[2] for x in sorted(v)] for k, v in g.items()}

        a = groups(new, lambda t: t not in out)
        b = groups([(r, c) for r, c, _ in master], lambda r: r not in taken)
        for k, ts in a.items():
            for t, r in zip(ts, b.get(k, [])):
                out[t] = (r, tier)
                taken.add(r)
    for t, c in new if sim else []:
        p = parse(c)
        if t in out or (p and p[0]):
            continue
        best = max(((sim[t, r], -i, r) for i, (r, _, _) in enumerate(master) if r not in taken and (t, r) in sim), default=None)
        if best:
            out[t] = (best[2], "VISUAL")
            taken.add(best[2])
    return out, taken


def as_dict(matches):
    return {r["tcid"]: (r["master_row"], r["tier"]) for r in matches.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_cases(spark, seed):
    rng = random.Random(seed)

    def code():
        if rng.random() < 0.3:
            return rng.choice(["", "tmp", "SHW_0000_01_010"])
        return f"SHW_{rng.randrange(4):04d}_{rng.randrange(1, 3):02d}_{rng.randrange(1, 6) * 10:03d}"

    new = [(f"t{i:02d}", code()) for i in range(40)]
    master = [(i + 3, code(), rng.choice(["", "Manual note"])) for i in range(30)]
    sim = {(t, r): rng.choice([0.1, 0.5, 0.5, 0.9]) for t, _ in new for r, _, _ in master if rng.random() < 0.7}
    n, m = tables(spark, new, master)
    s = spark.createDataFrame([(1, t, r, v) for (t, r), v in sim.items()], "show_id bigint, tcid string, row bigint, score double")
    found, left, omit = A.assign(n, m, s)
    want, taken = loop(new, master, sim)
    assert as_dict(found) == want
    slates = {parse(c)[0] for _, c, _ in master if parse(c)}
    rest = {t: "EXTRA" if parse(c) and parse(c)[0] in slates else "NEW" for t, c in new if t not in want}
    assert {r["tcid"]: r["tier"] for r in left.collect()} == rest
    assert {r["row"] for r in omit.collect()} == {r for r, _, v in master if r not in taken and not v}


def test_visual_rounds_equal_the_serial_choice(spark):
    """A block far smaller than the number of shots needs many rounds."""
    rng = random.Random(7)
    new = [(f"t{i:02d}", "tmp") for i in range(30)]
    master = [(i, "", "") for i in range(25)]
    sim = {(t, r): rng.choice([0.2, 0.4, 0.4, 0.8]) for t, _ in new for r, _, _ in master}
    n, m = tables(spark, new, master)
    s = spark.createDataFrame([(1, t, r, v) for (t, r), v in sim.items()], "show_id bigint, tcid string, row bigint, score double")
    assert as_dict(A.visual(n, m, s, block=7)) == loop(new, master, sim)[0]


def test_vectors_choose_as_a_table_would(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    new = [(f"t{i:02d}", "tmp") for i in range(12)]
    master = [(i, "", "") for i in range(9)]
    va, vb = rng.normal(size=(12, 5)), rng.normal(size=(9, 5))
    va[4] = va[3]
    n, m = tables(spark, new, master)
    a = spark.createDataFrame([(1, new[i][0], va[i].tolist()) for i in range(12)], "show_id bigint, tcid string, vec array<double>")
    b = spark.createDataFrame([(1, i, vb[i].tolist()) for i in range(9)], "show_id bigint, row bigint, vec array<double>")
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    s = (unit(va) @ unit(vb).T).round(12)
    sim = {(new[i][0], j): s[i, j] for i in range(12) for j in range(9)}
    assert as_dict(A.visual_by_vector(n, m, a, b, block=4)) == loop(new, master, sim)[0]


def test_hand_cases(spark):
    # Counter drift: 20, 30, 40 against 10, 20, 30 after the exact codes are gone.
    n, m = tables(
        spark,
        [("a", "SHW_0005_01_020"), ("b", "SHW_0005_01_030"), ("c", "SHW_0005_01_040"), ("d", "SHW_0009_01_010")],
        [(1, "SHW_0005_01_010", ""), (2, "SHW_0005_01_020", ""), (3, "SHW_0005_01_030", ""), (5, "SHW_0007_01_010", ""), (6, "X", "added by hand")],
    )
    found, left, omit = A.assign(n, m)
    assert as_dict(found) == {"a": (2, "EXACT-CODE"), "b": (3, "EXACT-CODE"), "c": (1, "ORDINAL")}
    assert [(r["tcid"], r["tier"]) for r in left.collect()] == [("d", "NEW")]
    assert [r["row"] for r in omit.collect()] == [5]


def test_duplicate_codes(spark):
    n, m = tables(spark, [("a", "X_1_1_10"), ("b", "X_1_1_10")], [(1, "X_1_1_10", ""), (2, "X_1_1_10", "")])
    found = A.assign(n, m)[0]
    assert as_dict(found) == {"a": (2, "EXACT-CODE"), "b": (1, "ORDINAL")}
    assert {(r["what"], r["n"]) for r in A.violations(found).collect()} == {("code", 2)}
    with pytest.raises(ValueError):
        A.check_unique(found)


def test_crosscheck_and_review(spark):
    n, m = tables(spark, [("a", "X_1_1_10"), ("b", "X_1_1_10"), ("c", "X_1_2_10"), ("d", "Y_7_1_10")], [(1, "X_1_1_10", "")])
    found, left, _ = A.assign(n, m)
    notes = {r["tcid"]: r["note"] for r in A.crosscheck(left, n, m).collect()}
    assert notes == {"b": "engine-missed-exact-code", "c": "counter-drift-candidate", "d": "genuinely-new"}
    review = n.select("show_id", "tcid").filter("tcid <> 'd'")
    staged = {r["tcid"]: (r["match_tier"], r["proposed_master_code"], r["duplicate"]) for r in A.stage_review(found, left, review).collect()}
    assert staged == {"a": ("EXACT-CODE", "X_1_1_10", False), "b": ("EXTRA", "", False), "c": ("EXTRA", "", False)}


def test_empty_visual(spark):
    n, m = tables(spark, [("a", "X_1_1_10")], [(1, "X_1_1_10", "")])
    s = spark.createDataFrame([], "show_id bigint, tcid string, row bigint, score double")
    assert A.visual(n, m, s).collect() == []


def vector_tables(spark, new, master, va, vb):
    a = spark.createDataFrame([(1, t, v.tolist()) for (t, _), v in zip(new, va)], "show_id bigint, tcid string, vec array<double>")
    b = spark.createDataFrame([(1, r, v.tolist()) for (r, _, _), v in zip(master, vb)], "show_id bigint, row bigint, vec array<double>")
    s = (va / np.linalg.norm(va, axis=1, keepdims=True)) @ (vb / np.linalg.norm(vb, axis=1, keepdims=True)).T
    sim = {(t, r): round(float(s[i, j]), 12) for i, (t, _) in enumerate(new) for j, (r, _, _) in enumerate(master)}
    return a, b, sim


@pytest.mark.parametrize("seed", [5, 6])
def test_four_tiers_with_vectors(spark, seed):
    rng, gen = random.Random(seed), np.random.default_rng(seed)
    code = lambda: rng.choice(["", "tmp"]) if rng.random() < 0.6 else f"SHW_{rng.randrange(3):04d}_{rng.randrange(1, 3):02d}_{rng.randrange(1, 6) * 10:03d}"
    new = [(f"t{i:03d}", code()) for i in range(60)]
    master = [(i + 3, code(), "") for i in range(45)]
    looks = gen.normal(size=(9, 6))
    # Crowds of equal pictures on both sides, and some of their own.
    va = np.array([looks[rng.randrange(9)] if rng.random() < 0.7 else gen.normal(size=6) for _ in new])
    vb = np.array([looks[rng.randrange(9)] if rng.random() < 0.7 else gen.normal(size=6) for _ in master])
    a, b, sim = vector_tables(spark, new, master, va, vb)
    n, m = tables(spark, new, master)
    found, left, omit = A.assign(n, m, vectors=(a, b))
    want, taken = loop(new, master, sim)
    assert as_dict(found) == want and {t for _, t in want.values()} >= {"EXACT-CODE", "VISUAL"}
    assert {r["tcid"] for r in left.collect()} == {t for t, _ in new} - set(want)
    assert {r["row"] for r in omit.collect()} == {r for r, _, _ in master} - taken


def test_rounds_do_not_grow_with_the_group(spark, caplog):
    """Shots that look like one master each, and a crowd of equal ones, take few rounds at any number."""
    gen = np.random.default_rng(8)
    took = []
    for size in (300, 1200):
        looks = gen.normal(size=(size, 16))
        looks[: size // 3] = looks[0]
        new = [(f"t{i:05d}", "tmp") for i in range(size)]
        master = [(i, "", "") for i in range(size)]
        order = gen.permutation(size)
        n, m = tables(spark, new, master)
        a, b, sim = vector_tables(spark, new, master, looks + 0, looks[order])
        caplog.clear()
        with caplog.at_level("INFO", logger="cutledger.operators.choice"):
            got = as_dict(A.visual_by_vector(n, m, a, b, block=16))
        took.append(len([r for r in caplog.records if "open" in r.message]))
        assert got == loop(new, master, sim)[0]
    assert max(took) <= 4


def test_staging_sends_no_proposals_to_the_driver(spark):
    found = spark.createDataFrame([(1, "a", 1, "C", "VISUAL")], "show_id bigint, tcid string, master_row bigint, master_code string, tier string")
    left = spark.createDataFrame([(1, "b", "NEW")], "show_id bigint, tcid string, tier string")
    review = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "show_id bigint, tcid string")
    got = A.stage_review(found, left, review)
    joins = [l for l in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in l]
    assert any("strategy=merge" in l for l in joins)
    assert sorted((r["tcid"], r["match_tier"]) for r in got.collect()) == [("a", "VISUAL"), ("b", "NEW"), ("c", None)]


def test_vectors_are_looked_up_for_rows_that_take_part_alone(spark, monkeypatch):
    """The choice of rows lies below the join with the pictures, for both sides."""
    made, plain = [], A.materialize
    monkeypatch.setattr(A, "materialize", lambda df: made.append(df) or plain(df))
    new = spark.createDataFrame([(1, "a", "SHW_0000_01_010", 1), (1, "b", "SHW_0002_01_010", 2)], "show_id bigint, tcid string, code string, input_pos bigint")
    master = spark.createDataFrame([(1, 5, "SHW_0009_01_010", 1)], "show_id bigint, row bigint, code string, input_pos bigint")
    e = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id bigint, vec array<double>")
    vec = lambda side, key: side.withColumn("vec_id", side["input_pos"] % 2).join(e, "vec_id").select("show_id", key, "vec")
    got = A.visual_by_vector(new, master, vec(new, "tcid"), vec(master, "row"))
    assert [(r["tcid"], r["master_row"]) for r in got.collect()] == [("a", 5)]
    seen = [df._jdf.queryExecution().optimizedPlan().toString().splitlines() for df in made if "vec" in df.columns and "since" not in df.columns and "k" not in df.columns]
    assert len(seen) == 2
    for plan in seen:
        at = {kind: [len(l) - len(l.lstrip(" :+-")) for l in plan if kind in l] for kind in ("Join LeftSemi", "Join Inner")}
        assert at["Join LeftSemi"] and max(at["Join LeftSemi"]) > max(at["Join Inner"])


def test_the_tiers_carry_only_what_they_read(spark, monkeypatch):
    new = spark.createDataFrame([(1, "a", "S_1_1_1", 1, 9), (1, "b", "S_2_1_1", 2, 9), (1, "c", "", 3, 9)], "show_id bigint, tcid string, code string, input_pos bigint, len_frames bigint")
    master = spark.createDataFrame([(1, 5, "S_1_1_1", "", 1, 9), (1, 6, "S_2_1_7", "", 2, 9)], "show_id bigint, row bigint, code string, revision string, input_pos bigint, len_frames bigint")
    kept, plain = [], A.materialize
    monkeypatch.setattr(A, "materialize", lambda df: kept.append(df.columns) or plain(df))
    found, left, omits = A.assign(new, master)
    assert not any("len_frames" in cols for cols in kept)
    assert sum("tcid" in cols and "code" in cols for cols in kept) == 1
    assert sorted((r.tcid, r.master_row, r.tier) for r in found.collect()) == [("a", 5, "EXACT-CODE"), ("b", 6, "ORDINAL")]
    assert [tuple(r) for r in left.collect()] == [(1, "c", "NEW")] and omits.count() == 0


def test_a_running_sum_moves_no_column_per_measure(spark):
    from cutledger.operators import ordered

    df = spark.range(10).selectExpr("id % 2 AS k", "id", "id * 2 AS len")
    got = ordered.running(df, ["k"], ["id"], {"n": A.F.lit(1).cast("bigint"), "at": A.F.col("len")})
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_m_n" not in plan and "_m_at" not in plan
    assert [tuple(r) for r in got.filter("id in (0, 5, 9)").select("id", "n", "at").orderBy("id").collect()] == [(0, 0, 0), (5, 2, 8), (9, 4, 32)]


def test_coded_tiers_take_one_deal_of_both_sides(spark, monkeypatch):
    new = [(f"t{i}", f"SHW_{i % 3:04d}_01_{i:03d}") for i in range(12)]
    master = [(i, f"SHW_{i % 3:04d}_02_{i:03d}", "") for i in range(9)]
    plans, plain = [], A.materialize
    monkeypatch.setattr(A, "materialize", lambda df: ("tier" in df.columns and plans.append(df._jdf.queryExecution().executedPlan().toString())) or plain(df))
    assert as_dict(A.assign(*tables(spark, new, master))[0]) == loop(new, master)[0]
    assert len(plans) == 1 and "Join" not in plans[0] and plans[0].count("Exchange hashpartitioning") == 1


def test_crowded_slates_and_repeated_ids_are_assigned_by_joins(spark, rows):
    """Show 2 has a row number twice, show 3 an id twice; a show that is missing meets nothing."""
    rng = random.Random(11)
    code = lambda: rng.choice(["", "tmp"]) if rng.random() < 0.2 else f"SHW_{rng.randrange(3):04d}_{rng.randrange(1, 3):02d}_{rng.randrange(1, 9) * 10:03d}"
    new = [(s, f"t{i:02d}" if (s, i) != (3, 5) else "t04", code(), i) for s in (1, 2, 3, None) for i in range(24)]
    master = [(s, i if (s, i) != (2, 5) else 4, code(), rng.choice(["", "manual"]), i) for s in (1, 2, 3, None) for i in range(18)]
    n = spark.createDataFrame(new, "show_id bigint, tcid string, code string, input_pos bigint")
    m = spark.createDataFrame(master, "show_id bigint, row bigint, code string, revision string, input_pos bigint")
    want = [rows(x) for x in A._assign_stepwise(*(A._parsed(x) for x in (n, m)), None, None)]
    for crowd in (4, 1000):
        assert [rows(x, *w) for x, w in zip(A.assign(n, m, crowd=crowd), (A.MATCH, ["show_id", "tcid", "tier"], ["show_id", "row"]))] == want
    assert {tuple(r) for r in A._uncommon(*(A._parsed(x) for x in (n, m)), 1000).collect()} == {(2,), (3,)}
    assert any(r[0] is None for r in want[1]) and any(r[0] is None for r in want[2]) and all(r[0] for r in want[0])
