"""Audits: flag columns in any spelling, boundary matches against augmenting paths."""

import random

from cutledger.operators import audit

K = "show_id bigint, cut_id bigint, start_frame bigint"


def most(ds, ts, tol):
    pair = {}

    def go(x, seen):
        for t in ts:
            if abs(x - t) <= tol and t not in seen:
                seen.add(t)
                if t not in pair or go(pair[t], seen):
                    pair[t] = x
                    return True
        return False

    return sum(go(x, set()) for x in ds)


def test_boundaries_match_as_often_as_can_be(spark):
    rng, d, t, want = random.Random(1), [(2, 0, 10), (2, 0, 11)], [(2, 0, 11), (2, 0, 12)], {(2, 0): 2}
    for c in range(40):
        ds, ts = (sorted(rng.sample(range(90), rng.randint(1, 40))) for _ in range(2))
        d += [(1, c, x) for x in ds]
        t += [(1, c, x) for x in ts]
        want[1, c] = most(ds, ts, 2)
    got = audit.score_boundaries(spark.createDataFrame(d, K), spark.createDataFrame(t, K), 2).collect()
    assert {(r["show_id"], r["cut_id"]): r["n_hit"] for r in got} == want


def test_flag_columns_in_any_spelling(spark):
    df = spark.createDataFrame([(1, "x", ""), (2, "", "no"), (3, None, "yes")], ["id", " FLAG", "Operator Flag"])
    assert {r["id"]: r["flag"] for r in audit.operator_flags(df, ["id"]).collect()} == {1: True, 2: False, 3: True}
