"""Shots, manifests, splits, merges, ledger; votes, notes, offsets; boundary findings."""

from pyspark.sql import functions as F

from cutledger.operators import qc
from cutledger.operators import reads as R
from cutledger.operators import shots as S

K = "show_id bigint, cut_id bigint"


def shots(spark, lengths, fps=24.0):
    df = spark.createDataFrame([(1, 1, i, n, fps) for i, n in enumerate(lengths)], f"{K}, o bigint, len_frames bigint, fps double")
    return S.with_times(S.from_lengths(df, ["o"])).drop("o")


def ranges(df):
    return [(r["seq"], r["start_frame"], r["end_frame"]) for r in df.orderBy("start_frame").collect()]


def test_lengths_starts_scores(spark):
    s = shots(spark, [120, 569, 5])
    assert ranges(s) == [(1, 1, 120), (2, 121, 689), (3, 690, 694)]
    starts = s.select("show_id", "cut_id", (F.col("start_frame") - 1).alias("start0"))
    n = spark.createDataFrame([(1, 1, 694)], f"{K}, n_frames bigint")
    assert [(r["start_frame"], r["end_frame"]) for r in S.from_starts(starts, n).orderBy("start_frame").collect()] == [(1, 120), (121, 689), (690, 694)]
    scores = spark.createDataFrame([(1, 1, i, v) for i, v in enumerate([0.0, 0.9, 0.8, 0.0, 0.0, 0.5, 0.1])], f"{K}, frame_idx bigint, score double")
    assert [(r["start_frame"], r["end_frame"]) for r in S.from_scores(scores).orderBy("start_frame").collect()] == [(1, 3), (4, 6), (7, 7)]


def test_manifest_frames(spark):
    got = {}
    for r in S.frame_manifest(shots(spark, [120, 569, 1])).collect():
        got.setdefault(r["tcid"], {})[r["pos"]] = r["frame_idx"]
        assert 0 <= r["post_s"] <= 2 and abs(r["pre_s"] + r["post_s"] - r["seek_s"]) < 1e-9
    assert sorted(tuple(v[p] for p in ("start", "mid", "end")) for v in got.values()) == [(0, 59, 119), (120, 404, 688), (689, 689, 689)]


def decide(spark, rows, col="at_frame bigint"):
    return spark.createDataFrame([(1, 1, *r) for r in rows], f"{K}, tcid string, {col}")


def test_split_and_merge_undo(spark):
    s = shots(spark, [100, 40]).cache()
    first = s.orderBy("seq").first()["tcid"]
    table, changes, rejects = S.split(s, decide(spark, [(first, 20), (first, 70), (first, 40), (first, 40)]))
    assert [(a, e - b + 1) for a, b, e in ranges(table)] == [(1, 20), (2, 20), (3, 30), (4, 30), (5, 40)]
    assert rejects.count() == 0 and changes.count() == 4
    assert table.orderBy("seq").first()["tcid"] == first
    thumbs = S.rethumb_manifest(changes).groupBy("tcid").count().collect()
    assert sorted(r["count"] for r in thumbs) == [2, 3, 3, 3]
    names = [r["tcid"] for r in table.orderBy("seq").collect()]
    whole, _, bad = S.merge(table, decide(spark, [(first, t) for t in names[1:4]], "absorb_tcid string").withColumnRenamed("tcid", "keep_tcid"))
    assert bad.count() == 0
    assert [(b, e) for _, b, e in ranges(whole)] == [(1, 100), (101, 140)]
    assert [a for a, _, _ in ranges(whole)] == [1, 5]


def test_split_rejects(spark):
    s = shots(spark, [100, 1, 50]).cache()
    t = [r["tcid"] for r in s.orderBy("seq").collect()]
    bad = [(t[0], 0), (t[2], 50), ("99999999", 3)]
    table, changes, rejects = S.split(s, decide(spark, bad))
    assert {r["tcid"]: r["reason"] for r in rejects.collect()} == {
        t[0]: "split point outside shot", t[2]: "split point outside shot", "99999999": "shot not found"
    }
    assert changes.count() == 0 and table.count() == 3


def test_split_key_collision(spark):
    s = shots(spark, [100, 50]).cache()
    a, b = [r["tcid"] for r in s.orderBy("seq").collect()]
    other = s.withColumn("tcid", F.when(F.col("tcid") == b, F.lit("00000020")).otherwise(F.col("tcid")))
    table, _, rejects = S.split(other, decide(spark, [(a, 20)]))
    assert [r["reason"] for r in rejects.collect()] == ["new key exists"] and table.count() == 2


def test_merge_rejects(spark):
    s = shots(spark, [10, 10, 10, 10]).cache()
    t = [r["tcid"] for r in s.orderBy("seq").collect()]
    rows = decide(spark, [(t[0], t[2]), (t[3], "12345678")], "absorb_tcid string").withColumnRenamed("tcid", "keep_tcid")
    table, _, rejects = S.merge(s, rows)
    assert {r["tcid"]: r["reason"] for r in rejects.collect()} == {t[0]: "not consecutive", t[3]: "shot not found"}
    assert table.count() == 4
    assert S.contiguity(s.filter(f"tcid <> '{t[1]}'")).collect()[0]["reason"] == "not contiguous"


def test_ledger(spark):
    s = shots(spark, [100, 40]).cache()
    a, b = [r["tcid"] for r in s.orderBy("seq").collect()]
    led = spark.createDataFrame(
        [(1, 1, "x", a, 7, None, [30]), (1, 1, "y", a, None, 3, [60]), (1, 1, "z", b, 9, 9, None), (1, 1, "w", b, 1, 4, [10])],
        f"{K}, id string, tcid string, sheet_row bigint, top_row bigint, cut_frames array<bigint>",
    )
    assert [r["id"] for r in S.ledger_order(led).collect()] == ["z", "w", "y", "x"]
    assert {r["id"]: r["place"] for r in S.ledger_places(led).collect()} == {"z": 1, "w": 2, "y": 3, "x": 4}
    table, _, rejects = S.apply_ledger(s, led)
    assert [(x, y) for _, x, y in ranges(table)] == [(1, 30), (31, 60), (61, 100), (101, 110), (111, 140)]
    assert [r["reason"] for r in rejects.collect()] == ["missing key or frame"]
    assert S.apply_ledger(s, led, ["w"])[0].count() == 3


def test_ledger_places_over_blocks(spark):
    rows = [("a", "90000000", 5), ("b", "10000000", 4), ("c", "95000000", 3), ("d", "20000000", None), ("e", "80000000", None), ("f", "00000001", 6)]
    led = spark.createDataFrame([(1, 1, *r) for r in rows], f"{K}, id string, tcid string, top_row bigint")
    got = sorted(S.ledger_places(led).collect(), key=lambda r: r["place"])
    assert [(r["id"], r["place"]) for r in got] == [("f", 1), ("a", 2), ("b", 3), ("c", 4), ("e", 5), ("d", 6)]
    assert [r["id"] for r in S.ledger_order(led).collect()] == list("fabced")


def reads(spark, field, per_shot):
    rows = [(1, 1, t, p, field, raw) for t, raws in per_shot.items() for p, raw in zip(("start", "mid", "end"), raws)]
    return spark.createDataFrame(rows, f"{K}, tcid string, pos string, field string, raw string")


def test_slate_votes(spark):
    got = {
        r["tcid"]: (r["scene"], r["slate"], r["take_roman"], r["take_int"], r["tier"], r["n_slate_frames"])
        for r in R.slate_votes(
            reads(spark, "slate", {
                "a": ("1/5/I", "1/6/II", "1/7/l"),
                "b": ("1/5/I", "1/6/II", "1/5/III"),
                "c": ("", "junk", ""),
                "d": ("", "", None),
                "e": ("1/5/V", "", "1/6/I"),
            })
        ).collect()
    }
    assert got == {
        "a": ("1", "6", "II", 2, "OK", 3),
        "b": ("1", "5", "I", 1, "OK", 3),
        "c": ("", "", "", 0, "SUSPECT", 0),
        "d": ("", "", "", 0, "BLANK", 0),
        "e": ("1", "5", "V", 5, "OK", 2),
    }


def test_note_votes(spark):
    got = {
        r["tcid"]: (r["vfx_note"], r["tier"], r["is_vfx"], r["n_present"])
        for r in R.note_votes(
            reads(spark, "note", {
                "a": ("WIRE", "wire.", "Wire out"),
                "b": ("", "rain", "rain!!"),
                "c": ("rain", "", ""),
                "d": ("..", "", "--"),
                "e": ("aa", "bb", "cccc"),
            })
        ).collect()
    }
    assert got == {
        "a": ("wire.", "ALL3", True, 3), "b": ("rain!!", "MIDEND", True, 2), "c": ("rain", "PARTIAL", False, 1),
        "d": ("", "NONE", False, 0), "e": ("cccc", "ALL3", True, 3),
    }


def test_offsets(spark):
    cuts = spark.createDataFrame([(1, 1, 24.0), (2, 1, 24.0), (3, 1, 24.0)], f"{K}, fps double")
    rows = []
    for show, offs in ((1, [100, 101, 100]), (2, [100, 102, 100]), (3, [None])):
        for i, o in enumerate(offs):
            rows.append((show, 1, f"000000{i:02d}", "start", "showtc", "bad" if o is None else f"00:00:{(o + i) // 24:02d}:{(o + i) % 24:02d}"))
    df = spark.createDataFrame(rows, f"{K}, tcid string, pos string, field string, raw string")
    got = {r["show_id"]: (r["n_read"], r["constant"], r["median_offset"], r["spread"]) for r in R.tc_offset(df, cuts).collect()}
    assert got == {1: (3, True, 100, 1), 2: (3, False, 100, 2), 3: (0, False, None, None)}


def test_boundaries_and_suppression(spark):
    s = shots(spark, [20, 20, 20, 5]).cache()
    t = [r["tcid"] for r in s.orderBy("seq").collect()]
    cols = f"{K}, tcid string, slate string, take_roman string, start_slate string, end_slate string, raw_start string, raw_mid string, raw_end string"
    slates = spark.createDataFrame(
        [(1, 1, t[0], "5", "I", "5", "5", "", "", ""), (1, 1, t[1], "5", "I", "53", "629", "", "", ""), (1, 1, t[2], "7", "", "7", "7", "", "stock", ""), (1, 1, t[3], "7", "", "1", "90", "", "", "")],
        cols,
    )
    mads = spark.createDataFrame([(1, 1, x, 3.25, 30.0, 1.0) for x in t], f"{K}, tcid string, d_prev double, d_startmid double, d_midend double")
    found = qc.boundaries(s, slates, mads).cache()
    assert sorted((r["kind"], r["prev_tcid"], r["after_tcid"]) for r in found.collect()) == sorted(
        [("MERGE", t[0], t[1]), ("SPLIT", t[1], ""), ("UNRELIABLE", t[1], t[2]), ("UNRELIABLE", t[2], t[3])]
    )
    notes = spark.createDataFrame([(1, 1, t[1], "MORPH CUT here")], f"{K}, tcid string, vfx_note string")
    left = qc.suppress(found, notes, notes.filter("false"))
    assert left.filter("kind = 'SPLIT'").count() == 0 and left.count() == 3


def test_suspects(spark):
    s = shots(spark, [24] * 5 + [3, 24 * 30]).cache()
    h = s.select("show_id", "cut_id", "tcid", F.lit(0).cast("bigint").alias("a_start"), F.when(F.col("len_frames") == 3, F.lit(2**40 - 1)).otherwise(0).cast("bigint").alias("a_mid"), F.lit(None).cast("bigint").alias("a_end"))
    got = [r["note"] for r in qc.suspects(s, h).orderBy("tcid").collect() if r["note"]]
    assert got == ["len<4f; phash-jump", "dur>10.0s(med=1.0)"]


def exchanges(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return plan.count("Exchange "), plan.count("FileScan")


def test_split_and_merge_read_the_table_few_times(spark, monkeypatch):
    """One pass settles table, changes and rejects: few exchanges and scans of the stored table."""
    from cutledger.session import materialize

    counted = []

    def counting(df):
        counted.append(exchanges(df))
        return materialize(df)

    monkeypatch.setattr(S, "materialize", counting)
    rows = [(1, 1, i + 1, i * 50 + 1, i * 50 + 50, 50, f"{i:08d}", 24.0) for i in range(40)]
    shots = materialize(spark.createDataFrame(rows, "show_id bigint, cut_id bigint, seq bigint, start_frame bigint, end_frame bigint, len_frames bigint, tcid string, fps double"))
    points = shots.filter("seq % 3 = 0").selectExpr("show_id", "cut_id", "tcid", "20L AS at_frame")
    table, changes, rejects = S.split(shots, points)
    end = exchanges(table)
    assert counted[0][1] + end[1] <= 4 and counted[0][1] <= 3 and counted[0][0] + end[0] <= 15
    assert changes.count() == 26 and rejects.count() == 0 and table.count() == 53
    counted.clear()
    pairs = shots.filter("seq % 5 = 1").selectExpr("show_id", "cut_id", "tcid AS keep_tcid", "lpad(CAST(CAST(tcid AS BIGINT) + 1 AS STRING), 8, '0') AS absorb_tcid")
    table, changes, rejects = S.merge(shots, pairs)
    assert counted[0][1] <= 3 and counted[0][0] + exchanges(table)[0] <= 15
    assert changes.count() == 8 and table.count() == 32


def test_votes_sort_no_texts_before_they_are_dealt_out(spark):
    reads = spark.createDataFrame([(1, 1, "a", "mid", "slate", "1/2/I")], "show_id bigint, cut_id bigint, tcid string, pos string, field string, raw string")
    plan = R.slate_votes(reads)._jdf.queryExecution().sparkPlan().toString().splitlines()
    dealt = next(i for i, l in enumerate(plan) if "RepartitionByExpression" in l or "Exchange" in l)
    assert not any("Aggregate" in l for l in plan[dealt:])


def test_the_middle_read_wins_unless_the_others_agree(spark):
    raws = {"a": ("1/2/I", "1/3/I", "1/2/II"), "b": ("1/2/I", "1/3/I", "1/4/I"), "c": ("1/2/I", "x", "1/4/I"), "d": ("x", "", "1/4/I")}
    rows_ = [(1, 1, k, p, "slate", raw) for k, v in raws.items() for p, raw in zip(("start", "mid", "end"), v)]
    got = R.slate_votes(spark.createDataFrame(rows_, "show_id bigint, cut_id bigint, tcid string, pos string, field string, raw string"))
    assert {r["tcid"]: (r["slate"], r["take_int"]) for r in got.collect()} == {"a": ("2", 1), "b": ("3", 1), "c": ("2", 1), "d": ("4", 1)}


def test_boundary_findings_come_from_one_pass(spark):
    s = spark.createDataFrame([(1, 1, "a", 1, 9)], "show_id bigint, cut_id bigint, tcid string, seq bigint, len_frames bigint")
    slates = spark.createDataFrame(
        [(1, 1, "a", *["1"] * 7)], "show_id bigint, cut_id bigint, tcid string, slate string, take_roman string, start_slate string, end_slate string, raw_start string, raw_mid string, raw_end string"
    )
    mads = spark.createDataFrame([(1, 1, "a", 1.0, 1.0, 1.0)], "show_id bigint, cut_id bigint, tcid string, d_prev double, d_startmid double, d_midend double")
    found = qc.boundaries(s, slates, mads)
    notes = s.select("show_id", "cut_id", "tcid", F.lit("swish pan").alias("vfx_note"))
    plan = qc.suppress(found, notes, s)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lag(") == 2  # of blocks and inside them


def test_one_edit_for_shots_and_reads(spark, monkeypatch):
    from cutledger.plans import changes, derive, reads

    made, plain = [], derive.edit
    monkeypatch.setattr(derive, "edit", lambda *a: made.append(1) or plain(*a))
    changes._extras(spark, "/root/testdata/sf0.001")
    reads._boundary_inputs(spark, "/root/testdata/sf0.001")
    assert len(made) == 2
