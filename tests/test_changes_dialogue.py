"""Change sets, note merging, decisions; dialogue overlap, chunks, names, replies."""

import random

import pytest
from pyspark.sql import functions as F

from cutledger.operators import audit, deliver, scrub
from cutledger.operators import changes as C
from cutledger.operators import dialogue as D

K = "show_id bigint, cut_id bigint"
SHOT = ["show_id", "cut_id", "tcid"]


def test_non_clobber(spark):
    one = lambda rows, cols: spark.createDataFrame([(1, 1, *r) for r in rows], f"{K}, tcid string, {cols}")
    shots = spark.createDataFrame([(1, 1, t) for t in "abc"], f"{K}, tcid string")
    slate = one([(t, "12", "5", "II", "SHW_0005_02_010") for t in "abc"], "scene string, slate string, take_roman string, official_code string")
    notes = one([("a", "wire", "1"), ("b", "wire", "0"), ("c", "wire", "yes")], "vfx_note string, is_vfx string")
    desc = one([("a", "cap", " "), ("b", "cap", "rev")], "visual_caption string, revised_description string")
    talk = one([("a", " hi ")], "dialogue string")
    now = one([("b", "scene", "12"), ("b", "slate", " 5 "), ("c", "scene", "13"), ("c", "slate", "6"), ("c", "take", "I"), ("c", "shot_code", "Z"), ("a", "scene", "  ")], "field string, value string")
    got = {(r["tcid"], r["field"]): (r["action"], r["new"]) for r in C.enrich(shots, slate, notes, desc, talk, now).collect()}
    assert got["a", "scene"] == ("write", "12") and got["a", "slate_takes"] == ("write", "5 II")
    assert got["b", "scene"][0] == "same" and got["b", "slate"][0] == "same" and ("b", "vfx_note") not in got
    assert got["a", "description"][1] == "cap" and got["b", "description"][1] == "rev" and got["a", "dialogue"][1] == "hi"
    assert sum(v[0] == "operator_kept" for k, v in got.items() if k[0] == "c") == 4
    only = C.enrich(shots, slate, notes, desc, talk, now, ["scene"])
    assert {r["field"] for r in only.collect()} == {"scene"}


def test_upsert_rows(spark):
    shots = spark.createDataFrame([(1, 1, i, c, "00:00:00:00", 5) for i, c in enumerate("pqrs")], f"{K}, seq bigint, temp_code string, tc_in string, len_frames bigint")
    sheet = spark.createDataFrame([(1, 1, "q", 3), (1, 1, "old", 4), (1, 1, "q", 6), (1, 1, " ", 8)], f"{K}, code string, row bigint")
    placed = {r["temp_code"]: (r["row"], r["kind"]) for r in C.place(shots, sheet).collect()}
    assert placed == {"p": (9, "append"), "q": (6, "update"), "r": (10, "append"), "s": (11, "append")}
    fresh = {r["temp_code"]: r["row"] for r in C.place(shots, sheet.filter("false")).collect()}
    assert fresh == {"p": 3, "q": 4, "r": 5, "s": 6}
    cells = {(r["row"], r["field"]): r["new"] for r in C.upsert(shots, sheet).collect()}
    assert cells[6, "tc_in"] == "'00:00:00:00" and (6, "status") not in cells and len(cells) == 12


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def test_notes_are_append_only(spark):
    rng = random.Random(3)
    vocab = ["CROWD", "CROWE", "DUPLICATION", "DUBLICATION", "RAIN", "SKY", "REPLACEMENT", "WIRE", "REMOVAL", "a"]
    olds, news = [], []
    for i in range(60):
        olds.append((i, " ".join(rng.choices(vocab, k=rng.randrange(0, 5)))))
        if rng.random() < 0.9:
            news.append((i, " ".join(rng.choices(vocab, k=rng.randrange(0, 5))), rng.random() < 0.1))
    got = {
        r["id"]: (r["status"], r["merged"])
        for r in C.reconcile_notes(spark.createDataFrame(olds, "id bigint, note string"), spark.createDataFrame(news, "id bigint, note string, shaky boolean"), ["id"]).collect()
    }
    new = {i: (n, s) for i, n, s in news}
    for i, old in olds:
        n, shaky = new.get(i, ("", False))
        words = lambda t: {w.upper() for w in t.split() if len(w) >= 4}
        survives = any(all(edit_distance(w, o) > 2 for o in words(old)) for w in words(n))
        if old == n:
            want = ("unchanged", old)
        elif shaky:
            want = ("held", old)
        elif not n:
            want = ("removed", old + " ## Blank")
        elif not old:
            want = ("added", n)
        else:
            want = ("changed", f"{old} ## {n}") if survives else ("held", old)
        assert got[i] == want


def test_decisions_and_delivery(spark):
    new = spark.createDataFrame([(1, "a", 5, 1), (1, "b", 6, 1), (1, "c", 7, 1)], "show_id bigint, tcid string, slate bigint, take bigint")
    old = spark.createDataFrame([(1, 5, 1, "keep", 1), (1, 5, 1, "keep", 2), (1, 6, 1, "keep", 1), (1, 6, 1, "split", 2)], "show_id bigint, slate bigint, take bigint, decision string, decided_at bigint")
    got = {r["tcid"]: (r["decision"], r["state"], r["review"]) for r in C.carry_decisions(new, old).collect()}
    assert got == {"a": ("keep", "carried", False), "b": ("split", "ambiguous", True), "c": (None, "new", True)}
    shots = spark.createDataFrame([(1, "A", " vfx "), (1, "B", "Online"), (1, "C", "VFX")], "show_id bigint, code string, status string")
    m = deliver.vendor_manifest(shots, ["n", "s"])
    assert sorted((r["vendor"], r["clip_name"]) for r in m.collect()) == [("n", "A.mp4"), ("n", "C.mp4"), ("s", "A.mp4"), ("s", "C.mp4")]
    assert all(r["complete"] for r in deliver.vendor_counts(m, shots).collect())


def test_audit_truth_table(spark):
    o = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "tcid string, is_vfx boolean")
    f = spark.createDataFrame([("a", True), ("c", True), ("d", False)], "tcid string, flag boolean")
    t = audit.invisible(o, f, ["tcid"])
    assert {r["tcid"]: (r["is_vfx"], r["category"]) for r in t.collect()} == {
        "a": (True, None), "b": (True, "ocr_only_unflagged"), "c": (True, "operator_only_invisible"), "d": (False, None)
    }
    cuts = spark.createDataFrame([(1, 1, 1, 24.0), (1, 2, 2, 23.976), (1, 3, 3, 25.0), (1, 4, 4, None)], f"{K}, arrival_seq bigint, fps double")
    assert [r["verdict"] for r in audit.fps_guard(cuts).orderBy("cut_id").collect()] == ["OK", "MISMATCH", "UNKNOWN"]
    d = spark.createDataFrame([(1, 1, x) for x in (1, 10, 21, 40)], f"{K}, start_frame bigint")
    tr = spark.createDataFrame([(1, 1, x) for x in (1, 11, 20, 22)], f"{K}, start_frame bigint")
    assert audit.score_boundaries(d, tr).first()["n_hit"] == 1
    assert audit.score_boundaries(d, tr, 2).first()["n_hit"] == 3


def test_dialogue_overlap(spark):
    shots = spark.createDataFrame([(1, 1, "s1", 1, 24, 24.0), (1, 1, "s2", 25, 2400, 24.0), (1, 1, "s3", 2401, 2424, 24.0)], f"{K}, tcid string, start_frame bigint, end_frame bigint, fps double")
    segs = spark.createDataFrame([(1, 1, 0, 0.5, 1.5, "both"), (1, 1, 1, 1.0, 1.0, "edge"), (1, 1, 2, 0.0, 1.0, "first"), (1, 1, 3, 2.0, 100.5, "long")], f"{K}, idx bigint, start double, end double, text string")
    for width in (0.3, 10.0):
        got = {r["tcid"]: r["dialogue"] for r in D.to_shots(segs, shots, width).collect()}
        assert got == {"s1": "both first", "s2": "both long", "s3": "long"}


@pytest.mark.parametrize("n,want", [(60, [(0, 25), (22, 47), (44, 60)]), (25, [(0, 25)]), (26, [(0, 25), (22, 26)])])
def test_chunks(spark, n, want):
    shots = spark.createDataFrame([(1, 1, f"{i:03d}", i) for i in range(n)], f"{K}, tcid string, seq bigint")
    rows = D.chunks(shots).collect()
    got = {}
    for r in rows:
        got.setdefault(r["chunk"], []).append((r["seq"], r["is_context"]))
    assert [(min(v)[0], max(v)[0] + 1) for _, v in sorted(got.items())] == want
    assert all(sum(c for _, c in v) == (3 if k else 0) for k, v in got.items())


def test_names_and_prompts(spark):
    t = spark.createDataFrame([(1, 1, f"{i}", i, s) for i, s in enumerate(["so it is right, Sam?", "no", "Mia, come.", "ok"])], f"{K}, tcid string, seq bigint, dialogue string")
    ch = D.chunks(t.drop("dialogue"), 2, 1)
    assert {r["chunk"]: r["names"] for r in D.known_names(ch, t).collect()} == {0: ["Sam"], 1: ["Mia", "Sam"], 2: ["Mia", "Sam"]}
    rows = ch.join(t, ["show_id", "cut_id", "tcid", "seq"]).withColumns({"shot_code": F.concat(F.lit("S"), "tcid"), "visual_caption": F.lit("cap")})
    p = {r["chunk"]: r["prompt"] for r in D.prompts(rows, D.known_names(ch, t)).collect()}
    assert '- S0: cap | dialogue: "so it is right, Sam?"\n- S1: cap' in p[0]


def test_replies(spark):
    reply = "STORY_STATE: They meet.\nREVISED:\n- S1: one\nS9: no\nS1: two: three\nS2:\n"
    df = spark.createDataFrame([(1, 1, 0, reply)], f"{K}, chunk bigint, reply string")
    codes = spark.createDataFrame([(1, 1, 0, "S1"), (1, 1, 0, "S2")], f"{K}, chunk bigint, shot_code string")
    states, lines = D.parse_replies(df, codes)
    assert states.first()["story_state"] == "They meet."
    assert {r["shot_code"]: r["revised"] for r in lines.collect()} == {"S1": "two: three", "S2": ""}
    chunked = spark.createDataFrame([(1, 1, "1", "S1", "c1", 0), (1, 1, "2", "S2", "c2", 0)], f"{K}, tcid string, shot_code string, visual_caption string, chunk bigint")
    assert {r["tcid"]: r["revised_description"] for r in D.latest_revision(chunked, lines).collect()} == {"1": "two: three", "2": "c2"}


def test_scrub(spark):
    cells = spark.createDataFrame([("T", 1, "A", "PEF_001 x"), ("T", 3, "A", "PEF_002"), ("T", 3, "B", "Acme"), ("R", 3, "E", "1,500"), ("R", 4, "E", "=B1"), ("T", 4, "B", "red ring")], "tab string, row bigint, col string, value string")
    vendors = scrub.vendor_names(spark.createDataFrame([(2, " Acme "), (3, "Vendor 3")], "slot int, name string"))
    table, changes = scrub.apply(cells, [("ring", "prop"), ("red prop", "hero")], vendors, "PEF", "SHW", 2, ("R", "E"), 2.0)
    assert {(r["tab"], r["row"], r["col"]): (r["new"], r["category"]) for r in changes.collect()} == {
        ("T", 1, "A"): ("SHW_001 x", "shot_code_prefix"), ("T", 3, "B"): ("Vendor 2", "vendor_name"),
        ("R", 3, "E"): ("3000.0", "rate"), ("T", 4, "B"): ("hero", "term_swap"),
    }
    assert table.count() == 6
    assert scrub.detect_prefix(cells, "A").first()["prefix"] == "PEF"
    left = scrub.clear(cells, spark.createDataFrame([("R", 4)], "tab string, first_row bigint"), auto_tabs=["T"])
    assert sorted((r["tab"], r["row"], r["col"]) for r in left.collect()) == [("R", 3, "E"), ("T", 1, "A"), ("T", 3, "A"), ("T", 3, "B")]


def test_a_note_that_only_the_new_read_has_is_added(spark):
    old = spark.createDataFrame([(1, "wire removal"), (2, "gone")], "id bigint, note string")
    new = spark.createDataFrame([(1, "wire removal", False), (3, "sky replacement", False)], "id bigint, note string, shaky boolean")
    got = {r["id"]: (r["status"], r["merged"]) for r in C.reconcile_notes(old, new, ["id"]).collect()}
    assert got == {1: ("unchanged", "wire removal"), 2: ("removed", "gone ## Blank"), 3: ("added", "sky replacement")}


def test_prefix_and_header_come_from_all_rows(spark):
    rows = [("t", i, "A", "ABC_1") for i in range(1, 10)] + [("t", 9, c, "x") for c in "BCD"] + [("t", i, "A", "ZZ_2") for i in range(300, 320)]
    cells = spark.createDataFrame(rows, "tab string, row bigint, col string, value string")
    assert scrub.detect_prefix(cells, "A").first()["prefix"] == "ZZ"
    assert scrub.header_row(cells).first()["header_row"] == 9
