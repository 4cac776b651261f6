"""What a shuffle or a stored table carries, and how often it is made."""

import pytest

from cutledger.operators import changes as C
from cutledger.operators import qc
from cutledger.operators import shots as S
from cutledger.plans import changes as plans

SHOT = ["show_id", "cut_id", "tcid"]


def plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_split_moves_no_column_that_follows_from_others(spark, monkeypatch):
    kept, plain = [], S.materialize
    monkeypatch.setattr(S, "materialize", lambda df: (kept.append(plan(df)), plain(df))[1])
    shots = spark.range(3).selectExpr("1L AS show_id", "1L AS cut_id", "lpad(string(id * 50), 8, '0') AS tcid", "id * 50 + 1 AS start_frame", "id * 50 + 50 AS end_frame", "50L AS len_frames", "25.0D AS fps")
    points = shots.selectExpr(*SHOT, "10L AS at_frame").unionByName(shots.limit(1).selectExpr("show_id", "cut_id", "'x' AS tcid", "NULL AS at_frame"))
    table, changes, rejects = S.split(shots, points)
    assert table.count() == 6 and changes.count() == 6 and [r.reason for r in rejects.collect()] == ["shot not found"]
    above = kept[0][: kept[0].rindex("Window [")]
    assert "points#" not in above and "new_start#" not in above and "new_tcid#" not in above


@pytest.fixture
def sheet(spark):
    key = "1L AS show_id, 1L AS cut_id, lpad(string(id), 8, '0') AS tcid"
    shots = spark.sql(f"SELECT {key} FROM range(4)")
    slate = spark.sql(f"SELECT {key}, 's' AS scene, string(id) AS slate, 'I' AS take_roman, 'C' AS official_code FROM range(3)")
    notes = spark.sql(f"SELECT {key}, 'n' AS vfx_note, id = 1 AS is_vfx FROM range(4)")
    words = spark.sql(f"SELECT {key}, 'c' AS visual_caption, ' ' AS revised_description FROM range(4)")
    talk = spark.sql(f"SELECT {key}, '' AS dialogue FROM range(4)")
    cells = "(0L, 'slate', '0'), (0L, 'slate', 'x'), (1L, 'slate', '  '), (1L, 'scene', NULL), (2L, 'take', 'II'), (9L, 'slate', 'y'), (2L, NULL, 'z'), (3L, 'status', 'q')"
    current = spark.sql(f"SELECT {key}, field, value FROM VALUES {cells} AS t(id, field, value)")
    current = current.unionByName(current.selectExpr("NULL AS show_id", "cut_id", "tcid", "field", "value"))
    return shots, slate, notes, words, talk, current


def test_cells_meet_their_shot_before_it_is_taken_apart(spark, sheet, rows):
    fields = ["scene", "slate", "take", "description"]
    for some in (None, fields):
        want = C.decide(C.enrichment(*sheet[:5]).unpivot(SHOT, some or C.FIELDS, "field", "new"), sheet[5], SHOT)
        got = C.enrich(*sheet, fields=some)
        assert got.columns == want.columns and rows(got) == rows(want)
    assert not any("field#" in x for x in plan(got, "sparkPlan").splitlines() if "Exchange" in x or "Join" in x)


def test_votes_are_stored_without_reads(spark, monkeypatch):
    kept, plain = [], plans.d.stored
    monkeypatch.setattr(plans.d, "stored", lambda df: (kept.append(df.columns), plain(df))[1])
    plans._extras(spark, "/root/testdata/sf0.001")
    assert sorted(kept[-1]) == sorted([*SHOT, "seq", "scene", "slate", "take_roman", "take_int"])


def test_boundaries_vote_once(spark):
    shots = spark.sql("SELECT 1L AS show_id, 1L AS cut_id, string(id) AS tcid, id AS seq, 50L AS len_frames FROM range(1, 4)")
    reads = shots.selectExpr(*SHOT, "'7' AS slate", "'I' AS take_roman", "'7' AS start_slate", "'7' AS end_slate", "'' AS raw_start", "'' AS raw_mid", "'' AS raw_end")
    mads = shots.selectExpr(*SHOT, "1.0D AS d_prev", "0.0D AS d_startmid", "0.0D AS d_midend")
    got = qc.boundaries(shots, reads, mads)
    assert got.inputFiles() and "Range" not in plan(got)
    assert [(r.kind, r.prev_tcid, r.after_tcid) for r in got.orderBy("after_tcid").collect()] == [("MERGE", "1", "2"), ("MERGE", "2", "3")]
