"""Streams: state that is dropped, and batches that read only the cuts they touch."""

from test_sources import HEAD, cuts, scene_file

from cutledger.plans import streams
from cutledger.streaming import intake

SF = "/root/testdata/sf0.001"


def test_the_guard_forgets_what_is_beyond_its_horizon(spark):
    left, progress = streams.guarded(spark, SF)
    n = spark.read.parquet(f"{SF}/events.parquet").count()
    assert left.count() == left.select("event_id").distinct().count() == n
    state = progress["stateOperators"][0]
    assert 0 < state["numRowsTotal"] < n / 3


def test_a_batch_reads_the_folders_of_its_cuts_only(spark, tmp_path, monkeypatch):
    src, sink, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    c = cuts(spark).selectExpr("*", "cut_id AS arrival_seq")
    read, plain = [], intake._folders

    def folders(own, path, some):
        got = plain(own, path, some)
        read.append(len(got))
        return got

    monkeypatch.setattr(intake, "_folders", folders)
    for n in range(1, 4):
        scene_file(src, 1, n, [HEAD, f"1,10,00:00:0{n}.000,0,19,00:00:0{n}.000,0,10,x,1.0"], "a-Scenes.csv")
        intake.stream(spark, src, log, sink, c).awaitTermination()
    assert max(read) == 1
    assert spark.read.parquet(f"{sink}/shots").count() == 3


def test_a_batch_of_many_cuts_writes_few_files_and_a_late_file_replaces_its_cut(spark, tmp_path):
    src, sink, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    n = 120
    c = spark.range(1, n + 1).selectExpr("id AS show_id", "1L AS cut_id", "25.0D AS fps", "1L AS arrival_seq")
    line = lambda seq, s: f"{seq},10,00:00:0{s}.000,0,19,00:00:0{s}.000,0,10,x,1.0"
    for show in range(1, n + 1):
        scene_file(src, show, 1, [HEAD, line(1, 1)], "a-Scenes.csv")
    intake.stream(spark, src, log, sink, c).awaitTermination()
    for name in ("arrived", "shots", "qc_flags"):
        assert len(list((tmp_path / "out" / name).rglob("*.parquet"))) <= intake.PARTS < n
    scene_file(src, 7, 1, [HEAD, line(2, 2)], "b-Scenes.csv")
    intake.stream(spark, src, log, sink, c).awaitTermination()
    for name in ("shots", "qc_flags"):
        got = [r.show_id for r in spark.read.parquet(f"{sink}/{name}").collect()]
        assert sorted(got) == sorted([*range(1, n + 1), 7])
