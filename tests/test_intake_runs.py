"""A cut whose files arrive in several runs ends as if they had come at once."""

from test_sources import HEAD, cuts, scene_file

from cutledger.sources import scenes
from cutledger.streaming import intake

FLAGS = ["cut_id", "tcid", "dur_flag", "note"]


def shot(n, second, length):
    return f"{n},{n * 10},00:00:{second:02d}.000,0,{n * 10 + 9},00:00:{second:02d}.000,0,10,x,{length}"


FILES = [
    (1, "a", [shot(1, 1, 1.0), shot(2, 2, 1.0), shot(3, 3, 40.0)]),
    (2, "a", [shot(1, 1, 1.0)]),
    (3, "a", [shot(1, 1, 2.0)]),
    (1, "b", [shot(4, 3, 40.0), shot(5, 5, 30.0), shot(6, 6, 30.0), shot(7, 7, 30.0)]),
    (2, "again", [shot(1, 1, 1.0)]),
    (1, "b-again", [shot(3, 3, 40.0), shot(8, 8, 9.0)]),
]


def left(spark, base, groups):
    src, sink, log = (str(base / n) for n in ("in", "out", "log"))
    c = cuts(spark).selectExpr("*", "cut_id AS arrival_seq")
    for group in groups:
        for cut, name, lines in group:
            scene_file(src, 1, cut, [HEAD, *lines], f"{name}-Scenes.csv")
        scene_file(src, 1, 3, ["no head"], f"bad{len(group)}.csv")
        intake.stream(spark, src, log, sink, c).awaitTermination()
    read = lambda name: spark.read.parquet(f"{sink}/{name}")
    tables = (
        read("shots").select("cut_id", "tcid", "seq", "duration_s"),
        read("qc_flags").select(*FLAGS),
        read("rejects").filter("reason != 'no header row'").selectExpr("cut_id", "reason"),
        read("fps_guard").select("show_id", "old_cut", "cut_id", "verdict"),
    )
    return [sorted(map(tuple, t.collect())) for t in tables]


def test_runs_and_one_run_leave_the_same(spark, tmp_path):
    one = left(spark, tmp_path / "one", [FILES])
    runs = left(spark, tmp_path / "runs", [FILES[:3], FILES[3:5], FILES[5:]])
    assert runs == one
    assert [(c, s) for c, _, s, _ in one[0]] == [(1, 1), (1, 2), (1, 5), (1, 6), (1, 7), (1, 8), (3, 1)]
    assert [r for c, r in one[2]] == ["duplicate tcid 00000300"] * 3 + ["duplicate tcid 00000100"] * 2


def test_scene_lists_are_one_file_each_without_steps_of_a_job_per_file(spark, tmp_path):
    rows = spark.range(40).selectExpr("id % 20 AS show_id", "IF(id % 20 = 3, NULL, 1L) AS cut_id", "1 + id DIV 20 AS seq")
    whole = rows.selectExpr("*", "seq * 10 AS start_frame", "seq * 10 + 9 AS end_frame", "10L AS len_frames", "0.5D AS start_s", "1.5D AS end_s", "'00:00:00.500' AS start_tc", "'00:00:01.500' AS end_tc", "1.0D AS duration_s")
    scenes.write_scenes(whole, str(tmp_path / "lib"))
    files = [p for p in (tmp_path / "lib").rglob("*") if p.is_file()]
    assert len(files) == 20 and len({p.parent for p in files}) == 20  # no marker and no checksum of a job beside them
    text = (tmp_path / "lib" / "show_id=3" / "cut_id=__HIVE_DEFAULT_PARTITION__" / "block=0" / files[0].name).read_text()
    lines = [f"{n},{n}0,00:00:00.500,0.500,{n}9,00:00:01.500,1.500,10,00:00:01.000,1.000" for n in (1, 2)]
    assert text.split("\n") == ["Timecode List:", ",".join(scenes.HEADER), *lines, ""]


def test_folders_are_listed_by_few_tasks(spark):
    own = intake._lister(spark)
    assert int(own.conf.get(intake.LISTERS)) <= 4 * spark.sparkContext.defaultParallelism < int(spark.conf.get(intake.LISTERS))
    assert own.conf.get("spark.sql.session.timeZone") == spark.conf.get("spark.sql.session.timeZone")
