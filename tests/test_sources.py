"""Loaders, sinks, intake."""

import json
import os

import pytest

from cutledger.sources import artifacts as X
from cutledger.sources import scenes
from cutledger.sources import tables as T
from cutledger.streaming import intake

K = "show_id bigint, cut_id bigint"
HEAD = ",".join(scenes.HEADER)


def scene_file(base, show, cut, lines, name="a-Scenes.csv"):
    d = f"{base}/show_id={show}/cut_id={cut}"
    os.makedirs(d, exist_ok=True)
    with open(f"{d}/{name}", "wb") as f:
        f.write("\n".join(lines).encode("utf-8") + b"\n")


def line(n, a, b, tc="00:00:00.000"):
    return f" {n} ,{a},{tc},0.0,{b},{tc},0.0,{b - a + 1},x,1.0"


def cuts(spark):
    return spark.createDataFrame([(1, 1, 24.0), (1, 2, 25.0), (1, 3, 24.0)], f"{K}, fps double")


def library(base):
    scene_file(base, 1, 1, ["Timecode List:," + ",".join(["00:00:01.000"] * 30), HEAD, line(1, 1, 24), line(2, 25, 30, "00:00:01.000"), "note,x"])
    swapped = HEAD.replace("Start Frame", "?").replace("End Frame", "Start Frame").replace("?", "End Frame")
    scene_file(base, 1, 2, ["Timecode List:", swapped, "1,24,00:00:00.000,0,1,00:00:01.000,1,24,x,1"])
    scene_file(base, 2, 1, ["Timecode List:", "1,2,3"])
    scene_file(base, 1, 3, [HEAD, line(1, 1, 5), line(2, 6, 9)])


def test_scan(spark, tmp_path):
    library(tmp_path)
    shots, rejects = scenes.scan_scenes(spark, str(tmp_path), cuts(spark))
    got = sorted((r["show_id"], r["cut_id"], r["tcid"], r["start_frame"], r["end_frame"]) for r in shots.collect())
    assert got == [(1, 1, "00000000", 1, 24), (1, 1, "00000100", 25, 30), (1, 2, "00000000", 1, 24)]
    assert sorted(r["reason"] for r in rejects.collect()) == ["duplicate tcid 00000000", "duplicate tcid 00000000", "no header row"]


def test_scan_of_wide_files_and_unknown_rates(spark, tmp_path):
    wide = HEAD.replace("Scene Number", "Scene Number,More,Notes")
    scene_file(tmp_path, 1, 1, ["Timecode List:," + ",".join(["00:00:01.000"] * 3000), wide, '7,x,"a, ""b"", c",1,00:00:00.000,0,24,00:00:01.000,1,24,x,1.0'])
    scene_file(tmp_path, 9, 9, [HEAD, line(1, 1, 24)])
    shots, rejects = scenes.scan_scenes(spark, str(tmp_path), cuts(spark))
    assert [(r["seq"], r["start_frame"], r["end_frame"], r["len_frames"], r["duration_s"]) for r in shots.collect()] == [(7, 1, 24, 24, 1.0)]
    assert [r["reason"] for r in rejects.collect()] == ["unknown frame rate"]


def test_links_under_one_path_piece_all_stay(spark):
    urls = ["https://a.example/articles/1", "https://b.example/articles/2", "HTTPS://A.example/articles/1#top", "https://c.example/" + "x" * 200 + "/a", "https://c.example/" + "x" * 200 + "/b", "no link"]
    got = X.url_intake(spark.createDataFrame(list(enumerate(urls)), "url_id bigint, url string")).collect()
    assert sorted(r["url_id"] for r in got) == [0, 1, 3, 4] and len({r["stem"] for r in got}) == 4


def test_an_unreadable_artifact_is_an_error_and_an_absent_one_is_empty(spark, tmp_path):
    assert X.optional(spark, str(tmp_path / "none"), "a bigint").count() == 0
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.parquet").write_bytes(b"junk")
    with pytest.raises(Exception):
        X.optional(spark, str(tmp_path / "t"), "a bigint").count()


def test_stream_takes_each_file_once(spark, tmp_path):
    src, sink, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    c = cuts(spark).selectExpr("*", "cut_id AS arrival_seq")
    scene_file(src, 1, 1, [HEAD, line(1, 1, 24)])
    intake.stream(spark, src, log, sink, c).awaitTermination()
    scene_file(src, 1, 2, [HEAD, line(1, 1, 9)])
    intake.stream(spark, src, log, sink, c).awaitTermination()
    intake.stream(spark, src, log, sink, c).awaitTermination()
    got = spark.read.parquet(f"{sink}/shots").select("cut_id", "end_frame").collect()
    assert sorted(tuple(r) for r in got) == [(1, 24), (2, 9)]
    assert spark.read.parquet(f"{sink}/fps_guard").select("verdict").distinct().first()[0] == "MISMATCH"


def test_precedence(spark):
    rows = [("m", "/o/other/Scenes.csv"), ("m", "/o/scenes_transnet/m-Scenes.csv"), ("n", "/o/scenes/x-Scenes.csv"), ("n", "/o/scenes_transnet/n-Scenes.csv"), ("q", "/o/scenes/readme.txt")]
    got = {r["stem"]: r["path"] for r in scenes.precedence(spark.createDataFrame(rows, "stem string, path string")).collect()}
    assert got == {"m": "/o/scenes_transnet/m-Scenes.csv", "n": "/o/scenes_transnet/n-Scenes.csv"}


def test_headers(spark):
    assert T.resolve([" Scene ", "VFX  Notes"], T.CANDIDATES) == {"scene": " Scene ", "vfx_note": "VFX  Notes", **T.resolve(["VFX  Notes"], {})}
    assert T.resolve(["Suggested Scene"], {"scene": ["Scene"]}) == {"scene": "Suggested Scene"}
    df = spark.createDataFrame([("a", 1)], "x string, p int")
    with pytest.raises(ValueError):
        T.by_header(df, {"tcid": ["tcid"]}, ["tcid"])
    assert T.by_header(df, {"tcid": ["tcid"]}).first()["tcid"] is None


def test_ledger_shapes(spark, tmp_path):
    d = tmp_path / "show_id=1" / "cut_id=2"
    os.makedirs(d)
    doc = {"corrections": [{"id": "a", "merged_tcid": "001", "cut_frame": 5, "sheet_row": 9}, {"id": "b", "cut7": {"merged_tcid": "002", "sheet_row": 4, "cut_frames": [1, 2]}}, {"id": "c"}]}
    (d / "l.json").write_text(json.dumps(doc, indent=1))
    (d / "m.json").write_text(json.dumps([{"id": "d", "merged_tcid": "3", "cut_frame": [7, 8]}]))
    got = {r["id"]: (r["tcid"], r["sheet_row"], r["top_row"], r["cut_frames"]) for r in X.scan_ledger(spark, str(tmp_path)).collect()}
    assert got == {"a": ("001", 9, 9, [5]), "b": ("002", 4, None, [1, 2]), "c": (None, None, None, None), "d": ("3", None, None, [7, 8])}


def test_stems_and_links(spark):
    assert len(X.ACCENTED) == len(X.PLAIN)
    rows = [(1, "https://v.example/watch?v=AbC_123456&x=1"), (2, "HTTP://e.example/a/clip.MP4?x#y"), (3, "ftp://no"), (4, "https://v.example/watch?v=AbC_123456"), (5, None)]
    got = {r["url_id"]: (r["stem"], r["direct"]) for r in X.url_intake(spark.createDataFrame(rows, "url_id bigint, url string")).collect()}
    assert got == {1: ("AbC_123456", False), 2: ("HTTPe.exampleaclip.MP4x#y", True)}
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("Café: <Ünïté>  1 . ",), ("???",), ("x" * 200,)], "t string").coalesce(1)
    assert [r[0] for r in df.select(X.safe_stem(F.col("t"))).collect()] == ["Cafe Unite 1", "video", "x" * 200]


def test_optional_pending_and_diff(spark, tmp_path):
    assert X.optional(spark, str(tmp_path / "none"), "a bigint").count() == 0
    df = spark.createDataFrame([(1,), (2,), (3,)], "k bigint")
    done = spark.createDataFrame([(1, "x"), (2, " ")], "k bigint, out string")
    assert sorted(r["k"] for r in X.pending(df, done, ["k"], output="out").collect()) == [2, 3]
    assert X.pending(df, done, ["k"], force=True).count() == 3
    X.sink(spark.createDataFrame([(1, 2, 3)], f"{K}, v bigint"), str(tmp_path / "s"))
    assert os.path.isdir(tmp_path / "s" / "show_id=1" / "cut_id=2")
    texts = spark.createDataFrame([(1, "=> CONSTANT\nmedian offset = 00:59:50:00 (86160 frames @ 24.0fps)"), (2, "nothing")], "id bigint, report string")
    got = {r["id"]: tuple(r)[1:] for r in X.offset_reports(texts, ["id"]).collect()}
    assert got == {1: ("00:59:50:00", 86160, True), 2: (None, None, None)}
