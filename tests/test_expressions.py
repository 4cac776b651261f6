"""Timecode and grammar expressions on hand cases."""

import pytest
from pyspark.sql import functions as F

from cutledger.functions import grammar as G
from cutledger.functions import timecode as T


def one(spark, values, fn, schema="a string"):
    df = spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in values], schema)
    df = df.withColumn("_n", F.monotonically_increasing_id())
    return [r[0] for r in df.select(fn.alias("x"), "_n").orderBy("_n").collect()]


def test_tcid_rounds_and_clamps(spark):
    assert one(spark, ["01:02:45.917", "00:00:00.999"], T.tcid_from_tc("a", F.lit(24.0))) == ["01024522", "00000023"]


def test_tcid_keys(spark):
    assert one(spark, ["00400813", "400813", " 0 ", "000"], T.norm_tcid("a")) == ["400813", "400813", "0", "0"]
    assert one(spark, ["SHW_00091413", "91413"], T.tcid_of("a")) == ["00091413", "91413"]


def test_seconds_round_trip_carries(spark):
    assert one(spark, [59.9996, -3.0, 3725.5], T.seconds_tc("a"), "a double") == [
        "00:01:00.000",
        "00:00:00.000",
        "01:02:05.500",
    ]
    assert one(spark, ["01:02:05.500"], T.tc_seconds("a")) == [3725.5]


def test_smpte(spark):
    assert one(spark, ["00:59:50:00", "'00:00:10;05", "junk"], T.smpte_frames("a", F.lit(24.0))) == [86160, 245, None]
    assert one(spark, [86160, -5], T.frames_smpte("a", F.lit(23.976)), "a long") == ["00:59:50:00", "00:00:00:00"]
    assert one(spark, ["00:00:10:00"], T.real_tc("a", F.lit(86160), F.lit(24.0))) == ["01:00:00:00"]
    assert one(spark, [2.5], T.seconds_smpte("a", F.lit(24.0)), "a double") == ["00:00:02:12"]


def test_show_tc_reads(spark):
    got = one(spark, ["01:00:00:10", "01.00.00.24", "0100", "01:61:00:00", None], T.show_tc_frames("a", F.lit(24.0)))
    assert got == [86410, None, None, None, None]


def test_takes(spark):
    cases = {"l": ("I", 1), "lll": ("III", 3), "1V": ("IV", 4), "|": ("I", 1), "Vl*": ("VI", 6), "MOS": ("", 0), "": ("", 0), "XC": ("XC", 90)}
    got = one(spark, list(cases), G.roman_take("a"))
    assert [tuple(x) for x in got] == list(cases.values())


def test_slate_lines(spark):
    cases = {
        "79pt 1/535/I": ("535", "I"),
        "12/045/I": ("45", "I"),
        "3pt3/56 I/ll*": ("56", "II"),
        "7pt2/503o/i": ("503", "I"),
        "6/1O0/l*": ("10", "I"),
        "2+3pt2/sso/ll*": ("550", "II"),
        "2+3pt2/55&/11 B-CAM*": ("558", "II"),
        "5+6pt2/I/V*": (None, "V"),
        "stock 1/22/I": (None, ""),
        "clip.mov/22/I": (None, ""),
        "STOCKHOLM/22/I": ("22", "I"),
        "Snowfield-503": (None, ""),
        "12/55 1/I": ("551", "I"),
        "12/500 12/I": ("50012", "I"),
        "12/5001 12/II": ("5001", "II"),
        "12/56 I/MOS": ("56", "I"),
        "12/000/I": ("0", "I"),
        "": (None, ""),
        None: (None, ""),
        "75pt/+79pt 1/535/I": ("535", "I"),
    }
    got = one(spark, list(cases), G.slate_line("a"))
    assert [(g["slate"], g["take"]) for g in got] == list(cases.values())
    assert got[6]["extra"] == "B-CAM*"
    assert got[-1]["scene"] == "75pt/+79pt 1"
    assert got[8]["scene"] == "stock 1/22/I"


def test_slate_change(spark):
    pairs = [("53", "535"), ("535", "536"), ("535", "629"), ("", "5"), (None, "5"), ("5", "5")]
    df = spark.createDataFrame(pairs, "a string, b string").coalesce(1)
    assert [r[0] for r in df.select(G.clean_slate_change("a", "b")).collect()] == [False, False, True, False, False, False]


def test_codes(spark):
    got = one(spark, ["SHW_0535_01_020", "bad", None, "A_1_2"], G.code_parts("a"))
    assert tuple(got[0]) == ("SHW", 535, 1, 20)
    assert got[1:] == [None, None, None]


def test_names(spark):
    got = one(spark, ["Isn't that right, Sam? Mrs. Carter, wait!", "The, end.", None], G.addressed_names("a"))
    assert got[0] == ["Mrs. Carter", "Sam"] or "Sam" in got[0]
    assert got[1] == [] and got[2] == []


@pytest.mark.parametrize("text,want", [("manual add", True), ("NEW CUT 3", True), ("", False), (None, False)])
def test_protected(spark, text, want):
    assert one(spark, [text], G.is_protected("a")) == [want]
