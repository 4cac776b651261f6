"""Votes over repeated reads of the start, middle and end frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutledger.functions import grammar as g
from cutledger.functions import timecode as tc
from cutledger.operators import ordered
from cutledger.schema import POSITIONS

K = ["show_id", "cut_id"]
SHOT = [*K, "tcid"]


def _by_position(frame_reads: DataFrame, field: str, value: Column) -> DataFrame:
    """One row per shot with a column per position, in one shuffle.

    Reads are dealt out before they are grouped: a shot has too few of them to gain from combining on
    the map side, where texts would be sorted, all rows of a task at once.
    """
    reads = frame_reads.filter(F.col("field") == field).select(*SHOT, "pos", value.alias("_v")).repartition(*SHOT)
    at = [F.max(F.when(F.col("pos") == p, F.col("_v"))).alias(p) for p in POSITIONS]
    return reads.groupBy(*SHOT).agg(*at)


def slate_votes(frame_reads: DataFrame) -> DataFrame:
    """Modal (scene, slate) of the three reads; ties go to middle, start, end."""
    wide = _by_position(frame_reads, "slate", F.coalesce(F.col("raw"), F.lit("")))
    lines = F.transform(F.array(*POSITIONS), g.slate_line)
    parsed = wide.withColumn("_p", lines).select(
        *SHOT,
        *[F.coalesce(p, F.lit("")).alias(f"raw_{p}") for p in POSITIONS],
        *[F.get("_p", F.lit(i)).alias(f"p_{p}") for i, p in enumerate(POSITIONS)],
    )
    here = {p: F.col(f"p_{p}.slate").isNotNull() for p in POSITIONS}

    def same(x: str, y: str) -> Column:
        a, b = F.col(f"p_{x}"), F.col(f"p_{y}")
        return F.coalesce((a["scene"] == b["scene"]) & (a["slate"] == b["slate"]), F.lit(False))

    # Of three reads, the middle one wins unless the other two agree against it, or it has no slate.
    best = (
        F.when(same("mid", "start") | same("mid", "end"), F.col("p_mid"))
        .when(same("start", "end"), F.col("p_start"))
        .when(here["mid"], F.col("p_mid"))
        .when(here["start"], F.col("p_start"))
        .when(here["end"], F.col("p_end"))
    )
    voted = parsed.withColumn("_best", best)
    n = sum(here[p].cast("int") for p in POSITIONS)
    some_text = F.greatest(*[F.length(F.coalesce(F.col(f"raw_{p}"), F.lit(""))) for p in POSITIONS]) > 0
    take = F.coalesce(F.col("_best.take"), F.lit(""))
    return voted.select(
        *SHOT,
        F.coalesce("_best.scene", F.lit("")).alias("scene"),
        F.coalesce("_best.slate", F.lit("")).alias("slate"),
        take.alias("take_roman"),
        F.when(take == "", 0).otherwise(g.roman_value(take)).alias("take_int"),
        F.when(n >= 2, "OK").when((n == 1) | some_text, "SUSPECT").otherwise("BLANK").alias("tier"),
        n.alias("n_slate_frames"),
        *[F.col(f"p_{p}.scene").alias(f"{p}_scene") for p in POSITIONS],
        *[F.coalesce(F.col(f"p_{p}.slate"), F.lit("")).alias(f"{p}_slate") for p in POSITIONS],
        *[f"raw_{p}" for p in POSITIONS],
    )


def official_codes(slate_reads: DataFrame, prefix: str = "SHW") -> DataFrame:
    """Add the official code: the counter is the occurrence of the slate in edit order.

    ``slate_reads`` carries seq. Rows without a slate get a blank code and do not count.
    """
    counted = ordered.ordinal(slate_reads.filter(F.col("slate") != ""), [*K, "slate"], ["seq"], "_nth")
    coded = counted.withColumn("official_code", g.official_code(F.col("slate"), F.col("take_int"), F.col("_nth"), prefix))
    blank = slate_reads.filter(F.col("slate") == "").withColumn("official_code", F.lit(""))
    return coded.drop("_nth").unionByName(blank)


def note_votes(frame_reads: DataFrame) -> DataFrame:
    """Consensus note and presence tier. Whole texts are compared."""
    wide = _by_position(frame_reads, "note", F.coalesce(F.col("raw"), F.lit("")))
    reads = F.array(
        *[F.struct(F.coalesce(F.col(p), F.lit("")).alias("raw"), g.norm_note(p).alias("norm")) for p in POSITIONS]
    )
    here = {p: F.col(f"p_{p}") for p in POSITIONS}
    present = wide.withColumn("_r", reads)
    present = present.withColumns({f"p_{p}": F.get("_r", F.lit(i))["norm"] != "" for i, p in enumerate(POSITIONS)})
    kept = present.withColumn("_c", F.filter("_r", lambda r: r["norm"] != ""))

    def group(r: Column) -> Column:
        return F.filter(F.col("_c"), lambda o: o["norm"] == r["norm"])

    def rank(r: Column) -> Column:
        return F.struct(F.size(group(r)), F.array_max(F.transform(group(r), lambda o: F.length(o["raw"]))))

    scored = kept.withColumn("_s", F.transform("_c", lambda r: F.struct(rank(r).alias("k"), r.alias("r"))))
    modal = scored.withColumn(
        "_m",
        F.get(F.filter("_s", lambda s: s["k"] == F.array_max(F.transform("_s", lambda o: o["k"]))), F.lit(0))["r"]["norm"],
    )
    same = modal.withColumn("_g", F.filter("_c", lambda r: r["norm"] == F.col("_m")))
    longest = F.get(
        F.filter(
            "_g", lambda r: F.length(r["raw"]) == F.array_max(F.transform("_g", lambda o: F.length(o["raw"])))
        ),
        F.lit(0),
    )["raw"]
    n = sum(here[p].cast("int") for p in POSITIONS)
    tier = (
        F.when(here["start"] & here["mid"] & here["end"], "ALL3")
        .when(here["mid"] & here["end"], "MIDEND")
        .when(n == 0, "NONE")
        .otherwise("PARTIAL")
    )
    return same.select(
        *SHOT,
        F.coalesce(longest, F.lit("")).alias("vfx_note"),
        tier.alias("tier"),
        tier.isin("ALL3", "MIDEND").alias("is_vfx"),
        *[here[p] for p in POSITIONS],
        n.alias("n_present"),
    )


def tc_offset(frame_reads: DataFrame, cuts: DataFrame, tolerance: int = 1, positions: tuple[str, ...] = ("start",)) -> DataFrame:
    """Offset of burned-in against file timecode per cut, and whether it is constant.

    The first non-empty read over ``positions`` counts for a shot. Offsets are counted per
    distinct value before the median, so a cut of any size leaves few rows.
    """
    wide = _by_position(frame_reads, "showtc", F.when(F.col("raw") != "", F.col("raw")))
    raw = F.coalesce(*[F.col(p) for p in positions])
    read = ordered.salted_lookup(wide.withColumn("_raw", raw), cuts.select(*K, "fps"), K, ["tcid"])
    off = tc.show_tc_frames("_raw", "fps") - tc.tcid_frames("tcid", "fps")
    counted = read.withColumn("_off", off).groupBy(*K, "_off").agg(F.count("*").alias("_n"), F.max("fps").alias("fps"))
    got = counted.groupBy(*K).agg(
        F.sum("_n").alias("n_samples"),
        F.coalesce(F.sum(F.when(F.col("_off").isNotNull(), F.col("_n"))), F.lit(0)).alias("n_read"),
        F.min("_off").alias("min_offset"),
        F.max("_off").alias("max_offset"),
        F.bround(F.percentile("_off", F.lit(0.5), F.col("_n"))).cast("bigint").alias("median_offset"),
        F.max("fps").alias("fps"),
    )
    spread = F.col("max_offset") - F.col("min_offset")
    return got.select(
        *K,
        "n_samples",
        "n_read",
        "min_offset",
        "max_offset",
        spread.alias("spread"),
        F.coalesce(spread <= tolerance, F.lit(False)).alias("constant"),
        "median_offset",
        tc.frames_smpte("median_offset", "fps", clamp=False).alias("median_offset_tc"),
    )
