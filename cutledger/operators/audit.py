"""Audits and accuracy measures."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutledger.functions import grammar as g
from cutledger.operators import ordered
from cutledger.sources.tables import norm_header

K = ["show_id", "cut_id"]
# Headers of flag columns, as norm_header spells them.
FLAGS = {"flag", "status", "match", "new", "vfx_flag", "operator_flag"}


def operator_flags(sheet: DataFrame, key: list[str]) -> DataFrame:
    """True where any flag-like column holds something other than a no; headers count in any spelling."""
    cols = [c for c in sheet.columns if norm_header(c) in FLAGS]
    flags = [g.is_flagged(F.coalesce(sheet[f"`{c}`"].cast("string"), F.lit(""))) for c in cols]
    flag = reduce(lambda a, b: a | b, flags, F.lit(False))
    return sheet.select(*key, flag.alias("flag"))


def invisible(ocr: DataFrame, flags: DataFrame, key: list[str]) -> DataFrame:
    """Full truth table: is_vfx is read or flagged; a one-sided shot gets a category."""
    o = ocr.select(*key, F.col("is_vfx").alias("_o"))
    f = flags.select(*key, F.col("flag").alias("_f"))
    both = o.join(f, key, "full_outer")
    read, flag = F.coalesce("_o", F.lit(False)), F.coalesce("_f", F.lit(False))
    category = F.when(flag & ~read, F.lit("operator_only_invisible")).when(read & ~flag, F.lit("ocr_only_unflagged"))
    return both.select(*key, (read | flag).alias("is_vfx"), read.alias("ocr"), flag.alias("flag"), category.alias("category"))


def invisible_counts(table: DataFrame, by: list[str]) -> DataFrame:
    return table.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if("is_vfx").alias("is_vfx"),
        F.count_if("ocr").alias("ocr_confirmed"),
        F.count_if(F.col("category") == "operator_only_invisible").alias("operator_only_invisible"),
        F.count_if(F.col("category") == "ocr_only_unflagged").alias("ocr_only_unflagged"),
    )


def fps_guard(cuts: DataFrame, tol: float = 0.05) -> DataFrame:
    """Each cut against the one that arrived before it in its show."""
    prev = ordered.neighbour(cuts, ["show_id"], ["arrival_seq"], ["cut_id", "fps"], "_p")
    a, b = F.col("_p.fps"), F.col("fps")
    verdict = (
        F.when(a.isNull() | b.isNull(), F.lit("UNKNOWN")).when(F.abs(a - b) > tol, F.lit("MISMATCH")).otherwise(F.lit("OK"))
    )
    return prev.filter(F.col("_p").isNotNull()).select(
        "show_id", F.col("_p.cut_id").alias("old_cut"), "cut_id", a.alias("old_fps"), "fps", verdict.alias("verdict")
    )


def score_reads(reads: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """Share of truth shots whose scene, slate and take (and note) were read exactly."""
    key = [*K, "tcid"]
    t = truth.select(*key, *[F.col(c).alias(f"t_{c}") for c in ("scene", "slate", "take_roman", "vfx_note")])
    both = t.join(reads.select(*key, "scene", "slate", "take_roman", "vfx_note"), key, "left")

    def same(c: str):
        return F.coalesce(F.coalesce(F.col(c), F.lit("")) == F.coalesce(F.col(f"t_{c}"), F.lit("")), F.lit(False))

    slate = same("scene") & same("slate") & same("take_roman")
    noted = F.coalesce(F.col("t_vfx_note"), F.lit("")) != ""
    return both.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(slate.cast("double")).alias("slate_exact"),
        F.count_if(noted).alias("n_notes"),
        F.avg(F.when(noted, same("vfx_note").cast("double"))).alias("note_exact"),
    )


def _match_runs(tol: int):
    """Hits of every run, from its sorted starts: free starts of one side wait in a queue, and the
    next one of the other side takes the first that is near enough. No more starts wait than fit
    into the tolerance."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, free, waiting, n = None, deque(), 0, 0
        for pdf in batches:
            out = []
            for show, cut, at_run, at, side in pdf.itertuples(index=False, name=None):
                if (show, cut, at_run) != key:
                    if n:
                        out.append((*key[:2], n))
                    key, waiting, n = (show, cut, at_run), side, 0
                    free.clear()
                while free and free[0] < at - tol:
                    free.popleft()
                if side != waiting and free:
                    free.popleft()
                    n += 1
                    continue
                waiting = side if not free else waiting
                free.append(at)
            yield pd.DataFrame(out, columns=[*K, "n"])
        if n:
            yield pd.DataFrame([(*key[:2], n)], columns=[*K, "n"])

    return run


def score_boundaries(shots: DataFrame, truth: DataFrame, tol_frames: int = 0) -> DataFrame:
    """Precision and recall of shot starts against truth starts, one to one within a tolerance.

    As many starts are matched as can be. Starts further apart than the tolerance never meet, so a
    cut falls into runs of starts that follow each other closely, and each run is settled by itself:
    along it a start takes the earliest one of the other side that is still free and near enough.
    Runs are dealt to tasks and read in order, so one of any length takes no memory.
    """
    d = shots.select(*K, F.col("start_frame").alias("d")).distinct()
    t = truth.select(*K, F.col("start_frame").alias("t")).distinct()
    one = d.select(*K, F.col("d").alias("at"), F.lit(0).alias("side")).unionByName(t.select(*K, F.col("t").alias("at"), F.lit(1).alias("side")))
    one = ordered.neighbour(one, K, ["at", "side"], ["at"], "_p")
    breaks = F.when(F.col("at") - F.col("_p.at") <= tol_frames, 0).otherwise(1).cast("bigint")
    one = one.withColumn("_break", breaks).drop("_p")
    one = ordered.running(one, K, ["at", "side"], {"_run": F.col("_break")}).withColumn("_run", F.col("_run") + F.col("_break"))
    runs = [*K, "_run"]
    laid = one.select(*runs, "at", "side").repartition(*runs).sortWithinPartitions(*runs, "at", "side")
    hits = laid.mapInPandas(_match_runs(tol_frames), "show_id bigint, cut_id bigint, n bigint").groupBy(*K).agg(F.sum("n").alias("n_hit"))
    nd, nt = d.groupBy(*K).agg(F.count("*").alias("n_detected")), t.groupBy(*K).agg(F.count("*").alias("n_truth"))
    both = nd.join(nt, K, "full_outer").join(hits, K, "left").na.fill(0, ["n_detected", "n_truth", "n_hit"])
    return both.select(
        *K,
        "n_detected",
        "n_truth",
        "n_hit",
        F.when(F.col("n_detected") > 0, F.col("n_hit") / F.col("n_detected")).alias("precision"),
        F.when(F.col("n_truth") > 0, F.col("n_hit") / F.col("n_truth")).alias("recall"),
    )


def score_matches(matches: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Share of confirmed shots whose proposed row agrees, and rows claimed more than once."""
    got = confirmed.select("show_id", "tcid", F.col("master_row").alias("_want")).join(
        matches.select("show_id", "tcid", "master_row"), ["show_id", "tcid"], "left"
    )
    agreed = got.groupBy("show_id").agg(
        F.count("*").alias("n_confirmed"),
        F.count_if(F.coalesce(F.col("_want") == F.col("master_row"), F.lit(False))).alias("n_agreed"),
    )
    rows = matches.groupBy("show_id", "master_row").count()
    clash = rows.groupBy("show_id").agg(F.count_if(F.col("count") > 1).alias("n_collisions"))
    return agreed.join(clash, "show_id", "left").na.fill(0, ["n_collisions"]).withColumn(
        "share_agreed", F.col("n_agreed") / F.col("n_confirmed")
    )
