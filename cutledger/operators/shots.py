"""Shot tables: building, manifests, splitting, merging, ledger replay.

``show_id, cut_id`` key every table. Mutations return ``(new table, change set, rejects)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutledger.functions import timecode as tc
from cutledger.operators import ordered
from cutledger.schema import POSITIONS
from cutledger.session import materialize

K = ["show_id", "cut_id"]


def with_times(shots: DataFrame, fps: str = "fps") -> DataFrame:
    """Add seconds, timecodes, SMPTE and tcid from the frame range and the cut's rate."""
    f = F.col(fps)
    return shots.withColumns(
        {
            "start_s": (F.col("start_frame") - 1) / f,
            "end_s": F.col("end_frame") / f,
            "duration_s": F.col("len_frames") / f,
            "tc_in": tc.frames_smpte(F.col("start_frame") - 1, f),
            "tcid": tc.tcid_from_frames(F.col("start_frame") - 1, f),
        }
    ).withColumns({"start_tc": tc.seconds_tc("start_s"), "end_tc": tc.seconds_tc("end_s")})


def key_projection(shots: DataFrame, prefix: str = "SHW") -> DataFrame:
    """tcid, temporary code, SMPTE in and duration of each shot."""
    return shots.select(
        *K, "tcid", F.concat(F.lit(prefix + "_"), "tcid").alias("temp_code"), "tc_in", F.col("len_frames").alias("duration")
    )


def time_range(shots: DataFrame, start_min: float | None = None, end_min: float | None = None) -> DataFrame:
    """Shots that start inside a minute range, both ends included."""
    if start_min is not None:
        shots = shots.filter(F.col("start_s") >= start_min * 60)
    if end_min is not None:
        shots = shots.filter(F.col("start_s") <= end_min * 60)
    return shots


def from_lengths(lengths: DataFrame, order: list[str], blocks: list[Column] | None = None) -> DataFrame:
    """Sequence number, start and end frame from per-shot lengths in edit order."""
    got = ordered.running(
        lengths,
        K,
        order,
        {"seq": F.lit(1).cast("bigint"), "start_frame": F.col("len_frames").cast("bigint")},
        blocks,
    )
    return got.withColumns({"seq": F.col("seq") + 1, "start_frame": F.col("start_frame") + 1}).withColumn(
        "end_frame", F.col("start_frame") + F.col("len_frames") - 1
    )


def from_starts(starts: DataFrame, n_frames: DataFrame) -> DataFrame:
    """Shots from 0-based start frames: half open, the last ends at n_frames, empty ones dropped."""
    nxt = ordered.neighbour(starts, K, ["start0"], ["start0"], "_next", ahead=True)
    ends = ordered.salted_lookup(nxt, n_frames, K, ["start0"])
    out = ends.select(*K, "start0", F.coalesce(F.col("_next.start0"), F.col("n_frames")).alias("end0"))
    return out.filter(F.col("end0") > F.col("start0")).withColumns(
        {
            "start_frame": F.col("start0") + 1,
            "end_frame": F.col("end0"),
            "len_frames": F.col("end0") - F.col("start0"),
        }
    )


def from_scores(scores: DataFrame, threshold: float = 0.25) -> DataFrame:
    """Shots from per-frame cut scores: a shot starts at 0 and after each run above threshold."""
    hot = scores.select(*K, "frame_idx", (F.col("score") > threshold).alias("hot"))
    hot = ordered.neighbour(hot, K, ["frame_idx"], ["hot"], "_prev")
    starts = hot.filter((F.col("frame_idx") == 0) | (F.col("_prev.hot") & ~F.col("hot"))).select(
        *K, F.col("frame_idx").alias("start0")
    )
    n = scores.groupBy(*K).agg((F.max("frame_idx") + 1).alias("n_frames"))
    return from_starts(starts, n)


def frame_total(shots: DataFrame) -> DataFrame:
    """Frames of a cut: its largest end frame."""
    return shots.groupBy(*K).agg(F.max("end_frame").alias("total"))


def frame_manifest(shots: DataFrame, positions: tuple[str, ...] = POSITIONS, total: DataFrame | None = None) -> DataFrame:
    """One row per position to grab: 0-based index and seek times."""
    first, last = F.col("start_frame") - 1, F.col("end_frame") - 1
    at = {"start": first, "mid": F.floor((first + last) / 2).cast("bigint"), "end": F.greatest(first, last)}
    picks = F.array(*[F.struct(F.lit(p).alias("pos"), at[p].alias("k")) for p in positions])
    total = frame_total(shots) if total is None else total
    rows = ordered.salted_lookup(shots, total, K, ["start_frame"])
    rows = rows.withColumn("_p", F.explode(picks)).select(*K, "tcid", "fps", "total", "_p.pos", F.col("_p.k").alias("frame_idx"))
    clamped = F.when(
        F.col("total") > 0, F.greatest(F.lit(0), F.least(F.col("frame_idx"), F.col("total") - 1))
    ).otherwise(F.greatest(F.lit(0), F.col("frame_idx")))
    t = F.greatest(F.lit(0.0), (F.col("_k") - 0.5) / F.col("fps"))
    return (
        rows.withColumn("_k", clamped)
        .withColumn("seek_s", t)
        .withColumn("pre_s", F.greatest(F.lit(0.0), F.col("seek_s") - 2.0))
        .withColumn("post_s", F.col("seek_s") - F.col("pre_s"))
        .select(*K, "tcid", "pos", "frame_idx", "seek_s", "pre_s", "post_s")
    )


def clip_manifest(shots: DataFrame, prefix: str = "SHW") -> DataFrame:
    return shots.select(
        *K,
        "tcid",
        "start_tc",
        (F.col("len_frames") / F.col("fps")).alias("clip_s"),
        F.concat(F.lit(prefix + "_"), "tcid", F.lit(".mp4")).alias("clip_name"),
    )


def renumber(shots: DataFrame) -> DataFrame:
    """Scene numbers 1..N along the frames."""
    return ordered.ordinal(shots.drop("seq"), K, ["start_frame"], "seq")


def contiguity(shots: DataFrame) -> DataFrame:
    """Neighbours that do not touch: a gap or overlap in frames, or a jump in scene number."""
    nxt = ordered.neighbour(shots, K, ["seq"], ["seq", "start_frame", "tcid"], "_n", ahead=True)
    bad_frames = F.col("end_frame") + 1 != F.col("_n.start_frame")
    bad_seq = F.col("seq") + 1 != F.col("_n.seq")
    return nxt.filter(F.col("_n").isNotNull() & (bad_frames | bad_seq)).select(
        *K,
        "tcid",
        F.col("_n.tcid").alias("next_tcid"),
        "end_frame",
        F.col("_n.start_frame").alias("next_start"),
        F.when(bad_frames, F.lit("not contiguous")).otherwise(F.lit("not consecutive")).alias("reason"),
    )


def split(shots: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Split shots at clip-relative frames.

    ``decisions``: show_id, cut_id, tcid, at_frame. All points of a shot apply at once, each must
    lie strictly inside it, and no new key may collide with a shot of the cut or another piece.
    A shot with any bad point is left whole and rejected. ``shots`` has one row per tcid of a cut.

    Shots and points meet in one grouping by key, every shot then gives its pieces, and two windows
    settle them: pieces of one key, and pieces of one shot. What comes out is stored once and holds
    table, changes and rejects.
    """
    cols = ["start_frame", "end_frame", "len_frames", "fps"]
    none = F.lit(None)
    known = shots.select(*K, "tcid", F.struct(*cols).alias("shot"), none.cast("bigint").alias("at_frame"), F.lit(False).alias("asked"))
    asked = decisions.select(*K, "tcid", none.cast(known.schema["shot"].dataType).alias("shot"), F.col("at_frame").cast("bigint").alias("at_frame"), F.lit(True).alias("asked"))
    met = known.unionByName(asked).groupBy(*K, "tcid").agg(
        F.max("shot").alias("shot"), F.bool_or("asked").alias("asked"), F.array_sort(F.collect_set("at_frame")).alias("points")
    )
    inside = lambda p: (p > 0) & (p < F.col("shot.len_frames"))
    why = F.when(
        F.col("asked"),
        F.when(F.col("shot").isNull(), F.lit("shot not found"))
        .when(~F.forall("points", inside), F.lit("split point outside shot"))
        .when(F.size("points") == 0, F.lit("no split point")),
    )
    judged = met.withColumn("reason", why)
    # A shot that is not asked for, or badly, is one piece, its whole.
    cuts = F.when(F.col("reason").isNull(), F.col("points")).otherwise(F.array().cast("array<bigint>"))
    bounds = F.concat(F.array(F.lit(0).cast("bigint")), cuts, F.array(F.col("shot.len_frames")))
    piece = F.transform(F.slice("_b", F.lit(1), F.size("_b") - 1), lambda b, i: F.struct(i.alias("n"), b.alias("a"), F.get(F.col("_b"), i + 1).alias("b")))
    pieces = judged.withColumn("_b", bounds).select("*", F.explode(piece).alias("p"))
    new_start = F.col("shot.start_frame") + F.col("p.a")
    new_key = F.when(F.col("p.n") > 0, tc.tcid_from_frames(new_start - 1, "shot.fps")).otherwise(F.col("tcid"))
    # A point beside any shot holds no key: its own name goes with a sign that no key begins with.
    held = F.when(F.col("shot").isNull(), F.concat(F.lit("?"), "tcid")).otherwise(new_key)
    # What follows from other columns is worked out behind the windows, which shuffle every piece.
    pieces = pieces.select(*K, "tcid", held.alias("_held"), "shot", "p", "reason", (F.size("points") == 0).alias("_uncut"))
    new_tcid = F.when(F.col("shot").isNull(), F.col("tcid")).otherwise(F.col("_held"))
    clash = (F.count("*").over(Window.partitionBy(*K, "_held")) > 1) & (F.col("p.n") > 0)
    pieces = pieces.withColumn("_clash", clash)
    pieces = pieces.withColumn("_bad", F.max("_clash").over(Window.partitionBy(*K, "tcid"))).filter((F.col("p.n") == 0) | ~F.col("_bad"))
    whole = F.col("_bad") | F.col("reason").isNotNull() | F.col("_uncut")
    settled = materialize(
        pieces.select(
            *K,
            F.col("tcid").alias("from_tcid"),
            new_tcid.alias("tcid"),
            F.when(~whole, F.col("p.n").cast("bigint")).alias("piece"),
            new_start.alias("start_frame"),
            F.when(whole, F.col("shot.end_frame")).otherwise(F.col("shot.start_frame") + F.col("p.b") - 1).alias("end_frame"),
            F.when(whole, F.col("shot.len_frames")).otherwise(F.col("p.b") - F.col("p.a")).alias("len_frames"),
            F.col("shot.fps").alias("fps"),
            F.when(F.col("_bad"), F.lit("new key exists")).otherwise(F.col("reason")).alias("reason"),
        )
    )
    table = settled.filter(F.col("start_frame").isNotNull()).select(*K, *cols, "tcid")
    changes = settled.filter(F.col("piece").isNotNull()).drop("reason")
    rejects = settled.filter(F.col("reason").isNotNull()).select(*K, "tcid", "reason")
    return renumber(table), changes.select(*K, "from_tcid", "tcid", "piece", *cols), rejects


def merge(shots: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merge a shot with the directly following ones.

    ``decisions``: show_id, cut_id, keep_tcid, absorb_tcid. A group that is not consecutive and
    contiguous is rejected whole. Numbers are left as they are. ``shots`` has one row per tcid of
    a cut.

    Shots and decisions meet in one grouping by key; a window over each merge then says what it
    comes to, and the stored rows hold table, changes and rejects.
    """
    cols = ["seq", "start_frame", "end_frame", "len_frames", "tcid", "fps"]
    known = shots.select(*K, "tcid", F.struct(*cols).alias("shot"), F.lit(None).cast(dict(shots.dtypes)["tcid"]).alias("keep"))
    both = F.explode(F.array("keep_tcid", "absorb_tcid")).alias("tcid")
    asked = decisions.select(*K, both, F.lit(None).cast(known.schema["shot"].dataType).alias("shot"), F.col("keep_tcid").alias("keep"))
    met = known.unionByName(asked).groupBy(*K, "tcid").agg(F.max("shot").alias("shot"), F.sort_array(F.collect_set("keep")).alias("keeps"))
    # A shot that no merge names is a group of its own.
    rows = met.select(*K, "tcid", "shot", (F.size("keeps") > 1).alias("_many"), F.posexplode_outer("keeps").alias("_k", "keep"))
    rows = rows.withColumn("_grp", F.coalesce("keep", F.concat(F.lit("?"), "tcid")))
    w = Window.partitionBy(*K, "_grp")
    # A run of shots is consecutive and contiguous exactly when its counts and lengths add up,
    # so no ordering inside the group is needed.
    rows = rows.withColumns(
        {
            "n": F.count("*").over(w),
            "_found": F.count("shot").over(w),
            "_twice": F.max("_many").over(w),
            "_first": F.min(F.struct("shot.seq", "tcid")).over(w),
            "_last": F.max("shot.seq").over(w),
            "_start": F.min("shot.start_frame").over(w),
            "_end": F.max("shot.end_frame").over(w),
            "_frames": F.sum(F.col("shot.end_frame") - F.col("shot.start_frame") + 1).over(w),
        }
    )
    reason = F.when(
        F.col("keep").isNotNull(),
        F.when(F.col("_found") < F.col("n"), F.lit("shot not found"))
        .when(F.col("_twice"), F.lit("shot in two merges"))
        .when(F.col("_first.tcid") != F.col("keep"), F.lit("not consecutive"))
        .when(F.col("_last") - F.col("_first.seq") + 1 != F.col("n"), F.lit("not consecutive"))
        .when(F.col("_end") - F.col("_start") + 1 != F.col("_frames"), F.lit("not contiguous")),
    )
    rows = rows.withColumn("reason", reason)
    merged = F.col("keep").isNotNull() & F.col("reason").isNull()
    # Of a good merge its first shot stays, and of every other shot one row.
    stays = F.col("shot").isNotNull() & F.when(merged, F.col("tcid") == F.col("keep")).otherwise(F.coalesce(F.col("_k"), F.lit(0)) == 0)
    settled = materialize(rows.select(*K, "tcid", "shot", "keep", "reason", "n", "_first", "_end", "_frames", merged.alias("_merged"), stays.alias("_stays")))
    pick = lambda new, old: F.when(F.col("_merged"), F.col(new)).otherwise(F.col(f"shot.{old}")).alias(old)
    table = settled.filter("_stays").select(
        *K, "shot.seq", "shot.start_frame", pick("_end", "end_frame"), pick("_frames", "len_frames"), "tcid", "shot.fps"
    )
    changes = settled.filter(F.col("_merged") & F.col("_stays")).select(
        *K, "tcid", "shot.seq", "shot.start_frame", F.col("_end").alias("end_frame"), F.col("_frames").alias("len_frames"), (F.col("n") - 1).alias("absorbed")
    )
    rejects = settled.filter(F.col("reason").isNotNull()).select(*K, F.col("keep").alias("tcid"), "reason").distinct()
    return table, changes, rejects


def _replay_key() -> list[Column]:
    """Rows with a sheet row first, the lowest row of the sheet first; the rest by tcid descending."""
    number = tc.norm_tcid(F.coalesce(F.col("tcid"), F.lit("0"))).try_cast("bigint")
    return [F.col("top_row").isNull().cast("bigint"), -F.coalesce("top_row", F.lit(0)), -number]


def ledger_order(ledger: DataFrame) -> DataFrame:
    """The ledger in replay order, bottom to top."""
    return ledger.orderBy(*_replay_key())


def ledger_places(ledger: DataFrame) -> DataFrame:
    """Place of every entry in the replay of its cut."""
    late, row, number = _replay_key()
    keyed = ledger.withColumns({"_late": late, "_row": row, "_num": number})
    step = ordered.BLOCK_ROWS
    got = ordered.ordinal(
        keyed,
        K,
        ["_late", "_row", "_num"],
        "place",
        # The tcid leads only among the rows without a sheet row.
        blocks=[
            F.col("_late"),
            F.floor(F.col("_row") / step),
            F.when(F.col("_late") == 1, F.floor(F.col("_num") / (100 * step))).otherwise(F.lit(0)),
        ],
    )
    return got.drop("_late", "_row", "_num")


def apply_ledger(shots: DataFrame, ledger: DataFrame, ids: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Replay recorded missed cuts: all points of a shot are joined and applied once."""
    if ids is not None:
        ledger = ledger.filter(F.col("id").isin(ids))
    usable = ledger.filter(F.col("tcid").isNotNull() & F.col("cut_frames").isNotNull() & (F.size("cut_frames") > 0))
    decisions = usable.select(*K, "tcid", F.explode("cut_frames").alias("at_frame"))
    table, changes, rejects = split(shots, decisions)
    skipped = ledger.join(usable.select(*K, "id"), [*K, "id"], "left_anti").select(
        *K, "tcid", F.lit("missing key or frame").alias("reason")
    )
    return table, changes, rejects.unionByName(skipped)


def rethumb_manifest(changes: DataFrame, merged: bool = False) -> DataFrame:
    """Positions to grab again: the kept start still holds, every other position changed."""
    later = F.array(F.lit("mid"), F.lit("end"))
    every = F.array(*[F.lit(p) for p in POSITIONS])
    pos = later if merged else F.when(F.col("piece") == 0, later).otherwise(every)
    first, n = F.col("start_frame") - 1, F.col("len_frames")
    at = (
        F.when(F.col("pos") == "start", F.lit(0))
        .when(F.col("pos") == "mid", F.floor((n - 1) / 2))
        .otherwise(n - 1)
        .cast("bigint")
    )
    return changes.withColumn("pos", F.explode(pos)).select(*K, "tcid", "pos", (first + at).alias("frame_idx"))
