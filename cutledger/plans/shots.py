"""Queries over shot tables: keys, manifests, windows, splits and merges."""

from pyspark.sql import functions as F

from cutledger.functions import timecode as tc
from cutledger.operators import ordered
from cutledger.operators import shots as S
from cutledger.plans import derive as d
from cutledger.plans.derive import sql
from cutledger.plans.registry import query

K = ["show_id", "cut_id"]
KEY = "show_id, cut_id"


@query("b01_shot_keys", sql("shots", f"SELECT {KEY}, tcid, 'SHW_' || tcid AS temp_code, tc_in, len_frames AS duration FROM shots"))
def b01(spark, sf):
    return S.key_projection(d.shots(spark, sf))


@query(
    "b02_minute_range",
    sql("shots", f"SELECT {KEY}, tcid, seq, start_frame FROM shots WHERE start_s >= 60 AND start_s <= 300"),
)
def b02(spark, sf):
    return S.time_range(d.shots(spark, sf), 1, 5).select(*K, "tcid", "seq", "start_frame")


_T = "greatest(0.0::DOUBLE, (greatest(0, least(k, total - 1)) - 0.5) / fps)"


@query(
    "b05_frame_manifest",
    sql(
        "shots",
        f"""SELECT {KEY}, tcid, pos, k AS frame_idx, round({_T}, 6) AS seek_s, round(greatest(0.0::DOUBLE, {_T} - 2), 6) AS pre_s,
        round({_T} - greatest(0.0::DOUBLE, {_T} - 2), 6) AS post_s FROM (
        SELECT *, max(end_frame) OVER (PARTITION BY show_id, cut_id) AS total,
        CASE pos WHEN 'start' THEN start_frame - 1 WHEN 'mid' THEN (start_frame + end_frame - 2) // 2 ELSE greatest(start_frame, end_frame) - 1 END AS k
        FROM shots CROSS JOIN (SELECT unnest(['start', 'mid', 'end']) AS pos))""",
    ),
)
def b05(spark, sf):
    m = S.frame_manifest(d.shots(spark, sf))
    return m.select(*K, "tcid", "pos", "frame_idx", *[F.round(c, 6).alias(c) for c in ("seek_s", "pre_s", "post_s")])


@query(
    "b06_clip_manifest",
    sql("shots", f"SELECT {KEY}, tcid, start_tc, round(len_frames / fps, 6) AS clip_s, 'SHW_' || tcid || '.mp4' AS clip_name FROM shots"),
)
def b06(spark, sf):
    return S.clip_manifest(d.shots(spark, sf)).withColumn("clip_s", F.round("clip_s", 6))


@query(
    "c14_neighbour_join",
    sql(
        "shots",
        f"""SELECT {KEY}, seq, tcid, lag(tcid) OVER w AS prev_tcid, lag(len_frames) OVER w AS prev_len FROM shots
        WINDOW w AS (PARTITION BY show_id, cut_id ORDER BY seq)""",
    ),
)
def c14(spark, sf):
    got = ordered.neighbour(d.shots(spark, sf), K, ["seq"], ["tcid", "len_frames"], "prev")
    return got.select(*K, "seq", "tcid", F.col("prev.tcid").alias("prev_tcid"), F.col("prev.len_frames").alias("prev_len"))


@query("d11_frame_total", sql("edit", f"SELECT {KEY}, max(end_frame) AS total FROM edit GROUP BY {KEY}"))
def d11(spark, sf):
    return S.frame_total(d.edit(spark, sf))


@query(
    "e04_renumber",
    sql(
        "shots",
        f"SELECT {KEY}, tcid, row_number() OVER (PARTITION BY {KEY} ORDER BY start_frame) AS seq, start_frame FROM shots",
    ),
)
def e04(spark, sf):
    return S.renumber(d.shots(spark, sf)).select(*K, "tcid", "seq", "start_frame")


@query("e05_running_start", sql("edit", f"SELECT {KEY}, seq, len_frames, start_frame, end_frame FROM edit"))
def e05(spark, sf):
    return d.edit(spark, sf).select(*K, "seq", "len_frames", "start_frame", "end_frame")


@query(
    "e06_shots_from_starts",
    sql(
        "edit",
        f"""SELECT {KEY}, s0 + 1 AS start_frame, e0 AS end_frame, e0 - s0 AS len_frames FROM (
        SELECT {KEY}, s0, coalesce(lead(s0) OVER (PARTITION BY {KEY} ORDER BY s0), n) AS e0 FROM (
        SELECT {KEY}, start_frame - 1 AS s0, max(end_frame) OVER (PARTITION BY {KEY}) AS n, slate_n FROM edit) WHERE slate_n <> 0 OR s0 = 0) WHERE e0 > s0""",
    ),
)
def e06(spark, sf):
    e = d.edit(spark, sf)
    starts = e.filter((F.col("slate_n") != 0) | (F.col("start_frame") == 1)).select(*K, (F.col("start_frame") - 1).alias("start0"))
    n = S.frame_total(e).withColumnRenamed("total", "n_frames")
    return S.from_starts(starts, n).select(*K, "start_frame", "end_frame", "len_frames")


@query(
    "e07_shots_from_scores",
    sql(
        "scores",
        f"""SELECT {KEY}, s0 + 1 AS start_frame, e0 AS end_frame, e0 - s0 AS len_frames FROM (
        SELECT {KEY}, frame_idx AS s0, coalesce(lead(frame_idx) OVER (PARTITION BY {KEY} ORDER BY frame_idx), n) AS e0 FROM (
        SELECT *, lag(score > 0.1) OVER (PARTITION BY {KEY} ORDER BY frame_idx) AS was, max(frame_idx) OVER (PARTITION BY {KEY}) + 1 AS n FROM scores)
        WHERE frame_idx = 0 OR (was AND NOT score > 0.1)) WHERE e0 > s0""",
    ),
)
def e07(spark, sf):
    return S.from_scores(d.scores(spark, sf), 0.1).select(*K, "start_frame", "end_frame", "len_frames")


_GAPS = "SELECT * FROM shots WHERE slate_n <> 7"


@query(
    "e12_contiguity",
    sql(
        "shots",
        f"""SELECT {KEY}, tcid, next_tcid, end_frame, next_start, 'not contiguous' AS reason FROM (
        SELECT *, lead(tcid) OVER w AS next_tcid, lead(start_frame) OVER w AS next_start FROM ({_GAPS}) WINDOW w AS (PARTITION BY {KEY} ORDER BY seq))
        WHERE next_tcid IS NOT NULL AND next_start <> end_frame + 1""",
    ),
)
def e12(spark, sf):
    """The cut under test is the edit without the shots of slate 7, so that it has gaps; all its neighbours are looked at."""
    return S.contiguity(d.shots(spark, sf).filter(F.col("slate_n") != 7))


@query(
    "f03_first_n",
    sql("edit", f"SELECT {KEY}, seq, len_frames FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY start_frame) AS n FROM edit) WHERE n <= 10"),
)
def f03(spark, sf):
    ranked = ordered.ordinal(d.edit(spark, sf), K, ["start_frame"], "n")
    return ranked.filter(F.col("n") <= 10).select(*K, "seq", "len_frames")


@query(
    "h01_tcid_from_timecode",
    sql(
        "shots",
        f"""SELECT {KEY}, seq, start_tc, substr(start_tc, 1, 2) || substr(start_tc, 4, 2) || substr(start_tc, 7, 2) ||
        printf('%02d', least(CAST(round_even((CAST(substr(start_tc, 7) AS DOUBLE) - floor(CAST(substr(start_tc, 7) AS DOUBLE))) * fps, 0) AS BIGINT), CAST(round_even(fps, 0) AS BIGINT) - 1)) AS tcid_tc FROM shots""",
    ),
)
def h01(spark, sf):
    return d.shots(spark, sf).select(*K, "seq", "start_tc", tc.tcid_from_tc("start_tc", "fps").alias("tcid_tc"))


@query(
    "h02_clock_text",
    sql(
        "shots",
        f"""SELECT {KEY}, seq, start_tc, end_tc, round(CAST(substr(start_tc, 1, 2) AS BIGINT) * 3600
        + CAST(substr(start_tc, 4, 2) AS BIGINT) * 60 + CAST(substr(start_tc, 7) AS DOUBLE), 3) AS back_s FROM shots""",
    ),
)
def h02(spark, sf):
    return d.shots(spark, sf).select(*K, "seq", "start_tc", "end_tc", F.round(tc.tc_seconds("start_tc"), 3).alias("back_s"))


@query(
    "h03_smpte",
    sql(
        "shots",
        f"SELECT {KEY}, seq, tc_in, start_frame - 1 AS frames, {d.smpte('CAST(round_even(start_s * fps, 0) AS BIGINT)', 'fps')} AS from_seconds FROM shots",
    ),
)
def h03(spark, sf):
    return d.shots(spark, sf).select(
        *K, "seq", "tc_in", tc.smpte_frames("tc_in", "fps").alias("frames"), tc.seconds_smpte("start_s", "fps").alias("from_seconds")
    )


@query(
    "h04_tcid_seconds",
    sql(
        "shots",
        f"SELECT {KEY}, tcid, round(CAST(substr(tcid, 1, 2) AS BIGINT) * 3600 + CAST(substr(tcid, 3, 2) AS BIGINT) * 60 + CAST(substr(tcid, 5, 2) AS BIGINT) + CAST(substr(tcid, 7, 2) AS BIGINT) / fps, 6) AS secs FROM shots",
    ),
)
def h04(spark, sf):
    return d.shots(spark, sf).select(*K, "tcid", F.round(tc.tcid_seconds("tcid", "fps"), 6).alias("secs"))


@query(
    "h05_burnin_to_file",
    sql(
        "shots",
        f"""SELECT {KEY}, tcid, CASE WHEN fr >= 0 THEN {d.smpte('fr', 'fps')} END AS file_tc, fr < 0 AS rejected FROM (
        SELECT *, start_frame - 1 - 5 * CAST(round_even(fps, 0) AS BIGINT) AS fr FROM shots)""",
    ),
)
def h05(spark, sf):
    fr = tc.burnin_file_frames(F.col("tc_in"), F.lit("00:00:05:00"), "fps")
    return d.shots(spark, sf).select(
        *K, "tcid", F.when(fr >= 0, tc.frames_smpte(fr, "fps")).alias("file_tc"), (fr < 0).alias("rejected")
    )


@query(
    "h06_real_timecode",
    sql(
        "shots",
        f"SELECT {KEY}, tcid, {d.smpte('start_frame - 1 + 86160', 'fps')} AS real_in, {d.smpte('start_frame - 1 + 86160 + len_frames - 1', 'fps')} AS real_out FROM shots",
    ),
)
def h06(spark, sf):
    out = tc.out_tc("tc_in", "len_frames", "fps", F.lit(86160))
    return d.shots(spark, sf).select(
        *K, "tcid", tc.real_tc("tc_in", F.lit(86160), "fps").alias("real_in"), out.alias("real_out")
    )


@query(
    "h09_tcid_keys",
    sql("shots", f"SELECT {KEY}, tcid, CASE WHEN ltrim(tcid, '0') = '' THEN '0' ELSE ltrim(tcid, '0') END AS key, regexp_extract('SHW_' || tcid, '(\\d{{8}})', 1) AS found FROM shots"),
)
def h09(spark, sf):
    return d.shots(spark, sf).select(
        *K, "tcid", tc.norm_tcid("tcid").alias("key"), tc.tcid_of(F.concat(F.lit("SHW_"), "tcid")).alias("found")
    )


# Split decisions: a third and two thirds of long shots, a point outside some short ones, and a
# show without such a shot.
_POINTS = """SELECT show_id, cut_id, tcid, unnest([len_frames // 3, 2 * len_frames // 3]) AS at_frame FROM shots WHERE len_frames >= 30
    UNION ALL SELECT show_id, cut_id, tcid, len_frames FROM shots WHERE len_frames <= 3"""
d.CTES["points"] = ("shots", _POINTS)
_PIECES = f"""SELECT show_id, cut_id, tcid AS from_tcid, fps, CAST(p AS BIGINT) AS piece,
    start_frame + CASE p WHEN 0 THEN 0 WHEN 1 THEN len_frames // 3 ELSE 2 * len_frames // 3 END AS start_frame,
    start_frame - 1 + CASE p WHEN 0 THEN len_frames // 3 WHEN 1 THEN 2 * len_frames // 3 ELSE len_frames END AS end_frame
    FROM shots CROSS JOIN (SELECT unnest([0, 1, 2]) AS p) WHERE len_frames >= 30"""
d.CTES["pieces"] = ("shots", f"SELECT *, replace({d.smpte('start_frame - 1', 'fps')}, ':', '') AS tcid FROM ({_PIECES})")


def _points(shots):
    n = F.col("len_frames")
    both = F.explode(F.array(F.floor(n / 3).cast("bigint"), F.floor(n * 2 / 3).cast("bigint")))
    good = shots.filter(n >= 30).select(*K, "tcid", both.alias("at_frame"))
    return good.unionByName(shots.filter(n <= 3).select(*K, "tcid", n.alias("at_frame")))


@query(
    "i01_split",
    sql(
        "pieces",
        f"""SELECT {KEY}, tcid, row_number() OVER (PARTITION BY {KEY} ORDER BY start_frame) AS seq, start_frame, end_frame, end_frame - start_frame + 1 AS len_frames FROM (
        SELECT {KEY}, tcid, start_frame, end_frame FROM shots WHERE len_frames < 30 UNION ALL SELECT {KEY}, tcid, start_frame, end_frame FROM pieces)""",
    ),
)
def i01(spark, sf):
    shots = d.stored(d.shots(spark, sf))
    table, _, _ = S.split(shots, _points(shots))
    return table.select(*K, "tcid", "seq", "start_frame", "end_frame", "len_frames")


@query(
    "i01_split_rejects",
    sql("shots", f"SELECT {KEY}, tcid, 'split point outside shot' AS reason FROM shots WHERE len_frames <= 3"),
)
def i01r(spark, sf):
    shots = d.stored(d.shots(spark, sf))
    return S.split(shots, _points(shots))[2]


# Merge decisions: a shot with slate 1 keeps the one behind it, unless that one is slate 1 too.
d.CTES["pairs"] = (
    "shots",
    """SELECT * FROM (SELECT *, lead(tcid) OVER w AS n_tcid, lead(slate_n) OVER w AS n_slate, lead(end_frame) OVER w AS n_end FROM shots
    WINDOW w AS (PARTITION BY show_id, cut_id ORDER BY seq)) WHERE slate_n = 1 AND n_slate <> 1""",
)


def _pairs(shots):
    nxt = ordered.neighbour(shots, K, ["seq"], ["tcid", "slate_n"], "_n", ahead=True)
    hit = nxt.filter((F.col("slate_n") == 1) & (F.col("_n.slate_n") != 1))
    return hit.select(*K, F.col("tcid").alias("keep_tcid"), F.col("_n.tcid").alias("absorb_tcid"))


@query(
    "i02_merge",
    sql(
        "pairs",
        f"""SELECT {KEY}, s.tcid, s.seq, s.start_frame, coalesce(p.n_end, s.end_frame) AS end_frame, coalesce(p.n_end, s.end_frame) - s.start_frame + 1 AS len_frames
        FROM shots s LEFT JOIN (SELECT {KEY}, tcid, n_end FROM pairs) p USING (show_id, cut_id, tcid)
        WHERE NOT EXISTS (SELECT 1 FROM pairs q WHERE q.show_id = s.show_id AND q.cut_id = s.cut_id AND q.n_tcid = s.tcid)""",
    ),
)
def i02(spark, sf):
    shots = d.stored(d.shots(spark, sf))
    table, _, _ = S.merge(shots, _pairs(shots))
    return table.select(*K, "tcid", "seq", "start_frame", "end_frame", "len_frames")


def _ledger(shots):
    """One entry per long shot with a sheet row on every other one, and entries without frames."""
    n = F.col("len_frames")
    frames = F.when(n >= 30, F.array(F.floor(n / 3).cast("bigint"), F.floor(n * 2 / 3).cast("bigint")))
    row = F.when(F.col("seq") % 2 == 0, F.col("seq"))
    return shots.filter((n >= 30) | (n <= 3)).select(
        *K, F.concat(F.lit("c"), F.col("seq").cast("string")).alias("id"), "tcid", row.alias("sheet_row"), row.alias("top_row"), frames.alias("cut_frames")
    )


@query(
    "i03_ledger_replay",
    sql(
        "pieces",
        f"""SELECT {KEY}, tcid, row_number() OVER (PARTITION BY {KEY} ORDER BY start_frame) AS seq, start_frame, end_frame FROM (
        SELECT {KEY}, tcid, start_frame, end_frame FROM shots WHERE len_frames < 30 UNION ALL SELECT {KEY}, tcid, start_frame, end_frame FROM pieces)""",
    ),
)
def i03(spark, sf):
    shots = d.stored(d.shots(spark, sf))
    table, _, _ = S.apply_ledger(shots, _ledger(shots))
    return table.select(*K, "tcid", "seq", "start_frame", "end_frame")


@query(
    "f02_ledger_order",
    sql(
        "shots",
        f"""SELECT {KEY}, id, row_number() OVER (PARTITION BY {KEY} ORDER BY CASE WHEN top_row IS NULL THEN 1 ELSE 0 END, top_row DESC NULLS LAST, num DESC) AS place FROM (
        SELECT {KEY}, 'c' || seq AS id, CASE WHEN seq % 2 = 0 THEN seq END AS top_row, CAST(tcid AS BIGINT) AS num FROM shots WHERE len_frames >= 30 OR len_frames <= 3)""",
    ),
)
def f02(spark, sf):
    return S.ledger_places(_ledger(d.shots(spark, sf))).select(*K, "id", "place")


@query(
    "i04_rethumb_manifest",
    sql(
        "pieces",
        f"""SELECT {KEY}, tcid, pos, start_frame - 1 + CASE pos WHEN 'start' THEN 0 WHEN 'mid' THEN (n - 1) // 2 ELSE n - 1 END AS frame_idx FROM (
        SELECT *, end_frame - start_frame + 1 AS n FROM pieces) CROSS JOIN (SELECT unnest(['start', 'mid', 'end']) AS pos) WHERE piece > 0 OR pos <> 'start'""",
    ),
)
def i04(spark, sf):
    shots = d.stored(d.shots(spark, sf).select(*K, "tcid", "start_frame", "end_frame", "len_frames", "fps"))
    return S.rethumb_manifest(S.split(shots, _points(shots))[1])
