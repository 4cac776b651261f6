"""Queries over repeated reads: slates, notes, offsets, boundaries."""

from pyspark.sql import functions as F

from cutledger.functions import grammar as g
from cutledger.functions import timecode as tc
from cutledger.operators import ordered, qc
from cutledger.operators import reads as R
from cutledger.plans import derive as d
from cutledger.plans.derive import sql
from cutledger.plans.registry import query

K = ["show_id", "cut_id"]
KEY = "show_id, cut_id"


@query(
    "h13_slate_lines",
    sql(
        "parsed",
        f"SELECT {KEY}, tcid, CASE pi WHEN 0 THEN 'start' WHEN 1 THEN 'mid' ELSE 'end' END AS pos, scene, slate, take FROM parsed",
    ),
)
def h13(spark, sf):
    r = d.slate_reads(spark, sf).withColumn("p", g.slate_line("raw"))
    return r.select(*K, "tcid", "pos", "p.scene", "p.slate", "p.take")


@query(
    "h10_roman_takes",
    sql(
        "reads",
        f"SELECT {KEY}, tcid, pi, r AS roman, CAST(take_n AS INTEGER) AS value FROM reads",
    ),
)
def h10(spark, sf):
    """Takes misread with look-alikes of I, with noise stuck to the end."""
    shown = F.array(F.lit("*"), F.lit("."), F.lit(""))
    e = d.edit(spark, sf).select(
        *K,
        F.lpad(F.col("seq").cast("string"), 8, "0").alias("tcid"),
        F.element_at(F.array(F.lit("l"), F.lit("1I"), F.lit("|l!")), F.col("take_n").cast("int")).alias("raw"),
        F.posexplode(shown).alias("pi", "tail"),
    )
    t = g.roman_take(F.concat("raw", "tail"))
    return e.select(*K, "tcid", "pi", t["roman"].alias("roman"), t["value"].alias("value"))


@query(
    "h11_slate_tokens",
    sql(
        "edit",
        f"""SELECT {KEY}, seq, CAST(slate_n AS VARCHAR) AS plain, CASE WHEN slate_n >= 10 THEN CAST(slate_n AS VARCHAR) WHEN slate_n = 1 THEN NULL WHEN slate_n > 0 THEN CAST(slate_n * 10 AS VARCHAR) ELSE '0' END AS letter,
        CASE slate_n % 4 WHEN 0 THEN '550' WHEN 1 THEN '558' WHEN 2 THEN '5' ELSE '10' END AS lookalike FROM edit""",
    ),
)
def h11(spark, sf):
    """Plain digits with zeros before, a letter stuck on, and digits misread as letters."""
    e = d.edit(spark, sf)
    l = F.col("slate_n").cast("string")
    misread = F.element_at(F.array(*[F.lit(x) for x in ("sso", "55&", "oS", "1O0")]), (F.col("slate_n") % 4 + 1).cast("int"))
    return e.select(
        *K,
        "seq",
        g.slate_token(F.lpad(l, 4, "0")).alias("plain"),
        g.slate_token(F.concat(l, F.lit("o"))).alias("letter"),
        g.slate_token(misread).alias("lookalike"),
    )


@query(
    "h12_slate_fields",
    sql(
        "edit",
        f"""SELECT {KEY}, seq, CAST(slate_n * 10 + take_n AS VARCHAR) AS joined, CAST(slate_n AS VARCHAR) AS with_take,
        CASE take_n WHEN 1 THEN 'I' WHEN 2 THEN 'II' ELSE 'III' END AS take, CAST(NULL AS VARCHAR) AS scene_ref FROM edit""",
    ),
)
def h12(spark, sf):
    e = d.edit(spark, sf)
    l = F.col("slate_n").cast("string")
    ones = F.element_at(F.array(F.lit("l"), F.lit("ll"), F.lit("lll")), F.col("take_n").cast("int"))
    f = g.slate_field(F.concat_ws(" ", l, ones))
    return e.select(
        *K,
        "seq",
        g.slate_field(F.concat_ws(" ", l, F.col("take_n").cast("string")))["slate"].alias("joined"),
        f["slate"].alias("with_take"),
        f["take"].alias("take"),
        g.slate_field(F.concat(l, F.lit("pt1")))["slate"].alias("scene_ref"),
    )


@query(
    "d03_slate_votes",
    sql("slates", f"SELECT {KEY}, tcid, scene, slate, take_roman, take_int, tier, n_slate_frames FROM slates"),
)
def d03(spark, sf):
    return R.slate_votes(d.slate_reads(spark, sf)).select(
        *K, "tcid", "scene", "slate", "take_roman", "take_int", "tier", "n_slate_frames"
    )


@query("e01_official_codes", sql("official", f"SELECT {KEY}, tcid, slate, official_code FROM official"))
def e01(spark, sf):
    votes = R.slate_votes(d.slate_reads(spark, sf)).withColumn("seq", F.col("tcid").cast("bigint"))
    return R.official_codes(d.stored(votes)).select(*K, "tcid", "slate", "official_code")


_NORM = "trim(regexp_replace(replace(upper({0}), 'ß', 'SS'), '[^A-Z0-9 ]', '', 'g'))"
d.CTES["notes"] = (
    "docs",
    f"""SELECT *, {_NORM.format('text')} <> '' AS noted FROM docs""",
)


@query(
    "d04_note_consensus",
    sql("notes", f"SELECT {KEY}, tcid, CASE WHEN NOT noted OR k = 3 THEN '' WHEN k = 4 THEN text || '!!' ELSE text END AS vfx_note FROM notes"),
)
def d04(spark, sf):
    return R.note_votes(d.note_reads(spark, sf)).select(*K, "tcid", "vfx_note")


@query(
    "d05_presence_tier",
    sql(
        "notes",
        f"""SELECT {KEY}, tcid, CASE WHEN NOT noted OR k = 3 THEN 'NONE' WHEN k = 1 THEN 'MIDEND' WHEN k = 2 THEN 'PARTIAL' ELSE 'ALL3' END AS tier,
        noted AND k NOT IN (2, 3) AS is_vfx, CAST(CASE WHEN NOT noted OR k = 3 THEN 0 WHEN k IN (1, 2) THEN 2 ELSE 3 END AS INTEGER) AS n_present FROM notes""",
    ),
)
def d05(spark, sf):
    return R.note_votes(d.note_reads(spark, sf)).select(*K, "tcid", "tier", "is_vfx", "n_present")


def _tc_reads(spark, sf):
    """Show timecode burned in on every shot: constant but for a frame in even shows, drifting in odd."""
    s = d.shots(spark, sf)
    drift = F.when(F.col("show_id") % 2 == 0, F.col("seq") % 2).otherwise(F.col("seq") % 7)
    raw = tc.frames_smpte(F.col("start_frame") - 1 + 86160 + drift, "fps")
    raw = F.when(F.col("seq") % 11 == 0, F.lit("??")).otherwise(raw)
    return s.select(*K, "tcid", F.lit("start").alias("pos"), F.lit("showtc").alias("field"), raw.alias("raw"))


d.CTES["offsets"] = (
    "shots",
    "SELECT *, CASE WHEN seq % 11 = 0 THEN NULL ELSE 86160 + CASE WHEN show_id % 2 = 0 THEN seq % 2 ELSE seq % 7 END END AS off FROM shots",
)


@query("h07_show_timecode_reads", sql("offsets", f"SELECT {KEY}, tcid, start_frame - 1 + off AS frames FROM offsets"))
def h07(spark, sf):
    r = ordered.salted_lookup(_tc_reads(spark, sf), d.cuts(spark, sf), K, ["tcid"])
    return r.select(*K, "tcid", tc.show_tc_frames("raw", "fps").alias("frames"))


d.CTES["offset_stats"] = (
    "offsets",
    """SELECT show_id, cut_id, count(*) AS n_samples, count(off) AS n_read, min(off) AS min_offset, max(off) AS max_offset, max(off) - min(off) AS spread,
    coalesce(max(off) - min(off) <= 1, FALSE) AS constant, CAST(round_even(median(off), 0) AS BIGINT) AS median_offset, max(fps) AS fps FROM offsets GROUP BY show_id, cut_id""",
)


@query(
    "d08_offset_estimate",
    sql(
        "offset_stats",
        f"SELECT * EXCLUDE (fps), {d.smpte('median_offset', 'fps')} AS median_offset_tc FROM offset_stats",
    ),
)
def d08(spark, sf):
    return R.tc_offset(_tc_reads(spark, sf), d.cuts(spark, sf))


@query(
    "d02_duration_outliers",
    sql(
        "shots",
        f"""SELECT {KEY}, tcid, round(duration_s, 6) AS duration_s, round(t, 6) AS threshold_s FROM (
        SELECT *, greatest(1.0::DOUBLE, 1.9::DOUBLE * median(duration_s) OVER (PARTITION BY {KEY})) AS t FROM shots) WHERE duration_s > t""",
    ),
)
def d02(spark, sf):
    s = d.shots(spark, sf)
    limit = qc.duration_threshold(s, 1.0, 1.9)
    rows = ordered.salted_lookup(s, limit, K, ["tcid"]).filter(F.col("duration_s") > F.col("threshold_s"))
    return rows.select(*K, "tcid", F.round("duration_s", 6).alias("duration_s"), F.round("threshold_s", 6).alias("threshold_s"))


@query(
    "b12_unreliable_slates",
    sql("reads", f"SELECT {KEY}, tcid, pi, k = 10 AS unreliable FROM reads"),
)
def b12(spark, sf):
    r = d.slate_reads(spark, sf)
    pi = F.when(F.col("pos") == "start", 0).when(F.col("pos") == "mid", 1).otherwise(2)
    return r.select(*K, "tcid", pi.alias("pi"), g.is_unreliable("raw").alias("unreliable"))


d.CTES["ends"] = (
    "slates",
    """SELECT s.*, a.slate AS start_slate, a.k AS ka, m.k AS km, b.slate AS end_slate, b.k AS kb, (s.seq * 13 + s.show_id) % 40 AS d_prev, (s.seq * 7) % 50 AS d_sm, (s.seq * 11) % 45 AS d_me, e.len_frames
    FROM slates s JOIN parsed a ON s.show_id = a.show_id AND s.tcid = a.tcid AND a.pi = 0 JOIN parsed m ON s.show_id = m.show_id AND s.tcid = m.tcid AND m.pi = 1
    JOIN parsed b ON s.show_id = b.show_id AND s.tcid = b.tcid AND b.pi = 2 JOIN edit e ON e.show_id = s.show_id AND e.seq = s.seq""",
)
d.CTES["around"] = (
    "ends",
    """SELECT *, lag(tcid) OVER w AS p_tcid, lag(slate) OVER w AS p_slate, lag(take_roman) OVER w AS p_take, lag(km) OVER w AS p_km FROM ends WINDOW w AS (PARTITION BY show_id, cut_id ORDER BY seq)""",
)
_CHANGE = """coalesce(start_slate, '') <> '' AND coalesce(end_slate, '') <> '' AND start_slate <> end_slate AND NOT contains(start_slate, end_slate)
    AND NOT contains(end_slate, start_slate) AND abs(CAST(start_slate AS BIGINT) - CAST(end_slate AS BIGINT)) > 1"""
_REASON = "'slate is a placeholder and proves nothing'"
d.CTES["findings"] = (
    "around",
    f"""SELECT show_id, cut_id, 'MERGE' AS kind, tcid AS boundary_frame_tcid, p_tcid AS prev_tcid, tcid AS after_tcid, slate, printf('one slate and take, picture goes on (difference %.1f)', d_prev::DOUBLE) AS detail
    FROM around WHERE p_tcid IS NOT NULL AND km <> 10 AND p_km <> 10 AND slate <> '' AND slate = p_slate AND take_roman = p_take AND d_prev < 12
    UNION ALL SELECT show_id, cut_id, 'UNRELIABLE', '', p_tcid, tcid, '', {_REASON} FROM around WHERE p_tcid IS NOT NULL AND (km = 10 OR p_km = 10)
    UNION ALL SELECT show_id, cut_id, 'SPLIT', '', tcid, '', start_slate || '->' || end_slate, printf('picture jumps by %.1f and the slate changes', greatest(d_sm, d_me)::DOUBLE)
    FROM around WHERE len_frames >= 8 AND greatest(d_sm, d_me) >= 26 AND ka <> 10 AND kb <> 10 AND {_CHANGE}
    UNION ALL SELECT show_id, cut_id, 'UNRELIABLE', '', '', tcid, '', {_REASON} FROM around WHERE len_frames >= 8 AND greatest(d_sm, d_me) >= 26 AND (ka = 10 OR kb = 10)""",
)


def _boundary_inputs(spark, sf):
    whole = d.edit(spark, sf)
    votes = R.slate_votes(d.slate_reads(spark, sf, whole))
    e = whole.withColumn("tcid", F.lpad(F.col("seq").cast("string"), 8, "0"))
    mads = e.select(
        *K,
        "tcid",
        ((F.col("seq") * 13 + F.col("show_id")) % 40).cast("double").alias("d_prev"),
        ((F.col("seq") * 7) % 50).cast("double").alias("d_startmid"),
        ((F.col("seq") * 11) % 45).cast("double").alias("d_midend"),
    )
    return e, votes, mads


@query("j03_boundary_qc", sql("findings", "SELECT * FROM findings"))
def j03(spark, sf):
    e, votes, mads = _boundary_inputs(spark, sf)
    return qc.boundaries(e, votes, mads)


@query("g03_findings_by_kind", sql("findings", f"SELECT {KEY}, kind, count(*) AS n FROM findings GROUP BY {KEY}, kind"))
def g03(spark, sf):
    e, votes, mads = _boundary_inputs(spark, sf)
    return qc.boundaries(e, votes, mads).groupBy(*K, "kind").agg(F.count("*").alias("n"))


@query(
    "j03b_split_suppression",
    sql(
        "findings",
        """SELECT * FROM findings f WHERE kind <> 'SPLIT' OR (TRY_CAST(prev_tcid AS BIGINT) % 4 <> 0 AND NOT EXISTS (
        SELECT 1 FROM edit e WHERE e.show_id = f.show_id AND e.seq = TRY_CAST(f.prev_tcid AS BIGINT) AND e.take_n = 2))""",
    ),
)
def j03b(spark, sf):
    """Notes name a transition on every fourth shot; second takes are already checked."""
    e, votes, mads = _boundary_inputs(spark, sf)
    notes = e.select(*K, "tcid", F.when(F.col("seq") % 4 == 0, F.lit("Swish pan to left")).otherwise(F.lit("panning")).alias("vfx_note"))
    checked = e.filter(F.col("take_n") == 2)
    return qc.suppress(qc.boundaries(e, votes, mads), notes, checked)


@query(
    "h14_slate_change",
    sql("ends", f"SELECT {KEY}, tcid, coalesce({_CHANGE}, FALSE) AS change FROM ends"),
)
def h14(spark, sf):
    votes = R.slate_votes(d.slate_reads(spark, sf))
    return votes.select(*K, "tcid", g.clean_slate_change("start_slate", "end_slate").alias("change"))


_A = {"a_start": "seq * 2654435761 % 4294967296", "a_mid": "seq * 2246822519 % 4294967296", "a_end": "seq * 3266489917 % 4294967296"}


@query(
    "j02_suspect_shots",
    sql(
        "shots",
        f"""SELECT {KEY}, tcid, temp_code, start_tc, len_frames, round(duration_s, 6) AS duration_s, CAST(df AS INTEGER) AS dur_flag, sm AS phash_startmid, me AS phash_midend,
        CAST(sm > 18 OR me > 18 AS INTEGER) AS phash_flag, CAST(len_frames < 4 AS INTEGER) AS short_flag,
        concat_ws('; ', CASE WHEN df THEN printf('dur>%.1fs(med=%.1f)', t, md) END, CASE WHEN len_frames < 4 THEN 'len<4f' END, CASE WHEN sm > 18 OR me > 18 THEN 'phash-jump' END) AS note FROM (
        SELECT *, duration_s > t AS df FROM (SELECT *, 'SHW_' || tcid AS temp_code, greatest(1.5::DOUBLE, 1.7::DOUBLE * md) AS t,
        CAST(bit_count(xor({_A['a_start']}, {_A['a_mid']})) AS BIGINT) AS sm, CAST(bit_count(xor({_A['a_mid']}, {_A['a_end']})) AS BIGINT) AS me FROM (
        SELECT *, median(duration_s) OVER (PARTITION BY {KEY}) AS md FROM shots)))""",
    ),
)
def j02(spark, sf):
    s = d.stored(d.shots(spark, sf))
    hashes = s.select(*K, "tcid", *[F.expr(e).cast("bigint").alias(n) for n, e in _A.items()])
    got = qc.suspects(s, hashes, min_dur=1.5, median_mult=1.7, jump=18)
    return got.withColumn("duration_s", F.round("duration_s", 6))
