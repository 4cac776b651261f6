"""Queries for audits and accuracy."""

from pyspark.sql import functions as F

from cutledger.functions import grammar as g
from cutledger.operators import audit
from cutledger.operators import reads as R
from cutledger.plans import derive as d
from cutledger.plans.derive import sql
from cutledger.plans.registry import query

K = ["show_id", "cut_id"]
KEY = "show_id, cut_id"


def _audit(spark, sf):
    """Read side: documents with their quality; operator side: labels with toxicity."""
    docs = d.table(spark, sf, "documents").select("doc_id", "lang")
    labels = d.table(spark, sf, "labels")
    ocr = docs.join(labels.select("doc_id", "quality"), "doc_id", "left").select("doc_id", g.is_true("quality").alias("is_vfx"))
    return ocr.na.fill(False), audit.operator_flags(labels.withColumnRenamed("toxic", "flag"), ["doc_id"])


d.CTES["audited"] = (
    "",
    """SELECT doc_id, coalesce(q, FALSE) OR coalesce(f, FALSE) AS is_vfx, coalesce(q, FALSE) AS ocr, coalesce(f, FALSE) AS flag FROM (
    SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, l.quality = 1 AS q, l.toxic <> 0 AS f FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id)""",
)
_CATEGORY = "CASE WHEN flag AND NOT ocr THEN 'operator_only_invisible' WHEN ocr AND NOT flag THEN 'ocr_only_unflagged' END"


@query("c16_invisible_audit", sql("audited", f"SELECT *, {_CATEGORY} AS category FROM audited"))
def c16(spark, sf):
    return audit.invisible(*_audit(spark, sf), ["doc_id"])


@query(
    "c16_audit_counts",
    sql(
        "audited",
        """SELECT is_vfx AS any_vfx, count(*) AS total, count_if(is_vfx)::BIGINT AS is_vfx, count_if(ocr)::BIGINT AS ocr_confirmed, count_if(flag AND NOT ocr)::BIGINT AS operator_only_invisible,
        count_if(ocr AND NOT flag)::BIGINT AS ocr_only_unflagged FROM audited GROUP BY audited.is_vfx""",
    ),
)
def c16c(spark, sf):
    table = audit.invisible(*_audit(spark, sf), ["doc_id"]).withColumn("any_vfx", F.col("is_vfx"))
    return audit.invisible_counts(table, ["any_vfx"])


@query(
    "b08_truth_words",
    """SELECT doc_id, quality = 1 AS is_true, toxic <> 0 AS is_flagged FROM labels""",
)
def b08(spark, sf):
    return d.table(spark, sf, "labels").select("doc_id", g.is_true("quality").alias("is_true"), g.is_flagged("toxic").alias("is_flagged"))


# Three cuts per show; every seventh supplier's second cut has an unknown rate.
_CUTS3 = """SELECT show_id, c AS cut_id, c AS arrival_seq, CASE WHEN show_id % 7 = 0 AND c = 2 THEN NULL WHEN c = 3 AND show_id % 2 = 0 THEN 23.976::DOUBLE ELSE fps END AS fps
    FROM cuts CROSS JOIN (SELECT unnest([1, 2, 3]::BIGINT[]) AS c)"""


@query(
    "c18_fps_guard",
    sql(
        "cuts",
        f"""SELECT show_id, old_cut, cut_id, old_fps, fps, CASE WHEN old_fps IS NULL OR fps IS NULL THEN 'UNKNOWN' WHEN abs(old_fps - fps) > 0.05 THEN 'MISMATCH' ELSE 'OK' END AS verdict FROM (
        SELECT *, lag(cut_id) OVER w AS old_cut, lag(fps) OVER w AS old_fps FROM ({_CUTS3}) WINDOW w AS (PARTITION BY show_id ORDER BY arrival_seq)) WHERE old_cut IS NOT NULL""",
    ),
)
def c18(spark, sf):
    c = d.cuts(spark, sf).withColumn("arrival_seq", F.explode(F.array(*[F.lit(i).cast("bigint") for i in (1, 2, 3)])))
    c = c.withColumn("cut_id", F.col("arrival_seq"))
    unknown = (F.col("show_id") % 7 == 0) & (F.col("arrival_seq") == 2)
    other = (F.col("arrival_seq") == 3) & (F.col("show_id") % 2 == 0)
    fps = F.when(unknown, F.lit(None).cast("double")).when(other, 23.976).otherwise(F.col("fps"))
    return audit.fps_guard(c.withColumn("fps", fps))


@query(
    "m01_read_accuracy",
    sql(
        "slates",
        """SELECT s.show_id, count(*) AS n, round(avg(CASE WHEN s.scene = CAST(e.l_partkey % 97 + 1 AS VARCHAR) AND s.slate = CAST(e.slate_n AS VARCHAR) AND s.take_int = e.take_n THEN 1.0::DOUBLE ELSE 0 END), 6) AS slate_exact,
        CAST(count(*) FILTER (WHERE e.len_frames % 5 = 0) AS BIGINT) AS n_notes, round(avg(CASE WHEN e.len_frames % 5 = 0 THEN CASE WHEN e.len_frames % 10 = 0 THEN 1.0::DOUBLE ELSE 0 END END), 6) AS note_exact
        FROM slates s JOIN edit e ON s.show_id = e.show_id AND s.seq = e.seq GROUP BY s.show_id""",
    ),
)
def m01(spark, sf):
    """Truth is the edit itself; half of the noted shots have a note that was read right."""
    e = d.edit(spark, sf)
    tcid = F.lpad(F.col("seq").cast("string"), 8, "0").alias("tcid")
    noted = F.col("len_frames") % 5 == 0
    truth = e.select(
        *K,
        tcid,
        (F.col("l_partkey") % 97 + 1).cast("string").alias("scene"),
        F.col("slate_n").cast("string").alias("slate"),
        F.element_at(F.array(*[F.lit(x) for x in ("I", "II", "III")]), F.col("take_n").cast("int")).alias("take_roman"),
        F.when(noted, F.lit("paint out rig")).otherwise(F.lit("")).alias("vfx_note"),
    )
    notes = e.select(*K, tcid, F.when(F.col("len_frames") % 10 == 0, F.lit("paint out rig")).otherwise(F.lit("")).alias("vfx_note"))
    got = R.slate_votes(d.slate_reads(spark, sf)).join(notes, [*K, "tcid"])
    score = audit.score_reads(got, truth, ["show_id"])
    return score.withColumns({c: F.round(c, 6) for c in ("slate_exact", "note_exact")})


@query(
    "m02_boundary_accuracy",
    sql(
        "scores edit",
        f"""SELECT {KEY}, n_detected, n_truth, n_hit, round(n_hit / n_detected, 6) AS precision, round(n_hit / n_truth, 6) AS recall FROM (
        SELECT {KEY}, count_if(d)::BIGINT AS n_detected, count_if(t)::BIGINT AS n_truth, count_if(d AND t)::BIGINT AS n_hit FROM (
        SELECT {KEY}, slate_n % 3 <> 0 AS d, slate_n % 5 <> 0 AS t FROM edit) GROUP BY {KEY})""",
    ),
)
def m02(spark, sf):
    """Detected: starts whose slate is no multiple of three; truth: no multiple of five."""
    e = d.stored(d.edit(spark, sf).select(*K, "start_frame", "slate_n"))
    got = audit.score_boundaries(e.filter(F.col("slate_n") % 3 != 0), e.filter(F.col("slate_n") % 5 != 0))
    return got.withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


@query(
    "m02_boundary_tolerance",
    sql(
        "edit",
        f"""SELECT {KEY}, n_detected, n_truth, n_hit, n_hit / n_detected AS precision, n_hit / n_truth AS recall FROM (
        WITH RECURSIVE s AS (SELECT {KEY}, start_frame AS pos, 0 AS side FROM edit WHERE slate_n % 3 <> 0 UNION SELECT {KEY}, start_frame + 1, 1 FROM edit WHERE slate_n % 5 <> 0),
        e AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY pos, side) AS k FROM s),
        w AS (SELECT {KEY}, k, [pos] AS waits, side, CAST(0 AS BIGINT) AS n FROM e WHERE k = 1
          UNION ALL SELECT show_id, cut_id, k, CASE WHEN was <> side AND len(f) > 0 THEN f[2:] WHEN was = side THEN list_append(f, pos) ELSE [pos] END,
          CASE WHEN was <> side AND len(f) > 0 THEN was ELSE side END, n + CASE WHEN was <> side AND len(f) > 0 THEN 1 ELSE 0 END FROM (
            SELECT e.show_id, e.cut_id, e.k, e.pos, e.side, w.side AS was, w.n, list_filter(w.waits, lambda p: p >= e.pos - 2) AS f
            FROM w JOIN e ON e.show_id = w.show_id AND e.cut_id = w.cut_id AND e.k = w.k + 1))
        SELECT s.show_id, s.cut_id, count_if(side = 0)::BIGINT AS n_detected, count_if(side = 1)::BIGINT AS n_truth, max(m.n)::BIGINT AS n_hit
        FROM s JOIN (SELECT {KEY}, max(n) AS n FROM w GROUP BY {KEY}) m USING (show_id, cut_id) GROUP BY ALL)""",
    ),
)
def m02t(spark, sf):
    """The same with a tolerance of two frames."""
    e = d.stored(d.edit(spark, sf).select(*K, "start_frame", "slate_n"))
    return audit.score_boundaries(
        e.filter(F.col("slate_n") % 3 != 0), e.filter(F.col("slate_n") % 5 != 0).withColumn("start_frame", F.col("start_frame") + 1), 2
    )
