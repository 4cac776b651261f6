"""Queries over fingerprints, vectors and the diff of two cuts."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cutledger.operators import diff, ordered, vision, wall
from cutledger.plans import derive as d
from cutledger.plans.derive import sql
from cutledger.plans.registry import query
from cutledger.session import scratch_path
from cutledger.sources import artifacts

K = ["show_id", "cut_id"]
_N = "row_number() OVER (PARTITION BY pair_id ORDER BY {0}) - 1"
_T = "lpad(CAST(vec_id AS VARCHAR), 8, '0')"
d.CTES["old_cut"] = (
    "looks",
    f"SELECT pair_id, {_N.format('vec_id')} AS pos, {_T} AS tcid, len_frames, h_start, h_mid, h_end, embedding AS color, embedding[2] > 0.25 AS dark, kind % 8 AS kind FROM looks",
)
d.CTES["new_pictures"] = (
    "looks",
    f"""SELECT pair_id, {_N.format('vec_id + CASE WHEN kind % 8 = 4 THEN 1000000000 ELSE 0 END')} AS pos, {_T} AS tcid, len_frames + CASE WHEN kind % 8 = 3 THEN 5 ELSE 0 END AS len_frames,
    [CASE WHEN kind % 8 = 2 OR (kind % 8 = 1 AND i <= 20) THEN NOT h_start[i] ELSE h_start[i] END for i in range(1, 65)] AS h_start,
    [CASE WHEN kind % 8 = 2 THEN NOT h_mid[i] ELSE h_mid[i] END for i in range(1, 65)] AS h_mid, [CASE WHEN kind % 8 = 2 THEN NOT h_end[i] ELSE h_end[i] END for i in range(1, 65)] AS h_end,
    [CASE WHEN kind % 8 IN (1, 2) THEN x + 0.5::FLOAT ELSE x END for x in embedding] AS color, embedding[2] > 0.25 AS dark, kind % 8 AS kind FROM looks""",
)
_DP = " + ".join(f"len([i for i in range(1, 65) if a.{w}[i] <> b.{w}[i]])" for w in ("h_start", "h_mid", "h_end"))
_DC = "list_sum([abs(CAST(a.color[i] AS DOUBLE) - CAST(b.color[i] AS DOUBLE)) for i in range(1, 65)]) / 64 * 100"


@query(
    "c08_picture_pairs",
    sql(
        "old_cut new_pictures",
        f"""SELECT pair_id, a_pos, b_pos, a_n, b_n, dp, round(dc, 6) AS dc, CAST(CASE WHEN dp <= 12 OR (dc <= 0 AND lit) THEN 2 ELSE 1 END AS INTEGER) AS level FROM (
        SELECT a.pair_id, a.pos AS a_pos, b.pos AS b_pos, a.n AS a_n, b.n AS b_n, CAST({_DP} AS BIGINT) AS dp, {_DC} AS dc, NOT a.dark AND NOT b.dark AS lit
        FROM (SELECT pair_id, h_start, h_mid, h_end, color, dark, min(pos) AS pos, count(*) AS n FROM old_cut GROUP BY pair_id, h_start, h_mid, h_end, color, dark) a
        JOIN (SELECT pair_id, h_start, h_mid, h_end, color, dark, min(pos) AS pos, count(*) AS n FROM new_pictures GROUP BY pair_id, h_start, h_mid, h_end, color, dark) b USING (pair_id))
        WHERE dp <= 40 OR (dc <= 0 AND lit)""",
    ),
)
def c08(spark, sf):
    a, b = d.old_and_new(spark, sf)
    return diff.pairs(a, b).withColumn("dc", F.round("dc", 6))


# The alignment as a table of scores, row by row, and the way back from its end; whole thousandths.
d.CTES["level"] = (
    "old_cut new_pictures",
    f"""SELECT pair_id, i, j, CASE WHEN dp <= 12 OR (dc <= 0 AND lit) THEN 2000 WHEN dp <= 40 THEN 400 ELSE -1000000000000 END AS w FROM (
    SELECT a.pair_id, a.pos + 1 AS i, b.pos + 1 AS j, {_DP} AS dp, {_DC} AS dc, NOT a.dark AND NOT b.dark AS lit FROM old_cut a JOIN new_pictures b USING (pair_id))""",
)
d.CTES["score_rows"] = ("level", "SELECT pair_id, i, list(w ORDER BY j) AS ws, count(*) AS m FROM level GROUP BY pair_id, i")
d.CTES["score_table"] = (
    "score_rows",
    """SELECT * FROM (WITH RECURSIVE t AS (SELECT DISTINCT pair_id, CAST(0 AS BIGINT) AS i, [CAST(-1000 * k AS BIGINT) for k in range(m + 1)] AS s FROM score_rows UNION ALL
    SELECT pair_id, i, [CAST(list_max(e[1:k]) - 1000 * (k - 1) AS BIGINT) for k in range(1, m + 2)] FROM (
    SELECT r.pair_id, r.i, r.m, list_prepend(-1000 * r.i, [greatest(t.s[k] + r.ws[k] + 1000 * k, t.s[k + 1] - 1000 + 1000 * k) for k in range(1, r.m + 1)]) AS e FROM t JOIN score_rows r ON r.pair_id = t.pair_id AND r.i = t.i + 1))
    SELECT * FROM t)""",
)
d.CTES["aligned"] = (
    "score_table",
    """SELECT pair_id, tag, oi AS i, oj AS j, step FROM (WITH RECURSIVE b AS (
    SELECT pair_id, max(i) AS i, max(m) AS j, CAST(-1 AS BIGINT) AS step, '' AS tag, CAST(NULL AS BIGINT) AS oi, CAST(NULL AS BIGINT) AS oj FROM score_rows GROUP BY pair_id UNION ALL
    SELECT pair_id, CASE WHEN tag = 'ins' THEN i ELSE i - 1 END, CASE WHEN tag = 'del' THEN j ELSE j - 1 END, step + 1, tag, CASE WHEN tag <> 'ins' THEN i - 1 END, CASE WHEN tag <> 'del' THEN j - 1 END FROM (
    SELECT b.pair_id, b.i, b.j, b.step, CASE WHEN b.i = 0 THEN 'ins' WHEN b.j = 0 THEN 'del' WHEN r.ws[b.j] > 0 AND h.s[b.j + 1] = u.s[b.j] + r.ws[b.j] THEN CASE r.ws[b.j] WHEN 2000 THEN 'equal' ELSE 'sub' END
    WHEN h.s[b.j + 1] = u.s[b.j + 1] - 1000 THEN 'del' ELSE 'ins' END AS tag
    FROM b LEFT JOIN score_table h ON h.pair_id = b.pair_id AND h.i = b.i LEFT JOIN score_table u ON u.pair_id = b.pair_id AND u.i = b.i - 1 LEFT JOIN score_rows r ON r.pair_id = b.pair_id AND r.i = b.i WHERE b.i > 0 OR b.j > 0))
    SELECT * FROM b) WHERE step >= 0""",
)
d.CTES["move_lists"] = (
    "aligned level",
    """SELECT pair_id, i, row_number() OVER (PARTITION BY pair_id ORDER BY i) AS nth, js FROM (SELECT x.pair_id, x.i, list(y.j ORDER BY y.j) AS js FROM aligned x JOIN aligned y ON y.pair_id = x.pair_id
    JOIN level l ON l.pair_id = x.pair_id AND l.i = x.i + 1 AND l.j = y.j + 1 WHERE x.tag = 'del' AND y.tag = 'ins' AND l.w = 2000 GROUP BY x.pair_id, x.i)""",
)
d.CTES["moved"] = (
    "move_lists",
    """SELECT pair_id, i, j FROM (WITH RECURSIVE t AS (SELECT DISTINCT pair_id, CAST(0 AS BIGINT) AS nth, CAST(-1 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS j, CAST([] AS BIGINT[]) AS used FROM move_lists UNION ALL
    SELECT pair_id, nth, i, j, CASE WHEN j IS NULL THEN used ELSE list_append(used, j) END FROM (
    SELECT l.pair_id, l.nth, l.i, t.used, list_filter(l.js, lambda x: NOT list_contains(t.used, x))[1] AS j FROM t JOIN move_lists l ON l.pair_id = t.pair_id AND l.nth = t.nth + 1)) SELECT * FROM t) WHERE j IS NOT NULL""",
)


@query("c09_cut_alignment", sql("aligned", "SELECT * FROM aligned"))
def c09(spark, sf):
    a, b = (d.stored(x) for x in d.old_and_new(spark, sf))
    return diff.align(a, b)


@query("c10_moved_shots", sql("moved", "SELECT * FROM moved"))
def c10(spark, sf):
    a, b = (d.stored(x) for x in d.old_and_new(spark, sf))
    return diff.moves(d.stored(diff.align(a, b)), a, b)


_HASHES = "a.h_start IS NOT NULL AND b.h_start IS NOT NULL"


@query(
    "c11_cut_diff",
    sql(
        "moved",
        f"""SELECT pair_id, CASE WHEN paired AND (in_dark OR hamming <= 12) THEN CASE WHEN abs(delta) > 2 THEN 'RETIMED' ELSE 'SAME' END WHEN paired AND hamming <= 40 THEN 'CHANGED' WHEN paired THEN 'REVIEW'
        WHEN tag = 'del' AND went THEN 'MOVED' WHEN tag = 'del' THEN 'REMOVED' ELSE 'ADDED' END AS status, coalesce(old_tcid, '') AS a_tcid, coalesce(new_tcid, '') AS b_tcid, hamming, CASE WHEN paired THEN delta END AS len_delta_frames,
        CASE WHEN paired AND in_dark THEN 'slate' WHEN paired AND hamming <= 40 THEN 'phash' WHEN paired THEN 'color' WHEN went THEN 'phash' ELSE '' END AS method FROM (
        SELECT o.pair_id, o.tag, o.tag IN ('equal', 'sub') AS paired, o.went, a.tcid AS old_tcid, b.tcid AS new_tcid, a.dark AND b.dark AS in_dark, b.len_frames - a.len_frames AS delta, CASE WHEN {_HASHES} THEN CAST({_DP} AS BIGINT) END AS hamming FROM (
        SELECT x.pair_id, x.tag, x.i, coalesce(x.j, m.j) AS j, m.j IS NOT NULL AS went FROM aligned x LEFT JOIN moved m ON m.pair_id = x.pair_id AND m.i = x.i AND x.tag = 'del'
        LEFT JOIN moved t ON t.pair_id = x.pair_id AND t.j = x.j AND x.tag = 'ins' WHERE t.j IS NULL) o
        LEFT JOIN old_cut a ON a.pair_id = o.pair_id AND a.pos = o.i LEFT JOIN new_pictures b ON b.pair_id = o.pair_id AND b.pos = o.j)""",
    ),
)
def c11_full(spark, sf):
    """The whole diff: alignment, moves, classes."""
    a, b = (d.stored(x) for x in d.old_and_new(spark, sf))
    ops = d.stored(diff.align(a, b))
    return diff.classify(ops, diff.moves(ops, a, b), a, b)


def _given(spark, sf):
    """An alignment known from how the new cut was made, with its classes."""
    a, b = (d.stored(x) for x in d.old_and_new(spark, sf))
    kind = d.looks(spark, sf).select("pair_id", F.lpad(F.col("vec_id").cast("string"), 8, "0").alias("tcid"), (F.col("kind") % 8).alias("kind"))
    both = a.select("pair_id", "tcid", F.col("pos").alias("i")).join(b.select("pair_id", "tcid", F.col("pos").alias("j")), ["pair_id", "tcid"])
    both = d.stored(both.join(kind, ["pair_id", "tcid"]))
    none = F.lit(None).cast("bigint")
    same = both.filter(~F.col("kind").isin(2, 4)).select("pair_id", F.lit("equal").alias("tag"), "i", "j")
    apart = both.filter(F.col("kind").isin(2, 4))
    ops = same.unionByName(apart.select("pair_id", F.lit("del").alias("tag"), "i", none.alias("j"))).unionByName(
        apart.select("pair_id", F.lit("ins").alias("tag"), none.alias("i"), "j")
    )
    moved = both.filter(F.col("kind") == 4).select("pair_id", "i", "j")
    return diff.classify(ops, moved, a, b), a, b


d.CTES["statuses"] = (
    "old_cut",
    """SELECT pair_id, CASE WHEN kind = 2 THEN 'REMOVED' WHEN kind = 4 THEN 'MOVED' WHEN kind = 3 THEN 'RETIMED' WHEN kind = 1 AND NOT dark THEN 'CHANGED' ELSE 'SAME' END AS status, tcid AS a_tcid, CASE WHEN kind = 2 THEN '' ELSE tcid END AS b_tcid,
    CAST(CASE kind WHEN 1 THEN 20 WHEN 2 THEN NULL ELSE 0 END AS BIGINT) AS hamming, CAST(CASE WHEN kind IN (2, 4) THEN NULL WHEN kind = 3 THEN 5 ELSE 0 END AS BIGINT) AS len_delta_frames,
    CASE WHEN kind = 2 THEN '' WHEN kind = 4 THEN 'phash' WHEN dark THEN 'slate' ELSE 'phash' END AS method, len_frames FROM old_cut
    UNION ALL SELECT pair_id, 'ADDED', '', tcid, NULL, NULL, '', len_frames FROM old_cut WHERE kind = 2""",
)


@query("c11_diff_classes", sql("statuses", "SELECT * EXCLUDE (len_frames) FROM statuses"))
def c11(spark, sf):
    return _given(spark, sf)[0]


d.CTES["report"] = (
    "statuses",
    """SELECT pair_id, a_tcid AS old_code, b_tcid AS new_code, CASE status WHEN 'MOVED' THEN 'SHIFTED' WHEN 'RETIMED' THEN 'CHANGED' ELSE status END AS verdict, CASE WHEN a_tcid <> '' THEN len_frames END AS old_dur,
    CASE WHEN b_tcid <> '' THEN len_frames + CASE WHEN status = 'RETIMED' THEN 5 ELSE 0 END END AS new_dur,
    CASE WHEN a_tcid <> '' AND b_tcid <> '' THEN CAST(CASE WHEN status = 'RETIMED' THEN 5 ELSE 0 END AS BIGINT) END AS dur_delta FROM statuses""",
)


@query("c12_change_report", sql("report", "SELECT * FROM report"))
def c12(spark, sf):
    return diff.report(*_given(spark, sf))


@query(
    "d07_duration_summary",
    sql(
        "report",
        """SELECT pair_id, count(*) AS n, CAST(sum(dur_delta) AS BIGINT) AS sum_delta, round(avg(dur_delta), 6) AS avg_delta, min(dur_delta) AS min_delta, max(dur_delta) AS max_delta FROM report WHERE dur_delta IS NOT NULL GROUP BY pair_id""",
    ),
)
def d07(spark, sf):
    return diff.summary(diff.report(*_given(spark, sf))).withColumn("avg_delta", F.round("avg_delta", 6))


@query(
    "d01_verdict_tally",
    sql(
        "report",
        """SELECT pair_id, verdict, count(*) AS n, CAST(CASE verdict WHEN 'SAME' THEN 1 WHEN 'SHIFTED' THEN 2 WHEN 'CHANGED' THEN 3 WHEN 'ADDED' THEN 4 WHEN 'REMOVED' THEN 5 ELSE 6 END AS BIGINT) AS display FROM report GROUP BY pair_id, verdict""",
    ),
)
def d01v(spark, sf):
    return diff.tally(diff.report(*_given(spark, sf)), ["pair_id"], "verdict", diff.VERDICT_ORDER)


def _cosine(a, b):
    dot = f"list_sum([CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE) for i in range(1, 65)])"
    return f"{dot} / (sqrt({dot.replace(b + '[', a + '[')}) * sqrt({dot.replace(a + '[', b + '[')}))"


@query(
    "j04_vector_similarity",
    f"""SELECT vec_id, round({_cosine('embedding', 'after')}, 6) AS score FROM (SELECT *, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS after FROM embeddings) WHERE after IS NOT NULL""",
)
def j04(spark, sf):
    e = d.table(spark, sf, "embeddings")
    near = ordered.neighbour(e, ["label"], ["vec_id"], ["embedding"], "n", ahead=True).filter(F.col("n").isNotNull())
    return near.select("vec_id", F.round(vision.cosine("embedding", "n.embedding"), 6).alias("score"))


@query(
    "j04_top_similar",
    f"""SELECT label, proposer, item, round(score, 6) AS score, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label, proposer ORDER BY round(score, 12) DESC, item) AS rn FROM (
    SELECT x.label, x.vec_id AS proposer, y.vec_id AS item, {_cosine('x.embedding', 'y.embedding')} AS score FROM embeddings x JOIN embeddings y USING (label))) WHERE rn <= 5""",
)
def j04t(spark, sf):
    e = d.table(spark, sf, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vec"))
    return vision.top_similar(e, e, ["label"], 5).select("label", "proposer", "item", F.round("score", 6).alias("score"), "rank")


_WORD = "CAST(list_sum([CASE WHEN {0}[i] THEN 1::UBIGINT << (i - 1) ELSE 0::UBIGINT END for i in range(1, 65)]) AS UBIGINT)"
d.CTES["words"] = ("looks", f"SELECT pair_id, vec_id, {_WORD.format('h_start')} AS a, {_WORD.format('h_mid')} AS b, {_WORD.format('h_end')} AS c FROM looks")


@query(
    "j04_hash_similarity",
    sql(
        "words",
        """SELECT vec_id, round(0.5::DOUBLE * (1 - bit_count(xor(a, na)) / 64.0::DOUBLE) + 0.5::DOUBLE * (1 - bit_count(xor(b, nb)) / 64.0::DOUBLE), 6) AS score FROM (
        SELECT *, lead(a) OVER w AS na, lead(b) OVER w AS nb FROM words WINDOW w AS (PARTITION BY pair_id ORDER BY vec_id)) WHERE na IS NOT NULL""",
    ),
)
def j04h(spark, sf):
    e = d.looks(spark, sf)
    near = ordered.neighbour(e, ["pair_id"], ["vec_id"], ["h_start", "h_mid"], "n", ahead=True).filter(F.col("n").isNotNull())
    score = vision.hash_similarity(F.col("h_start"), F.col("n.h_start"), F.col("h_mid"), F.col("n.h_mid"))
    return near.select("vec_id", F.round(score, 6).alias("score"))


# The library holds every picture and a copy with up to 15 bits of its first word turned.
d.CTES["library"] = (
    "words",
    """SELECT min(shot) AS shot, count(*) AS n, a, b, c FROM (SELECT vec_id * 2 AS shot, a, b, c FROM words UNION ALL
    SELECT vec_id * 2 + 1, xor(a, (1::UBIGINT << CAST(vec_id % 16 AS INTEGER)) - 1), b, c FROM words) GROUP BY a, b, c""",
)


_FAR = " + ".join(f"CAST(bit_count(xor(x.{w}, y.{w})) AS BIGINT)" for w in "abc")


def _library(spark, sf):
    e = d.looks(spark, sf)
    words = ["h_start", "h_mid", "h_end"]
    mask = F.expr("shiftleft(1L, cast(vec_id % 16 as int)) - 1")
    turned = e.select((F.col("vec_id") * 2 + 1).alias("shot"), F.col("h_start").bitwiseXOR(mask).alias("h_start"), *words[1:])
    return e.select((F.col("vec_id") * 2).alias("shot"), *words).unionByName(turned)


@query(
    "j06_near_duplicates",
    sql(
        "library",
        f"""SELECT * FROM (SELECT x.shot AS a_shot, y.shot AS b_shot, x.n AS a_n, y.n AS b_n, {_FAR} AS bits FROM library x JOIN library y ON x.shot < y.shot) WHERE bits <= 12""",
    ),
)
def j06(spark, sf):
    return vision.near_duplicates(_library(spark, sf))[1]


@query(
    "j06_copies",
    sql(
        "words",
        """SELECT shot, min(shot) OVER (PARTITION BY a, b, c) AS fid FROM (SELECT vec_id * 2 AS shot, a, b, c FROM words UNION ALL
        SELECT vec_id * 2 + 1, xor(a, (1::UBIGINT << CAST(vec_id % 16 AS INTEGER)) - 1), b, c FROM words)""",
    ),
)
def j06c(spark, sf):
    return vision.near_duplicates(_library(spark, sf))[0]


@query(
    "d16_dark_shots",
    """SELECT vec_id, (abs(CAST(embedding[1] AS DOUBLE)) / 2 + CASE WHEN embedding[2] > 0 THEN CAST(embedding[2] AS DOUBLE) ELSE 0 END + abs(CAST(embedding[3] AS DOUBLE)) / 2) / 3 < 0.06 AS dark FROM embeddings""",
)
def d16(spark, sf):
    x = [F.element_at("embedding", i).cast("double") for i in (1, 2, 3)]
    return d.table(spark, sf, "embeddings").select(
        "vec_id", vision.dark([F.abs(x[0]) / 2, F.when(x[1] > 0, x[1]), F.abs(x[2]) / 2]).alias("dark")
    )


d.CTES["frames"] = (
    "",
    "SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS p, count(*) OVER (PARTITION BY label) AS n, vec_id, embedding FROM embeddings",
)
_SAMPLED = "SELECT * FROM frames WHERE n <= 80 OR (p % (n // 80) = 0 AND p // (n // 80) < 80)"


def _luma(spark, sf):
    e = d.table(spark, sf, "embeddings").select(
        F.col("label").cast("bigint").alias("show_id"), F.lit(1).cast("bigint").alias("cut_id"), "vec_id",
        F.transform("embedding", lambda x, i: F.abs(x.cast("double")) * F.when((i < 6) | (i > 57), 20).otherwise(100)).alias("row_luma"),
    )
    e = ordered.ordinal(e, K, ["vec_id"], "frame_pos")
    return e.withColumn("frame_pos", F.col("frame_pos") - 1)


@query(
    "d09_letterbox_rows",
    sql(
        "frames",
        f"""SELECT CAST(label AS BIGINT) AS show_id, CAST(1 AS BIGINT) AS cut_id, CAST(CASE WHEN lo IS NULL THEN 0 ELSE least(lo + 1, 63) END AS BIGINT) AS top,
        CAST(CASE WHEN hi IS NULL THEN 63 ELSE greatest(hi - 1, CASE WHEN lo IS NULL THEN 0 ELSE least(lo + 1, 63) END) END AS BIGINT) AS bottom FROM (
        SELECT label, min(CASE WHEN luma > 12 THEN y END) AS lo, max(CASE WHEN luma > 12 THEN y END) AS hi FROM (
        SELECT label, i - 1 AS y, max(abs(CAST(embedding[i] AS DOUBLE)) * CASE WHEN i <= 6 OR i > 58 THEN 20 ELSE 100 END) AS luma FROM frames, range(1, 65) t(i) GROUP BY label, i) GROUP BY label)""",
    ),
)
def d09(spark, sf):
    return vision.letterbox(_luma(spark, sf))


@query("f05_frame_sampling", sql("frames", f"SELECT label, vec_id FROM ({_SAMPLED})"))
def f05(spark, sf):
    rows = _luma(spark, sf).withColumnRenamed("vec_id", "v")
    return vision.sampled(rows, 80).select(F.col("show_id").cast("int").alias("label"), F.col("v").alias("vec_id"))


def _drawn(spark, sf):
    """Pictures in the shape of the image source, drawn from the vectors over all cores, and the folder each is kept in.

    Every fifth shot has full frames only; every third has both, the full ones upside down.
    """
    e = d.table(spark, sf, "embeddings").repartition(spark.sparkContext.defaultParallelism)
    e = e.select(F.col("label").cast("bigint").alias("show_id"), F.lit(1).cast("bigint").alias("cut_id"), "vec_id", "embedding")
    return e.mapInArrow(vision.by_slices(_draw, _PICTURES), _PICTURES)


_PICTURES = "show_id bigint, cut_id bigint, folder string, tcid string, pos string, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


def _draw(batches):
    for pdf in batches:
        out = []
        for show, cut, vec, x in pdf.itertuples(index=False, name=None):
            base = np.clip((np.asarray(x, float).reshape(8, 8) * 300 + 128), 0, 255)
            for pos, a in (("start", base), ("mid", base), ("end", base.T)):
                for folder in ["frames"] if vec % 5 == 0 else ["thumbs", "frames"] if vec % 3 == 0 else ["thumbs"]:
                    big = np.kron(a[::-1] if folder == "frames" and vec % 5 else a, np.ones((6, 8))).astype(np.uint8)
                    px = np.stack([big, 255 - big, big // 2], 2)
                    im = {"origin": "", "height": 48, "width": 64, "nChannels": 3, "mode": 16, "data": px.tobytes()}
                    out.append((show, cut, folder, f"{vec:08d}", pos, im))
        yield pd.DataFrame(out, columns=["show_id", "cut_id", "folder", "tcid", "pos", "image"])


def _files(spark, sf):
    """The pictures as files in the shared folder, and as the image source reads them back."""
    path = scratch_path(spark, "frames")
    artifacts.write_images(_drawn(spark, sf), path)
    return artifacts.scan_images(spark, path)


@query(
    "a03_scan_images",
    """SELECT CAST(label AS BIGINT) AS show_id, CAST(1 AS BIGINT) AS cut_id, lpad(CAST(vec_id AS VARCHAR), 8, '0') AS tcid, pos, CASE WHEN vec_id % 5 = 0 THEN 'frames' ELSE 'thumbs' END AS folder,
    48 AS height, 64 AS width, CAST(floor(greatest(0, least(255, CAST(embedding[1] AS DOUBLE) * 300 + 128))) AS BIGINT) AS first_pixel FROM embeddings, (SELECT unnest(['start', 'mid', 'end']) AS pos)""",
)
def a03i(spark, sf):
    """What was read: the folder a file was chosen from, its size and its first blue value."""
    folder = F.regexp_extract("image.origin", r"([^/]+)/[^/]+$", 1).alias("folder")
    blue = F.conv(F.hex(F.substring("image.data", 1, 1)), 16, 10).cast("bigint").alias("first_pixel")
    return _files(spark, sf).select(*K, "tcid", "pos", folder, "image.height", "image.width", blue)


@query("j01_fingerprints")
def j01(spark, sf):
    return vision.fingerprints(_files(spark, sf)).select(*K, "tcid", "h_start", "h_mid", "h_end", "dark", F.size("color").alias("n_color"))


@query("j03_gray_differences")
def j03g(spark, sf):
    f = vision.image_features(_files(spark, sf))
    wide = f.groupBy(*K, "tcid").agg(*[F.max(F.when(F.col("pos") == p, F.col("gray"))).alias(f"g_{p}") for p in ("start", "mid", "end")])
    return vision.gray_differences(wide.withColumn("seq", F.col("tcid").cast("bigint")))


@query(
    "j07_contact_tiles",
    """SELECT show_id, cut_id, tcid, x0, y0, x1, y1, (x1 - x0) * (y1 - y0) * 3 AS n_bytes FROM (SELECT show_id, CAST(1 AS BIGINT) AS cut_id, tcid, i % c * 768 // c AS x0, i // c * 432 // r AS y0, (i % c + 1) * 768 // c AS x1, (i // c + 1) * 432 // r AS y1 FROM (
    SELECT *, CAST(ceil(n / c) AS BIGINT) AS r FROM (SELECT *, greatest(1, CAST(round_even(sqrt(768 / 432.0::DOUBLE * n / (64 / 48.0::DOUBLE)), 0) AS BIGINT)) AS c FROM (
    SELECT CAST(label AS BIGINT) AS show_id, lpad(CAST(vec_id AS VARCHAR), 8, '0') AS tcid, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings))))""",
)
def j07(spark, sf):
    im = d.stored(_files(spark, sf).filter(F.col("pos") == "mid"))
    keys = im.select(*K, "tcid", F.col("tcid").cast("bigint").alias("seq"))
    grid = wall.grid(keys, (768, 432), 64 / 48)
    luma = vision.image_features(im).select(*K, (F.col("tcid").cast("bigint")).alias("v"), "row_luma")
    luma = ordered.ordinal(luma, K, ["v"], "frame_pos").withColumn("frame_pos", F.col("frame_pos") - 1)
    got = vision.tiles(im, grid, vision.letterbox(luma))
    return got.select(*K, "tcid", "x0", "y0", "x1", "y1", F.length("pixels").cast("bigint").alias("n_bytes"))


# Two cuts of each label's pictures: in the second every 13th shot has another picture, every 17th
# is longer by five frames, every 19th stands at the end, but for the last ones.
d.CTES["recut"] = (
    "",
    """SELECT CAST(label AS BIGINT) AS pair_id, lpad(CAST(vec_id AS VARCHAR), 8, '0') AS tcid, vec_id % 90 + 10 AS len_frames, CASE WHEN r > n - 8 THEN 'same' WHEN r % 13 = 4 THEN 'other' WHEN r % 17 = 5 THEN 'longer' WHEN r % 19 = 6 THEN 'moved' ELSE 'same' END AS kind FROM (
    SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings)""",
)


def _recut(spark, sf):
    e = d.table(spark, sf, "embeddings").select(F.col("label").cast("bigint").alias("show_id"), "vec_id", "embedding")
    e = ordered.ordinal(e, ["show_id"], ["vec_id"], "r").join(e.groupBy("show_id").agg(F.count("*").alias("n")), "show_id")
    r = F.col("r")
    kind = F.when(r > F.col("n") - 8, "same").when(r % 13 == 4, "other").when(r % 17 == 5, "longer").when(r % 19 == 6, "moved").otherwise("same")
    e = d.stored(e.withColumn("kind", kind))
    cut = F.explode(F.array(*[F.lit(x).cast("bigint") for x in (1, 2)])).alias("cut_id")
    both = e.select("show_id", cut, "vec_id", "embedding", "kind")
    new = F.col("cut_id") == 2
    shots = both.select(
        *K, F.lpad(F.col("vec_id").cast("string"), 8, "0").alias("tcid"), (F.col("vec_id") + F.when(new & (F.col("kind") == "moved"), 10**9).otherwise(0)).alias("seq"),
        (F.col("vec_id") % 90 + 10 + F.when(new & (F.col("kind") == "longer"), 5).otherwise(0)).alias("len_frames"),
    )
    other = F.transform("embedding", lambda x: F.negative(x))
    drawn = both.select(*K, "vec_id", F.when(new & (F.col("kind") == "other"), other).otherwise(F.col("embedding")).alias("embedding"))
    path = scratch_path(spark, "two-cuts")
    artifacts.write_images(drawn.repartition(spark.sparkContext.defaultParallelism).mapInArrow(vision.by_slices(_draw, _PICTURES), _PICTURES), path)
    return d.stored(shots), d.stored(vision.fingerprints(artifacts.scan_images(spark, path)))


@query(
    "c12_compare_pictures",
    sql(
        "recut",
        """SELECT pair_id, tcid AS old_code, CASE WHEN kind = 'other' THEN '' ELSE tcid END AS new_code, CASE kind WHEN 'other' THEN 'REMOVED' WHEN 'longer' THEN 'CHANGED' WHEN 'moved' THEN 'SHIFTED' ELSE 'SAME' END AS verdict,
        len_frames AS old_dur, CASE WHEN kind <> 'other' THEN len_frames + CASE WHEN kind = 'longer' THEN 5 ELSE 0 END END AS new_dur, CASE WHEN kind <> 'other' THEN CAST(CASE WHEN kind = 'longer' THEN 5 ELSE 0 END AS BIGINT) END AS dur_delta FROM recut
        UNION ALL SELECT pair_id, '', tcid, 'ADDED', NULL, len_frames, NULL FROM recut WHERE kind = 'other'""",
    ),
)
def c12p(spark, sf):
    """From picture files to the report: fingerprints, looks, alignment, moves, classes."""
    shots, prints = _recut(spark, sf)
    sides = [diff.side(prints, shots.filter(F.col("cut_id") == c)) for c in (1, 2)]
    return diff.compare(*sides)[0]
