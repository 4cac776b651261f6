"""Queries for loaders, sinks and intake. Files they scan are written by Spark from the tables."""

from pyspark.sql import functions as F

from cutledger.plans import derive as d
from cutledger.plans.derive import sql
from cutledger.plans.registry import query
from cutledger.plans.reads import _tc_reads
from cutledger.operators import reads as R
from cutledger.session import scratch_path
from cutledger.sources import artifacts as X
from cutledger.sources import scenes
from cutledger.sources import tables as T

K = ["show_id", "cut_id"]
KEY = "show_id, cut_id"

_TCID = """substr(start_tc, 1, 2) || substr(start_tc, 4, 2) || substr(start_tc, 7, 2) || printf('%02d', least(CAST(round_even((CAST(substr(start_tc, 7) AS DOUBLE)
    - floor(CAST(substr(start_tc, 7) AS DOUBLE))) * fps, 0) AS BIGINT), CAST(round_even(fps, 0) AS BIGINT) - 1))"""
d.CTES["scanned"] = (
    "shots",
    f"SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY show_id, cut_id, tcid) AS same FROM (SELECT * EXCLUDE (tcid), {_TCID} AS tcid FROM shots)) WHERE same = 1",
)
SCANNED = sql("scanned", f"SELECT {KEY}, tcid, seq, start_frame, end_frame, len_frames, start_tc, end_tc FROM scanned")
_COLS = [*K, "tcid", "seq", "start_frame", "end_frame", "len_frames", "start_tc", "end_tc"]


def written_scenes(spark, sf):
    path = scratch_path(spark, "scenes")
    scenes.write_scenes(d.shots(spark, sf), path)
    return path


@query("a01_scan_scene_lists", SCANNED)
def a01(spark, sf):
    shots, _ = scenes.scan_scenes(spark, written_scenes(spark, sf), d.cuts(spark, sf))
    return shots.select(*_COLS)


_FOLDER = "CASE o_orderkey % 4 WHEN 0 THEN 'scenes' WHEN 1 THEN 'scenes_transnet' WHEN 2 THEN 'scenes' ELSE 'other' END"
_FILE = "CASE o_orderkey % 4 WHEN 2 THEN 'x' || o_orderkey || '-Scenes.csv' WHEN 3 THEN CASE WHEN o_orderkey % 8 = 3 THEN 'notes.txt' ELSE 'Scenes-old.csv' END ELSE 'm' || o_custkey || '-Scenes.csv' END"


@query(
    "a02_source_precedence",
    f"""SELECT stem, path, CAST(priority AS INTEGER) AS priority FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY priority, path) AS rn FROM (
    SELECT 'm' || o_custkey AS stem, '/lib/m' || o_custkey || '/' || {_FOLDER} || '/' || {_FILE} AS path, CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 4 END AS priority, o_orderkey FROM orders)
    WHERE o_orderkey % 8 <> 3) WHERE rn = 1""",
)
def a02(spark, sf):
    o = d.table(spark, sf, "orders")
    k, stem = F.col("o_orderkey") % 4, F.concat(F.lit("m"), F.col("o_custkey").cast("string"))
    folder = F.when(k == 1, F.lit("scenes_transnet")).when(k == 3, F.lit("other")).otherwise(F.lit("scenes"))
    other = F.when(F.col("o_orderkey") % 8 == 3, F.lit("notes.txt")).otherwise(F.lit("Scenes-old.csv"))
    name = F.when(k == 2, F.concat(F.lit("x"), F.col("o_orderkey").cast("string"), F.lit("-Scenes.csv"))).when(k == 3, other).otherwise(F.concat(stem, F.lit("-Scenes.csv")))
    paths = o.select(stem.alias("stem"), F.concat(F.lit("/lib/"), stem, F.lit("/"), folder, F.lit("/"), name).alias("path"))
    return scenes.precedence(paths)


@query(
    "a03_frame_files",
    sql(
        "shots",
        f"""SELECT {KEY}, tcid, pos, CASE WHEN seq % 3 = 0 THEN 'frames' ELSE 'thumbs' END AS folder FROM shots CROSS JOIN (SELECT unnest(['start', 'mid', 'end']) AS pos) WHERE NOT (seq % 5 = 0 AND pos = 'mid' AND seq % 3 = 0)""",
    ),
)
def a03(spark, sf):
    """Every shot has full frames, but for some middle ones; two of three have thumbnails."""
    s = d.stored(d.shots(spark, sf).select(*K, "tcid", "seq"))
    s = s.withColumn("pos", F.explode(F.array(*[F.lit(p) for p in ("start", "mid", "end")])))
    path = lambda folder: F.concat(F.lit(f"/lib/{folder}/SHW_"), "tcid", F.lit("-"), "pos", F.lit(".jpg"))
    frames = s.filter(~((F.col("seq") % 5 == 0) & (F.col("pos") == "mid"))).select(*K, path("frames").alias("path"))
    thumbs = s.filter(F.col("seq") % 3 != 0).select(*K, path("thumbs").alias("path"))
    return X.image_keys(frames.unionByName(thumbs)).select(*K, "tcid", "pos", "folder")


@query("a04_new_shot_table", sql("new_cut", "SELECT show_id, tcid, code, CASE WHEN input_pos % 2 = 0 THEN input_pos * 3 ELSE input_pos END AS \"order\" FROM new_cut"))
def a04(spark, sf):
    """A table with untidy headers; every other order is no number."""
    path = scratch_path(spark, "new")
    n = d.new_cut(spark, sf)
    order = F.when(F.col("input_pos") % 2 == 0, (F.col("input_pos") * 3).cast("string")).otherwise(F.lit("?"))
    n.select("show_id", F.concat(F.lit(" "), "tcid").alias(" TcId"), F.col("code").alias("CODE "), order.alias("Order"), "input_pos").write.parquet(path)
    return T.new_shots(spark.read.parquet(path)).select("show_id", "tcid", "code", "order")


@query("a04_master_table", sql("master", "SELECT show_id, row, code, revision FROM master"))
def a04m(spark, sf):
    path = scratch_path(spark, "master")
    m = d.master(spark, sf)
    m.select("show_id", F.col("row").cast("string").alias("Master  Row"), F.col("code").alias("Code"), F.when(F.col("revision") != "", F.col("revision")).alias("REVISION"), "input_pos").write.parquet(path)
    return T.master_rows(spark.read.parquet(path)).select("show_id", "row", "code", "revision")


@query(
    "a05_sheet_row_index",
    sql("shots", "SELECT show_id, CASE WHEN ltrim(tcid, '0') = '' THEN '0' ELSE ltrim(tcid, '0') END AS key, seq + 2 AS row FROM shots WHERE seq % 6 <> 0"),
)
def a05(spark, sf):
    s = d.shots(spark, sf)
    code = F.when(F.col("seq") % 6 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" SHW_"), "tcid"))
    sheet = s.select("show_id", code.alias("code"), (F.col("seq") + 2).alias("row"))
    return T.row_index(sheet, "code")


@query(
    "a06_last_row_per_key",
    """SELECT lpad(CAST(user_id AS VARCHAR), 8, '0') AS tcid, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events WHERE user_id % 5 <> 0 GROUP BY user_id""",
)
def a06(spark, sf):
    """Artifact rows keyed by user, later ones beat earlier ones; blank keys drop out."""
    e = d.table(spark, sf, "events")
    key = F.when(F.col("user_id") % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lpad(F.col("user_id").cast("string"), 8, "0"), F.lit(" ")))
    return T.last_per_key(e.select(key.alias("tcid"), "event_id", "event_type"), ["tcid"], "event_id")


@query("a07_absent_artifact", sql("edit", f"SELECT {KEY}, seq, CAST(NULL AS VARCHAR) AS dialogue FROM edit"))
def a07(spark, sf):
    none = X.optional(spark, scratch_path(spark, "absent"), "show_id bigint, cut_id bigint, seq bigint, dialogue string")
    return d.edit(spark, sf).select(*K, "seq").join(none, [*K, "seq"], "left")


@query(
    "a08_ledger_scan",
    sql(
        "edit",
        f"""SELECT {KEY}, 'c' || seq AS id, lpad(CAST(seq AS VARCHAR), 8, '0') AS tcid, seq AS sheet_row, CASE WHEN seq % 2 = 0 THEN seq END AS top_row, CAST(CASE WHEN seq % 2 = 0 THEN len_frames ELSE len_frames + 1 END AS VARCHAR) AS frames FROM edit""",
    ),
)
def a08(spark, sf):
    """Flat and nested entries in turn."""
    e = d.edit(spark, sf)
    tcid = F.lpad(F.col("seq").cast("string"), 8, "0")
    flat = F.format_string('{"corrections":[{"id":"c%d","merged_tcid":"%s","sheet_row":%d,"cut_frame":%d}]}', "seq", tcid, "seq", "len_frames")
    nested = F.format_string(
        '{"corrections":[{"id":"c%d","cut7":{"merged_tcid":"%s","sheet_row":%d,"cut_frames":[%d]}}]}', "seq", tcid, "seq", F.col("len_frames") + 1
    )
    raw = e.select(*K, F.when(F.col("seq") % 2 == 0, flat).otherwise(nested).alias("json"))
    path = scratch_path(spark, "ledger")
    raw.withColumnRenamed("json", "value").write.parquet(path)
    rows = X.ledger_rows(spark.read.parquet(path).withColumnRenamed("value", "json"), K)
    return rows.select(*K, "id", "tcid", "sheet_row", "top_row", F.array_join(F.transform("cut_frames", lambda x: x.cast("string")), ",").alias("frames"))


@query("a09_protected_rows", sql("master", "SELECT show_id, row FROM master WHERE len_frames % 2 = 0"))
def a09(spark, sf):
    path = scratch_path(spark, "protected")
    rows = d.master(spark, sf).filter(F.col("len_frames") % 2 == 0)
    rows.select("show_id", F.array("row").alias("protected_rows")).write.json(path)
    return X.scan_protected(spark, path)


@query(
    "a10_offset_reports",
    sql(
        "offset_stats",
        f"""SELECT {KEY}, CASE WHEN show_id % 5 <> 0 THEN {d.smpte('median_offset', 'fps')} END AS median_offset_tc, CASE WHEN show_id % 5 <> 0 THEN median_offset END AS median_offset_frames,
        CASE WHEN show_id % 5 <> 0 THEN constant END AS constant FROM offset_stats""",
    ),
)
def a10(spark, sf):
    return X.offset_reports(_reports(spark, sf).withColumnRenamed("value", "report"), K)


def _reports(spark, sf):
    """A report per cut; every fifth has no readable offset."""
    o = R.tc_offset(_tc_reads(spark, sf), d.cuts(spark, sf)).join(d.cuts(spark, sf), K)
    state = F.when(F.col("constant"), F.lit("=> CONSTANT")).otherwise(F.lit("=> DRIFTS"))
    line = F.concat(F.lit("median offset = "), "median_offset_tc", F.lit(" ("), F.col("median_offset").cast("string"), F.lit(" frames @ "), F.col("fps").cast("string"), F.lit("fps)"))
    text = F.when(F.col("show_id") % 5 == 0, F.lit("fps=24.0, 0 shots sampled")).otherwise(F.concat_ws("\n", state, line))
    return o.select(*K, text.alias("value"))


@query(
    "a10_report_files",
    sql(
        "offset_stats",
        f"""SELECT {KEY}, CASE WHEN show_id % 5 <> 0 THEN {d.smpte('median_offset', 'fps')} END AS median_offset_tc, CASE WHEN show_id % 5 <> 0 THEN median_offset END AS median_offset_frames,
        CASE WHEN show_id % 5 <> 0 THEN constant END AS constant FROM offset_stats""",
    ),
)
def a10f(spark, sf):
    """The same reports as text files, one per cut, found and read by path."""
    path = scratch_path(spark, "reports")
    _reports(spark, sf).repartition(*K).write.partitionBy(*K).text(path)
    got = X.scan_offset_reports(spark, f"{path}/*/*/*.txt")
    keys = [F.regexp_extract("path", rf"{k}=(\d+)/", 1).cast("bigint").alias(k) for k in K]
    return got.select(*keys, "median_offset_tc", "median_offset_frames", "constant")


@query("a04_csv_by_header", sql("new_cut", "SELECT CAST(show_id AS VARCHAR) AS show_id, tcid, code, CAST(input_pos AS VARCHAR) AS \"order\", CAST(NULL AS VARCHAR) AS vfx_note FROM new_cut"))
def a04c(spark, sf):
    """CSV files whose headers differ in case, blanks and order; one column is missing."""
    path = scratch_path(spark, "csv")
    n = d.new_cut(spark, sf)
    n.select(F.col("input_pos").alias(" Order"), F.col("code").alias("CODE "), F.col("show_id").alias("Show  ID"), F.col("tcid").alias("TcId")).write.option("header", True).csv(path)
    fields = {"show_id": ["show id"], "tcid": ["tcid"], "code": ["code"], "order": ["order"], "vfx_note": ["VFX Notes", "VFX Note"]}
    return T.read_by_header(spark, path, fields, ["show_id", "tcid"])


@query("a11_artifact_sink", sql("edit", f"SELECT {KEY}, seq, len_frames, start_frame FROM edit"))
def a11(spark, sf):
    path = scratch_path(spark, "artifact")
    X.sink(d.edit(spark, sf).select(*K, "seq", "len_frames", "start_frame"), path)
    return spark.read.parquet(path).select(*[F.col(k).cast("bigint").alias(k) for k in K], "seq", "len_frames", "start_frame")


d.CTES["links"] = (
    "",
    f"""SELECT page_id, url, direct, host || CASE WHEN v <> '' THEN substr(v, 2) ELSE substr(whole, length(host) + 1) END AS link, CASE WHEN s = '' THEN 'video' ELSE s END AS stem FROM (
    SELECT *, lower(regexp_extract(whole, '^[^/]*//[^/?]*')) AS host, regexp_extract(whole, '[?&]v=[A-Za-z0-9_-]{{6,}}') AS v FROM (
    SELECT page_id, url, split_part(trim(url), '#', 1) AS whole, regexp_matches(lower(split_part(split_part(url, '?', 1), '#', 1)), '\\.(mp4|mov|mkv|mxf|avi|webm|m4v|mpg|mpeg)$') AS direct,
    regexp_replace(regexp_replace(regexp_replace(CASE WHEN k <> '' THEN k ELSE url END, '[<>:"/\\\\|?*\\x00-\\x1f]', '', 'g'), '\\s+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g') AS s FROM (
    SELECT *, regexp_extract(url, '(?:v=|/)([A-Za-z0-9_-]{{6,}})(?:[/?&]|$)', 1) AS k FROM pages) WHERE regexp_matches(lower(trim(url)), '^https?://')))""",
)


@query(
    "a13_url_intake",
    sql(
        "links",
        """SELECT page_id AS url_id, url, link, CASE WHEN n > 1 THEN stem || '-' || substr(md5(link), 1, 8) ELSE stem END AS stem, direct FROM (
        SELECT *, count(*) OVER (PARTITION BY lower(stem)) AS n FROM (SELECT * FROM links QUALIFY row_number() OVER (PARTITION BY link ORDER BY page_id) = 1))
        WHERE link NOT IN (SELECT link FROM links WHERE page_id % 10 = 0)""",
    ),
)
def a13(spark, sf):
    p = d.table(spark, sf, "pages").select(F.col("page_id").alias("url_id"), "url")
    have = X.url_intake(p.filter(F.col("url_id") % 10 == 0)).select("link", "stem")
    return X.url_intake(p, have)


@query(
    "a14_content_diff",
    """SELECT doc_id, md5(text) AS md5, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id + 1000000 END AS file_id, CASE doc_id % 3 WHEN 0 THEN 'create' WHEN 1 THEN 'update' ELSE 'reuse' END AS action FROM documents""",
)
def a14(spark, sf):
    docs = d.table(spark, sf, "documents")
    local = docs.select("doc_id", F.encode("text", "UTF-8").alias("content"))
    there = docs.filter(F.col("doc_id") % 3 != 0).select(
        "doc_id", F.md5(F.when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit(" "))).otherwise(F.col("text"))).alias("md5"), (F.col("doc_id") + 1000000).alias("file_id")
    )
    return X.content_diff(local, there, ["doc_id"])


@query(
    "g05_ordered_dedupe",
    sql(
        "edit",
        f"SELECT {KEY}, seq, array_to_string(list_sort(list_distinct([len_frames // 3, len_frames // 2, 2 * len_frames // 4, len_frames // 5])), ',') AS points FROM edit",
    ),
)
def g05(spark, sf):
    n = F.col("len_frames")
    pts = F.array(*[F.floor(x).cast("bigint") for x in (n / 3, n / 2, n * 2 / 4, n / 5)])
    e = d.edit(spark, sf)
    return e.select(*K, "seq", F.array_join(F.array_sort(F.array_distinct(pts)).cast("array<string>"), ",").alias("points"))
