"""Queries for the board of tiles, and for scrubbing cell tables."""

from pyspark.sql import functions as F

from cutledger.functions import grammar as g
from cutledger.operators import ordered, scrub, wall
from cutledger.plans import derive as d
from cutledger.plans.derive import sql
from cutledger.plans.registry import query

K = ["show_id", "cut_id"]
STATUS = ["VFX", "online ", "Omit", "Practical", "", "Other"]

# Board rows of the edit: status by slate, timecode missing on some shots, thumbnails inside
# formulas, raw or missing.
d.CTES["board"] = (
    "shots",
    """SELECT show_id, cut_id, seq, 'SHW_' || tcid AS code, CASE slate_n % 6 WHEN 0 THEN 'VFX' WHEN 1 THEN 'online ' WHEN 2 THEN 'Omit' WHEN 3 THEN 'Practical' WHEN 4 THEN '' ELSE 'Other' END AS status,
    CASE WHEN len_frames % 10 = 0 THEN '' ELSE tc_in END AS tc, CASE WHEN len_frames % 10 = 0 THEN NULL ELSE CAST(start_frame // 4 AS BIGINT) END AS pos, start_frame, len_frames, tc_in, 'label ' || seq AS label,
    CASE WHEN seq % 9 = 0 THEN '' WHEN seq % 2 = 0 THEN '=IMAGE("https://img.example/' || tcid || '.jpg")' ELSE 'http://img.example/' || tcid || '.jpg' END AS thumbnail, tcid FROM shots""",
)


def _board(spark, sf):
    s = d.shots(spark, sf)
    url = F.concat(F.lit("img.example/"), "tcid", F.lit(".jpg"))
    thumb = (
        F.when(F.col("seq") % 9 == 0, F.lit(""))
        .when(F.col("seq") % 2 == 0, F.concat(F.lit('=IMAGE("https://'), url, F.lit('")')))
        .otherwise(F.concat(F.lit("http://"), url))
    )
    status = F.element_at(F.array(*[F.lit(x) for x in STATUS]), (F.col("slate_n") % 6 + 1).cast("int"))
    return s.select(
        *K, "seq", F.concat(F.lit("SHW_"), "tcid").alias("code"), status.alias("status"),
        F.when(F.col("len_frames") % 10 == 0, F.lit("")).otherwise(F.col("tc_in")).alias("tc"),
        F.concat(F.lit("label "), F.col("seq").cast("string")).alias("label"), thumb.alias("thumbnail"), "len_frames", "tcid",
    )


@query("b03_status_filter", sql("board", "SELECT show_id, code, status FROM board WHERE upper(trim(status)) IN ('VFX', 'ONLINE') AND upper(trim(status)) NOT IN ('OMIT')"))
def b03(spark, sf):
    return wall.by_status(_board(spark, sf), only=["vfx", "Online"], exclude=["omit"]).select("show_id", "code", "status")


@query("b04_usable_tiles", sql("board", "SELECT show_id, code FROM board WHERE thumbnail <> ''"))
def b04(spark, sf):
    return wall.usable(_board(spark, sf)).select("show_id", "code")


@query(
    "b09_first_link",
    """SELECT page_id, regexp_extract(html, '(https?://[^\\s"'')]+)', 1) AS in_page, regexp_extract('=IMAGE("' || url || '")', '(https?://[^\\s"'')]+)', 1) AS in_formula FROM pages""",
)
def b09(spark, sf):
    p = d.table(spark, sf, "pages")
    formula = F.concat(F.lit('=IMAGE("'), "url", F.lit('")'))
    return p.select("page_id", g.first_url("html").alias("in_page"), g.first_url(formula).alias("in_formula"))


_COLOUR = "CASE upper(trim({0})) WHEN 'VFX' THEN '#D6E4FF' WHEN 'ONLINE' THEN '#00FF00' WHEN 'OMIT' THEN '#ECECEC' WHEN 'PRACTICAL' THEN '#ECECEC' ELSE '#E9E9E9' END"
_PLAIN = _COLOUR.replace("#00FF00", "#FFE0B2")


@query("b11_status_colours", sql("board", f"SELECT show_id, code, {_COLOUR.format('status')} AS colour FROM board"))
def b11(spark, sf):
    return _board(spark, sf).select("show_id", "code", wall.colour("status", {"online": "#00FF00"}).alias("colour"))


@query("d12_legend", sql("board", f"SELECT DISTINCT show_id, status, {_PLAIN.format('status')} AS colour FROM board WHERE status <> ''"))
def d12(spark, sf):
    return wall.legend(_board(spark, sf))


d.CTES["walled"] = (
    "board",
    """SELECT *, row_number() OVER (PARTITION BY show_id ORDER BY fr IS NULL, fr, code) - 1 AS ord FROM (
    SELECT *, CASE WHEN tc <> '' THEN ((CAST(substr(tc, 1, 2) AS BIGINT) * 60 + CAST(substr(tc, 4, 2) AS BIGINT)) * 60 + CAST(substr(tc, 7, 2) AS BIGINT)) * 24 + CAST(substr(tc, 10, 2) AS BIGINT) END AS fr FROM board)""",
)


@query(
    "e10_board_order",
    sql("walled", "SELECT show_id, code, ord AS \"order\", -1700 + (ord % 11) * 340 AS x, -400 + (ord // 11) * 310 AS y FROM walled"),
)
def e10(spark, sf):
    rows = wall.order(_board(spark, sf))
    x, y = wall.slot(F.col("order"))
    return rows.select("show_id", "code", "order", x.alias("x"), y.alias("y"))


@query(
    "f01_chronological_sort",
    sql("walled", "SELECT show_id, code, fr AS tc_frames, ord AS \"order\" FROM walled"),
)
def f01(spark, sf):
    """The order is a column; sorting the whole library once more would add nothing."""
    return wall.order(_board(spark, sf)).select("show_id", "code", "tc_frames", "order")


# Shows with an odd number have a board already, with the tiles of slates 0 to 29.
_STATE = """SELECT show_id, code, 'f' || code AS frame_id, 'i' || code AS image_id, CASE WHEN slate5 = 4 THEN '' ELSE 'g' || code END AS group_id, ord, CASE WHEN slate5 = 1 THEN 'old' ELSE label END AS title_now,
    CASE WHEN slate5 = 2 THEN 'Old' ELSE status END AS status FROM (SELECT *, len_frames % 5 AS slate5 FROM walled) WHERE show_id % 2 = 1 AND len_frames <= 25"""
d.CTES["state"] = ("walled", _STATE)


def _state(rows):
    k = F.col("len_frames") % 5
    return rows.filter((F.col("show_id") % 2 == 1) & (F.col("len_frames") <= 25)).select(
        "show_id", "code", F.concat(F.lit("f"), "code").alias("frame_id"), F.concat(F.lit("i"), "code").alias("image_id"),
        F.when(k == 4, F.lit("")).otherwise(F.concat(F.lit("g"), "code")).alias("group_id"), "order",
        F.when(k == 1, F.lit("old")).otherwise(F.col("label")).alias("title_now"), F.when(k == 2, F.lit("Old")).otherwise(F.col("status")).alias("status"),
    )


@query(
    "c23_push_plan",
    sql(
        "state",
        f"""SELECT show_id, code, ord AS "order", top IS NOT NULL AS staged, CASE WHEN top IS NULL THEN -1700 + (ord % 11) * 340 ELSE -1700 + (k % 11) * 340 END AS x,
        CASE WHEN top IS NULL THEN -400 + (ord // 11) * 310 ELSE -400 + (k // 11 + greatest(top, n) // 11 + 3) * 310 END AS y, {_PLAIN.format('status')} AS colour, label FROM (
        SELECT w.*, t.top, row_number() OVER (PARTITION BY w.show_id ORDER BY w.ord) - 1 AS k FROM (SELECT *, count(*) OVER (PARTITION BY show_id) AS n FROM walled) w
        LEFT JOIN (SELECT show_id, max(ord) AS top FROM state GROUP BY show_id) t USING (show_id) WHERE NOT EXISTS (SELECT 1 FROM state s WHERE s.show_id = w.show_id AND s.code = w.code))""",
    ),
)
def c23(spark, sf):
    rows = d.stored(wall.order(_board(spark, sf)))
    return wall.push_plan(rows, _state(rows))


@query(
    "c22_board_resync",
    sql(
        "state",
        f"""SELECT s.show_id, s.code, 'rename' AS action, w.label AS title, NULL AS colour FROM state s JOIN walled w USING (show_id, code) WHERE s.title_now <> w.label AND w.start_frame % 6 <> 0
        UNION ALL SELECT s.show_id, s.code, 'recolour', NULL, {_PLAIN.format('w.status')} FROM state s JOIN walled w USING (show_id, code) WHERE s.status <> w.status AND w.start_frame % 6 <> 0
        UNION ALL SELECT s.show_id, s.code, 'missing', NULL, NULL FROM state s JOIN walled w USING (show_id, code) WHERE w.start_frame % 6 = 0
        UNION ALL SELECT w.show_id, w.code, 'new', NULL, NULL FROM walled w ANTI JOIN state s USING (show_id, code) WHERE w.start_frame % 6 <> 0""",
    ),
)
def c22(spark, sf):
    """The sheet has lost the shots whose start frame is a multiple of six."""
    rows = wall.order(_board(spark, sf)).join(d.shots(spark, sf).select(*K, "seq", "start_frame"), [*K, "seq"])
    rows = d.stored(rows)
    return wall.resync(rows.filter(F.col("start_frame") % 6 != 0), _state(rows))


@query(
    "c24_group_check",
    sql(
        "state",
        "SELECT show_id, code, CASE WHEN group_id = '' THEN 'no-group' WHEN length(code) > 0 AND CAST(right(code, 2) AS INTEGER) % 2 = 0 THEN 'ok' ELSE 'bad' END AS verdict FROM state",
    ),
)
def c24(spark, sf):
    """Groups of tiles with an odd last frame have lost their image."""
    s = d.stored(_state(wall.order(_board(spark, sf))))
    odd = F.substring("code", -2, 2).cast("int") % 2 == 1
    frames = s.select("show_id", "group_id", F.col("frame_id").alias("item"))
    images = s.filter(~odd).select("show_id", "group_id", F.col("image_id").alias("item"))
    return wall.verify(s, frames.unionByName(images))


@query(
    "e13_contact_grid",
    sql(
        "edit",
        """SELECT show_id, cut_id, tcid, c * 7680 // cols AS x0, r * 4320 // rows_ AS y0, (c + 1) * 7680 // cols AS x1, (r + 1) * 4320 // rows_ AS y1, cols, rows_ AS rows FROM (
        SELECT *, i % cols AS c, i // cols AS r, (n + cols - 1) // cols AS rows_ FROM (
        SELECT *, greatest(1, CAST(round_even(sqrt((7680.0::DOUBLE / 4320) * n / (16.0::DOUBLE / 9)), 0) AS BIGINT)) AS cols FROM (
        SELECT show_id, cut_id, lpad(CAST(seq AS VARCHAR), 8, '0') AS tcid, seq - 1 AS i, count(*) OVER (PARTITION BY show_id, cut_id) AS n FROM edit)))""",
    ),
)
def e13(spark, sf):
    e = d.edit(spark, sf).withColumn("tcid", F.lpad(F.col("seq").cast("string"), 8, "0"))
    return wall.grid(e)


# --- cells -----------------------------------------------------------------------------------

d.CTES["cells"] = (
    "",
    """SELECT 'T' || p_size % 5 AS tab, row, col, value FROM (SELECT p_size, row_number() OVER (PARTITION BY p_size % 5 ORDER BY p_partkey) AS row, p_name, p_brand, p_type, CAST(floor(p_retailprice) AS BIGINT) AS price FROM part),
    LATERAL (SELECT unnest(['A', 'B', 'C', 'E']) AS col, unnest([p_name, CASE WHEN row % 3 = 0 THEN '' ELSE upper(substr(p_brand, 1, 5)) || '_' || row END, p_type, CASE WHEN row % 2 = 0 THEN CAST(price AS VARCHAR) ELSE '=A1' END]) AS value)""",
)


def _cells(spark, sf):
    p = d.table(spark, sf, "part").withColumn("tab", F.concat(F.lit("T"), (F.col("p_size") % 5).cast("string")))
    p = ordered.ordinal(p, ["tab"], ["p_partkey"], "row")
    code = F.when(F.col("row") % 3 == 0, F.lit("")).otherwise(F.concat(F.upper(F.substring("p_brand", 1, 5)), F.lit("_"), F.col("row").cast("string")))
    price = F.when(F.col("row") % 2 == 0, F.col("p_retailprice").cast("bigint").cast("string")).otherwise(F.lit("=A1"))
    cells = F.array(*[F.struct(F.lit(c).alias("col"), v.alias("value")) for c, v in (("A", F.col("p_name")), ("B", code), ("C", F.col("p_type")), ("E", price))])
    return p.select("tab", "row", F.explode(cells).alias("c")).select("tab", "row", "c.col", "c.value")


@query(
    "d10_code_prefix",
    sql(
        "cells",
        """SELECT tab, max_by(prefix, (n, -first_row)) AS prefix, max(n) AS n FROM (SELECT tab, upper(regexp_extract(trim(value), '^([A-Za-z]{2,6})[_-]', 1)) AS prefix, count(*) AS n, min(row) AS first_row FROM cells WHERE col = 'B' GROUP BY tab, prefix) WHERE prefix <> '' GROUP BY tab""",
    ),
)
def d10(spark, sf):
    return scrub.detect_prefix(_cells(spark, sf), "B")


@query(
    "d15_header_row",
    sql(
        "cells",
        "SELECT tab, max_by(row, (n, -row)) AS header_row FROM (SELECT tab, row, count(*) AS n FROM cells WHERE trim(value) <> '' GROUP BY tab, row) GROUP BY tab",
    ),
)
def d15(spark, sf):
    return scrub.header_row(_cells(spark, sf))


_TERMS = [("ring", "prop"), ("red prop", "hero prop"), ("ECONOMY", "GRADE-1")]
d.CTES["scrubbed"] = (
    "cells",
    """SELECT *, CASE WHEN tab = 'T1' AND col = 'E' AND c NOT LIKE '=%' AND TRY_CAST(replace(c, ',', '') AS DOUBLE) IS NOT NULL THEN
    CAST(TRY_CAST(replace(c, ',', '') AS DOUBLE) * 2 AS VARCHAR) ELSE c END AS e FROM (
    SELECT *, replace(replace(replace(b, 'ring', 'prop'), 'red prop', 'hero prop'), 'ECONOMY', 'GRADE-1') AS c FROM (
    SELECT *, CASE WHEN row <= 2 THEN replace(a, 'BRAND', 'SHW') ELSE a END AS b FROM (
    SELECT *, CASE trim(value) WHEN 'PROMO' THEN 'Vendor 1' WHEN 'STANDARD' THEN 'Vendor 2' ELSE value END AS a FROM cells)))""",
)
_CHANGED = """SELECT tab, row, col, value AS old, e AS new, CASE WHEN value <> a THEN 'vendor_name' WHEN a <> b THEN 'shot_code_prefix' WHEN b <> c THEN 'term_swap' ELSE 'rate' END AS category FROM scrubbed WHERE value <> e"""


def _scrubbed(spark, sf):
    names = spark.createDataFrame([(1, "PROMO"), (2, " STANDARD"), (3, ""), (4, "Vendor 4")], "slot int, name string")
    return scrub.apply(_cells(spark, sf), _TERMS, scrub.vendor_names(names), "BRAND", "SHW", 2, ("T1", "E"), 2.0)


@query("i10_scrub_changes", sql("scrubbed", _CHANGED))
def i10(spark, sf):
    return _scrubbed(spark, sf)[1]


@query("d01_category_tally", sql("scrubbed", f"SELECT category, count(*) AS n FROM ({_CHANGED}) GROUP BY category"))
def d01c(spark, sf):
    return _scrubbed(spark, sf)[1].groupBy("category").agg(F.count("*").alias("n"))


@query(
    "i11_clear_cells",
    sql(
        "cells",
        """SELECT tab, row, col, value FROM cells c WHERE NOT (tab = 'T0' AND row >= 3) AND NOT (tab = 'T2' AND row > (SELECT max_by(row, (n, -row)) FROM (
        SELECT row, count(*) AS n FROM cells WHERE tab = 'T2' AND row <= 8 AND trim(value) <> '' GROUP BY row))) AND NOT (tab = 'T1' AND row = 1 AND col = 'A')""",
    ),
)
def i11(spark, sf):
    cells = _cells(spark, sf)
    rules = spark.createDataFrame([("T0", 3)], "tab string, first_row bigint")
    titles = spark.createDataFrame([("T1", 1, "A")], "tab string, row bigint, col string")
    return scrub.clear(cells, rules, titles, ["T2"])


# A walk keeps the number of the column, the sum of its vectors and their count.
_WALK = """WITH RECURSIVE walk AS (SELECT show_id, code, place, CAST(0 AS BIGINT) AS col, CAST(v AS DOUBLE[]) AS s, 1 AS n FROM rows WHERE place = 0 UNION ALL
    SELECT show_id, code, place, CASE WHEN keep THEN col ELSE col + 1 END, CASE WHEN keep THEN [s[i] + v[i] for i in range(1, 65)] ELSE CAST(v AS DOUBLE[]) END, CASE WHEN keep THEN n + 1 ELSE 1 END FROM (
    SELECT r.show_id, r.code, r.place, r.v, w.col, w.s, w.n, list_sum([w.s[i] * r.v[i] for i in range(1, 65)]) / (sqrt(list_sum([x * x for x in w.s])) * sqrt(list_sum([CAST(x AS DOUBLE) * x for x in r.v]))) >= 0.3 AS keep
    FROM walk w JOIN rows r ON r.show_id = w.show_id AND r.place = w.place + 1))
    SELECT show_id, CAST(1 AS BIGINT) AS cut_id, code, place AS "order", col AS "column" FROM walk"""
d.CTES["walked"] = ("", _WALK.replace("WITH RECURSIVE", "WITH RECURSIVE rows AS (SELECT CAST(label AS BIGINT) AS show_id, CAST(vec_id AS VARCHAR) AS code, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS place, embedding AS v FROM embeddings),", 1))
d.CTES["walked_vfx"] = ("", d.CTES["walked"][1].replace("FROM embeddings", "FROM embeddings WHERE NOT coalesce(embedding[3] > 0.2, FALSE)", 1))


@query("e11_similarity_walk", sql("walked", "SELECT * FROM walked"))
def e11(spark, sf):
    """Columns of each label's pictures in order of their ids."""
    e = d.table(spark, sf, "embeddings").select(
        F.col("label").cast("bigint").alias("show_id"), F.lit(1).cast("bigint").alias("cut_id"), F.col("vec_id").cast("string").alias("code"), "vec_id", F.col("embedding").alias("vec")
    )
    e = ordered.ordinal(e, K, ["vec_id"], "order").withColumn("order", F.col("order") - 1)
    return wall.walk(e.drop("vec_id"), 0.3)


@query(
    "j05_similarity_columns",
    sql(
        "walked_vfx",
        """SELECT * FROM walked_vfx UNION ALL SELECT show_id, 1, code, place, coalesce(last + 1, 0) FROM (
        SELECT CAST(label AS BIGINT) AS show_id, CAST(vec_id AS VARCHAR) AS code, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS place FROM embeddings WHERE embedding[3] > 0.2)
        LEFT JOIN (SELECT show_id, max("column") AS last FROM walked_vfx GROUP BY show_id) USING (show_id)""",
    ),
)
def j05(spark, sf):
    e = d.table(spark, sf, "embeddings").select(
        F.col("label").cast("bigint").alias("show_id"), F.lit(1).cast("bigint").alias("cut_id"), F.col("vec_id").cast("string").alias("code"), F.col("vec_id").alias("seq"),
        F.when(F.element_at("embedding", 3) > 0.2, F.lit("Online")).otherwise(F.lit("VFX")).alias("status"), F.col("embedding").alias("vec"),
    )
    e = d.stored(e)
    return wall.columns(e.drop("vec"), e, threshold=0.3)
