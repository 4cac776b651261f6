"""Shot-shaped tables that Spark derives from the given ones, and the same tables as SQL.

Every table is built from all rows of its source; the new cut and the master list divide the rows
by what they belong to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutledger.operators import ordered
from cutledger.operators import shots as S
from cutledger.session import materialize

K = ["show_id", "cut_id"]
ORDER_STEP = 16384


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long(x) -> F.Column:
    return (F.lit(x) if not isinstance(x, F.Column) else x).cast("bigint")


def cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    third = F.col("s_suppkey") % 3
    return s.select(
        F.col("s_suppkey").alias("show_id"),
        long(1).alias("cut_id"),
        F.when(third == 0, 24.0).when(third == 1, 25.0).otherwise(23.976).alias("fps"),
    )


def edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cut per show: sequence number, frame range, slate and take of every line item.

    Written once: what is derived from it reads it several times.
    """
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("show_id"),
        long(1).alias("cut_id"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_extendedprice",
        "l_quantity",
        F.col("l_quantity").cast("bigint").alias("len_frames"),
        "l_returnflag",
        "l_linestatus",
        "l_discount",
    )
    got = S.from_lengths(
        li,
        ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"],
        blocks=[F.floor(F.col("l_orderkey") / ORDER_STEP)],
    )
    slate, take = (F.col("l_partkey") % 60).alias("slate_n"), (1 + F.col("l_linenumber") % 3).cast("bigint").alias("take_n")
    parts = ["l_partkey", "len_frames", slate, take, "l_returnflag", "l_linestatus", "l_discount"]
    return stored(got.select(*K, *parts, "seq", "start_frame", "end_frame"))


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edit with rate, seconds, timecodes and tcid."""
    rows = ordered.salted_lookup(edit(spark, sf_dir), cuts(spark, sf_dir), K, ["seq"])
    return S.with_times(rows)


def _coded(rows: DataFrame) -> DataFrame:
    nth = ordered.ordinal(rows, ["show_id", "slate_n"], ["seq"], "_nth")
    code = F.format_string("SHW_%04d_%02d_%03d", "slate_n", "take_n", F.col("_nth") * 10)
    return nth.withColumn("code", code).drop("_nth")


def stored(df: DataFrame) -> DataFrame:
    """A derived table written once, as a library would hold it, for jobs that read it often."""
    return materialize(df)


def new_cut(spark: SparkSession, sf_dir: str, whole: DataFrame | None = None) -> DataFrame:
    """A shot belongs to the new cut by its return flag, and to the master list by its line status.

    ``whole``: the edit both are taken from, if it is there already.
    """
    rows = _coded((edit(spark, sf_dir) if whole is None else whole).filter(F.col("l_returnflag") != "N"))
    return rows.select(
        "show_id", F.lpad(F.col("seq").cast("string"), 8, "0").alias("tcid"), "code", F.col("seq").alias("input_pos"), "len_frames"
    )


def master(spark: SparkSession, sf_dir: str, whole: DataFrame | None = None) -> DataFrame:
    rows = _coded((edit(spark, sf_dir) if whole is None else whole).filter(F.col("l_linestatus") == "O"))
    return rows.select(
        "show_id",
        F.col("seq").alias("row"),
        "code",
        F.when(F.col("l_discount") > 0.095, F.lit("manual add")).otherwise(F.lit("")).alias("revision"),
        F.col("seq").alias("input_pos"),
        "len_frames",
    )


def slate_reads(spark: SparkSession, sf_dir: str, whole: DataFrame | None = None) -> DataFrame:
    """Three noisy slate reads of every shot; eleven kinds of noise rotate over shots and frames."""
    rows = (edit(spark, sf_dir) if whole is None else whole).select(
        *K,
        F.lpad(F.col("seq").cast("string"), 8, "0").alias("tcid"),
        "seq",
        (F.col("l_partkey") % 97 + 1).cast("string").alias("s"),
        F.col("slate_n").cast("string").alias("l"),
        F.element_at(F.array(*[F.lit(x) for x in ("I", "II", "III")]), F.col("take_n").cast("int")).alias("r"),
        F.posexplode(F.array(*[F.lit(p) for p in ("start", "mid", "end")])).alias("pi", "pos"),
    )
    s, l, r = F.col("s"), F.col("l"), F.col("r")
    k = (F.col("seq") + F.col("pi")) % 11
    raw = (
        F.when(k == 0, F.concat_ws("/", s, l, r))
        .when(k == 1, F.concat(s, F.lit("/"), F.lpad(l, 3, "0"), F.lit("/"), r, F.lit("*")))
        .when(k == 2, F.concat_ws("/", s, l, F.translate(r, "I", "l")))
        .when(k == 3, F.concat(s, F.lit("/"), l, F.lit("o/"), r))
        .when(k == 4, F.concat_ws("/", s, F.regexp_replace(l, "^(.)(.)$", "$1 $2"), r))
        .when(k == 5, F.concat(s, F.lit("pt2/"), l, F.lit("/"), r))
        .when(k == 6, F.concat(s, F.lit("+12pt1/+3/"), l, F.lit("/"), r))
        .when(k == 7, F.concat(F.lit("Snow-"), l))
        .when(k == 8, F.lit(""))
        .when(k == 9, F.concat(s, F.lit("/"), l, F.lit(" "), r, F.lit("/B-CAM")))
        .otherwise(F.concat(F.lit("stock "), s, F.lit("/"), l, F.lit("/"), r))
    )
    return rows.select(*K, "tcid", "pos", F.lit("slate").alias("field"), raw.alias("raw"), "seq")


def note_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three note reads of every document, whole text; presence varies by position."""
    d = table(spark, sf_dir, "documents").select(
        F.regexp_extract("source", r"(\d+)", 1).try_cast("bigint").alias("show_id"),
        long(1).alias("cut_id"),
        F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("tcid"),
        "text",
        (F.col("doc_id") % 5).alias("k"),
    )
    start = F.when(F.col("k").isin(1, 3), F.lit("")).otherwise(F.col("text"))
    mid = F.when(F.col("k").isin(2, 3), F.lit("")).when(F.col("k") == 4, F.concat("text", F.lit("!!"))).otherwise(F.col("text"))
    end = F.when(F.col("k") == 3, F.lit("")).otherwise(F.col("text"))
    each = F.array(*[F.struct(F.lit(p).alias("pos"), c.alias("raw")) for p, c in (("start", start), ("mid", mid), ("end", end))])
    return d.withColumn("_e", F.explode(each)).select(*K, "tcid", "_e.pos", F.lit("note").alias("field"), "_e.raw")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogue segments: a turn lasts a second per 15 characters."""
    c = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("show_id"), long(1).alias("cut_id"), F.col("turn").alias("idx"), "text", F.length("text").cast("bigint").alias("n")
    )
    got = ordered.running(c, K, ["idx"], {"before": F.col("n")})
    return got.select(
        *K, "idx", (F.col("before") / 15.0).alias("start"), ((F.col("before") + F.col("n")) / 15.0).alias("end"), "text"
    )


def talk_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shots of 96 frames at 24 fps that cover each conversation."""
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("show_id")).agg(
        F.sum(F.length("text").cast("bigint")).alias("n")
    )
    count = F.greatest(F.lit(1), F.ceil(F.col("n") / 15.0 * 24 / 96)).cast("bigint")
    rows = c.withColumn("seq", F.explode(F.sequence(long(1), count)))
    base = rows.select(
        "show_id", long(1).alias("cut_id"), "seq", (F.col("seq") * 96 - 95).alias("start_frame"), (F.col("seq") * 96).alias("end_frame"),
        long(96).alias("len_frames"), F.lit(24.0).alias("fps"),
    )
    return S.with_times(base)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-frame cut scores: one cut per user, frames in event order."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("show_id"), long(1).alias("cut_id"), "ts", "event_id", "value")
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01"))
    got = ordered.ordinal(e, K, ["ts", "event_id"], "frame_idx", blocks=[day])
    return got.select(*K, (F.col("frame_idx") - 1).alias("frame_idx"), (F.col("value") / 600.0).alias("score"))


def bit_word(rule: str) -> F.Column:
    """Hash word of an embedding: bit i is set where ``rule`` holds for x at index i."""
    return F.expr(
        f"aggregate(transform(embedding, (x, i) -> IF({rule}, shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)"
    )


RULES = {
    "h_start": "x > 0",
    "h_mid": "x > element_at(embedding, cast(1 + (i + 1) % size(embedding) as int))",
    "h_end": "x > element_at(embedding, cast(1 + (i + 7) % size(embedding) as int))",
}


def looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A picture per embedding: three hash words, colour, and a number for its kind."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("label").cast("bigint").alias("pair_id"),
        "vec_id",
        "embedding",
        *[bit_word(r).alias(n) for n, r in RULES.items()],
        F.floor(F.abs(F.element_at("embedding", 1).cast("double")) * 1000).cast("bigint").alias("kind"),
    )


def old_and_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two cuts per label: the old one as it is; the new one with shots retouched, replaced,
    retimed and moved by kind."""
    e = looks(spark, sf_dir)
    kind = F.col("kind") % 8
    length = (F.col("vec_id") % 90 + 10).alias("len_frames")
    tcid = F.lpad(F.col("vec_id").cast("string"), 8, "0").alias("tcid")
    common = [F.col("embedding").alias("color"), (F.element_at("embedding", 2) > 0.25).alias("dark")]
    old = ordered.ordinal(e, ["pair_id"], ["vec_id"], "_n").select(
        "pair_id", (F.col("_n") - 1).alias("pos"), tcid, length, "h_start", "h_mid", "h_end", *common
    )
    # Kind 1: 20 bits of the first word flip. Kind 2: another picture. Kind 3: retimed.
    # Kind 4: moved to the end of the cut.
    moved = e.withColumn("_at", F.col("vec_id") + F.when(kind == 4, F.lit(10**9)).otherwise(F.lit(0)))
    flip1 = F.col("h_start").bitwiseXOR(F.lit((1 << 20) - 1).cast("bigint"))
    other = {w: F.bitwise_not(F.col(w)) for w in ("h_start", "h_mid", "h_end")}
    new = ordered.ordinal(moved, ["pair_id"], ["_at"], "_n").select(
        "pair_id",
        (F.col("_n") - 1).alias("pos"),
        tcid,
        (F.col("vec_id") % 90 + 10 + F.when(kind == 3, 5).otherwise(0)).alias("len_frames"),
        F.when(kind == 1, flip1).when(kind == 2, other["h_start"]).otherwise(F.col("h_start")).alias("h_start"),
        *[F.when(kind == 2, other[w]).otherwise(F.col(w)).alias(w) for w in ("h_mid", "h_end")],
        F.when(kind.isin(1, 2), F.transform("embedding", lambda x: x + F.lit(0.5).cast("float")))
        .otherwise(F.col("embedding"))
        .alias("color"),
        (F.element_at("embedding", 2) > 0.25).alias("dark"),
    )
    return old, new


# --- the same tables as SQL ------------------------------------------------------------------


def smpte(frames: str, fps: str) -> str:
    n = f"CAST(round_even({fps}, 0) AS BIGINT)"
    t = f"(({frames}) // {n})"
    return f"printf('%02d:%02d:%02d:%02d', {t} // 3600, ({t} // 60) % 60, {t} % 60, ({frames}) % {n})"


def clock(sec: str) -> str:
    ms = f"CAST(floor({sec}) * 1000 + round_even(({sec} - floor({sec})) * 1000, 0) AS BIGINT)"
    return f"printf('%02d:%02d:%02d.%03d', {ms} // 3600000, ({ms} // 60000) % 60, ({ms} // 1000) % 60, {ms} % 1000)"


_ORDER = "PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity"
_CODE = "printf('SHW_%04d_%02d_%03d', slate_n, take_n, 10 * row_number() OVER (PARTITION BY show_id, slate_n ORDER BY seq))"

CTES: dict[str, tuple[str, str]] = {
    "cuts": (
        "",
        "SELECT s_suppkey AS show_id, CAST(1 AS BIGINT) AS cut_id, CAST(CASE s_suppkey % 3 WHEN 0 THEN 24 WHEN 1 THEN 25 ELSE 23.976 END AS DOUBLE) AS fps FROM supplier",
    ),
    "edit": (
        "",
        f"""SELECT *, start_frame + len_frames - 1 AS end_frame FROM (SELECT l_suppkey AS show_id, CAST(1 AS BIGINT) AS cut_id,
        row_number() OVER ({_ORDER}) AS seq, CAST(l_quantity AS BIGINT) AS len_frames,
        1 + coalesce(CAST(sum(CAST(l_quantity AS BIGINT)) OVER ({_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start_frame,
        l_partkey % 60 AS slate_n, CAST(1 + l_linenumber % 3 AS BIGINT) AS take_n, l_partkey, l_returnflag, l_linestatus, l_discount FROM lineitem)""",
    ),
    "shots": (
        "edit cuts",
        f"""SELECT *, replace(tc_in, ':', '') AS tcid, {clock('start_s')} AS start_tc, {clock('end_s')} AS end_tc FROM (
        SELECT edit.*, fps, (start_frame - 1) / fps AS start_s, end_frame / fps AS end_s, len_frames / fps AS duration_s,
        {smpte('start_frame - 1', 'fps')} AS tc_in FROM edit JOIN cuts USING (show_id, cut_id))""",
    ),
    "new_cut": (
        "edit",
        f"SELECT show_id, lpad(CAST(seq AS VARCHAR), 8, '0') AS tcid, {_CODE} AS code, seq AS input_pos, len_frames, slate_n, take_n FROM edit WHERE l_returnflag <> 'N'",
    ),
    "master": (
        "edit",
        f"SELECT show_id, seq AS row, {_CODE} AS code, CASE WHEN l_discount > 0.095 THEN 'manual add' ELSE '' END AS revision, seq AS input_pos, len_frames, slate_n, take_n FROM edit WHERE l_linestatus = 'O'",
    ),
    "exact": (
        "new_cut master",
        "SELECT n.show_id, n.tcid, m.row AS master_row, m.code AS master_code, 'EXACT-CODE' AS tier FROM new_cut n JOIN master m ON n.show_id = m.show_id AND n.code = m.code",
    ),
    "n2": ("exact", "SELECT n.* FROM new_cut n ANTI JOIN exact e ON n.show_id = e.show_id AND n.tcid = e.tcid"),
    "m2": ("exact", "SELECT m.* FROM master m ANTI JOIN exact e ON m.show_id = e.show_id AND m.row = e.master_row"),
    "ordinal": (
        "n2 m2",
        """SELECT n.show_id, n.tcid, m.row AS master_row, m.code AS master_code, 'ORDINAL' AS tier FROM
        (SELECT *, row_number() OVER (PARTITION BY show_id, slate_n, take_n ORDER BY input_pos) AS rn FROM n2 WHERE slate_n <> 0) n JOIN
        (SELECT *, row_number() OVER (PARTITION BY show_id, slate_n, take_n ORDER BY input_pos) AS rn FROM m2 WHERE slate_n <> 0) m USING (show_id, slate_n, take_n, rn)""",
    ),
    "n3": ("ordinal", "SELECT n.* FROM n2 n ANTI JOIN ordinal e ON n.show_id = e.show_id AND n.tcid = e.tcid"),
    "m3": ("ordinal", "SELECT m.* FROM m2 m ANTI JOIN ordinal e ON m.show_id = e.show_id AND m.row = e.master_row"),
    "slate_ordinal": (
        "n3 m3",
        """SELECT n.show_id, n.tcid, m.row AS master_row, m.code AS master_code, 'SLATE-ORDINAL' AS tier FROM
        (SELECT *, row_number() OVER (PARTITION BY show_id, slate_n ORDER BY input_pos) AS rn FROM n3 WHERE slate_n <> 0) n JOIN
        (SELECT *, row_number() OVER (PARTITION BY show_id, slate_n ORDER BY input_pos) AS rn FROM m3 WHERE slate_n <> 0) m USING (show_id, slate_n, rn)""",
    ),
    "coded": ("slate_ordinal", "SELECT * FROM exact UNION ALL SELECT * FROM ordinal UNION ALL SELECT * FROM slate_ordinal"),
    "n4": ("coded", "SELECT n.* FROM new_cut n ANTI JOIN coded e ON n.show_id = e.show_id AND n.tcid = e.tcid"),
    "m4": ("coded", "SELECT m.* FROM master m ANTI JOIN coded e ON m.show_id = e.show_id AND m.row = e.master_row"),
    # Each shot without a slate lists the rows left, best first; then one after the other takes the
    # first that none before it took.
    "pictures": ("", "SELECT vec_id, embedding AS v, sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) for x in embedding])) AS norm, count(*) OVER () AS n FROM embeddings"),
    "lists": (
        "n4 m4 pictures",
        """SELECT show_id, nth, any_value(tcid) AS tcid, list(row ORDER BY score DESC, row) AS rows FROM (
        SELECT a.show_id, a.nth, a.tcid, b.row, round(list_sum([CAST(a.v[i] AS DOUBLE) * CAST(b.v[i] AS DOUBLE) for i in range(1, 65)]) / (a.norm * b.norm), 12) AS score FROM
        (SELECT *, row_number() OVER (PARTITION BY show_id ORDER BY input_pos) AS nth FROM n4 JOIN pictures ON vec_id = (show_id * 37 + input_pos * 11) % n WHERE slate_n = 0) a
        JOIN (SELECT * FROM m4 JOIN pictures ON vec_id = (show_id * 37 + input_pos * 11) % n) b USING (show_id)) GROUP BY show_id, nth""",
    ),
    "visual": (
        "lists",
        """SELECT t.show_id, t.tcid, m.row AS master_row, m.code AS master_code, 'VISUAL' AS tier FROM (
        WITH RECURSIVE turns AS (SELECT DISTINCT show_id, CAST(0 AS BIGINT) AS nth, '' AS tcid, CAST([] AS BIGINT[]) AS used FROM lists UNION ALL
        SELECT l.show_id, l.nth, l.tcid, list_append(t.used, list_filter(l.rows, lambda x: NOT list_contains(t.used, x))[1]) FROM turns t JOIN lists l ON l.show_id = t.show_id AND l.nth = t.nth + 1)
        SELECT show_id, tcid, used[-1] AS row FROM turns WHERE nth > 0) t JOIN master m ON m.show_id = t.show_id AND m.row = t.row""",
    ),
    "matches": ("visual", "SELECT * FROM coded UNION ALL SELECT * FROM visual"),
    "n5": ("matches", "SELECT n.* FROM n4 n ANTI JOIN matches e ON n.show_id = e.show_id AND n.tcid = e.tcid"),
    "m5": ("matches", "SELECT m.* FROM m4 m ANTI JOIN matches e ON m.show_id = e.show_id AND m.row = e.master_row"),
    "leftovers": (
        "n5",
        "SELECT n.show_id, n.tcid, n.code, n.slate_n, CASE WHEN k.slate_n IS NULL THEN 'NEW' ELSE 'EXTRA' END AS tier FROM n5 n LEFT JOIN (SELECT DISTINCT show_id, slate_n FROM master) k ON k.show_id = n.show_id AND k.slate_n = n.slate_n",
    ),
    "omits": ("m5", "SELECT show_id, row FROM m5 WHERE revision = ''"),
    "reads": (
        "edit",
        """SELECT show_id, cut_id, lpad(CAST(seq AS VARCHAR), 8, '0') AS tcid, seq, pi, (seq + pi) % 11 AS k,
        CAST(l_partkey % 97 + 1 AS VARCHAR) AS s, slate_n, CASE take_n WHEN 1 THEN 'I' WHEN 2 THEN 'II' ELSE 'III' END AS r, take_n
        FROM edit CROSS JOIN (SELECT unnest([0, 1, 2]) AS pi)""",
    ),
    # What each kind of noise must read as, stated from the way it is made. A lone 1 with a letter
    # behind it reads as a take and so is no slate.
    "parsed": (
        "reads",
        """SELECT *, CASE WHEN k IN (7, 8, 10) OR (k = 3 AND slate_n = 1) THEN NULL WHEN k = 3 AND slate_n BETWEEN 1 AND 9 THEN CAST(slate_n * 10 AS VARCHAR) ELSE CAST(slate_n AS VARCHAR) END AS slate,
        CASE WHEN k IN (7, 8) THEN '' WHEN k = 10 THEN 'stock ' || s || '/' || slate_n || '/' || r WHEN k = 5 THEN s || 'pt2' WHEN k = 6 THEN s || '+12pt1/+3' ELSE s END AS scene,
        CASE WHEN k IN (7, 8, 10) THEN '' ELSE r END AS take, CASE pi WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END AS rank FROM reads""",
    ),
    "votes": (
        "parsed",
        """SELECT show_id, cut_id, tcid, any_value(seq) AS seq, CAST(count(slate) AS INTEGER) AS n_slate_frames,
        CASE WHEN count(slate) >= 2 THEN 'OK' WHEN count(slate) = 1 OR bool_or(k <> 8) THEN 'SUSPECT' ELSE 'BLANK' END AS tier FROM parsed GROUP BY show_id, cut_id, tcid""",
    ),
    "winners": (
        "votes",
        """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY show_id, cut_id, tcid ORDER BY cnt DESC, rank) AS rn FROM
        (SELECT *, count(*) OVER (PARTITION BY show_id, cut_id, tcid, scene, slate) AS cnt FROM parsed WHERE slate IS NOT NULL)) WHERE rn = 1""",
    ),
    "slates": (
        "winners",
        """SELECT v.show_id, v.cut_id, v.tcid, v.seq, coalesce(w.scene, '') AS scene, coalesce(w.slate, '') AS slate, coalesce(w.take, '') AS take_roman,
        CAST(CASE coalesce(w.take, '') WHEN 'I' THEN 1 WHEN 'II' THEN 2 WHEN 'III' THEN 3 ELSE 0 END AS INTEGER) AS take_int, v.tier, v.n_slate_frames
        FROM votes v LEFT JOIN winners w USING (show_id, cut_id, tcid)""",
    ),
    "official": (
        "slates",
        """SELECT *, CASE WHEN slate = '' THEN '' ELSE printf('SHW_%04d_%02d_%03d', CAST(slate AS BIGINT), take_int,
        10 * row_number() OVER (PARTITION BY show_id, cut_id, slate ORDER BY seq)) END AS official_code FROM slates""",
    ),
    "docs": (
        "",
        "SELECT CAST(regexp_extract(source, '(\\d+)', 1) AS BIGINT) AS show_id, CAST(1 AS BIGINT) AS cut_id, lpad(CAST(doc_id AS VARCHAR), 8, '0') AS tcid, text, doc_id, doc_id % 5 AS k, lang FROM documents",
    ),
    "segments": (
        "",
        """SELECT conv_id AS show_id, CAST(1 AS BIGINT) AS cut_id, turn AS idx, text, (b - n) / 15.0::DOUBLE AS start, b / 15.0::DOUBLE AS stop FROM
        (SELECT *, length(text) AS n, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS b FROM conversations)""",
    ),
    "talk": (
        "",
        f"""SELECT *, replace(tc_in, ':', '') AS tcid FROM (SELECT *, {smpte('start_frame - 1', '24.0::DOUBLE')} AS tc_in FROM (
        SELECT show_id, CAST(1 AS BIGINT) AS cut_id, seq, seq * 96 - 95 AS start_frame, seq * 96 AS end_frame FROM (
        SELECT conv_id AS show_id, unnest(range(1, 1 + greatest(1, CAST(ceil(sum(length(text)) / 15.0::DOUBLE * 24 / 96) AS BIGINT)))) AS seq FROM conversations GROUP BY conv_id)))""",
    ),
    "scores": (
        "",
        "SELECT user_id AS show_id, CAST(1 AS BIGINT) AS cut_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx, value / 600.0::DOUBLE AS score FROM events",
    ),
    "looks": (
        "",
        """SELECT CAST(label AS BIGINT) AS pair_id, vec_id, embedding, CAST(floor(abs(CAST(embedding[1] AS DOUBLE)) * 1000) AS BIGINT) AS kind,
        [(embedding[i + 1] > 0) for i in range(64)] AS h_start, [(embedding[i + 1] > embedding[1 + (i + 1) % 64]) for i in range(64)] AS h_mid,
        [(embedding[i + 1] > embedding[1 + (i + 7) % 64]) for i in range(64)] AS h_end, vec_id % 90 + 10 AS len_frames FROM embeddings""",
    ),
}


def sql(names: str, body: str) -> str:
    """``body`` behind the named tables and all they build on."""
    need: list[str] = []

    def add(n: str) -> None:
        for dep in CTES[n][0].split():
            add(dep)
        if n not in need:
            need.append(n)

    for n in names.split():
        add(n)
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in need) + " " + body
