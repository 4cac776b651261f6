"""Queries over dialogue: overlap with shots, chunks, names, prompts, replies."""

from pyspark.sql import functions as F

from cutledger.functions import grammar as g
from cutledger.operators import dialogue as D
from cutledger.plans import derive as d
from cutledger.plans.derive import sql
from cutledger.plans.registry import query

K = ["show_id", "cut_id"]
KEY = "show_id, cut_id"

d.CTES["heard"] = (
    "talk segments",
    """SELECT t.show_id, t.cut_id, t.tcid, t.seq, (t.start_frame - 1) / 24.0::DOUBLE AS s0, t.end_frame / 24.0::DOUBLE AS s1,
    trim(coalesce(string_agg(s.text, ' ' ORDER BY s.idx), '')) AS dialogue FROM talk t LEFT JOIN segments s ON s.show_id = t.show_id AND s.start < t.end_frame / 24.0::DOUBLE
    AND s.stop > (t.start_frame - 1) / 24.0::DOUBLE GROUP BY t.show_id, t.cut_id, t.tcid, t.seq, t.start_frame, t.end_frame""",
)


def _heard(spark, sf):
    return D.to_shots(d.segments(spark, sf), d.talk_shots(spark, sf))


@query(
    "c13_dialogue_on_shots",
    sql("heard", f"SELECT {KEY}, tcid, 'SHW_' || tcid AS shot_code, round(s0, 6) AS start, round(s1, 6) AS \"end\", md5(dialogue) AS dialogue_md5 FROM heard"),
)
def c13(spark, sf):
    return _heard(spark, sf).select(
        *K, "tcid", "shot_code", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), F.md5("dialogue").alias("dialogue_md5")
    )


@query(
    "d14_ordered_text",
    "SELECT conv_id, md5(string_agg(text, ' ' ORDER BY turn)) AS whole_md5, count(*) AS turns FROM conversations GROUP BY conv_id",
)
def d14(spark, sf):
    c = d.table(spark, sf, "conversations")
    return c.groupBy("conv_id").agg(F.md5(D.ordered_text("turn", "text")).alias("whole_md5"), F.count("*").alias("turns"))


d.CTES["chunked"] = (
    "edit",
    """SELECT show_id, cut_id, seq, c AS chunk, r - c * 22 AS place, c > 0 AND r - c * 22 < 3 AS is_context, slate_n FROM (
    SELECT *, unnest(range(greatest(0, CASE WHEN r >= 25 THEN (r - 25) // 22 + 1 ELSE 0 END), 1 + least(r // 22, greatest(0, CAST(ceil((n - 25) / 22) AS BIGINT))))) AS c FROM (
    SELECT *, seq - 1 AS r, count(*) OVER (PARTITION BY show_id, cut_id) AS n FROM edit))""",
)


def _edit(spark, sf):
    return d.edit(spark, sf).withColumn("tcid", F.lpad(F.col("seq").cast("string"), 8, "0")).select(*K, "tcid", "seq", "slate_n")


@query("e08_overlapping_chunks", sql("chunked", f"SELECT {KEY}, seq, chunk, place, is_context FROM chunked"))
def e08(spark, sf):
    return D.chunks(_edit(spark, sf)).select(*K, "seq", "chunk", "place", "is_context")


@query(
    "g04_chunks_with_work",
    sql(
        "chunked",
        f"SELECT {KEY}, seq, chunk FROM chunked SEMI JOIN (SELECT DISTINCT show_id, chunk FROM chunked WHERE slate_n = 9) USING (show_id, chunk)",
    ),
)
def g04(spark, sf):
    rows = d.stored(_edit(spark, sf))
    return D.chunks_with_work(D.chunks(rows), rows.filter(F.col("slate_n") == 9)).select(*K, "seq", "chunk")


_VOC = r"(?:^|[,\.\!\?]\s*)((?:Mrs?\.|Ms\.|Dr\.)?\s*[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\s*[,\.\!\?]"
_STOP = "'The', 'A', 'An', 'It', 'This', 'That', 'He', 'She', 'They', 'We', 'You', 'I'"
_FOUND = f"regexp_replace(unnest(regexp_extract_all(text, '{_VOC}', 1)), '^\\s+|\\s+$', '', 'g')"
_FIRST = "rtrim(regexp_extract(name, '^\\S+', 0), '.')"


@query(
    "h15_addressed_names",
    f"""SELECT conv_id, turn, name FROM (SELECT DISTINCT conv_id, turn, {_FOUND} AS name FROM conversations) WHERE length(name) >= 2 AND {_FIRST} NOT IN ({_STOP})""",
)
def h15(spark, sf):
    c = d.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.explode(g.addressed_names("text")).alias("name"))


# Chunks of eight turns with an overlap of two, names heard so far.
d.CTES["turns"] = (
    "",
    """SELECT conv_id, turn, text, unnest(range(greatest(0, CASE WHEN r >= 2 THEN (r - 2) // 1 + 1 ELSE 0 END), 1 + least(r // 1, greatest(0, n - 2)))) AS chunk FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)""",
)


def _turns(spark, sf):
    return d.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("show_id"), F.lit(1).cast("bigint").alias("cut_id"), F.lpad(F.col("turn").cast("string"), 8, "0").alias("tcid"),
        F.col("turn").alias("seq"), F.col("text").alias("dialogue"),
    )


@query(
    "e09_names_so_far",
    sql(
        "turns",
        f"""SELECT c.show_id, c.chunk, coalesce(string_agg(f.name, '|' ORDER BY f.name), '') AS names FROM (SELECT DISTINCT conv_id AS show_id, chunk FROM turns) c LEFT JOIN (
        SELECT conv_id AS show_id, name, min(chunk) AS chunk FROM (SELECT conv_id, chunk, {_FOUND} AS name FROM turns) WHERE length(name) >= 2 AND {_FIRST} NOT IN ({_STOP}) GROUP BY conv_id, name) f
        ON f.show_id = c.show_id AND f.chunk <= c.chunk GROUP BY c.show_id, c.chunk""",
    ),
)
def e09(spark, sf):
    t = d.stored(_turns(spark, sf))
    names = D.known_names(D.chunks(t.drop("dialogue"), 2, 1), t)
    return names.select("show_id", "chunk", F.array_join("names", "|").alias("names"))


@query(
    "h18_transcript_lines",
    sql("segments", f"SELECT {KEY}, idx, md5('[' || {d.clock('start')} || ' --> ' || {d.clock('stop')} || '] ' || text) AS line_md5 FROM segments"),
)
def h18(spark, sf):
    return D.transcript(d.segments(spark, sf)).select(*K, "idx", F.md5("line").alias("line_md5"))


def _captioned(spark, sf):
    t = _turns(spark, sf)
    base = D.chunks(t.drop("dialogue"), 4, 1).join(t.select(*K, "tcid", "dialogue"), [*K, "tcid"])
    return base.withColumns(
        {"shot_code": F.concat(F.lit("SHW_"), "tcid"), "visual_caption": F.concat(F.lit("turn "), F.col("seq").cast("string"))}
    )


# Chunks of four turns, each beginning with the last of the one before.
d.CTES["turns4"] = (
    "",
    """SELECT conv_id, turn, text, unnest(range(CASE WHEN r >= 4 THEN (r - 4) // 3 + 1 ELSE 0 END, 1 + least(r // 3, greatest(0, CAST(ceil((n - 4) / 3.0) AS BIGINT))))) AS chunk FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)""",
)
_QUOTED = lambda x: "'" + x.replace("'", "''") + "'"


@query(
    "h17_prompts",
    sql(
        "turns4",
        f"""SELECT show_id, CAST(1 AS BIGINT) AS cut_id, chunk, CAST(length(p) AS INTEGER) AS n_chars, md5(p) AS prompt_md5 FROM (
        SELECT b.show_id, b.chunk, {_QUOTED(D.STORY_RULES)} || chr(10) || CASE WHEN n.names IS NULL THEN '' ELSE 'Names heard so far: ' || n.names || chr(10) END || 'Story so far: (start of the film)' || chr(10) || 'Shots:' || chr(10) || b.body || chr(10) || {_QUOTED(D.STORY_FORMAT)} AS p FROM
        (SELECT conv_id AS show_id, chunk, string_agg('- SHW_' || lpad(CAST(turn AS VARCHAR), 8, '0') || ': turn ' || turn || CASE WHEN coalesce(text, '') <> '' THEN ' | dialogue: "' || text || '"' ELSE '' END, chr(10) ORDER BY turn) AS body FROM turns4 GROUP BY conv_id, chunk) b
        LEFT JOIN (SELECT c.show_id, c.chunk, string_agg(f.name, ', ' ORDER BY f.name) AS names FROM (SELECT DISTINCT conv_id AS show_id, chunk FROM turns4) c JOIN (
        SELECT conv_id AS show_id, name, min(chunk) AS chunk FROM (SELECT conv_id, chunk, {_FOUND} AS name FROM turns4) WHERE length(name) >= 2 AND {_FIRST} NOT IN ({_STOP}) GROUP BY conv_id, name) f
        ON f.show_id = c.show_id AND f.chunk <= c.chunk GROUP BY c.show_id, c.chunk) n USING (show_id, chunk))""",
    ),
)
def h17(spark, sf):
    rows = d.stored(_captioned(spark, sf))
    t = d.stored(_turns(spark, sf))
    got = D.prompts(rows, D.known_names(rows, t))
    return got.select(*K, "chunk", F.length("prompt").alias("n_chars"), F.md5("prompt").alias("prompt_md5"))


_REPLY = """SELECT conv_id, turn, 'STORY_STATE: turn ' || turn || chr(10) || 'REVISED:' || chr(10) || '- SHW_A: ' || length(text) || chr(10) || 'SHW_B:  ' || role || ' : x'
    || chr(10) || 'SHW_C: unknown' || chr(10) || 'SHW_A: again ' || length(text) AS reply FROM conversations"""


def _replies(spark, sf):
    t = d.table(spark, sf, "conversations")
    n, turn = F.length("text").cast("string"), F.col("turn").cast("string")
    reply = F.concat(
        F.lit("STORY_STATE: turn "), turn, F.lit("\nREVISED:\n- SHW_A: "), n, F.lit("\nSHW_B:  "), F.col("role"), F.lit(" : x\nSHW_C: unknown\nSHW_A: again "), n
    )
    base = t.select(F.col("conv_id").alias("show_id"), F.lit(1).cast("bigint").alias("cut_id"), F.col("turn").alias("chunk"), reply.alias("reply"))
    codes = base.select(*K, "chunk", F.explode(F.array(F.lit("SHW_A"), F.lit("SHW_B"))).alias("shot_code"))
    return D.parse_replies(base, codes)


@query(
    "h16_reply_lines",
    """SELECT conv_id AS show_id, turn AS chunk, 'SHW_A' AS shot_code, 'again ' || length(text) AS revised FROM conversations
    UNION ALL SELECT conv_id, turn, 'SHW_B', role || ' : x' FROM conversations""",
)
def h16(spark, sf):
    return _replies(spark, sf)[1].select("show_id", "chunk", "shot_code", "revised")


@query("h16_story_states", "SELECT conv_id AS show_id, turn AS chunk, 'turn ' || turn AS story_state FROM conversations")
def h16s(spark, sf):
    return _replies(spark, sf)[0].select("show_id", "chunk", "story_state")


def _stub(batches):
    """A model of the caller: the revised line is the caption in capitals."""
    for pdf in batches:
        yield pdf[[*K, "chunk", "shot_code"]].assign(revised=pdf["visual_caption"].str.upper() + " " + pdf["chunk"].astype(str))


@query(
    "j08_batch_inference",
    """SELECT conv_id AS show_id, lpad(CAST(turn AS VARCHAR), 8, '0') AS tcid, 'TURN ' || turn || ' ' || least(r // 3, greatest(0, CAST(ceil((n - 4) / 3) AS BIGINT))) AS revised_description FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)""",
)
def j08(spark, sf):
    rows = d.stored(_captioned(spark, sf))
    out = "show_id bigint, cut_id bigint, chunk bigint, shot_code string, revised string"
    revised = D.infer(rows, _stub, out, [*K, "tcid"])
    return D.latest_revision(rows, revised).select("show_id", "tcid", "revised_description")


@query(
    "a12_pending_work",
    sql("edit", f"SELECT {KEY}, seq FROM edit WHERE slate_n % 2 <> 0 OR len_frames % 4 = 0"),
)
def a12(spark, sf):
    """Shots with an even slate are done, but every fourth output of those is blank."""
    from cutledger.sources.artifacts import pending

    rows = d.edit(spark, sf).select(*K, "seq", "slate_n", "len_frames")
    blank = F.when(F.col("len_frames") % 4 == 0, F.lit("  ")).otherwise(F.lit("done"))
    done = rows.filter(F.col("slate_n") % 2 == 0).select(*K, "seq", blank.alias("caption"))
    return pending(rows, done, [*K, "seq"], output="caption").select(*K, "seq")
