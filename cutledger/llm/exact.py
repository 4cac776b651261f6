"""Exact dedup by progressive refinement: length, then a hash of the head, then a hash of the whole text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutledger.llm.common import KEY, bare, keyed, packed, stored, text_of, without

#: Bits of one row of the filter, as the bitmap functions have them, and its most rows: 16 MB in all.
CHUNK, CHUNKS = 32768, 4096


def survivors(rows: DataFrame, wanted: DataFrame, chunks: int = CHUNKS) -> DataFrame:
    """The rows of `rows` whose KEY is in `wanted`, and few others, found without moving a row or opening a text.

    The keys are folded into a bitmap of at most `chunks` rows, about sixteen bits a key, which
    travels to the rows. So another row is let through by chance alone, the more often the more
    the bitmap is filled; no row of `wanted` is held back.
    """
    n = wanted.count()
    size = min(chunks, max(1, -(-16 * n // CHUNK)))
    bit = F.pmod(F.xxhash64(KEY), F.lit(size * CHUNK))
    at = wanted.select(bit.alias("bit")).select(F.expr(f"bit div {CHUNK}").alias("chunk"), (F.col("bit") % CHUNK).alias("bit"))
    bitmap = stored(at.groupBy("chunk").agg(F.bitmap_construct_agg("bit").alias("bits")), "survivors")
    tried = rows.withColumn("_bit", bit).withColumn("chunk", F.expr(f"_bit div {CHUNK}")).join(F.broadcast(bitmap), "chunk")
    byte = F.conv(F.hex(F.substring("bits", (F.expr(f"_bit % {CHUNK} div 8") + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
    return tried.where(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1).select(*rows.columns)


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = 128) -> DataFrame:
    """One row per row of `docs` (which carries KEY): KEY, keep_id, group_size, kept.

    Texts are equal when they are identical without white space; a null text is an empty one, and
    empty texts are copies of each other. Of equal texts the one with the most code points before
    white space went stays, then the smallest id (a null id comes last), then the smallest key.

    A first reading keeps numbers only: each row's length without white space and a hash of its
    first `head` characters. Lengths that occur once leave; of the rest, pairs of length and head
    that occur once leave. A second reading hashes the whole texts of the rows left, which a
    bitmap of their keys picks out at every size of the table, so texts never move. What is looked
    up is stored first, so that a length or text which many rows share is split where they meet it.
    """
    rows = docs.select(KEY, F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"))
    measured = rows.withColumn("b", bare(F.col("text"))).withColumns(
        {"n": F.length("b"), "h": F.xxhash64(F.substring("b", 1, head)), "chars": F.length("text").cast("bigint")}
    )
    light = stored(measured.select(KEY, "id", "n", "h", "chars"), "lengths")
    lengths = stored(light.groupBy("n").agg(F.count("*").alias("c")).where("c > 1").select("n"), "common-lengths")
    heads = stored(light.join(lengths, "n", "left_semi").groupBy("n", "h").agg(F.count("*").alias("c")).where("c > 1").select("n", "h"), "heads")
    wanted = stored(light.join(heads, ["n", "h"], "left_semi").select(KEY), "wanted")
    left = survivors(rows, wanted)
    whole = stored(left.select(KEY, "id", F.length("text").cast("bigint").alias("chars"), F.sha2(bare(F.col("text")), 256).alias("sha")), "hashed")
    best = F.min(F.struct((-F.col("chars")).alias("c"), F.col("id").isNull().alias("none"), F.col("id").alias("keep_id"), F.col(KEY).alias("keep_key")))
    groups = stored(whole.groupBy("sha").agg(F.count("*").alias("group_size"), best.alias("best")).where("group_size > 1"), "copies")
    copies = whole.join(groups, "sha").select(KEY, "group_size", "best.keep_id", "best.keep_key")
    return light.select(KEY, "id").join(copies, KEY, "left").select(
        KEY,
        F.when(F.col("keep_key").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        F.coalesce(F.col("keep_key") == F.col(KEY), F.lit(True)).alias("kept"),
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the copies; all columns stay as they are, whatever their names."""
    rows = keyed(docs.select(packed(docs), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "id")
    dropped = decide(rows, "id").where(~F.col("kept"))
    return without(rows, dropped).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def query(docs: DataFrame) -> DataFrame:
    """One row per document with the digest of its text without white space."""
    rows = keyed(docs.select("doc_id", "text"))
    digests = rows.select(KEY, F.col("doc_id").cast("bigint").alias("doc_id"), F.sha2(bare(text_of("text")), 256).alias("text_sha256"))
    return digests.join(decide(rows), KEY).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""
