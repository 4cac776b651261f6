"""Line dedup by built-in expressions only: hashed lines, documents per hash, kept lines by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutledger.llm.common import KEY, WHITE, keyed, packed, stored, text_of

#: Keys of fewer code points are never dropped; a key in so many documents is.
SHORTEST, LEAST = 10, 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def key_of(line: Column) -> Column:
    """The line without white space at its ends, A to Z lower-cased."""
    bare = F.btrim(line, F.lit(WHITE))
    # Where every character is one byte, lower() changes A to Z alone, and is quicker.
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _hashed(line: Column, shortest: int) -> Column:
    """Two independent hashes of the line's key, 128 bits in all; null where it is short."""
    key = key_of(line)
    return F.when(F.length(key) >= shortest, F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(11), key).alias("b")))


def repeated(docs: DataFrame, id_col: str, text_col: str, shortest: int, least: int) -> DataFrame:
    """KEY, drop (positions in order) for each row of `docs` (which carries KEY) that loses lines.

    A reading keeps the hashes of each document's lines. A document counts once for each hash; the
    first of its documents (smallest id, null last, then key) keeps its lines. Counts combine
    before the shuffle and are stored, so that a hash which many documents hold is split when it
    meets their lines. Lines that no other document holds end there.
    """
    lines = F.split(F.col("text"), "\n")
    rows = docs.select(KEY, F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"))
    hashed = stored(rows.select(KEY, "id", F.transform(lines, lambda x: _hashed(x, shortest)).alias("hashes")), "line-hashes")
    order = F.struct(F.col("id").isNull().alias("none"), "id", KEY)
    once = hashed.select(order.alias("doc"), F.explode(F.array_distinct(F.array_compact("hashes"))).alias("h"))
    counted = once.groupBy("h.a", "h.b").agg(F.count("*").alias("n"), F.min("doc").alias("first")).where(F.col("n") >= least)
    shared = stored(counted.select("a", "b", F.col(f"first.{KEY}").alias("first")), "shared-lines")
    placed = hashed.select(KEY, F.posexplode("hashes").alias("pos", "h")).where("h IS NOT NULL").select(KEY, "pos", "h.a", "h.b")
    dropped = placed.join(shared, ["a", "b"]).where(F.col(KEY) != F.col("first"))
    return dropped.groupBy(KEY).agg(F.sort_array(F.collect_list("pos")).alias("drop"))


def deduped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """`row` (all columns of `docs` as one struct), n_lines, n_dropped, kept (the text of the lines that stay).

    A line's key is the line without white space at its ends, A to Z lower-cased. Keys of at least
    `shortest` code points that at least `least` documents hold lose all their lines except in the
    first of these documents, where repeats stay. Every row of `docs` is a document of its own, also
    with a null or repeated id; the smallest id is first, null ids are last, then rows go by number.
    A null or empty text is one empty line, which stays. A table without rows gives none.

    Positions travel, not lines: a text meets the positions it loses by its key, once.
    """
    rows = keyed(docs.select(packed(docs), F.col(f"`{id_col}`").alias("id"), text_of(f"`{text_col}`").alias("text")), "id")
    drop = repeated(rows, "id", "text", shortest, least)
    split = rows.join(drop, KEY, "left").withColumn("lines", F.split("text", "\n"))
    stay = F.expr("transform(array_except(sequence(0, size(lines) - 1), drop), i -> lines[i])")
    return split.select(
        "row",
        F.size("lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(stay, "\n")).alias("kept"),
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """`docs` with the lines that stay as its texts; all other columns stay as they are."""
    got = deduped(docs, id_col, text_col, shortest, least)
    return got.select(*(F.col("kept").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))


def query(docs: DataFrame) -> DataFrame:
    got = deduped(docs.select("doc_id", "text"))
    return got.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


_TRIM = r"regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')"
SQL = rf"""
WITH l AS (SELECT doc_id, pos, ls[pos] AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS u(pos)),
k AS MATERIALIZED (SELECT doc_id, pos, line, translate({_TRIM}, '{_UPPER}', '{_LOWER}') AS key FROM l),
s AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= {SHORTEST} GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST}),
d AS (SELECT k.*, first IS NOT NULL AND first <> doc_id AS dropped FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
