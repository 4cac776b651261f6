"""What the operators of this subpackage share: text expressions, row keys, stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutledger.session import stored

#: White space of all contracts: the blank and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
KEY = "_row_key"

__all__ = ["KEY", "WHITE", "bare", "documents", "keyed", "packed", "stored", "text_of", "without", "words"]


def text_of(column: str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def bare(text: Column) -> Column:
    """The text without its white space."""
    return F.translate(text, WHITE, "")


def words(text: Column) -> Column:
    """The runs of other characters between white space, in order."""
    return F.array_remove(F.split(F.translate(text, WHITE[1:], " " * (len(WHITE) - 1)), " "), "")


def packed(docs: DataFrame) -> Column:
    """All columns of a caller's table as one struct `row`, so that no name of theirs can clash."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def keyed(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Add a key that names every row: the id itself, as long as it is never null and never repeats.

    Otherwise the rows are stored once with numbers of their own, so that the number of a row
    holds for every later reading. Which of the two holds is found from the id column alone.
    """
    unclear = docs.groupBy(F.col(id_col).alias("i")).agg(F.count("*").alias("n")).where("n > 1 OR i IS NULL")
    if unclear.limit(1).count() == 0:
        return docs.withColumn(KEY, F.col(id_col).cast("bigint"))
    return stored(docs.withColumn(KEY, F.monotonically_increasing_id()), "keyed")


def without(rows: DataFrame, dropped: DataFrame, few: int = 1_000_000) -> DataFrame:
    """`rows` whose KEY is not in `dropped` (KEY, distinct).

    Up to `few` keys travel to the rows, which then stay where they are; beyond that both are shuffled.
    """
    listed = stored(dropped.select(KEY), "dropped")
    return rows.join(F.broadcast(listed) if listed.count() <= few else listed, KEY, "left_anti")
