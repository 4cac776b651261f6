"""Connected components of a table of links, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutledger.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of `links` (a, b), by star contraction.

    Every round ties each node's larger neighbours to its smallest one, then its smaller ones; the
    links end as stars. Minima combine before the shuffle and no list of neighbours is ever
    gathered. A round is written and read, and so are its minima, since a join to a stored table
    is split where one node has many links.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    before = None
    while True:
        # Large star: each node's larger neighbours go to the smallest of its neighbours and itself.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        least = stored(least, "least")
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large, "large-stars")
        # Small star: each node and its smaller neighbours go to the smallest of them.
        small = stored(large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m"), "smallest")
        moved = large.join(small, F.col("a") == F.col("u")).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        edges = stored(moved, "small-stars")
        state = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("bigint")), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
