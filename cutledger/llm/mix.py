"""Mixing sources to target weights by Sainte-Laguë apportionment, by built-in expressions only.

Sizes are words. Targets share the size of the corpus by weight, none above `most` times its
source. Equal blocks of words are then dealt to sources by highest quotients, a source's blocks
to its shards in the same way, and each shard takes its quota as a run of blocks of its texts in
seeded order, going round as often as needed. Cutting at blocks, a text may be taken in part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutledger.llm.common import KEY, keyed, packed, stored, text_of, words

WEIGHTS = 3
MOST = 3
SEED = "mix"
SHARD_ROWS = 50_000
LARGEST_BLOCK = 1024


def _number(digest: Column) -> Column:
    """A digest's first 60 bits."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def _recipe(sizes: DataFrame) -> DataFrame:
    """One row per source: source, source_size, n_rows, target, block (words), blocks in all."""
    every = Window.partitionBy()
    cap = MOST * F.col("source_size")
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    rows = rows.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % WEIGHTS + 1)
    # Filling up: in order of cap over weight, the level is what is left over the weights left;
    # it is highest where the first source stays below its cap.
    w = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    level = (F.sum("source_size").over(every) - F.sum(cap).over(w.rowsBetween(Window.unboundedPreceding, 0)) + cap) / F.sum("weight").over(
        w.rowsBetween(0, Window.unboundedFollowing)
    )
    rows = rows.withColumn("level", level)
    rows = rows.withColumn("target", F.least(cap.cast("double"), F.max("level").over(every) * F.col("weight")))
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(every)
    block = F.greatest(F.lit(1), F.least(F.lit(LARGEST_BLOCK), F.floor(F.coalesce(least, F.lit(0.0)) / 100))).cast("bigint")
    rows = rows.withColumn("block", block)
    return rows.select("source", "source_size", "n_rows", "target", "block", F.expr("sum(source_size) OVER () div block").alias("blocks"))


def _apportion(rows: DataFrame, group: list[str], name: list[str], votes: str, seats: str, most: str, order: Column) -> DataFrame:
    """Deal `seats` of a group to its rows by highest quotient votes / (2 j - 1), none above `most`.

    A row's share of the seats is within its share of the group's number of rows, plus one or two,
    of what it gets; only seats in that range compete, all below are its own.
    """
    g = Window.partitionBy(*group)
    share = F.coalesce(F.col(votes) / F.nullif(F.sum(votes).over(g), F.lit(0)), F.lit(0.0)).cast("double")
    n = F.count("*").over(g)
    wide = rows.withColumns({"_q": share * F.col(seats), "_w": F.ceil(share * n) + 3})
    wide = wide.withColumns(
        {"_low": F.least(F.greatest(F.floor("_q") - F.col("_w"), F.lit(0)), F.col(most)), "_high": F.least(F.ceil("_q") + F.col("_w"), F.col(most))}
    ).withColumn("_left", F.col(seats) - F.sum("_low").over(g))
    seat = F.explode(F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low") + 1, F.col("_high"))).otherwise(F.array().cast("array<bigint>")))
    tried = wide.where(F.col(votes) > 0).select(*group, *name, "_left", seat.alias("_j"), votes)
    rank = F.row_number().over(Window.partitionBy(*group).orderBy((F.col(votes) / (2 * F.col("_j") - 1)).desc(), order))
    won = tried.withColumn("_rank", rank).where("_rank <= _left").groupBy(*group, *name).agg(F.count("*").alias("_won"))
    won = won.withColumnsRenamed({c: f"_{c}" for c in [*group, *name]})
    on = reduce(lambda x, c: x & F.col(c).eqNullSafe(F.col(f"_{c}")), [*group, *name], F.lit(True))
    return wide.join(won, on, "left").select(*rows.columns, (F.col("_low") + F.coalesce("_won", F.lit(0))).alias("quota"))


def plan(docs: DataFrame, text_col: str = "text", source_col: str = "source", seed: str = SEED, few: int = 50_000) -> DataFrame:
    """One row per row of `docs` (which carries KEY): KEY, size, source_size, target, taken, rounds and cuts.

    The mix takes the text `rounds` times whole and then each of `cuts`, (first word, words).
    A null text has no words and is never taken; a null source is one of its own, the last.
    Sources are put in order in one task, one row each; texts are numbered within shards of about
    SHARD_ROWS rows, dealt by hash, so that a hot source has many. The recipe is broadcast up to
    `few` sources, else joined by a shuffle. Nothing is random but by `seed`.
    """
    rows = docs.select(KEY, F.col(source_col).alias("source"), text_of(text_col).alias("text"))
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col(KEY).cast("string")))
    sizes = stored(rows.select(KEY, "source", F.size(words(F.col("text"))).cast("bigint").alias("size"), digest.alias("h")), "sizes")
    recipe = _recipe(sizes).withColumn("most", F.expr(f"{MOST} * source_size div block"))
    recipe = _apportion(recipe, [], ["source"], "target", "blocks", "most", F.col("source").asc_nulls_last())
    recipe = stored(recipe.withColumnRenamed("quota", "source_quota").drop("most"), "recipe")
    small = (F.broadcast(recipe) if recipe.count() <= few else recipe).withColumnRenamed("source", "_source")
    dealt = sizes.join(small, sizes["source"].eqNullSafe(small["_source"])).withColumn("shard", F.expr(f"{_SHARD} % (1 + n_rows div {SHARD_ROWS})")).drop("_source", "n_rows")
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.max("block").alias("block"), F.max("source_quota").alias("source_quota"))
    shards = shards.withColumn("most", F.expr(f"{MOST} * shard_size div block"))
    shards = _apportion(shards, ["source"], ["shard"], "shard_size", "source_quota", "most", F.col("shard"))
    start = _number(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("source"), F.lit("")), F.lit("|"), F.col("shard").cast("string"))))
    shards = shards.withColumns(
        {
            "rounds": F.expr("coalesce(quota * block div nullif(shard_size, 0), 0)"),
            "rest": F.expr("coalesce(quota * block % nullif(shard_size, 0), 0)"),
            "start": F.coalesce(start % F.nullif(F.expr("(shard_size + block - 1) div block"), F.lit(0)), F.lit(0)) * F.col("block"),
        }
    ).select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "shard_size", "rounds", "rest", "start")
    w = Window.partitionBy("source", "shard").orderBy("h", KEY).rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("at", F.sum("size").over(w) - F.col("size"))
    placed = placed.join(stored(shards, "shards"), placed["source"].eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))
    # The run begins at a block chosen by the seed and may go on at the shard's first text.
    placed = placed.withColumns({"a": F.expr("greatest(at, start)"), "b": F.expr("least(at + size, start + rest)"), "c": F.expr("least(at + size, start + rest - shard_size)")})
    cuts = F.filter(F.array(F.struct((F.col("a") - F.col("at")).alias("first"), (F.col("b") - F.col("a")).alias("n")), F.struct(F.lit(0).cast("bigint").alias("first"), (F.col("c") - F.col("at")).alias("n"))), lambda x: x["n"] > 0)
    return placed.withColumn("cuts", cuts).select(
        KEY, "size", "source_size", "target", F.expr("rounds * size + aggregate(cuts, 0L, (s, x) -> s + x.n)").alias("taken"), "rounds", "cuts"
    )


_SHARD = "cast(conv(substring(h, 16, 15), 16, 10) AS bigint)"


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """`docs` as the mix takes them: a row per whole repeat, and one per cut with its words only.

    All columns stay; a cut keeps the white space between its words, and n_chars, where there is
    such a column, says its length.
    """
    rows = keyed(docs.select(packed(docs), *(F.col(f"`{c}`").alias(n) for c, n in ((id_col, "id"), (text_col, "text"), (source_col, "source")))), "id")
    taken = plan(rows).where("taken > 0").select(KEY, "size", "rounds", "cuts")
    whole = F.struct(F.lit(0).cast("bigint").alias("first"), F.col("size").alias("n"))
    # A cut of all words is a whole text.
    takes = F.concat(F.when(F.col("rounds") > 0, F.array_repeat(whole, F.col("rounds").cast("int"))).otherwise(F.array().cast("array<struct<first:bigint,n:bigint>>")), F.col("cuts"))
    out = rows.select(KEY, "row").join(taken, KEY).select("row", "size", F.explode(takes).alias("take"))
    run = f"[^{_CLASS}]+[{_CLASS}]*"
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col("row")[text_col], F.lit(run), F.lit(0)), (F.col("take.first") + 1).cast("int"), F.col("take.n").cast("int")), "")
    text = F.when(F.col("take.n") == F.col("size"), F.col("row")[text_col]).otherwise(cut)
    out = out.withColumn("text", text)
    changed = {text_col: F.col("text"), "n_chars": F.length("text").cast(dict(docs.dtypes).get("n_chars", "bigint"))}
    return out.select(*(changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


_CLASS = "\\x20\\x09-\\x0D"


def query(docs: DataFrame) -> DataFrame:
    rows = keyed(docs.select("doc_id", "text", "source"))
    return rows.select(KEY, F.col("doc_id")).join(plan(rows), KEY).select("doc_id", "size", "source_size", "target", "taken")


SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('{SEED}|' || doc_id) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_rows FROM d GROUP BY 1),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {WEIGHTS} + 1 AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER () - sum({MOST} * source_size) OVER (ORDER BY {MOST} * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) + {MOST} * source_size)::DOUBLE
  / sum(weight) OVER (ORDER BY {MOST} * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT *, least({MOST} * source_size::DOUBLE, max(level) OVER () * weight) AS target FROM l),
b AS MATERIALIZED (SELECT *, sum(source_size) OVER ()::BIGINT AS total, greatest(1, least({LARGEST_BLOCK}, floor(coalesce(min(target) FILTER (WHERE target > 0) OVER (), 0) / 100)))::BIGINT AS block FROM t),
q AS MATERIALIZED (SELECT source, target, x.j FROM b, unnest(range(1, least({MOST} * source_size // block, ceil(target / block)::BIGINT + 50) + 1)) AS x(j) WHERE target > 0),
p AS (SELECT source, count(*) AS quota FROM (SELECT * FROM q QUALIFY row_number() OVER (ORDER BY target / (2 * j - 1) DESC, source NULLS LAST) <= (SELECT max(total // block) FROM b)) GROUP BY 1),
r AS MATERIALIZED (SELECT b.*, coalesce(quota, 0) AS source_quota FROM b LEFT JOIN p ON b.source IS NOT DISTINCT FROM p.source),
e AS MATERIALIZED (SELECT d.*, source_size, target, block, source_quota, ('0x' || substr(h, 16, 15))::BIGINT % (1 + n_rows // {SHARD_ROWS}) AS shard FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
h AS (SELECT source, shard, sum(size)::BIGINT AS shard_size, max(block) AS block, max(source_quota) AS source_quota FROM e GROUP BY ALL),
hq AS (SELECT source, shard, shard_size, source_quota, x.j FROM h, unnest(range(1, least({MOST} * shard_size // block, source_quota) + 1)) AS x(j) WHERE shard_size > 0),
hp AS (SELECT source, shard, count(*) AS quota FROM (SELECT * FROM hq QUALIFY row_number() OVER (PARTITION BY source ORDER BY shard_size / (2 * j - 1) DESC, shard) <= source_quota) GROUP BY ALL),
g AS (SELECT h.source, h.shard, shard_size, coalesce(coalesce(quota, 0) * block // nullif(shard_size, 0), 0) AS rounds, coalesce(coalesce(quota, 0) * block % nullif(shard_size, 0), 0) AS rest,
  coalesce(('0x' || substr(md5('{SEED}|' || coalesce(h.source, '') || '|' || h.shard), 1, 15))::BIGINT % nullif((shard_size + block - 1) // block, 0), 0) * block AS start
  FROM h LEFT JOIN hp ON h.source IS NOT DISTINCT FROM hp.source AND h.shard = hp.shard),
o AS (SELECT *, sum(size) OVER (PARTITION BY source, shard ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - size AS pos FROM e)
SELECT doc_id, size, source_size, target,
  (rounds * size + greatest(0, least(pos + size, start + rest) - greatest(pos, start)) + greatest(0, least(pos + size, start + rest - shard_size) - pos))::BIGINT AS taken
FROM o JOIN g ON o.source IS NOT DISTINCT FROM g.source AND o.shard = g.shard
"""
