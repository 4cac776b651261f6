"""Ordinals, running sums and neighbours over groups of any size.

A plain window puts a whole group into one task, so one show with a third of all rows would end
up on one executor. Here every group is cut into blocks along its order; the window runs per
block, and a small table with one row per block carries the offsets from block to block.

Keys must not be null.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutledger.session import materialize

BLOCK_ROWS = 65536


def block(order: str | Column, rows: int = BLOCK_ROWS) -> Column:
    """Block number of a numeric, roughly dense order column."""
    col = F.col(order) if isinstance(order, str) else order
    return F.floor(col / F.lit(rows)).cast("bigint")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    measures: dict[str, Column],
    blocks: Sequence[Column] | None = None,
    outer: Column | None = None,
) -> DataFrame:
    """Exclusive running sum of every measure along ``order`` inside ``keys``.

    ``blocks`` are columns that never decrease along ``order``; the default is the first order
    column cut into BLOCK_ROWS steps. Where there may be about as many blocks as rows, ``outer``
    cuts the block table itself the same way (written over the columns _b0, _b1, ...).
    """
    keys, order = list(keys), list(order)
    blocks = list(blocks) if blocks is not None else [block(order[0])]
    names = [f"_b{i}" for i in range(len(blocks))]
    tagged = df.withColumns(dict(zip(names, blocks)))
    heads = tagged.groupBy(*keys, *names).agg(
        *[F.sum(c).alias(f"_s_{n}") for n, c in measures.items()]
    )
    if outer is None:
        w = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
        heads = heads.select(*keys, *names, *[F.sum(f"_s_{n}").over(w).alias(f"_o_{n}") for n in measures])
    else:
        heads = heads.withColumn("_outer", outer).transform(
            lambda h: running(
                h.withColumnsRenamed({n: f"_h{n}" for n in names}),
                keys,
                [f"_h{n}" for n in names],
                {f"_o_{n}": F.col(f"_s_{n}") for n in measures},
                blocks=[F.col("_outer")],
            )
        )
        heads = heads.select(
            *keys, *[F.col(f"_h{n}").alias(n) for n in names], *[f"_o_{n}" for n in measures]
        )
    # The first block of a group has no offset, so a library of ordinary groups joins to nothing.
    moved = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"_o_{n}"), F.lit(0)) != 0 for n in measures])
    heads = heads.filter(moved)
    w = Window.partitionBy(*keys, *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # Measures are summed as they are: as columns of their own they would be shuffled with every row.
    local = tagged.withColumns({f"_l_{n}": F.sum(c).over(w) for n, c in measures.items()})
    zero = F.lit(0)
    out = local.join(heads, [*keys, *names], "left").withColumns(
        {n: F.coalesce(F.col(f"_l_{n}"), zero) + F.coalesce(F.col(f"_o_{n}"), zero) for n in measures}
    )
    keep = [*df.columns, *[n for n in measures if n not in df.columns]]
    return out.select(*keep)


def ordinal(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str,
    blocks: Sequence[Column] | None = None,
    outer: Column | None = None,
) -> DataFrame:
    """Row number from 1 along ``order`` inside ``keys``."""
    got = running(df, keys, order, {name: F.lit(1).cast("bigint")}, blocks, outer)
    return got.withColumn(name, F.col(name) + 1)


def ordinal_by(
    df: DataFrame,
    keys: Sequence[str],
    lead: str,
    pos: str,
    name: str,
    lead_step: int = BLOCK_ROWS,
    limit: int = BLOCK_ROWS,
    pos_block: Column | None = None,
) -> DataFrame:
    """Row number along (lead, pos), where any one lead value may itself be hot.

    A count by key finds groups of more than ``limit`` rows. Where there is none, a plain window
    numbers all; else the rows of the crowded groups are cut, by lead value and then by position,
    so equal lead values of any number are spread as well. ``pos_block`` is the block of a position
    that is not a number, such as the head of a code.
    """
    keys = list(keys)
    crowded = materialize(df.groupBy(*keys).count().filter(F.col("count") > limit).select(*keys))
    calm = lambda rows: rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(lead, pos)).cast("bigint"))
    if crowded.isEmpty():
        return calm(df)
    got = ordinal(
        df.join(crowded, keys, "left_semi"),
        keys,
        [lead, pos],
        name,
        blocks=[F.col(lead).cast("bigint"), block(pos) if pos_block is None else pos_block],
        outer=F.floor(F.col("_b0") / F.lit(lead_step)).cast("bigint"),
    )
    return got.unionByName(calm(df.join(crowded, keys, "left_anti")))


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cols: Sequence[str],
    name: str,
    ahead: bool = False,
    blocks: Sequence[Column] | None = None,
) -> DataFrame:
    """Add ``name``: a struct of ``cols`` of the previous (or next) row, null at the end."""
    keys, order = list(keys), list(order)
    blocks = list(blocks) if blocks is not None else [block(order[0])]
    names = [f"_b{i}" for i in range(len(blocks))]
    tagged = df.withColumns(dict(zip(names, blocks))).withColumn("_v", F.struct(*cols))
    key = F.struct(*order)
    edge = (F.min_by if ahead else F.max_by)(F.col("_v"), key)
    heads = tagged.groupBy(*keys, *names).agg(edge.alias("_edge"))
    step = F.lead if ahead else F.lag
    wb = Window.partitionBy(*keys).orderBy(*names)
    heads = heads.select(*keys, *names, step("_edge").over(wb).alias("_carry")).filter(
        F.col("_carry").isNotNull()
    )
    w = Window.partitionBy(*keys, *names).orderBy(*order)
    local = tagged.withColumn("_near", step("_v").over(w))
    out = local.join(heads, [*keys, *names], "left")
    return out.withColumn(name, F.coalesce("_near", "_carry")).select(*df.columns, name)


def pick(
    df: DataFrame, keys: Sequence[str], by: Sequence[Column | str], last: bool = False
) -> DataFrame:
    """One row per key: the first (or last) along ``by``. Combines on the map side."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    choose = F.max_by if last else F.min_by
    got = df.groupBy(*keys).agg(choose(F.struct(*rest), F.struct(*by)).alias("_r"))
    return got.select(*keys, "_r.*").select(*df.columns)


def salted_lookup(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    salts: int = 8,
    how: str = "left",
) -> DataFrame:
    """Join rows to a table that is unique on ``on``, with hot keys of the left side spread.

    The right side is repeated once per salt, by a product with the salts: Spark's size check of a
    broadcast then counts the repeats, which it does not for an explode. ``spread`` names left
    columns that differ inside a hot key.
    """
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    every = left.sparkSession.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    wide = right.crossJoin(every)
    return left.withColumn("_salt", salt).join(wide, [*on, "_salt"], how).drop("_salt")
