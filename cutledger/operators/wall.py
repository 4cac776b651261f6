"""Plans for a board of shot tiles: order, slots, resync, verification, columns, grid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutledger.functions import grammar as g
from cutledger.functions import timecode as tc
from cutledger.operators import ordered
from cutledger.session import materialize

K = ["show_id", "cut_id"]
# Colours by status and the geometry of the board.
COLOURS = {
    "VFX": "#D6E4FF",
    "ONLINE": "#FFE0B2",
    "OMIT": "#ECECEC",
    "PRACTICAL": "#ECECEC",
    "OMITTED OR PRACTICAL": "#ECECEC",
}
FALLBACK = "#E9E9E9"
COLS, PITCH_X, PITCH_Y, ORIGIN_X, ORIGIN_Y = 11, 340, 310, -1700, -400


def usable(shots: DataFrame) -> DataFrame:
    """Rows with a code and a thumbnail address; the address may sit inside a formula."""
    url = g.first_url("thumbnail")
    return shots.withColumn("thumb_url", url).filter((g.strip("code") != "") & (F.col("thumb_url") != ""))


def by_status(shots: DataFrame, only: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    s = F.upper(g.strip("status"))
    if only:
        shots = shots.filter(s.isin([o.strip().upper() for o in only]))
    if exclude:
        shots = shots.filter(~s.isin([o.strip().upper() for o in exclude]))
    return shots


def colour(status: str | Column, overrides: dict[str, str] | None = None) -> Column:
    """Fill colour of a status, with a fallback."""
    table = {**COLOURS, **{k.strip().upper(): v for k, v in (overrides or {}).items()}}
    name = F.upper(F.regexp_replace(g.strip(status), r"\s+", " "))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), name), F.lit(FALLBACK))


def order(shots: DataFrame, fps: float = 24.0) -> DataFrame:
    """Chronological place from 0 per show: timecode first, rows without one last, then code.

    Rows come with ``tc`` text. A group of equal times, such as the rows without one, may be of
    any size.
    """
    frames = tc.smpte_frames("tc", F.lit(fps))
    well = F.coalesce("tc", F.lit("")).rlike(r"^\s*\d+:\d+:\d+[:;]\d+\s*$")
    late = F.lit(2**52).cast("bigint")
    rows = shots.withColumn("tc_frames", F.when(well, frames)).withColumn("_lead", F.coalesce("tc_frames", late))
    coded = ordered.ordinal_by(
        rows, ["show_id"], "_lead", "code", "_n", pos_block=F.substring("code", 1, 12)
    )
    return coded.withColumn("order", F.col("_n") - 1).drop("_n", "_lead")


def slot(place: Column, row_offset: Column | int = 0) -> tuple[Column, Column]:
    x = F.lit(ORIGIN_X) + F.pmod(place, F.lit(COLS)) * PITCH_X
    y = F.lit(ORIGIN_Y) + (F.floor(place / COLS) + row_offset) * PITCH_Y
    return x.cast("bigint"), y.cast("bigint")


def legend(shots: DataFrame) -> DataFrame:
    """Distinct non-blank statuses of a show, sorted, with colours."""
    s = shots.filter(F.coalesce("status", F.lit("")) != "").select("show_id", "status").distinct()
    return s.withColumn("colour", colour("status")).orderBy("show_id", "status")


def push_plan(shots: DataFrame, state: DataFrame) -> DataFrame:
    """Tiles to create. A show with no tile yet gets grid slots, any other a strip below.

    ``shots`` come from order(); ``state``: show_id, code, frame_id, order.
    """
    held = state.filter(F.col("frame_id").isNotNull()).select("show_id", "code")
    fresh = shots.join(held, ["show_id", "code"], "left_anti")
    n = shots.groupBy("show_id").agg(F.count("*").alias("_n"))
    top = state.groupBy("show_id").agg(F.max("order").alias("_top"))
    base = n.join(top, "show_id", "left")
    rows = ordered.salted_lookup(ordered.ordinal(fresh, ["show_id"], ["order"], "_k"), base, ["show_id"], ["code"])
    staged = F.col("_top").isNotNull()
    strip = F.floor(F.greatest(F.coalesce("_top", F.lit(0)), F.col("_n")) / COLS) + 3
    gx, gy = slot(F.col("order"))
    sx, sy = slot(F.col("_k") - 1, strip)
    return rows.select(
        "show_id",
        "code",
        "order",
        staged.alias("staged"),
        F.when(staged, sx).otherwise(gx).alias("x"),
        F.when(staged, sy).otherwise(gy).alias("y"),
        colour("status").alias("colour"),
        "label",
    )


def resync(shots: DataFrame, state: DataFrame) -> DataFrame:
    """Changes to bring a board in line: rename, recolour, missing, new. Positions never move."""
    s = shots.select("show_id", "code", F.struct("label", "status").alias("s"))
    t = state.select("show_id", "code", F.struct("frame_id", "title_now", "status").alias("t"))
    both = s.join(t, ["show_id", "code"], "full_outer")
    gone = F.col("t").isNotNull() & (F.col("s").isNull() | F.col("t.frame_id").isNull())
    live = F.col("t").isNotNull() & ~gone
    rename = live & ~F.col("t.title_now").eqNullSafe(F.col("s.label"))
    recolour = live & ~F.col("t.status").eqNullSafe(F.col("s.status"))
    acts = F.array(
        F.when(gone, F.lit("missing")),
        F.when(F.col("t").isNull(), F.lit("new")),
        F.when(rename, F.lit("rename")),
        F.when(recolour, F.lit("recolour")),
    )
    rows = both.withColumn("action", F.explode(F.array_compact(acts)))
    return rows.select(
        "show_id",
        "code",
        "action",
        F.when(F.col("action") == "rename", F.col("s.label")).alias("title"),
        F.when(F.col("action") == "recolour", colour("s.status")).alias("colour"),
    )


def verify(state: DataFrame, groups: DataFrame) -> DataFrame:
    """Tile state: ok if its group holds frame and image, bad, or no-group.

    ``groups``: show_id, group_id, item, one row per member. Two counting joins replace
    collecting a group's members.
    """
    want = state.select(
        "show_id", "code", "group_id", F.explode(F.array_distinct(F.array("frame_id", "image_id"))).alias("item")
    )
    members = groups.select("show_id", "group_id", "item").distinct().withColumn("_in", F.lit(1))
    got = want.join(members, ["show_id", "group_id", "item"], "left").groupBy("show_id", "code", "group_id").agg(
        F.count("*").alias("_need"), F.sum(F.coalesce("_in", F.lit(0))).alias("_have")
    )
    verdict = (
        F.when(F.coalesce(F.col("group_id").cast("string"), F.lit("")) == "", F.lit("no-group"))
        .when(F.col("_have") == F.col("_need"), F.lit("ok"))
        .otherwise(F.lit("bad"))
    )
    return got.select("show_id", "code", verdict.alias("verdict"))


def grid(shots: DataFrame, canvas: tuple[int, int] = (7680, 4320), aspect: float = 16 / 9, cols: int | None = None) -> DataFrame:
    """Cells of a contact grid without gaps: integer edges from the place along the cut."""
    w, h = canvas
    n = shots.groupBy(*K).agg(F.count("*").alias("n"))
    auto = F.greatest(F.lit(1), F.bround(F.sqrt(F.lit(w / h) * F.col("n") / F.lit(aspect)))).cast("bigint")
    n = n.withColumn("cols", F.lit(cols).cast("bigint") if cols else auto)
    n = n.withColumn("rows", F.ceil(F.col("n") / F.col("cols")).cast("bigint"))
    rows = ordered.salted_lookup(ordered.ordinal(shots, K, ["seq"], "_i"), n, K, ["seq"])
    i = F.col("_i") - 1
    c, r = F.pmod(i, F.col("cols")), F.floor(i / F.col("cols"))

    def at(k: Column, size: int, parts: str) -> Column:
        return F.floor(k * size / F.col(parts)).cast("bigint")

    return rows.select(
        *K,
        "tcid",
        at(c, w, "cols").alias("x0"),
        at(r, h, "rows").alias("y0"),
        at(c + 1, w, "cols").alias("x1"),
        at(r + 1, h, "rows").alias("y1"),
        "cols",
        "rows",
    )


WALK_ROWS = 1 << 17
_WALKED = "show_id bigint, cut_id bigint, _blk bigint, code string, order bigint, column bigint, sum array<double>, n bigint"


def _walk(threshold: float):
    """Columns along sorted rows of (cut, range); one row more per range says how it ends.

    A row with ``n`` is what the range before hands on: sum and number of its last column.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, total, n, col = None, None, 0, 0
        for pdf in batches:
            out = []
            for *now, code, order, vec, given in pdf.itertuples(index=False, name=None):
                if now != key:
                    if key is not None:
                        out.append((*key, None, None, col, total.tolist(), n))
                    key, total, n, col = now, None, 0, 0
                v = np.asarray(vec, float)
                if given > 0:
                    total, n = v.copy(), int(given)
                    continue
                if total is None:
                    total, n = v.copy(), 1
                else:
                    mean = total / n
                    size = (np.linalg.norm(mean) or 1.0) * (np.linalg.norm(v) or 1.0)
                    if float(mean @ v) / size >= threshold:
                        total, n = total + v, n + 1
                    else:
                        col, total, n = col + 1, v.copy(), 1
                out.append((*key, code, order, col, None, None))
            yield _frame(out)
        if key is not None:
            yield _frame([(*key, None, None, col, total.tolist(), n)])

    def _frame(rows: list) -> pd.DataFrame:
        got = pd.DataFrame(rows, columns=[c.split()[0] for c in _WALKED.split(", ")])
        return got.astype({"order": "Int64", "n": "Int64"})

    return run


def walk(vectors: DataFrame, threshold: float = 0.75, rows: int = WALK_ROWS) -> DataFrame:
    """Columns of consecutive similar shots: show_id, cut_id, code, order, column.

    A shot stays in the column while its cosine to the column's mean is at least ``threshold``.
    ``vectors``: show_id, cut_id, code, order, vec. Orders need not be dense.

    Cuts are dealt to tasks and walked in one pass that holds one vector. A cut longer than
    ``rows`` is dealt in ranges, which are walked at once as if each began a column, and then again
    from what the range before hands on. Two walks agree from the first column on that both begin
    at the same shot, so a range mostly ends as it did before; only where it does not, the range
    after it is walked again. Where no column ends within whole ranges, they take turns.
    """
    dealt = vectors.select(*K, F.floor(F.col("order") / rows).cast("bigint").alias("_blk"), "code", "order", "vec", F.lit(0).cast("bigint").alias("given"))
    dealt = materialize(dealt.withColumn("vec", F.col("vec").cast("array<double>")))
    ranges = [*K, "_blk"]

    def pass_over(these: DataFrame) -> DataFrame:
        laid = these.repartition(*ranges).sortWithinPartitions(*ranges, F.desc(F.col("given") > 0), "order")
        return materialize(laid.mapInPandas(_walk(threshold), _WALKED))

    walked = pass_over(dealt)
    ends = walked.filter(F.col("order").isNull()).select(*ranges, "column", "sum", "n")
    before = Window.partitionBy(*K).orderBy("_blk")
    chain = materialize(ends.withColumn("_from", F.lag("_blk").over(before)).select(*ranges, "_from"))
    todo = chain.filter(F.col("_from").isNotNull())
    while todo.limit(1).count():
        given = todo.join(ends.select(*K, F.col("_blk").alias("_from"), "sum", "n"), [*K, "_from"])
        given = given.select(*ranges, F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("order"), F.col("sum").alias("vec"), F.col("n").alias("given"))
        again = pass_over(dealt.join(todo.select(*ranges), ranges, "left_semi").unionByName(given))
        new_ends = again.filter(F.col("order").isNull()).select(*ranges, "column", "sum", "n")
        other = new_ends.join(ends.select(*ranges, F.col("sum").alias("_sum"), F.col("n").alias("_n")), ranges).filter((F.col("sum") != F.col("_sum")) | (F.col("n") != F.col("_n")))
        walked = walked.join(todo.select(*ranges), ranges, "left_anti").unionByName(again)
        ends = materialize(walked.filter(F.col("order").isNull()).select(*ranges, "column", "sum", "n"))
        todo = materialize(chain.join(other.select(*K, F.col("_blk").alias("_from")), [*K, "_from"]).select(*ranges, "_from"))
    # A range counts its columns from the one it was given; those before it come on top.
    earlier = F.coalesce(F.sum("column").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier")
    moved = ends.select(*ranges, earlier).filter(F.col("_earlier") > 0)
    shots = walked.filter(F.col("order").isNotNull()).join(moved, ranges, "left")
    return shots.select(*K, "code", "order", (F.col("column") + F.coalesce("_earlier", F.lit(0))).alias("column"))


def columns(shots: DataFrame, vectors: DataFrame, exclude: list[str] = ("ONLINE",), threshold: float = 0.75) -> DataFrame:
    """Similarity columns of the included shots; the excluded ones form one column at the end."""
    vec = vectors.select(*K, "code", "vec")
    main = by_status(shots, exclude=list(exclude))
    main = main.drop("order").join(vec, [*K, "code"])  # a shot without a picture takes no place
    main = ordered.ordinal(main, K, ["seq"], "order").withColumn("order", F.col("order") - 1)
    walked = walk(main.select(*K, "code", "order", "vec"), threshold)
    end = walked.groupBy(*K).agg((F.max("column") + 1).alias("_end"))
    rest = by_status(shots, only=list(exclude))
    rest = ordered.ordinal(rest.drop("order"), K, ["seq"], "order").withColumn("order", F.col("order") - 1)
    rest = ordered.salted_lookup(rest, end, K, ["seq"]).select(
        *K, "code", "order", F.coalesce("_end", F.lit(0)).alias("column")
    )
    return walked.unionByName(rest)
