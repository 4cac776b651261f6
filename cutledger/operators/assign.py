"""One-to-one assignment of a new cut to the master list of its show.

``new``: show_id, tcid, code, input_pos. ``master``: show_id, row, code, revision, input_pos.
Every tier claims master rows; later tiers see only what is left.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutledger.functions import grammar as g
from cutledger.operators import ordered
from cutledger.operators.choice import serial_choice, staggered, wishes_from_table
from cutledger.operators.vision import top_similar
from cutledger.session import materialize

#: Adds a column ``vec`` to rows of a side.
Pictured = Callable[[DataFrame], DataFrame]

MATCH = ["show_id", "tcid", "master_row", "master_code", "tier"]
TIERS = ["EXACT-CODE", "ORDINAL", "SLATE-ORDINAL", "VISUAL", "EXTRA", "NEW"]


def _parsed(side: DataFrame) -> DataFrame:
    if "_p" in side.columns:
        return side
    return side.withColumn("_p", g.code_parts("code"))


def _needed(side: DataFrame, *cols: str) -> DataFrame:
    """What the tiers read of a side: these columns and the parts of the code that they go by."""
    parts = F.struct(*[F.col(f"_p.{c}").alias(c) for c in ("slate", "take", "counter")])
    return _parsed(side).select("show_id", *cols, F.when(F.col("_p").isNotNull(), parts).alias("_p"))


def _has_slate() -> Column:
    return F.coalesce(F.col("_p.slate"), F.lit(0)) != 0


def exact_code(new: DataFrame, master: DataFrame) -> DataFrame:
    """Equal codes. The first new shot of a code meets the last master row of it."""
    coded = F.coalesce(F.col("code"), F.lit("")) != ""
    n = new.filter(coded).groupBy("show_id", "code").agg(F.min_by("tcid", "input_pos").alias("tcid"))
    m = master.filter(coded).groupBy("show_id", "code").agg(F.max_by("row", "input_pos").alias("master_row"))
    return n.join(m, ["show_id", "code"]).select(
        "show_id", "tcid", "master_row", F.col("code").alias("master_code"), F.lit("EXACT-CODE").alias("tier")
    )


def ordinal(new: DataFrame, master: DataFrame, with_take: bool = True) -> DataFrame:
    """Same slate (and take): the nth left shot by counter meets the nth left master row."""
    keys = ["show_id", "_slate", "_take"] if with_take else ["show_id", "_slate"]

    def ranked(side: DataFrame) -> DataFrame:
        rows = _parsed(side).filter(_has_slate()).withColumns(
            {"_slate": F.col("_p.slate"), "_take": F.col("_p.take"), "_counter": F.col("_p.counter")}
        )
        return ordered.ordinal_by(rows, keys, "_counter", "input_pos", "_nth")

    n = ranked(new).select(*keys, "_nth", "tcid")
    m = ranked(master).select(*keys, "_nth", F.col("row").alias("master_row"), F.col("code").alias("master_code"))
    tier = "ORDINAL" if with_take else "SLATE-ORDINAL"
    return n.join(m, [*keys, "_nth"]).select("show_id", "tcid", "master_row", "master_code", F.lit(tier).alias("tier"))


def unclaimed(new: DataFrame, master: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    n = new.join(matches.select("show_id", "tcid"), ["show_id", "tcid"], "left_anti")
    m = master.join(matches.select("show_id", F.col("master_row").alias("row")), ["show_id", "row"], "left_anti")
    return n, m


def visual(
    new: DataFrame, master: DataFrame, similarity: DataFrame, floor: float | None = None, block: int = 128
) -> DataFrame:
    """Shots without a slate, in input order, take the most similar free master row.

    ``similarity``: show_id, tcid, row, score. Ties go to the first master row.
    """
    n = _parsed(new).filter(~_has_slate())
    table = similarity.join(master.select("show_id", "row", F.col("input_pos").alias("item_pos")), ["show_id", "row"])
    if floor is not None:
        table = table.filter(F.col("score") >= floor)
    table = table.withColumnsRenamed({"tcid": "proposer", "row": "item"})
    picks = serial_choice(
        n.select("show_id", F.col("tcid").alias("proposer"), F.col("input_pos").alias("pos")),
        wishes_from_table(table, ["show_id"]),
        ["show_id"],
        block,
    )
    return _as_matches(picks, master)


def visual_by_vector(
    new: DataFrame, master: DataFrame, new_vec: DataFrame | Pictured, master_vec: DataFrame | Pictured, floor: float | None = None, block: int = 128
) -> DataFrame:
    """The same choice with vectors on both sides instead of a finished similarity table.

    ``new_vec``: show_id, tcid, vec; ``master_vec``: show_id, row, vec. A row without a vector is
    no candidate. Either may be a function instead that adds ``vec`` to the rows of its side, which
    moves a vector once. A shot lists its most similar items that no earlier shot holds, ``block`` a round.
    """
    n = materialize(_parsed(new).filter(~_has_slate()).select("show_id", "tcid", "input_pos"))
    master = materialize(master.select("show_id", "row", "code", "input_pos"))

    def seen(side: DataFrame, vec: DataFrame | Pictured, key: str) -> DataFrame:
        """A vector is looked up, or moved, for the rows that take part alone, few of all that have one."""
        if callable(vec):
            rows = vec(side).filter(F.col("show_id").isNotNull() & F.col(key).isNotNull())
        else:
            vec = vec.join(side.select("show_id", key), ["show_id", key], "left_semi")
            rows = side.join(vec, ["show_id", key])
        return materialize(rows.select("show_id", F.col(key).alias("id"), F.col("input_pos").alias("pos"), "vec"))

    a, b = seen(n, new_vec, "tcid"), seen(master, master_vec, "row")

    def wishes(members: DataFrame, held: DataFrame | None) -> DataFrame:
        mine = a.join(members.select("show_id", F.col("proposer").alias("id"), F.col("_rank").alias("since")), ["show_id", "id"])
        if held is None:
            return _first_wishes(mine, b, block, floor)
        # Blocks of items are built anew in a round, but only for shows that still choose.
        items = b.join(members.select("show_id").distinct(), "show_id", "left_semi")
        items = items.join(held.select("show_id", F.col("item").alias("id"), F.col("_holder").alias("until")), ["show_id", "id"], "left")
        return _wanted(top_similar(mine, items, ["show_id"], block, floor=floor))

    picks = serial_choice(a.select("show_id", F.col("id").alias("proposer"), "pos"), wishes, ["show_id"], block)
    return _as_matches(picks, master)


def _wanted(top: DataFrame, *more: str) -> DataFrame:
    want = F.struct((-F.col("score")).alias("s"), F.col("item_pos").alias("p"))
    return top.select("show_id", "proposer", "item", want.alias("want"), *more)


def _first_wishes(mine: DataFrame, items: DataFrame, block: int, floor: float | None) -> DataFrame:
    """Wishes while all items are free; shots of one vector share a list, which is made once."""
    same = ["show_id", "vec"]
    looks = mine.groupBy(*same).agg(F.min_by("id", "since").alias("id"), F.min("pos").alias("pos"), F.count("*").alias("k"))
    looks = materialize(looks.withColumn("k", F.col("k") + block - 1))
    lists = _wanted(top_similar(looks, items, ["show_id"], block, floor=floor), "rank").withColumnRenamed("proposer", "list")
    members = mine.join(looks.select(*same, F.col("id").alias("list")), same).select("show_id", "list", F.col("id").alias("proposer"), F.col("since").alias("pos"))
    return staggered(members, lists, ["show_id"], block)


def _as_matches(picks: DataFrame, master: DataFrame) -> DataFrame:
    code = master.select("show_id", F.col("row").alias("master_row"), F.col("code").alias("master_code"))
    got = picks.withColumnsRenamed({"proposer": "tcid", "item": "master_row"}).join(code, ["show_id", "master_row"])
    return got.withColumn("tier", F.lit("VISUAL")).select(*MATCH)


def _slates(master: DataFrame) -> DataFrame:
    """Distinct slates of a show's master, slate 0 included."""
    m = _parsed(master).filter(F.col("_p").isNotNull())
    return m.select("show_id", F.col("_p.slate").alias("_slate")).distinct().withColumn("_known", F.lit(True))


def leftovers(new_left: DataFrame, master: DataFrame) -> DataFrame:
    """Unmatched shots: EXTRA where the master knows the slate, else NEW."""
    rows = _parsed(new_left).withColumn("_slate", F.col("_p.slate"))
    rows = ordered.salted_lookup(rows, _slates(master), ["show_id", "_slate"], ["tcid"])
    tier = F.when(F.coalesce("_known", F.lit(False)), F.lit("EXTRA")).otherwise(F.lit("NEW"))
    return rows.select("show_id", "tcid", tier.alias("tier"))


def omits(master_left: DataFrame, protected: DataFrame | None = None) -> DataFrame:
    """Unclaimed master rows that no marker and no list protects."""
    rows = master_left.filter(~g.is_protected("revision"))
    if protected is not None:
        rows = rows.join(protected.select("show_id", "row"), ["show_id", "row"], "left_anti")
    return rows.select("show_id", "row")


def _uncommon(n: DataFrame, m: DataFrame, limit: int) -> DataFrame:
    """Shows that one deal by show and slate does not suit: an id that repeats or is missing, a
    missing position, or a slate with more than ``limit`` rows on both sides together."""
    ids = [(n, "tcid"), (m, "row")]
    sides = [s.select("show_id", F.col("_p.slate").alias("_slate"), (F.col(i).isNull() | F.col("input_pos").isNull()).alias("_gap")) for s, i in ids]
    both = reduce(DataFrame.unionByName, sides)
    shows = materialize(both.groupBy("show_id").agg(F.count("*").alias("_n"), F.max("_gap").alias("_gap")).filter(f"_gap OR _n > {limit}"))
    slates = both.join(shows.filter(F.col("_n") > limit).select("show_id"), "show_id", "left_semi")
    crowded = slates.groupBy("show_id", "_slate").count().filter(F.col("count") > limit)
    twice = [s.groupBy("show_id", i).count().filter(F.col("count") > 1).select("show_id") for s, i in ids]
    return reduce(DataFrame.unionByName, [shows.filter("_gap").select("show_id"), crowded.select("show_id"), *twice]).distinct()


def _dealt(n: DataFrame, m: DataFrame) -> DataFrame:
    """The three coded tiers over one deal of both sides by show and slate.

    A code settles the slate, so all that may meet by code, slate or take lies together, and every
    tier is a window over it. Ids must be unique in a show, and no slate crowded. Returns each row
    with what it needs later: side (``_m``: master), tier and the row it matched, null where it is
    left, and whether the master knows its slate.
    """
    rest = ["show_id", "input_pos", F.col("code").alias("_code"), *[F.col(f"_p.{c}").alias(f"_{c}") for c in ("slate", "take", "counter")]]
    kinds = {c: dict(m.dtypes)[c] for c in ("row", "revision")} | {"tcid": dict(n.dtypes)["tcid"]}
    none = lambda *cols: [F.lit(None).cast(kinds[c]).alias(c) for c in cols]
    one = n.select(F.lit(False).alias("_m"), "tcid", *none("row", "revision"), *rest, F.lit(False).alias("_coded"))
    one = one.unionByName(m.select(F.lit(True).alias("_m"), *none("tcid"), "row", "revision", *rest, F.col("_p").isNotNull().alias("_coded")))
    placed = F.col("show_id").isNotNull()
    slate = ["show_id", "_slate"]
    rows = one.filter(placed).repartition(*slate)

    # The first new shot of a code and the last master row of it.
    same = Window.partitionBy(*slate, "_code")
    first = F.min(F.when(~F.col("_m"), F.struct("input_pos", "tcid"))).over(same)
    last = F.max(F.when(F.col("_m"), F.struct("input_pos", "row"))).over(same)
    known = F.max("_coded").over(Window.partitionBy(*slate)) & F.col("_slate").isNotNull()
    rows = rows.withColumns({"_first": first, "_last": last}).withColumn("_known", known)
    mine = F.when(F.col("_m"), F.col("row") == F.col("_last.row")).otherwise(F.col("tcid") == F.col("_first.tcid"))
    met = (F.coalesce("_code", F.lit("")) != "") & F.col("_first").isNotNull() & F.col("_last").isNotNull() & mine
    rows = rows.withColumns(
        {
            "tier": F.when(met, F.lit("EXACT-CODE")),
            "master_row": F.when(met, F.col("_last.row")),
            "master_code": F.when(met, F.col("_code")),
        }
    ).drop("_first", "_last")

    # The nth shot left meets the nth row left.
    for tier, keys in (("ORDINAL", [*slate, "_take"]), ("SLATE-ORDINAL", slate)):
        free = F.col("tier").isNull() & (F.coalesce("_slate", F.lit(0)) != 0) & F.col(keys[-1]).isNotNull()
        rows = rows.withColumn("_free", free)
        nth = F.row_number().over(Window.partitionBy(*keys, "_free", "_m").orderBy("_counter", "input_pos"))
        pair = Window.partitionBy(*keys, "_free", "_nth")
        rows = rows.withColumn("_nth", nth).withColumns(
            {"_two": F.min("_m").over(pair) != F.max("_m").over(pair), "_row": F.max("row").over(pair), "_its": F.max(F.when(F.col("_m"), F.col("_code"))).over(pair)}
        )
        met = F.col("_free") & F.col("_two")
        rows = rows.withColumns(
            {
                "tier": F.when(met, F.lit(tier)).otherwise(F.col("tier")),
                "master_row": F.when(met, F.col("_row")).otherwise(F.col("master_row")),
                "master_code": F.when(met, F.col("_its")).otherwise(F.col("master_code")),
            }
        ).drop("_free", "_nth", "_two", "_row", "_its")

    # A row without a show meets nothing.
    lone = one.filter(~placed).withColumns({"_known": F.lit(False), "tier": F.lit(None).cast("string"), "master_row": F.lit(None).cast(kinds["row"]), "master_code": F.lit(None).cast("string")})
    left = F.col("tier").isNull()
    later = [F.when(left, F.col(c)).alias(c) for c in ("revision", "input_pos", "_code", "_slate")]
    cols = ["show_id", "_m", "tcid", "row", "tier", "master_row", "master_code", "_known"]
    return rows.unionByName(lone).select(*cols, *later)


def _assign_dealt(n: DataFrame, m: DataFrame, look: Callable[[DataFrame, DataFrame], DataFrame] | None, protected: DataFrame | None):
    """All tiers, the coded ones over one deal of both sides (see _dealt())."""
    rows = materialize(_dealt(n, m))
    found = rows.filter(~F.col("_m") & F.col("tier").isNotNull()).select(*MATCH)
    left = rows.filter(F.col("tier").isNull()).withColumn("_p", F.when(F.col("_slate").isNotNull(), F.struct(F.col("_slate").alias("slate"))))
    n_left = left.filter(~F.col("_m")).select("show_id", "tcid", "input_pos", "_p", "_known")
    m_left = left.filter("_m").select("show_id", "row", F.col("_code").alias("code"), "revision", "input_pos", "_p")
    if look is not None:
        picked = materialize(look(n_left, m_left))
        # Only a shot without a slate can have been picked for.
        bare, m_left = unclaimed(n_left.filter(~_has_slate()), m_left, picked)
        n_left = n_left.filter(_has_slate()).unionByName(bare.select(*n_left.columns))
        found = found.unionByName(picked.select(*MATCH))
    tier = F.when(F.col("_known"), F.lit("EXTRA")).otherwise(F.lit("NEW"))
    return found, n_left.select("show_id", "tcid", tier.alias("tier")), omits(m_left, protected)


def _assign_stepwise(n: DataFrame, m: DataFrame, look: Callable[[DataFrame, DataFrame], DataFrame] | None, protected: DataFrame | None):
    """All tiers one after the other by joins, which hold for crowded slates and ids that repeat."""
    tiers = [exact_code, lambda a, b: ordinal(a, b, True), lambda a, b: ordinal(a, b, False)] + ([look] if look else [])
    n_left, m_left, found = n, m, []
    for i, tier in enumerate(tiers):
        if i:
            n_left, m_left = materialize(n_left), materialize(m_left)
        found.append(materialize(tier(n_left, m_left)))
        # Only the first tier reads the code of a shot itself; later ones know its parts.
        n_left, m_left = unclaimed(n_left.drop("code"), m_left, found[-1])
    return reduce(DataFrame.unionByName, found), leftovers(n_left, m), omits(m_left, protected)


def assign(
    new: DataFrame,
    master: DataFrame,
    similarity: DataFrame | None = None,
    protected: DataFrame | None = None,
    visual_floor: float | None = None,
    vectors: tuple[DataFrame | Pictured, DataFrame | Pictured] | None = None,
    crowd: int = ordered.BLOCK_ROWS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All tiers in order. Returns matches, leftovers, omits.

    The visual tier runs over a table of similarities (see visual()) or over vectors of both sides
    (see visual_by_vector()). Both sides are dealt once by show and slate for the coded tiers; shows
    where an id repeats or a slate has more than ``crowd`` rows go through the tiers by joins, each
    tier's matches and what it leaves stored once. Other columns than those named above stay behind.
    """
    n, m = materialize(_needed(new, "tcid", "code", "input_pos")), materialize(_needed(master, "row", "code", "revision", "input_pos"))
    look = None
    if vectors is not None:
        look = lambda a, b: visual_by_vector(a, b, *vectors, floor=visual_floor)
    elif similarity is not None:
        look = lambda a, b: visual(a, b, similarity, visual_floor)
    odd = materialize(_uncommon(n, m, crowd))
    if odd.isEmpty():
        return _assign_dealt(n, m, look, protected)
    apart = lambda how: [side.join(odd, "show_id", how) for side in (n, m)]
    plain, rare = _assign_dealt(*apart("left_anti"), look, protected), _assign_stepwise(*map(materialize, apart("left_semi")), look, protected)
    return tuple(a.unionByName(b) for a, b in zip(plain, rare))


def violations(matches: DataFrame) -> DataFrame:
    """Master rows or non-blank master codes that more than one shot claims."""
    by_row = matches.groupBy("show_id", F.col("master_row").cast("string").alias("claimed")).count()
    by_code = matches.filter(F.coalesce("master_code", F.lit("")) != "").groupBy(
        "show_id", F.col("master_code").alias("claimed")
    ).count()
    tagged = by_row.withColumn("what", F.lit("row")).unionByName(by_code.withColumn("what", F.lit("code")))
    return tagged.filter(F.col("count") > 1).select("show_id", "what", "claimed", F.col("count").alias("n"))


def check_unique(matches: DataFrame) -> DataFrame:
    """Return the matches, or raise when the one-to-one rule is broken."""
    some = violations(matches).limit(5).collect()
    if some:
        raise ValueError(f"one-to-one rule broken, for example: {[tuple(r) for r in some]}")
    return matches


def crosscheck(left: DataFrame, new: DataFrame, master: DataFrame) -> DataFrame:
    """Say why a leftover may not be new: its code or its slate is in the master after all.

    The shots of a library are not for the driver, however small their files are.
    """
    rows = left.join(new.select("show_id", "tcid", "code").hint("merge"), ["show_id", "tcid"], "left").withColumn(
        "_p", g.code_parts("code")
    )
    rows = rows.withColumn("_slate", F.col("_p.slate"))
    coded = F.coalesce(F.col("code"), F.lit("")) != ""
    codes = master.filter(coded).select("show_id", "code").distinct().withColumn("_same", F.lit(True))
    rows = ordered.salted_lookup(rows, codes, ["show_id", "code"], ["tcid"])
    rows = ordered.salted_lookup(rows, _slates(master), ["show_id", "_slate"], ["tcid"])
    note = (
        F.when(F.coalesce("_same", F.lit(False)), F.lit("engine-missed-exact-code"))
        .when(
            F.coalesce("_known", F.lit(False)),
            F.when(F.col("tier") == "EXTRA", F.lit("counter-drift-candidate")).otherwise(
                F.lit("extra-piece-of-known-slate")
            ),
        )
        .otherwise(F.lit("genuinely-new"))
    )
    return rows.select("show_id", "tcid", "tier", note.alias("note"))


def stage_review(matches: DataFrame, left: DataFrame, review: DataFrame) -> DataFrame:
    """Fill the three review columns of the shots in the review table; all others stay.

    A code proposed twice is flagged. Shots that the table lacks are skipped.
    """
    text = F.lit("").alias("match_note")
    note = F.coalesce("note", F.lit("")).alias("match_note") if "note" in left.columns else text
    proposal = matches.select(
        "show_id", "tcid", F.col("tier").alias("match_tier"), F.col("master_code").alias("proposed_master_code"), text
    ).unionByName(
        left.select("show_id", "tcid", F.col("tier").alias("match_tier"), F.lit("").alias("proposed_master_code"), note)
    )
    base = review.drop("match_tier", "proposed_master_code", "match_note", "duplicate")
    staged = base.join(proposal.hint("merge"), ["show_id", "tcid"], "left")
    many = (
        staged.filter(F.coalesce("proposed_master_code", F.lit("")) != "")
        .groupBy("show_id", "proposed_master_code")
        .count()
        .filter(F.col("count") > 1)
        .select("show_id", "proposed_master_code", F.lit(True).alias("_dup"))
    )
    out = ordered.salted_lookup(staged, many, ["show_id", "proposed_master_code"], ["tcid"])
    return out.withColumn("duplicate", F.coalesce("_dup", F.lit(False))).drop("_dup").select(
        *base.columns, "match_tier", "proposed_master_code", "match_note", "duplicate"
    )
