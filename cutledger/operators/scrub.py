"""Scrubbing and clearing of cell tables: tab, row, col, value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutledger.functions import grammar as g
from cutledger.operators import ordered

PREFIX = r"^([A-Za-z]{2,6})[_\-]"


def detect_prefix(cells: DataFrame, col: str) -> DataFrame:
    """Most frequent code prefix among all rows of a tab, the earliest on a tie."""
    rows = cells.filter(F.col("col") == col)
    hit = F.upper(F.regexp_extract(g.strip("value"), PREFIX, 1))
    counts = rows.withColumn("prefix", hit).filter(F.col("prefix") != "").groupBy("tab", "prefix").agg(
        F.count("*").alias("n"), F.min("row").alias("first_row")
    )
    return counts.groupBy("tab").agg(
        F.max_by(F.struct("prefix", "n"), F.struct("n", -F.col("first_row"))).alias("b")
    ).select("tab", "b.prefix", "b.n")


def header_row(cells: DataFrame) -> DataFrame:
    """The row of a tab with most non-blank cells, the first on a tie."""
    full = cells.filter(g.strip("value") != "")
    n = full.groupBy("tab", "row").agg(F.count("*").alias("n"))
    return n.groupBy("tab").agg(F.max_by("row", F.struct("n", -F.col("row"))).alias("header_row"))


def vendor_names(names: DataFrame) -> DataFrame:
    """Vendor list (slot, name) to placeholder names by slot; blanks and placeholders drop out."""
    clean = F.regexp_replace(g.strip("name"), r"\s+", " ")
    rows = names.select(clean.alias("old"), F.concat(F.lit("Vendor "), F.col("slot").cast("string")).alias("new"))
    return rows.filter((F.col("old") != "") & ~F.lower("old").startswith("vendor "))


def _replace_all(text: Column, terms: list[tuple[str, str]]) -> Column:
    for old, new in terms:
        if old:
            text = F.replace(text, F.lit(old), F.lit(new))
    return text


def apply(
    cells: DataFrame,
    terms: list[tuple[str, str]] = (),
    vendors: DataFrame | None = None,
    prefix_from: str | None = None,
    prefix_to: str = "SHW",
    header_rows: int = 2,
    rates: tuple[str, str] | None = None,
    rates_mult: float = 1.0,
) -> tuple[DataFrame, DataFrame]:
    """Scrubbed cells and the change set by category.

    In order: a whole cell that is a vendor's name becomes its placeholder; the code prefix is
    swapped in the first ``header_rows`` rows; terms are replaced one after another; numeric
    leaves of the ``rates`` (tab, column) are multiplied. A cell's category is the first rule
    that changed it. ``terms`` is the short list of a show's own words.
    """
    if vendors is None:
        rows = cells.withColumn("_v", F.lit(None).cast("string"))
    else:
        key = F.regexp_replace(g.strip("value"), r"\s+", " ")
        rows = ordered.salted_lookup(
            cells.withColumn("old", key), vendors.select("old", F.col("new").alias("_v")), ["old"], ["tab", "row", "col"]
        ).drop("old")
    named = F.coalesce("_v", "value")
    swap = (
        F.when(F.col("row") <= header_rows, F.replace(F.col("_a"), F.lit(prefix_from), F.lit(prefix_to))).otherwise(F.col("_a"))
        if prefix_from and prefix_from != prefix_to
        else F.col("_a")
    )
    rows = rows.withColumn("_a", named).withColumn("_b", swap).withColumn("_c", _replace_all(F.col("_b"), list(terms)))
    if rates is not None and rates_mult != 1.0:
        leaf = (F.col("tab").cast("string") == rates[0]) & (F.col("col") == rates[1]) & ~F.startswith("_c", F.lit("="))
        num = F.replace(F.col("_c"), F.lit(","), F.lit("")).try_cast("double")
        rows = rows.withColumn("_d", F.when(leaf & num.isNotNull(), (num * rates_mult).cast("string")).otherwise(F.col("_c")))
    else:
        rows = rows.withColumn("_d", F.col("_c"))
    steps = [("value", "_a", "vendor_name"), ("_a", "_b", "shot_code_prefix"), ("_b", "_c", "term_swap"), ("_c", "_d", "rate")]
    category = F.coalesce(*[F.when(~F.col(x).eqNullSafe(F.col(y)), F.lit(c)) for x, y, c in steps])
    rows = rows.withColumn("category", category)
    table = rows.select("tab", "row", "col", F.col("_d").alias("value"))
    changes = rows.filter(F.col("category").isNotNull()).select(
        "tab", "row", "col", F.col("value").alias("old"), F.col("_d").alias("new"), "category"
    )
    return table, changes


def clear(cells: DataFrame, rules: DataFrame, titles: DataFrame | None = None, auto_tabs: list[str] = ()) -> DataFrame:
    """Cells that stay: no data rows of the tabs ``rules`` name (tab, first_row), no title cells.

    Tabs in ``auto_tabs`` start their data below the header row found in them.
    """
    if auto_tabs:
        found = header_row(cells.filter(F.col("tab").isin(list(auto_tabs))))
        rules = rules.unionByName(found.select("tab", (F.col("header_row") + 1).alias("first_row")))
    rows = ordered.salted_lookup(cells, rules.groupBy("tab").agg(F.min("first_row").alias("_first")), ["tab"], ["row", "col"])
    kept = rows.filter(F.col("_first").isNull() | (F.col("row") < F.col("_first"))).drop("_first")
    if titles is not None:
        kept = kept.join(titles.select("tab", "row", "col").distinct(), ["tab", "row", "col"], "left_anti")
    return kept.select(*cells.columns)
