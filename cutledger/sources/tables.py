"""Tables whose columns are found by header name."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutledger.functions import grammar as g
from cutledger.functions import timecode as tc
from cutledger.operators import ordered

# Names one column may go by.
ALIASES = [
    {"note", "status"},
    {"scene", "suggested_scene"},
    {"file_tc_in", "tc_in"},
    {"file_tc_out", "tc_out"},
    {"file_tc_id", "tc_id"},
]
CANDIDATES = {
    "temp_code": ["Temp Cut4 Shot Code"],
    "tc_in": ["TC In"],
    "duration": ["Duration"],
    "thumbnail": ["Thumbnail"],
    "status": ["Status"],
    "scene": ["Scene"],
    "slate": ["Slate"],
    "take": ["Take"],
    "slate_takes": ["Slate Takes"],
    "shot_code": ["Shot Code"],
    "vfx_note": ["VFX Notes", "VFX Note"],
    "real_tc_in": ["Real TC In"],
    "real_tc_out": ["Real TC Out"],
    "description": ["Description", "Short Description"],
    "dialogue": ["Dialogue"],
}


def norm_header(name: str) -> str:
    return re.sub(r"\s+", "_", str(name).strip().lower())


def resolve(columns: list[str], fields: dict[str, list[str]], aliases: bool = True) -> dict[str, str]:
    """Field to actual column: the first candidate present, else an alias of one."""
    have: dict[str, str] = {}
    for c in columns:
        have.setdefault(norm_header(c), c)
    found = {}
    for field, names in fields.items():
        wanted = [norm_header(n) for n in names]
        if aliases:
            wanted += [a for n in wanted for group in ALIASES if n in group for a in sorted(group)]
        hit = next((have[n] for n in wanted if n in have), None)
        if hit is not None:
            found[field] = hit
    return found


def by_header(df: DataFrame, fields: dict[str, list[str]], required: list[str] = (), keep: list[str] = ()) -> DataFrame:
    """Select fields by header; an absent optional one is null, an absent required one fails."""
    found = resolve(df.columns, fields)
    missing = [f for f in required if f not in found]
    if missing:
        raise ValueError(f"columns not found: {missing}; present: {df.columns[:20]}")
    cols = [F.col(f"`{found[f]}`").alias(f) if f in found else F.lit(None).cast("string").alias(f) for f in fields]
    return df.select(*keep, *cols)


def read_by_header(
    spark: SparkSession, paths: str | list[str], fields: dict[str, list[str]], required: list[str] = ()
) -> DataFrame:
    return by_header(spark.read.option("header", True).option("multiLine", False).csv(paths), fields, required)


def new_shots(df: DataFrame, keep: list[str] = ("show_id",), position: str = "input_pos") -> DataFrame:
    """Shots of a new cut; an order that is no number falls back to the input position."""
    rows = by_header(df, {"tcid": ["tcid"], "code": ["code"], "order": ["order"]}, ["tcid"], [*keep, position])
    order = F.when(g.strip("order").rlike("^[0-9]+$"), g.strip("order").try_cast("bigint"))
    return rows.select(
        *keep, g.strip("tcid").alias("tcid"), g.strip("code").alias("code"), F.coalesce(order, position).alias("order"), position
    )


def master_rows(df: DataFrame, keep: list[str] = ("show_id",), position: str = "input_pos") -> DataFrame:
    """Master list; the row id may be called row, id or master_row, else the position stands in."""
    fields = {"row": ["row", "id", "master_row"], "code": ["code"], "revision": ["revision"]}
    rows = by_header(df, fields, [], [*keep, position])
    row = F.coalesce(g.strip("row").try_cast("bigint"), position) if "row" in resolve(df.columns, fields) else F.col(position)
    return rows.select(
        *keep, row.alias("row"), g.strip("code").alias("code"), F.coalesce("revision", F.lit("")).alias("revision"), position
    )


def row_index(sheet: DataFrame, code: str, keep: list[str] = ("show_id",), row: str = "row") -> DataFrame:
    """Normalized key to sheet row; blanks drop out and a repeated key keeps its last row."""
    key = tc.norm_tcid(tc.tcid_of(g.strip(code)))
    rows = sheet.filter(g.strip(code) != "").select(*keep, key.alias("key"), F.col(row).alias("row"))
    return rows.groupBy(*keep, "key").agg(F.max("row").alias("row"))


def usable_tcid(df: DataFrame) -> DataFrame:
    return df.withColumn("tcid", g.strip("tcid")).filter(F.col("tcid") != "")


def last_per_key(df: DataFrame, key: list[str], position: str) -> DataFrame:
    """Drop blank tcids and keep the last row of every key by input position."""
    return ordered.pick(usable_tcid(df), key, [position], last=True)
