"""Scene lists: CSV files with a preamble, a named header row and one row per shot."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cutledger.functions import timecode as tc
from cutledger.operators import ordered

K = ["show_id", "cut_id"]
# The columns of the format.
HEADER = [
    "Scene Number",
    "Start Frame",
    "Start Timecode",
    "Start Time (seconds)",
    "End Frame",
    "End Timecode",
    "End Time (seconds)",
    "Length (frames)",
    "Length (timecode)",
    "Length (seconds)",
]
CUT_KEY = r"show_id=(\d+)/cut_id=(\d+)/"


def raw_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of all files with the file as key."""
    reader = spark.read.option("recursiveFileLookup", "true")
    return reader.text(paths).select("value", F.col("_metadata.file_path").alias("path"))


def cells_of(line: Column) -> Column:
    """All cells of a line, however many: commas inside quotes do not part them."""
    parts = F.split(line, ',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    return F.transform(parts, lambda c: F.replace(F.regexp_replace(F.trim(c), '^"|"$', ""), F.lit('""'), F.lit('"')))


def parse(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shots and rejects (path, reason) of raw lines.

    Cells are found by the header row of their own file. A file without one is rejected.
    """
    first = F.trim(F.replace(F.substring_index("value", ",", 1), F.lit('"'), F.lit("")))
    heads = lines.filter(first == HEADER[0]).groupBy("path").agg(F.min(cells_of(F.col("value"))).alias("_head"))
    # Where each column stands is looked up once per file; of a line only the cells asked for are cleaned.
    place = [F.array_position("_head", F.lit(name)).cast("int").alias(name) for name in HEADER]
    heads = heads.select("path", F.struct(*place).alias("_at"))
    quoted = F.contains("value", F.lit('"'))
    rows = lines.filter(first.rlike(r"^[0-9]+$")).withColumns(
        {"_quoted": quoted, "_cells": F.when(quoted, cells_of(F.col("value"))).otherwise(F.split("value", ","))}
    )
    rows = ordered.salted_lookup(rows, heads, ["path"], ["value"])

    def cell(name: str) -> Column:
        at = F.col("_at")[name]
        got = F.get("_cells", at - 1)
        return F.when(at > 0, F.when(F.col("_quoted"), got).otherwise(F.trim(got)))

    good = rows.filter(F.col("_at").isNotNull())
    shots = good.select(
        "path",
        cell("Scene Number").try_cast("bigint").alias("seq"),
        cell("Start Frame").try_cast("bigint").alias("start_frame"),
        cell("End Frame").try_cast("bigint").alias("end_frame"),
        cell("Length (frames)").try_cast("bigint").alias("len_frames"),
        cell("Start Time (seconds)").try_cast("double").alias("start_s"),
        cell("End Time (seconds)").try_cast("double").alias("end_s"),
        cell("Start Timecode").alias("start_tc"),
        cell("End Timecode").alias("end_tc"),
        cell("Length (seconds)").try_cast("double").alias("duration_s"),
    )
    no_head = lines.select("path").distinct().join(heads.select("path"), "path", "left_anti")
    return shots, no_head.select("path", F.lit("no header row").alias("reason"))


def precedence(paths: DataFrame) -> DataFrame:
    """One scene list per movie: scenes/, then scenes_transnet/, then any other.

    ``paths``: stem, path. Within a folder the exact ``<stem>-Scenes.csv`` beats other names.
    """
    exact = F.col("path").endswith(F.concat(F.col("stem"), F.lit("-Scenes.csv")))
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    rank = (
        F.when(exact & (folder == "scenes"), 0)
        .when(exact & (folder == "scenes_transnet"), 1)
        .when(folder == "scenes", 2)
        .when(folder == "scenes_transnet", 3)
        .otherwise(4)
    )
    usable = paths.filter(F.col("path").rlike(r"Scenes[^/]*\.csv$"))
    return ordered.pick(usable.withColumn("priority", rank), ["stem"], ["priority", "path"])


def scan_scenes(
    spark: SparkSession, paths: str | list[str], cuts: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Shots of all cuts below ``paths`` and the rejects.

    Files lie in ``show_id=../cut_id=../``. A tcid that occurs twice in a cut goes to the
    rejects with all its rows, since every later join relies on it. So do rows of a cut whose frame
    rate is unknown: without one there is no tcid.
    """
    return key_shots(*parse(raw_lines(spark, paths)), cuts)


def key_shots(shots: DataFrame, rejects: DataFrame, cuts: DataFrame) -> tuple[DataFrame, DataFrame]:
    return parted(judged(shots, cuts), rejects)


def judged(shots: DataFrame, cuts: DataFrame) -> DataFrame:
    """Parsed rows with cut, rate and tcid, and ``_why`` a row cannot be a shot, null where it can."""
    rows = shots.withColumns({k: F.regexp_extract("path", CUT_KEY, i + 1).cast("bigint") for i, k in enumerate(K)})
    rows = ordered.salted_lookup(rows, cuts.select(*K, "fps"), K, ["seq"])
    rows = rows.withColumn("tcid", tc.tcid_from_tc("start_tc", F.col("fps")))
    # A row without a full key is like no other, and one without a rate has no key.
    unknown = F.col("fps").isNull()
    full = F.col("show_id").isNotNull() & F.col("cut_id").isNotNull() & F.col("tcid").isNotNull()
    twice = full & (F.count("*").over(Window.partitionBy(*K, "tcid", unknown)) > 1)
    why = F.when(unknown, F.lit("unknown frame rate")).when(twice, F.concat(F.lit("duplicate tcid "), "tcid"))
    return rows.withColumn("_why", why)


def parted(rows: DataFrame, rejects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shots, and the rejects with those of the judged rows."""
    cols = [*K, "tcid", "seq", "start_frame", "end_frame", "len_frames", "start_s", "end_s", "start_tc", "end_tc", "duration_s", "fps"]
    good, bad = rows.filter(F.col("_why").isNull()), rows.filter(F.col("_why").isNotNull())
    return good.select(*cols), rejects.unionByName(bad.select("path", F.col("_why").alias("reason")))


def write_scenes(shots: DataFrame, path: str, block: int = ordered.BLOCK_ROWS) -> None:
    """Write scene lists below ``path``, one folder per cut.

    A file holds up to ``block`` shots behind its own header, so a long cut is several files and
    no task writes a whole cut of unbounded size. ``shots`` carry seconds and timecodes. Tasks write
    their files themselves, one after the other, so a library of many cuts costs no job step per
    file; a task that is repeated writes the same files again.
    """
    store, root = fs.FileSystem.from_uri(path)
    if store.get_file_info(root).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    store.create_dir(root, recursive=True)
    three = lambda c: F.format_string("%.3f", c)
    line = F.concat_ws(
        ",",
        F.col("seq").cast("string"),
        F.col("start_frame").cast("string"),
        "start_tc",
        three("start_s"),
        F.col("end_frame").cast("string"),
        "end_tc",
        three("end_s"),
        F.col("len_frames").cast("string"),
        tc.seconds_tc("duration_s"),
        three("duration_s"),
    )
    blk = F.floor((F.col("seq") - 1) / block).alias("block")
    body = shots.select(*K, blk, F.col("seq").alias("n"), line.alias("value"))
    files = body.repartition(*K, "block").sortWithinPartitions(*K, "block", "n")

    def run(batches):
        here, out, n = None, None, 0
        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for *key, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != here:
                    if out is not None:
                        out.close()
                    here, n = key, n + 1
                    folder = "/".join([root, *(folder_name(*kv) for kv in zip([*K, "block"], key, strict=True))])
                    store.create_dir(folder, recursive=True)
                    out = store.open_output_stream(f"{folder}/scenes.txt")
                    out.write(f"Timecode List:\n{','.join(HEADER)}\n".encode())
                out.write(f"{value}\n".encode())
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pydict({"n": [n]})

    files.select(*K, "block", "value").mapInArrow(run, "n bigint").agg(F.sum("n")).collect()


def folder_name(key: str, value: int | None) -> str:
    """A folder of a table partitioned by ``key``, as Spark names it."""
    return f"{key}={'__HIVE_DEFAULT_PARTITION__' if value is None else value}"
