"""Incremental intake of new cuts."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

from pyarrow import fs
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cutledger.operators import audit, qc
from cutledger.schema import POSITIONS
from cutledger.sources import scenes

K = ["show_id", "cut_id"]
#: Folders that a batch deals its shows to, so that a file holds many cuts and a cut that comes again is one of few there.
PARTS = 32
#: Spark's setting for the number of tasks that list folders.
LISTERS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def stream(spark: SparkSession, path: str, checkpoint: str, sink: str, cuts: DataFrame, files: int = 1000) -> StreamingQuery:
    """Turn scene files that arrived since the last run into shots, flags and fps guard rows.

    A micro-batch takes ``files`` files at most, and so touches no more cuts than that. Parsed rows
    are kept in ``arrived``, one folder per batch, so a batch that is repeated after a failure
    replaces itself; an empty folder per cut and batch in ``seen`` tells where rows of a cut are.
    Each batch runs the batch operators over all rows that its cuts have so far, read from the
    folders named there alone, and writes the results into a few folders of its own; what its cuts
    had in folders of earlier batches is taken out there. The outcome does not depend on how files
    fall into batches, and a batch costs what its cuts hold and, where cuts come again, what lies
    in one folder with them, however much was delivered before.
    """
    lines = (
        _lister(spark).readStream.option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files)
        .text(path)
        .select("value", F.col("_metadata.file_path").alias("path"))
    )

    def intake(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        batch.persist()
        touched = _keyed(batch.select("path").distinct()).select(*K).distinct().persist()
        some = [tuple(r) for r in touched.select(*K, _part()).collect()]  # no more than there are files in a batch
        fresh = dict(zip(("arrived", "unread"), scenes.parse(batch), strict=True))
        _at_once(own, *[partial(_write, _keyed(rows), f"{sink}/{name}", batch_id) for name, rows in fresh.items()])
        _note(f"{sink}/seen", some, batch_id)
        places = _places(f"{sink}/seen", _folders(own, f"{sink}/seen", some), {c[:2]: c[2] for c in some}, batch_id)
        so_far = [_so_far(own, f"{sink}/{name}", rows, places, touched) for name, rows in fresh.items()]
        known = cuts.join(touched, K, "left_semi").persist()
        judged = scenes.judged(so_far[0], known).persist()
        shots, rejects = scenes.parted(judged, so_far[1])
        before = [x for x in places if x[0] < batch_id]
        shots = _replace(shots, f"{sink}/shots", batch_id, before, touched)
        # No pictures come with scene files, so no shot has hashes.
        hashes = shots.select(*K, "tcid", *[F.lit(None).cast("bigint").alias(f"a_{p}") for p in POSITIONS]).limit(0)
        arrived = shots.select("show_id").distinct()
        guard = audit.fps_guard(cuts.join(arrived, "show_id", "left_semi"))
        _at_once(
            own,
            lambda: _replace(qc.suspects(shots, hashes), f"{sink}/qc_flags", batch_id, before, touched),
            lambda: _replace(_keyed(rejects), f"{sink}/rejects", batch_id, before, touched),
            lambda: _replace(guard, f"{sink}/fps_guard", batch_id, _places_of_shows(f"{sink}/seen", some, batch_id), arrived),
        )
        for df in (judged, known, touched, batch):
            df.unpersist()

    return (
        lines.writeStream.foreachBatch(intake)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _lister(spark: SparkSession) -> SparkSession:
    """A session with the same settings, but that listing one folder is no work for a task of its own."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set(LISTERS, min(int(spark.conf.get(LISTERS)), 4 * spark.sparkContext.defaultParallelism))
    return own


def _at_once(spark: SparkSession, *steps: Callable[[], object]) -> None:
    """Steps that do not build on each other: small jobs, of which one alone leaves most cores idle."""
    with ThreadPoolExecutor(len(steps)) as pool:
        for done in [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]:
            done.result()


def _keyed(rows: DataFrame) -> DataFrame:
    """With the cut that the path names, null where it names none."""
    return rows.withColumns({k: F.regexp_extract("path", scenes.CUT_KEY, i + 1).try_cast("bigint") for i, k in enumerate(K)})


def _part() -> Column:
    return F.pmod(F.xxhash64(F.col("show_id").cast("bigint")), F.lit(PARTS)).cast("int").alias("part")


def _write(rows: DataFrame, path: str, batch_id: int) -> DataFrame:
    """The rows as the folder of a batch, in place of what a failed try left there, and read back."""
    out = rows.withColumn("part", _part()).hint("rebalance", "part").write.mode("overwrite")
    out.option("partitionOverwriteMode", "static").partitionBy("part").parquet(f"{path}/batch={batch_id}")
    schema = ", ".join([f"{c} {t}" for c, t in rows.dtypes] + ["part int"])
    return rows.sparkSession.read.schema(schema).parquet(f"{path}/batch={batch_id}").select(*rows.columns)


def _there(store: fs.FileSystem, folders: list[str]) -> list[bool]:
    """Which of the folders exist, by one call for all."""
    return [x.type == fs.FileType.Directory for x in store.get_file_info(folders)]


def _cut_folder(root: str, cut: tuple) -> str:
    return "/".join([root, *map(scenes.folder_name, K, cut)])


def _folders(spark: SparkSession, path: str, some: list[tuple]) -> list[str]:
    """Folders of the given cuts below ``path``, those that exist."""
    store, root = fs.FileSystem.from_uri(path)
    every = [_cut_folder(root, cut) for cut in some]
    return [x for x, there in zip(every, _there(store, every), strict=True) if there]


def _note(path: str, some: list[tuple], batch_id: int) -> None:
    """An empty folder per cut of the batch."""
    store, root = fs.FileSystem.from_uri(path)
    for cut in some:
        store.create_dir(f"{_cut_folder(root, cut)}/batch={batch_id}", recursive=True)


def _batches(store: fs.FileSystem, folder: str) -> list[int]:
    """Batches that the folder of a cut in ``seen`` names."""
    return [int(x.base_name.split("=")[1]) for x in store.get_file_info(fs.FileSelector(folder, allow_not_found=True))]


def _places(path: str, folders: list[str], parts: dict[tuple, int], batch_id: int) -> list[tuple[int, int]]:
    """Batch and part, up to this batch, of all rows of the cuts that the folders of ``seen`` are of."""
    store, root = fs.FileSystem.from_uri(path)
    of = {_cut_folder(root, cut): part for cut, part in parts.items()}
    got = {(b, of[x]) for x in folders for b in _batches(store, x)}
    return sorted(p for p in got if p[0] <= batch_id)


def _places_of_shows(path: str, some: list[tuple], batch_id: int) -> list[tuple[int, int]]:
    """Batch and part of all earlier batches with any cut of the shows."""
    (store, root), got = fs.FileSystem.from_uri(path), set()
    for show, part in {(c[0], c[2]) for c in some}:
        cuts = store.get_file_info(fs.FileSelector(f"{root}/{scenes.folder_name('show_id', show)}", allow_not_found=True))
        got |= {(b, part) for cut in cuts for b in _batches(store, cut.path)}
    return sorted(p for p in got if p[0] < batch_id)


def _stored(spark: SparkSession, path: str, like: DataFrame, places: list[tuple[int, int]]) -> tuple[DataFrame | None, list[str]]:
    """Rows of these places below ``path``, None if there is none, and the folders that exist."""
    store, root = fs.FileSystem.from_uri(path)
    tails = [f"batch={b}/part={p}" for b, p in places]
    folders = [f"{path}/{x}" for x, there in zip(tails, _there(store, [f"{root}/{x}" for x in tails]), strict=True) if there]
    if not folders:
        return None, []
    schema = ", ".join([f"{c} {t}" for c, t in like.dtypes] + ["batch bigint", "part int"])
    return spark.read.schema(schema).option("basePath", path).parquet(*folders), folders


def _among(rows: DataFrame, touched: DataFrame, how: str) -> DataFrame:
    """Rows of the touched cuts, or of others; a file that names no cut counts as of one."""
    keys = [F.col(f"rows.{k}").eqNullSafe(F.col(f"touched.{k}")) for k in touched.columns]
    return rows.alias("rows").join(touched.alias("touched"), reduce(lambda a, b: a & b, keys), how)


def _so_far(spark: SparkSession, path: str, like: DataFrame, places: list[tuple[int, int]], touched: DataFrame) -> DataFrame:
    """Rows of the touched cuts from all batches up to this one, with the columns of ``like``."""
    keyed = _keyed(like)
    rows = _stored(spark, path, keyed, places)[0]
    if rows is None:
        return spark.createDataFrame([], like.schema)
    return _among(rows, touched, "left_semi").select(*like.columns)


def _replace(rows: DataFrame, path: str, batch_id: int, before: list[tuple[int, int]], touched: DataFrame) -> DataFrame:
    """Write the rows, and take those of the touched cuts out of the places they had before; the rows read back."""
    spark = rows.sparkSession
    new = _write(rows, path, batch_id)
    had, folders = _stored(spark, path, rows, before)
    if had is None:
        return new
    kept = _among(had, touched, "left_anti")
    full = {f"{path}/batch={r['batch']}/part={r['part']}" for r in kept.select("batch", "part").distinct().collect()}
    kept.hint("rebalance", "batch", "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "part").parquet(path)
    for folder in folders:
        if folder not in full:
            store, at = fs.FileSystem.from_uri(folder)
            store.delete_dir(at)
    return new


def once(events: DataFrame, keys: list[str], time: str, horizon: str) -> DataFrame:
    """Drop repeated deliveries of a key that come within the horizon of the first."""
    return events.withWatermark(time, horizon).dropDuplicatesWithinWatermark(keys)
