"""Session helpers: the shared folder for checkpoints and written tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in spark.checkpoint.dir.

    Where the setting is missing, the folder lies below the warehouse, never in a machine's own
    temporary folder. On a cluster that is only right if the warehouse is shared; one that is a
    local folder there is an error.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not named:
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
        if named.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors reach; {named} is a local one")
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder."""
    return stored(df, "table")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for a table one job writes and another reads."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet below the shared folder and read it back.

    Cuts the lineage like a checkpoint, survives lost executors, and keeps column pruning,
    pushdown and statistics for what follows.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this session stored below the shared folder; call it when no result is in use."""
    folder = spark.sparkContext.getCheckpointDir()
    if folder:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for item in files.listStatus(path):
            files.delete(item.getPath(), True)
