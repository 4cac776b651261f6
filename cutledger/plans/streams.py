"""Queries that run a stream to its end and return what it left."""

from pyspark.sql import functions as F

from cutledger.plans import derive as d
from cutledger.plans.intake import _COLS, SCANNED, written_scenes
from cutledger.plans.registry import query
from cutledger.session import scratch_path
from cutledger.streaming import intake


@query("k01_incremental_intake", SCANNED)
def k01(spark, sf):
    src, sink = written_scenes(spark, sf), scratch_path(spark, "intake")
    run = intake.stream(spark, src, scratch_path(spark, "intake-log"), sink, d.cuts(spark, sf).withColumn("arrival_seq", F.col("cut_id")))
    run.awaitTermination()
    shots = spark.read.option("basePath", f"{sink}/shots").parquet(f"{sink}/shots")
    return shots.select(*[F.col(c).cast("bigint").alias(c) if c in ("show_id", "cut_id") else F.col(c) for c in _COLS])


def _deliveries(spark, sf, path):
    """Events in five deliveries in order of time, the third of them twice, several files each."""
    e = d.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    span = e.agg(F.min("ts").cast("double"), F.max("ts").cast("double")).first()
    step = ((span[1] or 0.0) - (span[0] or 0.0)) / 5 + 1
    part = F.floor((F.col("ts").cast("double") - F.lit(span[0])) / step)
    parts = d.stored(e.withColumn("part", part))
    for n in (0, 1, 2, 2, 3, 4):
        parts.filter(F.col("part") == n).drop("part").repartition(4, "event_id").write.mode("append").parquet(path)
    return e.schema


def guarded(spark, sf, horizon="3 days"):
    """The guard over these deliveries: what it left, and its last progress."""
    path, out = scratch_path(spark, "events"), scratch_path(spark, "events-once")
    live = spark.readStream.schema(_deliveries(spark, sf, path)).option("maxFilesPerTrigger", 4).parquet(path)
    run = (
        intake.once(live, ["event_id"], "ts", horizon)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", scratch_path(spark, "events-log"))
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.parquet(out).select("event_id", "user_id", "event_type", "value"), run.lastProgress


@query("k02_delivery_guard", "SELECT event_id, user_id, event_type, value FROM events")
def k02(spark, sf):
    """Events arrive in order of time, a part of them twice; the guard forgets what is three days old."""
    return guarded(spark, sf)[0]
