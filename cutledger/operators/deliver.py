"""Views for delivery: duration deltas, vendor clips, chosen thumbnails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutledger.functions import grammar as g


def duration_deltas(bid: DataFrame, current: DataFrame) -> DataFrame:
    """Current against bid duration by show and code; a shot without a bid shows its full length."""
    b = bid.select("show_id", "code", F.col("len_frames").alias("bid_dur"))
    c = current.select("show_id", "code", F.col("len_frames").alias("current_dur"))
    delta = F.col("current_dur") - F.coalesce("bid_dur", F.lit(0))
    colour = F.when(delta < 0, F.lit("red")).when(delta > 0, F.lit("green")).otherwise(F.lit(""))
    return c.join(b, ["show_id", "code"], "left").select(
        "show_id", "code", "bid_dur", "current_dur", delta.alias("delta"), colour.alias("colour")
    )


def in_scope(shots: DataFrame) -> DataFrame:
    """Shots vendors bid on: status VFX, whatever its case; online, omitted and practical stay out."""
    return shots.filter(F.upper(g.strip("status")) == "VFX")


def vendor_manifest(shots: DataFrame, vendors: list[str]) -> DataFrame:
    """One clip per in-scope shot and vendor, named by the master code."""
    each = F.explode(F.array(*[F.lit(v) for v in vendors]))
    rows = in_scope(shots).withColumn("vendor", each)
    return rows.withColumn("clip_name", F.concat("code", F.lit(".mp4")))


def vendor_counts(manifest: DataFrame, shots: DataFrame) -> DataFrame:
    """Clips per vendor against the number of in-scope shots, for the check before delivery."""
    want = in_scope(shots).groupBy("show_id").agg(F.count("*").alias("in_scope"))
    got = manifest.groupBy("show_id", "vendor").agg(F.count("*").alias("clips"))
    return got.join(want, "show_id").withColumn("complete", F.col("clips") == F.col("in_scope"))


def chosen_thumb(shots: DataFrame) -> DataFrame:
    """Start or end frame if selected, the middle one otherwise."""
    pick = F.lower(g.strip("chosen"))
    url = F.when(pick == "start", F.col("thumb_start")).when(pick == "end", F.col("thumb_end")).otherwise(F.col("thumb_mid"))
    return shots.withColumn("thumb", url)
