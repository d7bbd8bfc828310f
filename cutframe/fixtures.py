"""Frame-timeline inputs derived from the driver's tables: every user is a video, every event a stretch of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .schema import FRAME, VIDEO


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, frame_idx, state, signal (a one-pixel frame), diff.

    Events are put in order, not frames: an event knows how many frames are before it and the signal that the one before ends with, so its frames are made where it lies.
    Rows that repeat an event share its frames out in turn.
    """
    size = 2 + (F.col("event_id") * 7) % 23
    state = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "error", 4).otherwise(0)
    signal = lambda k: F.floor("value").cast("long") % 250 + F.when((F.col("event_id") % 3 > 0) & ((F.col("event_id") + k) % 9 == 0), 4).otherwise(0)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id", "value", "event_type")
    same = Window.partitionBy("user_id", "ts", "event_id")
    ordered = events(spark, sf_dir).where("event_id IS NOT NULL").select("user_id", "ts", "event_id", "event_type", "value").withColumns({
        "_before": F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_prior": F.lag(signal(size - 1)).over(w),
        "_copy": F.row_number().over(same.orderBy("value", "event_type")) - 1, "_copies": F.count(F.lit(1)).over(same),
    })
    held = ordered.select("*", F.explode(F.sequence(F.lit(0), (size - 1).cast("int"))).alias("k"))
    earlier = F.when(F.col("_copy") > 0, signal(F.col("k"))).when(F.col("k") == 0, F.col("_prior")).otherwise(signal(F.col("k") - 1))
    place = F.col("_before") - F.col("_copy") * size + F.col("k") * F.col("_copies") + F.col("_copy")
    return held.select(F.col("user_id").alias(VIDEO), place.cast("long").alias(FRAME), state.cast("tinyint").alias("state"), signal(F.col("k")).alias("signal"), F.coalesce(F.abs(signal(F.col("k")) - earlier), F.lit(0)).cast("float").alias("diff"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, total, fps."""
    sizes = events(spark, sf_dir).groupBy(F.col("user_id").alias(VIDEO)).agg(F.sum(2 + (F.col("event_id") * 7) % 23).alias("total"))
    kind = F.col(VIDEO) % 4
    return sizes.withColumn("fps", F.when(kind == 0, F.lit(24.0)).when(kind == 1, F.lit(29.97)).when(kind == 2, F.lit(30.0)).otherwise(F.lit(60.0)))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 gray frames: video_id, frame_idx, w, h, label, px."""
    level = lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(x.cast("double") * 256).cast("int") + 128))
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vectors.select(F.floor(F.col("vec_id") / 50).alias(VIDEO), (F.col("vec_id") % 50).alias(FRAME), F.lit(8).alias("w"), F.lit(8).alias("h"), "label", F.transform("embedding", level).alias("px"))


def stills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames as 16 x 16 BGR stills: each pixel four times, in three equal channels, as bytes."""
    wide = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.lpad(F.hex(F.get("px", (F.floor(i / 32) * 8 + F.floor(i % 16 / 2)).cast("int"))), 2, "0"))
    bytes_of = F.unhex(F.array_join(F.transform(wide, lambda p: F.repeat(p, 3)), ""))
    return pixels(spark, sf_dir).select(VIDEO, FRAME, F.lit(16).alias("w"), F.lit(16).alias("h"), F.lit(3).alias("channels"), bytes_of.alias("px"))


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 4 x 4 patch at (2, 2) of the first frame of each label."""
    first = pixels(spark, sf_dir).groupBy("label").agg(F.min_by("px", F.col(VIDEO) * 50 + F.col(FRAME)).alias("src"))
    cut = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.get(F.col("src"), ((2 + F.floor(i / 4)) * 8 + 2 + i % 4).cast("int")))
    kind = F.col("label") % 4
    named = F.when(kind == 0, "pause").when(kind == 1, "speed_1x").when(kind == 2, "speed_2x").otherwise("speed_0_2x")
    rows = first.withColumn("t", cut)
    return rows.select(F.col("label").alias("template_id"), named.alias("class"), *(F.lit(v).alias(n) for n, v in (("roi_x", 0), ("roi_y", 0), ("roi_w", 8), ("roi_h", 8), ("t_w", 4), ("t_h", 4), ("src_w", 8), ("src_h", 8))), "src", "t", F.transform("t", lambda v: F.when(v > 100, 1).otherwise(0)).alias("m"))


def color(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four BGR pixels an event."""
    return events(spark, sf_dir).select("event_id", F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: ((F.col("event_id") * 31 + i * 57) % 256).cast("int")).alias("bgr"))


def _with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", F.col("user_id").alias(VIDEO)).join(catalog(spark, sf_dir), VIDEO)


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_total(spark, sf_dir).select(F.col("event_id").alias("probe_id"), VIDEO, F.expr("event_id * 31 % total").alias(FRAME))


def delete_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_total(spark, sf_dir).where("event_id % 7 = 0").select(VIDEO, F.expr("event_id * 11 % (total + 50) - 25").alias(FRAME)).distinct()


def mode_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(F.col("event_id") % 3 == 0, "keep").when(F.col("event_id") % 3 == 1, "auto").otherwise("all")
    return _with_total(spark, sf_dir).where("event_id % 5 = 0").select(VIDEO, F.col("event_id").alias("seq"), F.expr("event_id * 37 % total").alias(FRAME), mode.alias("mode"))


def toggle_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_total(spark, sf_dir).where("event_id % 5 = 3").select(VIDEO, F.col("event_id").alias("seq"), F.expr("event_id * 41 % total").alias(FRAME))


def bulk_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of all pauses of a video, between the others."""
    mode = F.when(F.col("event_id") % 3 == 0, "auto").when(F.col("event_id") % 3 == 1, "keep").otherwise("all")
    return events(spark, sf_dir).where("event_id % 25 = 7").select(F.col("user_id").alias(VIDEO), F.col("event_id").alias("seq"), mode.alias("mode"))


def clip_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.floor(F.col("event_id") / 10) % 2 == 0, "in").otherwise("out")
    return _with_total(spark, sf_dir).where("event_id % 2 = 1").select(VIDEO, F.col("event_id").alias("seq"), F.expr("event_id * 53 % total").alias("anchor_idx"), side.alias("side"), F.expr("event_id * 53 % total + event_id * 13 % 41 - 20").alias("tf"))
