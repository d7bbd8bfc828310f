"""Labelled export segments, their frames and their outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import segment_stem, speed_label
from ..schema import FRAME, PAUSE, VIDEO
from .islands import interval_join, joined_runs, run_bounds, spread


def export_segments(plan: DataFrame, pause_segments: DataFrame, split_by_speed: bool, merge_pause: bool) -> DataFrame:
    """(video_id, start, label, ranges): kept frames cut at deletes, pauses and, if asked, speed changes.

    With `merge_pause` all kept parts of a pause are one segment. `plan` must be without speed-ups; it has frames, or parts as delete_plan.plan_parts gives them.
    """
    paused = F.col("state") == PAUSE
    label = F.when(paused, "pause").otherwise(speed_label(F.col("state")) if split_by_speed else F.lit("normal"))
    if "start" in plan.columns:
        runs = joined_runs(plan.where("step IS NOT NULL").select(VIDEO, "start", "end", label.alias("label")), "label")
    else:
        runs = run_bounds(plan.where(~F.col("del")).select(VIDEO, FRAME, label.alias("label")), ["label"])
    alone = runs.select(VIDEO, "start", "label", F.array(F.struct(F.col("start").alias("s"), F.col("end").alias("e"))).alias("ranges"))
    if not merge_pause:
        return alone
    parts = runs.where("label = 'pause'").select(VIDEO, F.col("start").alias("s"), F.col("end").alias("e"))
    homes = interval_join(parts, pause_segments.select(VIDEO, "pause_id", "start", "end"), at="s")
    merged = homes.groupBy(VIDEO, "pause_id").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("ranges"))
    fused = merged.select(VIDEO, F.col("ranges")[0]["s"].alias("start"), F.lit("pause_merged").alias("label"), "ranges")
    return alone.where("label <> 'pause'").unionByName(fused)


def merge_adjacent_segments(segments: DataFrame) -> DataFrame:
    """Neighbours of one label, other than pauses, become one segment: their ranges are joined in order."""
    w = Window.partitionBy(VIDEO).orderBy("start")
    fresh = ~F.col("label").eqNullSafe(F.lag("label").over(w)) | F.col("label").contains("pause")
    grouped = segments.withColumn("_fresh", fresh.cast("int")).withColumn("_group", F.sum("_fresh").over(w))
    out = grouped.groupBy(VIDEO, "_group", "label").agg(F.min("start").alias("start"), F.sort_array(F.flatten(F.collect_list("ranges"))).alias("ranges"))
    return out.select(VIDEO, "start", "label", "ranges")


def segment_order(segments: DataFrame) -> DataFrame:
    """Segments numbered from 1 in time order."""
    return segments.withColumn("seg_no", F.row_number().over(Window.partitionBy(VIDEO).orderBy("start")))


def segment_manifest(numbered: DataFrame, folder: str) -> DataFrame:
    """One row for each segment: its stem and final path."""
    total = F.count(F.lit(1)).over(Window.partitionBy(VIDEO))
    named = numbered.withColumn("stem", segment_stem(F.col("seg_no"), total, F.col("label")))
    return named.select(VIDEO, "seg_no", "label", "stem", F.format_string("%s/%s.mp4", F.lit(folder), F.col("stem")).alias("path"), F.size("ranges").cast("long").alias("n_ranges"))


def to_half_open(segments: DataFrame) -> DataFrame:
    """Segments with half-open ranges and the number of frames they ask for; none gives an empty list and 0."""
    return segments.withColumns({
        "requested": F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["e"] + 1 - r["s"]),
        "half_open": F.transform("ranges", lambda r: F.struct(r["s"].alias("s"), (r["e"] + 1).alias("e"))),
    })


def segment_frames(numbered: DataFrame, present: DataFrame) -> DataFrame:
    """Frames of segments, range by range; a range stops before its first frame that is not present: it is written to the end of the run of present frames that holds its start."""
    return spread(_reached(numbered, present), "s", "_to").select(VIDEO, "seg_no", "range_no", FRAME)


def _reached(numbered: DataFrame, present: DataFrame) -> DataFrame:
    """Ranges of segments (video_id, seg_no, range_no, s) with the last frame that is written, _to. `present` has frames, or maximal runs of frames (start, end)."""
    asked = numbered.select(VIDEO, "seg_no", F.posexplode("ranges").alias("range_no", "r")).select(VIDEO, "seg_no", "range_no", F.col("r.s").alias("s"), F.col("r.e").alias("e"))
    runs = present.select(VIDEO, "start", "end") if "start" in present.columns else run_bounds(present.select(VIDEO, FRAME), [])
    return interval_join(asked, runs, at="s").select(VIDEO, "seg_no", "range_no", "s", F.least("e", "end").alias("_to"))


def segment_summary(numbered: DataFrame, present: DataFrame) -> DataFrame:
    """For each segment: frames asked for, frames written, and success. A range is written from its start to the end of the run of present frames that holds it."""
    written = _reached(numbered, present).groupBy(VIDEO, "seg_no").agg(F.sum(F.col("_to") - F.col("s") + 1).alias("written"))
    asked = to_half_open(numbered).select(VIDEO, "seg_no", "label", "requested")
    joined = asked.join(written, [VIDEO, "seg_no"], "left").withColumn("written", F.coalesce("written", F.lit(0).cast("long")))
    return joined.withColumn("success", F.col("written") > 0)


def export_totals(summary: DataFrame) -> DataFrame:
    return summary.groupBy(VIDEO).agg(F.sum(F.col("success").cast("long")).alias("succeeded"), F.sum((~F.col("success")).cast("long")).alias("failed"))


def first_failures(summary: DataFrame, limit: int = 3, width: int = 500) -> DataFrame:
    """The first failures of each video with a message cut to `width` characters."""
    rank = F.row_number().over(Window.partitionBy(VIDEO).orderBy("seg_no"))
    failed = summary.where(~F.col("success")).withColumn("_rank", rank).where(F.col("_rank") <= limit)
    return failed.select(VIDEO, "seg_no", F.substring(F.format_string("%s: wrote 0 of %d frames", "label", "requested"), 1, width).alias("error"))
