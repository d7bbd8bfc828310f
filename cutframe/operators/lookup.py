"""Lookups of frames in segments, and the timeline summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import state_step
from ..schema import FRAME, MODE_ALL, MODE_AUTO, MODE_KEEP, VIDEO, Params
from .delete_plan import clip_intervals, plan_frames, plan_pieces
from .intervals import overlaps, union
from .islands import first_wins, interval_join, spread


def segment_lookup(probes: DataFrame, pause_segments: DataFrame, speeds: DataFrame) -> DataFrame:
    """Every probe (probe_id, video_id, frame_idx) with what it is in: a pause (id, mode, boundary diff), else a speed run, else nothing. Of overlapping segments the first one counts."""
    paused = interval_join(probes, first_wins(pause_segments.select(VIDEO, "pause_id", "mode", "boundary_diff", "start", "end")), "left").drop("start", "end")
    found = interval_join(paused, first_wins(speeds.select(VIDEO, "type", "start", "end")), "left").drop("start", "end")
    kind = F.when(F.col("pause_id").isNotNull(), "pause").when(F.col("type").isNotNull(), "speed").otherwise("normal")
    return found.select("probe_id", VIDEO, FRAME, kind.alias("kind"), "pause_id", "mode", "boundary_diff", F.when(F.col("pause_id").isNull(), F.col("type")).alias("type"))


def speed_step(probes: DataFrame, speeds: DataFrame, speedup_1x: bool, speedup_02: bool, factor_02: int) -> DataFrame:
    """Frames that playback advances at every probe. Of overlapping segments the first one counts."""
    met = interval_join(probes, first_wins(speeds.select(VIDEO, "type", "start", "end")), "left")
    return met.select("probe_id", VIDEO, FRAME, F.coalesce(state_step(F.col("type"), speedup_1x, speedup_02, factor_02), F.lit(1)).alias("step"))


def timeline_buckets(plan: DataFrame, catalog: DataFrame, width: int, scroll: float = 0.0, zoom: float = 1.0) -> DataFrame:
    """Summary of the visible timeline by column: frames, frames of each state, kept frames. `plan` has frames, or parts as plan_parts gives them: those become frames after they have met the catalogue."""
    f, total = F.col(FRAME), F.col("total")
    if scroll == 0.0 and zoom == 1.0:
        bucket = F.expr(f"({FRAME} * {width}) div total")
    else:
        bucket = F.floor((f / total - F.lit(scroll)) * zoom * width)
    sized = plan.join(catalog.select(VIDEO, "total"), VIDEO)
    if "start" in plan.columns:
        sized = plan_frames(sized, "total")
    rows = sized.withColumn("bucket", bucket.cast("long")).where((F.col("bucket") >= 0) & (F.col("bucket") < width))
    count = lambda c: F.sum(c.cast("long"))
    return rows.groupBy(VIDEO, "bucket").agg(F.count(F.lit(1)).alias("frames"), *(count(F.col("state") == s).alias(f"state_{s}") for s in range(5)), count(~F.col("del")).alias("kept"))


def timeline_sums(skips: DataFrame, runs: DataFrame, catalog: DataFrame, params: Params) -> DataFrame:
    """The timeline as disjoint pieces with the sums before them: video_id, start, end, state, step (null: deleted), before (frames of each state, and kept ones).

    From it any window of the timeline is counted by two lookups a column, without frames. A row for each part of a run.
    """
    kept = plan_pieces(skips, runs, catalog, params)
    gone = overlaps(union(skips.select(VIDEO, "start", (F.col("end") - 1).alias("end"))), runs.select(VIDEO, "start", "end", "state")).withColumn("step", F.lit(None).cast("int"))
    rows = kept.unionByName(gone)
    size = F.col("end") - F.col("start") + 1
    w = Window.partitionBy(VIDEO).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0).cast("long"))
    sums = [total(F.when(F.col("state") == s, size).otherwise(0)).alias(f"state_{s}") for s in range(5)]
    return rows.select(VIDEO, "start", "end", "state", "step", F.struct(total(size).alias("frames"), *sums, total(_kept(size)).alias("kept")).alias("before"))


def _kept(frames: Column) -> Column:
    """Of a piece's first `frames` frames, those that stay."""
    return F.coalesce(F.floor((frames + F.col("step") - 1) / F.col("step")), F.lit(0)).cast("long")


def timeline_window(sums: DataFrame, catalog: DataFrame, width: int, scroll: float = 0.0, zoom: float = 1.0) -> DataFrame:
    """What timeline_buckets counts, from timeline_sums: the sums up to the two borders of each column, one taken from the other."""
    whole = scroll == 0.0 and zoom == 1.0
    guess = "greatest(0, ceil((i / ({z}D * {w}) + {s}D) * total) - 2)".format(z=float(zoom), w=width, s=float(scroll))
    reached = f"(f * {width}) div total >= i" if whole else f"floor((f / total - {float(scroll)}D) * {float(zoom)}D * {width}) >= i"
    borders = catalog.where("total > 0").select(VIDEO, "total", F.explode(F.sequence(F.lit(0), F.lit(width))).alias("i"))
    # the first frame of a column, by the rule that puts frames into columns: rounding may move it by one from where it should be
    placed = borders.select(VIDEO, "i", F.expr(f"least(total, coalesce(array_min(filter(sequence({guess}, {guess} + 4), f -> {reached})), total))").alias("_at"))
    met = interval_join(placed.withColumn(FRAME, F.col("_at") - 1), sums, "left")
    part = F.col("_at") - F.col("start")
    names = ["frames", *(f"state_{s}" for s in range(5)), "kept"]
    inside = {"frames": part, "kept": _kept(part)} | {f"state_{s}": F.when(F.col("state") == s, part).otherwise(0) for s in range(5)}
    upto = met.select(VIDEO, "i", *(F.coalesce(F.col(f"before.{n}") + inside[n], F.lit(0)).alias(n) for n in names))
    w = Window.partitionBy(VIDEO).orderBy("i")
    counted = upto.select(VIDEO, F.col("i").cast("long").alias("bucket"), *((F.lead(n).over(w) - F.col(n)).alias(n) for n in names))
    return counted.where("frames > 0")


def timeline_layers(mask: DataFrame, pause_segments: DataFrame, clips: DataFrame, catalog: DataFrame, width: int) -> DataFrame:
    """Layers of the whole timeline by column: frames in pauses by mask code and by mode, frames in clips that are kept and deleted. `mask` has codes of frames, or runs of codes.

    Clips are counted by the overlap of their parts with the columns they reach, without frame rows.
    """
    total = catalog.select(VIDEO, "total")
    moded = mask.join(pause_segments.select(VIDEO, "pause_id", "mode"), [VIDEO, "pause_id"]).join(total, VIDEO)
    coded = (spread(moded) if "start" in mask.columns else moded).withColumn("bucket", F.expr(f"({FRAME} * {width}) div total"))
    kept = clips.where("keep_in <= keep_out").select(VIDEO, F.col("keep_in").alias("start"), F.col("keep_out").alias("end"), F.lit("keep").alias("part"))
    parts = kept.unionByName(clip_intervals(clips).select(VIDEO, "start", "end", F.lit("del").alias("part"))).join(total, VIDEO)
    reached = parts.withColumn("bucket", F.explode(F.expr(f"sequence(start * {width} div total, end * {width} div total)")))
    first = F.expr(f"greatest(start, (bucket * total + {width - 1}) div {width})")
    last = F.expr(f"least(end, ((bucket + 1) * total + {width - 1}) div {width} - 1)")
    sized = reached.withColumn("n", F.greatest(last - first + 1, F.lit(0)))
    count = lambda c: F.sum(c.cast("long"))
    names = [*(f"code_{c}" for c in range(4)), *(f"mode_{m}" for m in (MODE_AUTO, MODE_KEEP, MODE_ALL)), "clip_keep", "clip_del"]
    paused = coded.groupBy(VIDEO, "bucket").agg(*(count(F.col("code") == c).alias(f"code_{c}") for c in range(4)), *(count(F.col("mode") == m).alias(f"mode_{m}") for m in (MODE_AUTO, MODE_KEEP, MODE_ALL)))
    clipped = sized.groupBy(VIDEO, "bucket").agg(*(F.sum(F.when(F.col("part") == p, F.col("n")).otherwise(0)).alias(f"clip_{p}") for p in ("keep", "del")))
    rows = paused.unionByName(clipped, allowMissingColumns=True).groupBy(VIDEO, "bucket").agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names))
    return rows.where(" OR ".join(f"{n} > 0" for n in names))
