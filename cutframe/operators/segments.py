"""Frame facts to segments: runs, pauses with their masks and modes, speed runs and clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalar import still_frames
from ..schema import AUTO_DELETE, AUTO_KEEP, FRAME, MODE_ALL, MODE_AUTO, PAUSE, SPEEDS, VIDEO, Params
from .islands import interval_join, run_bounds, spread


def _pause_window() -> WindowSpec:
    return Window.partitionBy(VIDEO, "pause_id").orderBy(FRAME)


def frame_spine(catalog: DataFrame, facts: DataFrame) -> DataFrame:
    """Every frame 0..total-1 of every video; frames without facts have state 0 and diff 0."""
    spine = catalog.where("total > 0").select(VIDEO, F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1)).alias(FRAME))
    joined = spine.join(facts.select(VIDEO, FRAME, "state", "diff"), [VIDEO, FRAME], "left")
    return joined.select(VIDEO, FRAME, F.coalesce("state", F.lit(0).cast("tinyint")).alias("state"), F.coalesce("diff", F.lit(0).cast("float")).alias("diff"))


def frame_diff(frames: DataFrame, pixels: str = "px") -> DataFrame:
    """Mean absolute difference to the frame before, as float; 0 at a video's first frame. For small payloads; see pixels.chunked_frame_diff."""
    from ..functions.scalar import pixel_mad

    w = Window.partitionBy(VIDEO).orderBy(FRAME)
    before = F.lag(pixels).over(w)
    return frames.withColumn("_before", before).select(VIDEO, FRAME, F.when(F.col("_before").isNull(), 0.0).otherwise(pixel_mad(F.col(pixels), F.col("_before"))).cast("float").alias("diff"))


def state_runs(facts: DataFrame) -> DataFrame:
    """Maximal runs of one state: video_id, state, start, end."""
    return run_bounds(facts, ["state"])


def dense_ids(segments: DataFrame, name: str) -> DataFrame:
    """Ids 0..n-1 per video by start."""
    return segments.withColumn(name, (F.row_number().over(Window.partitionBy(VIDEO).orderBy("start")) - 1).cast("int"))


def pauses(runs: DataFrame) -> DataFrame:
    """Pause runs with their ids: video_id, pause_id, start, end."""
    return dense_ids(runs.where(F.col("state") == PAUSE), "pause_id").select(VIDEO, "pause_id", "start", "end")


def speed_segments(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("state").isin(*SPEEDS)).select(VIDEO, F.col("state").alias("type"), "start", "end")


def pause_frames(pause_segments: DataFrame, facts: DataFrame) -> DataFrame:
    """The frames of every pause with their diffs: video_id, pause_id, start, end, frame_idx, diff."""
    return spread(pause_segments.select(VIDEO, "pause_id", "start", "end")).join(facts.select(VIDEO, FRAME, "diff"), [VIDEO, FRAME], "left").withColumn("diff", F.coalesce("diff", F.lit(0).cast("float")))


def motion_mask(frames: DataFrame, motion_thresh: float) -> DataFrame:
    """Adds `active`: a frame after a pause's first with a diff above the bound makes itself and the frame before active."""
    hot = (F.col("diff") > F.lit(motion_thresh).cast("float")) & (F.col(FRAME) > F.col("start"))  # compared as floats
    return frames.withColumn("_hot", hot).withColumn("active", F.col("_hot") | F.coalesce(F.lead("_hot").over(_pause_window()), F.lit(False))).drop("_hot")


def still_trim(masked: DataFrame, catalog: DataFrame, still_time: float) -> DataFrame:
    """Mask codes of frames with `active`: what exceeds the still stretch that each inactive run of a pause keeps is deleted.

    A run at the pause's start keeps its tail, one at its end its head, one in between half at each side; a pause without
    any activity keeps a stretch at both ends.
    """
    whole = Window.partitionBy(VIDEO, "pause_id")
    stepped = masked.withColumn("_run", F.sum((~F.col("active").eqNullSafe(F.lag("active").over(_pause_window()))).cast("int")).over(_pause_window()))
    run = Window.partitionBy(VIDEO, "pause_id", "_run")
    still = still_frames(F.col("fps"), F.lit(still_time))
    placed = stepped.withColumns({"_s": F.min(FRAME).over(run), "_e": F.max(FRAME).over(run), "_any": F.max("active").over(whole)}).join(catalog.select(VIDEO, "fps"), VIDEO).withColumn("_still", still.cast("long"))
    f, s, e, keep = F.col(FRAME), F.col("_s"), F.col("_e"), F.col("_still")
    half = F.floor(keep / 2)
    inner = F.when(s == F.col("start"), f <= e - keep).when(e == F.col("end"), f >= s + keep).otherwise(f.between(s + half, e - (keep - half)))
    length = F.col("end") - F.col("start") + 1
    none = (length > 2 * keep) & (f >= F.col("start") + keep) & (f <= F.col("end") - keep)
    drop = F.when(~F.col("_any"), none).when(F.col("active") | (e - s + 1 <= keep), False).otherwise(inner)
    return placed.select(VIDEO, FRAME, "pause_id", F.when(drop, AUTO_DELETE).otherwise(AUTO_KEEP).cast("tinyint").alias("code"))


def pause_masks(pause_segments: DataFrame, facts: DataFrame, catalog: DataFrame, params: Params) -> DataFrame:
    """Rows (video_id, frame_idx, pause_id, code) of every pause."""
    return still_trim(motion_mask(pause_frames(pause_segments, facts), params.motion_thresh), catalog, params.still_time)


def pause_deletes(pause_segments: DataFrame, facts: DataFrame, catalog: DataFrame, params: Params) -> DataFrame:
    """What pause_masks deletes, as intervals (video_id, pause_id, start, end, code), from the moving frames of pauses alone.

    A moving frame makes itself and the one before active; inactive runs are what lies between, and each of them loses all but its still stretch.
    """
    hot = facts.where((F.col("state") == PAUSE) & (F.col("diff") > F.lit(params.motion_thresh).cast("float"))).select(VIDEO, FRAME)
    held = interval_join(hot, pause_segments.select(VIDEO, "pause_id", "start", "end")).where(F.col(FRAME) > F.col("start"))
    active = held.select(VIDEO, "pause_id", F.col("start").alias("_first"), F.col("end").alias("_last"), (F.col(FRAME) - 1).alias("_from"), F.col(FRAME).alias("_to"))
    tail = pause_segments.select(VIDEO, "pause_id", F.col("start").alias("_first"), F.col("end").alias("_last"), (F.col("end") + 1).alias("_from"), F.lit(None).cast("long").alias("_to"))  # ends the last run
    w = Window.partitionBy(VIDEO, "pause_id").orderBy("_from", "_to")
    before = F.max("_to").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = active.unionByName(tail).withColumn("_before", before).join(catalog.select(VIDEO, F.col("fps").alias("_fps")), VIDEO)
    return _cut_runs(runs, F.lit(params.still_time))


def pause_codes(pause_segments: DataFrame, facts: DataFrame, catalog: DataFrame, params: Params) -> DataFrame:
    """The masks of pause_masks as maximal runs of equal codes: video_id, pause_id, start, end, code. What pause_deletes leaves of a pause is kept."""
    gone = pause_deletes(pause_segments, facts, catalog, params)
    none = F.lit(None).cast("tinyint")
    head = pause_segments.select(VIDEO, "pause_id", (F.col("start") - 1).alias("start"), (F.col("start") - 1).alias("end"), none.alias("code"))
    tail = pause_segments.select(VIDEO, "pause_id", (F.col("end") + 1).alias("start"), (F.col("end") + 1).alias("end"), none.alias("code"))
    before = F.lag("end").over(Window.partitionBy(VIDEO, "pause_id").orderBy("start"))
    run = lambda s, e, c: F.struct(s.alias("start"), e.alias("end"), c.cast("tinyint").alias("code"))
    rows = gone.select(*head.columns).unionByName(head).unionByName(tail).withColumn("_before", before)
    each = rows.select(VIDEO, "pause_id", F.explode(F.array(run(F.col("_before") + 1, F.col("start") - 1, F.lit(AUTO_KEEP)), run(F.col("start"), F.col("end"), F.col("code")))).alias("r"))
    return each.select(VIDEO, "pause_id", "r.*").where("start <= end AND code IS NOT NULL")


def _cut_runs(runs: DataFrame, still_time: Column, *extra: Column) -> DataFrame:
    """What inactive runs lose, from what ends them: _before (last active frame before, null at the pause's start), _from (first active one after), _to (null at its end), and the pause."""
    keep = still_frames(F.col("_fps"), still_time).cast("long")
    s, e, half = F.coalesce(F.col("_before") + 1, F.col("_first")), F.col("_from") - 1, F.floor(keep / 2)
    alone = F.col("_before").isNull() & F.col("_to").isNull()
    long = e - s + 1 > F.when(alone, 2 * keep).otherwise(keep)
    start = F.when(alone | (s != F.col("_first")) & (e == F.col("_last")), s + keep).when(s == F.col("_first"), s).otherwise(s + half)
    end = F.when(alone | (s == F.col("_first")), e - keep).when(e == F.col("_last"), e).otherwise(e - (keep - half))
    cut = runs.where(long).select(*extra, VIDEO, "pause_id", start.alias("start"), end.alias("end"))
    return cut.where("start <= end").withColumn("code", F.lit(AUTO_DELETE).cast("tinyint"))


def sweep_deletes(pause_segments: DataFrame, facts: DataFrame, catalog: DataFrame, sweep: list[Params]) -> DataFrame:
    """pause_deletes for many sets of parameters at once: params_id (the place in `sweep`), video_id, pause_id, start, end, code.

    Facts are read once, cut at the lowest threshold. What is active depends on the motion threshold alone, so sets share it; still times meet
    the inactive runs, which are few.
    """
    levels = sorted({p.motion_thresh for p in sweep})
    level = F.array(*(F.lit(t).cast("float") for t in levels))
    hot = facts.where((F.col("state") == PAUSE) & (F.col("diff") > F.lit(levels[0]).cast("float"))).select(VIDEO, FRAME, "diff")
    held = interval_join(hot, pause_segments.select(VIDEO, "pause_id", "start", "end")).where(F.col(FRAME) > F.col("start"))
    moving = held.select(VIDEO, "pause_id", F.col("start").alias("_first"), F.col("end").alias("_last"), (F.col(FRAME) - 1).alias("_from"), F.col(FRAME).alias("_to"), F.posexplode(F.filter(level, lambda t: F.col("diff") > t)).alias("_level", "_t")).drop("_t")
    tail = pause_segments.select(VIDEO, "pause_id", F.col("start").alias("_first"), F.col("end").alias("_last"), (F.col("end") + 1).alias("_from"), F.lit(None).cast("long").alias("_to"), F.explode(F.sequence(F.lit(0), F.lit(len(levels) - 1))).alias("_level"))
    w = Window.partitionBy(VIDEO, "pause_id", "_level").orderBy("_from", "_to")
    runs = moving.unionByName(tail).withColumn("_before", F.max("_to").over(w.rowsBetween(Window.unboundedPreceding, -1))).join(catalog.select(VIDEO, F.col("fps").alias("_fps")), VIDEO)
    sets = F.array(*(F.struct(F.lit(n).alias("id"), F.lit(levels.index(p.motion_thresh)).alias("level"), F.lit(p.still_time).alias("still")) for n, p in enumerate(sweep)))
    each = runs.withColumn("_set", F.explode(F.filter(sets, lambda s: s["level"] == F.col("_level"))))
    return _cut_runs(each, F.col("_set.still"), F.col("_set.id").alias("params_id"))


def boundary_targets(pause_segments: DataFrame, catalog: DataFrame) -> DataFrame:
    """Pauses with the frames just outside them, clamped to the video: before, after."""
    return pause_segments.join(catalog.select(VIDEO, "total"), VIDEO).withColumns({"before": F.greatest(F.lit(0), F.col("start") - 1), "after": F.least(F.col("total") - 1, F.col("end") + 1)}).drop("total")


def boundary_diff(pause_segments: DataFrame, catalog: DataFrame, frames: DataFrame, distance, payload: str) -> DataFrame:
    """Pauses with boundary_diff (0.0 if a frame is missing) and `both`, whether both frames exist.

    `distance` is a function of two payload columns. Frames meet the targets once.
    """
    targets = boundary_targets(pause_segments, catalog)
    wanted = targets.select(VIDEO, "pause_id", F.explode(F.map_from_arrays(F.array(F.lit("_b"), F.lit("_a")), F.array("before", "after"))).alias("_side", FRAME))
    kept = frames.select(VIDEO, FRAME, payload).join(wanted.hint("shuffle_hash"), [VIDEO, FRAME])  # the targets are the hashed side: frames are not sorted
    side = lambda s: F.first(F.when(F.col("_side") == s, F.col(payload)), True).alias(s)
    met = targets.join(kept.groupBy(VIDEO, "pause_id").agg(side("_b"), side("_a")), [VIDEO, "pause_id"], "left")
    both = F.col("_b").isNotNull() & F.col("_a").isNotNull()
    return met.select(VIDEO, "pause_id", "start", "end", F.when(both, distance(F.col("_b"), F.col("_a")).cast("double")).otherwise(0.0).alias("boundary_diff"), both.alias("both"))


def mode_override(measured: DataFrame, boundary_thresh: float) -> DataFrame:
    """Mode at analysis: a pause whose outside frames hardly differ goes altogether, if both exist."""
    return measured.withColumn("mode", F.when(F.col("both") & (F.col("boundary_diff") < boundary_thresh), MODE_ALL).otherwise(MODE_AUTO))


def clip_segments(pause_segments: DataFrame, catalog: DataFrame) -> DataFrame:
    """What lies between pauses, before the first and after the last: clip_id, start, end, keep_in, keep_out."""
    tail = catalog.where("total > 0").select(VIDEO, F.col("total").alias("start"), F.col("total").alias("end"))
    w = Window.partitionBy(VIDEO).orderBy("start")
    gaps = pause_segments.select(VIDEO, "start", "end").unionByName(tail).select(VIDEO, (F.coalesce(F.lag("end").over(w), F.lit(-1)) + 1).alias("start"), (F.col("start") - 1).alias("end")).where("end >= start")
    return dense_ids(gaps, "clip_id").select(VIDEO, "clip_id", "start", "end", F.col("start").alias("keep_in"), F.col("end").alias("keep_out"))


def analysis_summary(runs: DataFrame) -> DataFrame:
    """Pauses and speed runs found in every video."""
    return runs.groupBy(VIDEO).agg(F.sum((F.col("state") == PAUSE).cast("long")).alias("n_pauses"), F.sum(F.col("state").isin(*SPEEDS).cast("long")).alias("n_speeds"))
