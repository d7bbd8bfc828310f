"""User overrides as an append-only edit log, folded onto segments for all videos at once.

`replay_edits` takes the log as one history; the functions before it fold one kind of edit alone.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import AUTO_DELETE, AUTO_KEEP, FRAME, MANUAL_DELETE, MANUAL_KEEP, MODE_ALL, MODE_AUTO, VIDEO, Params
from .islands import interval_join, run_bounds, spread
from .segments import pause_codes, pause_masks

#: What a toggle makes of a code.
FLIPPED = {AUTO_KEEP: MANUAL_DELETE, MANUAL_KEEP: MANUAL_DELETE, AUTO_DELETE: MANUAL_KEEP, MANUAL_DELETE: MANUAL_KEEP}


def bulk_mode(pause_segments: DataFrame, mode: str, boundary_thresh: float) -> DataFrame:
    """Sets every pause's mode. Mode auto applies the boundary rule again, also to pauses whose difference was never measured (0.0)."""
    chosen = F.when(F.col("boundary_diff") < boundary_thresh, MODE_ALL).otherwise(MODE_AUTO) if mode == MODE_AUTO else F.lit(mode)
    return pause_segments.withColumn("mode", chosen)


def bulk_masks(mask: DataFrame, pause_segments: DataFrame, facts: DataFrame, catalog: DataFrame, mode: str, params: Params) -> DataFrame:
    """Mask after a bulk edit: auto computes all of it anew and forgets manual codes; other modes leave it."""
    return pause_masks(pause_segments, facts, catalog, params) if mode == MODE_AUTO else mask


def edited_pauses(edits: DataFrame, pause_segments: DataFrame) -> DataFrame:
    """Edits that name a frame, with the pause that holds it; others have no effect."""
    return interval_join(edits, pause_segments.select(VIDEO, "pause_id", "start", "end")).drop("start", "end")


def single_mode(pause_segments: DataFrame, edits: DataFrame) -> DataFrame:
    """Sets single pauses' modes; the last edit (by seq) of a pause wins, and the boundary rule is not applied."""
    last = edited_pauses(edits, pause_segments).groupBy(VIDEO, "pause_id").agg(F.max_by("mode", "seq").alias("_mode"))
    return pause_segments.join(last, [VIDEO, "pause_id"], "left").withColumn("mode", F.coalesce("_mode", "mode")).drop("_mode")


def single_masks(mask: DataFrame, pause_segments: DataFrame, edits: DataFrame, facts: DataFrame, catalog: DataFrame, params: Params) -> DataFrame:
    """Mask (codes of frames, or runs of equal codes) after single edits: pauses once set to auto are computed anew, the others' rows stay."""
    again = edited_pauses(edits, pause_segments).where(F.col("mode") == MODE_AUTO).select(VIDEO, "pause_id").distinct()
    return _renewed(mask, pause_segments.join(again, [VIDEO, "pause_id"], "left_semi"), facts, catalog, params)


def _toggled(code: Column) -> Column:
    return F.when(code.isin(AUTO_KEEP, MANUAL_KEEP), MANUAL_DELETE).otherwise(MANUAL_KEEP).cast("tinyint")


def toggle_block(mask: DataFrame, edits: DataFrame) -> DataFrame:
    """One edit (video_id, pause_id, frame_idx) per pause: the block of equal codes around its frame flips."""
    w = Window.partitionBy(VIDEO, "pause_id").orderBy(FRAME)
    blocks = mask.withColumn("_block", F.sum((~F.col("code").eqNullSafe(F.lag("code").over(w))).cast("int")).over(w))
    hit = blocks.join(edits.select(VIDEO, "pause_id", FRAME), [VIDEO, "pause_id", FRAME]).select(VIDEO, "pause_id", "_block").withColumn("_hit", F.lit(True))
    joined = blocks.join(hit, [VIDEO, "pause_id", "_block"], "left")
    return joined.select(VIDEO, FRAME, "pause_id", F.when(F.col("_hit"), _toggled(F.col("code"))).otherwise(F.col("code")).alias("code"))


@F.pandas_udf(T.StructType([T.StructField("start", T.ArrayType(T.LongType())), T.StructField("end", T.ArrayType(T.LongType())), T.StructField("code", T.ArrayType(T.ByteType()))]))
def _folded(starts: pd.Series, ends: pd.Series, codes: pd.Series, frames: pd.Series) -> pd.DataFrame:
    """A pause a row: its runs of equal codes after toggles at frames. A flipped run takes in the neighbours that it now equals."""

    def fold(starts: list, ends: list, codes: list, frames: list) -> tuple[list, list, list]:
        for frame in frames:
            i = bisect_right(starts, frame) - 1
            if i < 0 or frame > ends[i]:
                continue
            codes[i] = FLIPPED[codes[i]]
            for right in (i + 1, i):  # the run after it, then the one before
                if 0 < right < len(codes) and codes[right] == codes[right - 1] and starts[right] == ends[right - 1] + 1:
                    ends[right - 1] = ends[right]
                    del starts[right], ends[right], codes[right]
        return starts, ends, codes

    return pd.DataFrame([fold(*(c.tolist() for c in row)) for row in zip(starts, ends, codes, frames)], columns=["start", "end", "code"])


def _toggle_runs(runs: DataFrame, edits: DataFrame) -> DataFrame:
    """toggle_blocks on runs of equal codes. Runs and edits of a pause meet as arrays in one row; rows without edits stay out of Python."""
    moved = edits.select(VIDEO, "pause_id", F.struct("seq", FRAME).alias("_move"))
    held = runs.select(VIDEO, "pause_id", F.struct("start", "end", "code").alias("_run"))
    pauses = held.unionByName(moved, allowMissingColumns=True).groupBy(VIDEO, "pause_id").agg(F.sort_array(F.collect_list("_run")).alias("_runs"), F.sort_array(F.collect_list("_move")).alias("_moves"))
    touched = F.size("_moves") > 0
    done = pauses.where(touched & (F.size("_runs") > 0)).withColumn("_done", _folded("_runs.start", "_runs.end", "_runs.code", f"_moves.{FRAME}"))
    zipped = done.select(VIDEO, "pause_id", F.explode(F.arrays_zip(F.col("_done.start").alias("start"), F.col("_done.end").alias("end"), F.col("_done.code").alias("code"))).alias("r"))
    rest = pauses.where(~touched).select(VIDEO, "pause_id", F.explode("_runs").alias("r"))
    return zipped.select(VIDEO, "pause_id", "r.*").unionByName(rest.select(VIDEO, "pause_id", "r.*"))


def toggle_blocks(mask: DataFrame, edits: DataFrame) -> DataFrame:
    """Any number of edits (video_id, pause_id, seq, frame_idx): applied by seq, later ones see what earlier ones did.

    `mask` has codes of frames, or maximal runs of equal codes (start, end); so has the result. Only pauses with edits go through Python, as runs of equal codes.
    """
    if "start" in mask.columns:
        return _toggle_runs(mask, edits)
    touched = edits.select(VIDEO, "pause_id").distinct()
    some = run_bounds(mask.join(touched, [VIDEO, "pause_id"], "left_semi"), ["code"], (VIDEO, "pause_id"))
    rest = mask.join(touched, [VIDEO, "pause_id"], "left_anti").select(VIDEO, FRAME, "pause_id", "code")
    return rest.unionByName(mask_frames(_toggle_runs(some, edits)))


def mask_frames(runs: DataFrame) -> DataFrame:
    """Codes of frames from runs of equal codes."""
    return spread(runs).select(VIDEO, FRAME, "pause_id", "code")


def _renewed(mask: DataFrame, again: DataFrame, facts: DataFrame, catalog: DataFrame, params: Params) -> DataFrame:
    """The mask with the codes of the pauses `again` computed anew, in the mask's form: codes of frames or runs of codes."""
    fresh = (pause_codes if "start" in mask.columns else pause_masks)(again, facts, catalog, params)
    return mask.join(again.select(VIDEO, "pause_id"), [VIDEO, "pause_id"], "left_anti").select(*fresh.columns).unionByName(fresh)


#: Kinds of edits in a log, in the order that they take where a sequence number is shared.
BULK, SINGLE, TOGGLE = "bulk", "single", "toggle"
LOG = (VIDEO, "seq", "kind", FRAME, "mode")


@dataclass(frozen=True)
class Replayed:
    pauses: DataFrame  # with the mode after all edits
    mask: DataFrame


def edit_log(bulk: DataFrame, single: DataFrame, toggles: DataFrame) -> DataFrame:
    """One log (video_id, seq, kind, frame_idx, mode) of edits of all pauses, of one pause, and of blocks of its mask."""
    none = F.lit(None)
    return (
        bulk.select(VIDEO, "seq", F.lit(BULK).alias("kind"), none.cast("long").alias(FRAME), "mode")
        .unionByName(single.select(VIDEO, "seq", F.lit(SINGLE).alias("kind"), FRAME, "mode"))
        .unionByName(toggles.select(VIDEO, "seq", F.lit(TOGGLE).alias("kind"), FRAME, none.cast("string").alias("mode")))
    )


def _resolved(edit: Column, initial: Column, difference: Column, boundary_thresh: float) -> Column:
    """Mode that the edit (a struct with kind and mode, or null) leaves a pause in: a bulk edit to auto applies the boundary rule again, a single one does not."""
    ruled = F.when(difference < boundary_thresh, MODE_ALL).otherwise(MODE_AUTO)
    return F.when(edit.isNull(), initial).when((edit["kind"] == BULK) & (edit["mode"] == MODE_AUTO), ruled).otherwise(edit["mode"])


def replay_edits(log: DataFrame, pause_segments: DataFrame, mask: DataFrame, facts: DataFrame, catalog: DataFrame, params: Params, keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df) -> Replayed:
    """Modes and masks after a log of edits, one by one in order of seq.

    A mode edit to auto computes the pause's codes anew, whatever was toggled before. A toggle flips a block only while its pause is in
    mode auto. So of a pause's history count its last mode edit, its last reset, and the toggles after that which meet mode auto: what a toggle meets is
    found by windows over the log alone, bulk edits are not spread to pauses that were never toggled, and only pauses with such toggles are folded.
    Edits that name a frame outside pauses have no effect. `mask` has codes of frames, or runs of equal codes (start, end); so has the result.
    `keep(name, df)` may store a table and give it back: pauses with their last modes and live toggles are few rows that several steps start from.
    """
    order = F.when(F.col("kind") == BULK, 0).when(F.col("kind") == SINGLE, 1).otherwise(2)
    edit = F.struct("seq", order.alias("order"), "kind", "mode")
    named = log.where(F.col("kind") != BULK).select(*LOG)
    homes = pause_segments.select(VIDEO, "pause_id", "start", "end", F.col("mode").alias("_initial"), F.col("boundary_diff").alias("_diff"))
    located = interval_join(named, homes).drop("start", "end")
    bulk = log.where(F.col("kind") == BULK).select(*LOG)
    rows = located.unionByName(bulk, allowMissingColumns=True).withColumn("_edit", edit)
    video = Window.partitionBy(VIDEO).orderBy("_edit").rowsBetween(Window.unboundedPreceding, -1)
    pause = Window.partitionBy(VIDEO, "pause_id").orderBy("_edit").rowsBetween(Window.unboundedPreceding, -1)
    last = F.greatest(F.last(F.when(F.col("kind") == BULK, F.col("_edit")), True).over(video), F.last(F.when(F.col("kind") == SINGLE, F.col("_edit")), True).over(pause))
    reset = F.when(F.col("mode") == MODE_AUTO, F.col("_edit"))
    last_reset = F.greatest(F.max(F.when(F.col("kind") == BULK, reset)).over(Window.partitionBy(VIDEO)), F.max(F.when(F.col("kind") == SINGLE, reset)).over(Window.partitionBy(VIDEO, "pause_id")))
    met = rows.withColumns({"_last": last, "_reset": last_reset}).where(F.col("kind") == TOGGLE)
    live = met.where((_resolved(F.col("_last"), F.col("_initial"), F.col("_diff"), params.boundary_thresh) == MODE_AUTO) & (F.col("_reset").isNull() | (F.col("_edit") > F.col("_reset"))))

    newest = lambda rows, *keys: rows.withColumn("_edit", edit).groupBy(*keys).agg(F.max("_edit").alias("_last"), F.max(reset).alias("_reset"))
    one = newest(located.where(F.col("kind") == SINGLE), VIDEO, "pause_id").withColumnsRenamed({"_last": "_one", "_reset": "_one_reset"})
    every = newest(bulk, VIDEO).withColumnsRenamed({"_last": "_all", "_reset": "_all_reset"})
    joined = pause_segments.join(one, [VIDEO, "pause_id"], "left").join(every, VIDEO, "left")
    final = joined.withColumns({"mode": _resolved(F.greatest("_one", "_all"), F.col("mode"), F.col("boundary_diff"), params.boundary_thresh), "_again": F.coalesce("_one_reset", "_all_reset").isNotNull()})
    final = keep("replayed", final.select(*pause_segments.columns, "_again"))
    again = final.where("_again").select(VIDEO, "pause_id", "start", "end")
    return Replayed(final.select(*pause_segments.columns), toggle_blocks(_renewed(mask, again, facts, catalog, params), keep("live_toggles", live.select(VIDEO, "pause_id", "seq", FRAME))))


def trim_handles(clips: DataFrame, edits: DataFrame) -> DataFrame:
    """Moves of clip handles (video_id, clip_id, seq, side, tf), by seq: clamped to the clip; a handle that crosses pushes the other."""
    moves = edits.groupBy(VIDEO, "clip_id").agg(F.array_sort(F.collect_list(F.struct("seq", "side", "tf"))).alias("_moves"))
    joined = clips.join(moves, [VIDEO, "clip_id"], "left")
    s, e = F.col("start"), F.col("end")
    pair = lambda ki, ko: F.struct(ki.alias("ki"), ko.alias("ko"))

    def move(h: Column, m: Column) -> Column:
        ki = F.greatest(s, F.least(m["tf"], e + 1))
        ko = F.least(e, F.greatest(m["tf"], s - 1))
        moved_in = pair(ki, F.when(ki > h["ko"], F.least(ki - 1, e)).otherwise(h["ko"]))
        moved_out = pair(F.when(ko < h["ki"], F.greatest(ko + 1, s)).otherwise(h["ki"]), ko)
        return F.when(m["side"] == "in", moved_in).otherwise(moved_out)

    folded = F.aggregate(F.coalesce("_moves", F.array().cast("array<struct<seq:bigint,side:string,tf:bigint>>")), pair(F.col("keep_in"), F.col("keep_out")), move)
    return joined.withColumn("_h", folded).select(VIDEO, "clip_id", "start", "end", F.col("_h.ki").alias("keep_in"), F.col("_h.ko").alias("keep_out"))
