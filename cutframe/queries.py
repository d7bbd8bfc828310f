"""One query for each operator, over the driver's tables. Oracle SQL of the same names is in oracle.py."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import fixtures
from .functions import scalar
from .operators import delete_plan as plans
from .operators import edits, export, intervals, lookup, pixels, segments, stills
from .operators.islands import interval_join, joined_runs, spread
from .plans import timeline
from .schema import FRAME, MODE_AUTO, VIDEO, Params
from .sources import sinks, tables
from .streaming import frames as streams

PARAMS = Params()
#: Stored tables by application, input folder and name.
_STORED: dict[tuple[str, str, str], DataFrame] = {}


@dataclass
class Found:
    """The tables of timeline.Segments, each stored when it is first asked for."""

    inputs: Inputs

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.inputs.kept.runs if name == "runs" else self.inputs.stored(name, lambda: getattr(self.inputs.kept, name))


@dataclass
class Inputs:
    """Frames and what is derived from them, as lazy DataFrames."""

    spark: SparkSession
    sf_dir: str

    def __getattr__(self, name: str):
        if name in ("pixels", "stills", "templates", "color", "probes", "delete_set", "mode_edits", "toggle_edits", "bulk_edits", "clip_edits"):
            return getattr(fixtures, name)(self.spark, self.sf_dir)
        raise AttributeError(name)

    def stored(self, name: str, derive: Callable[[], DataFrame]) -> DataFrame:
        """A table that is derived once a session and kept as Parquet, as a warehouse keeps facts and segments for the operators after them."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _STORED:
            _STORED[key] = self.fresh(name, derive())
        return _STORED[key]

    @cached_property
    def frames(self) -> DataFrame:
        return self.stored("frames", lambda: fixtures.frames(self.spark, self.sf_dir))

    @cached_property
    def catalog(self) -> DataFrame:
        return fixtures.catalog(self.spark, self.sf_dir)

    @cached_property
    def facts(self) -> DataFrame:
        return self.frames.select(VIDEO, FRAME, "state", "diff")

    @cached_property
    def one_video(self) -> DataFrame:
        """All videos one after the other as a single long one."""
        w = Window.orderBy(VIDEO).rowsBetween(Window.unboundedPreceding, -1)  # a row a video
        ends = self.catalog.select(VIDEO, F.coalesce(F.sum("total").over(w), F.lit(0)).alias("_before"))
        return self.frames.join(ends.hint("shuffle_hash"), VIDEO).select(F.lit(0).cast("long").alias(VIDEO), (F.col("_before") + F.col(FRAME)).alias(FRAME), "state", "signal", "diff")

    @cached_property
    def live(self) -> timeline.Segments:
        """Segments straight from the facts, for the queries about them."""
        return timeline.segment(self.facts, self.catalog, self.frames, PARAMS)

    @cached_property
    def kept(self) -> timeline.Segments:
        """Segments whose runs and pauses are stored: all others start from these."""
        return timeline.segment(self.facts, self.catalog, self.frames, PARAMS, keep=lambda name, df: df if name == "moded" else self.stored(f"found_{name}", lambda: df))

    @cached_property
    def found(self) -> Found:
        """Segments as stored, for the queries that start from them."""
        return Found(self)

    def edited(self, clips: DataFrame) -> DataFrame:
        """Clips after the edits of their handles."""
        anchored = interval_join(self.clip_edits, clips.select(VIDEO, "clip_id", "start", "end"), at="anchor_idx").select(VIDEO, "clip_id", "seq", "side", "tf")
        return edits.trim_handles(clips, anchored)

    @cached_property
    def clips(self) -> DataFrame:
        return self.edited(self.found.clips)

    def fresh(self, name: str, df: DataFrame) -> DataFrame:
        """`df` written anew and read back."""
        path = self.folder(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    @cached_property
    def base_plan(self) -> DataFrame:
        return plans.base_frames(self.parts)

    @cached_property
    def parts(self) -> DataFrame:
        """The whole plan as parts of runs, kept and deleted."""
        return self.stored("parts", lambda: plans.plan_parts(self.pieces, self.found.runs, self.catalog))

    @cached_property
    def plan(self) -> DataFrame:
        return plans.plan_frames(self.parts)

    @cached_property
    def skips(self) -> DataFrame:
        """What playback skips, from intervals alone."""
        return plans.skip_intervals(self.found.pauses, self.found.codes, self.clips)

    @cached_property
    def pieces(self) -> DataFrame:
        return plans.plan_pieces(self.skips, self.found.runs, self.catalog, PARAMS)

    @cached_property
    def sums(self) -> DataFrame:
        return self.stored("timeline_sums", lambda: lookup.timeline_sums(self.skips, self.found.runs, self.catalog, PARAMS))

    def bucketed(self, name: str, rows: DataFrame) -> DataFrame:
        """`rows` as a table in buckets of (video_id, chunk), stored once a session."""

        def derive() -> DataFrame:
            return sinks.store_colocated(rows, f"cutframe_{name}_{uuid.uuid4().hex}", self.folder(name), 8, 256)

        key = (self.spark.sparkContext.applicationId, self.sf_dir, f"bucketed {name}")
        if key not in _STORED:
            _STORED[key] = derive()
        return _STORED[key]

    @cached_property
    def ranges(self) -> DataFrame:
        return plans.ranges_of_pieces(self.pieces)

    @cached_property
    def numbered(self) -> DataFrame:
        return self.stored("segments", lambda: export.segment_order(export.merge_adjacent_segments(_segments(self, True, True))))

    @cached_property
    def present(self) -> DataFrame:
        """Frames that can be read, as their maximal runs: every tenth video lacks its last three."""
        rows = self.found.runs.join(self.catalog.select(VIDEO, "total"), VIDEO)
        last = F.when(F.col(VIDEO) % 10 == 0, F.least(F.col("end"), F.col("total") - 4)).otherwise(F.col("end"))
        return joined_runs(rows.select(VIDEO, "start", last.alias("end"), F.lit(True).alias("here")).where("start <= end"), "here")

    @cached_property
    def scores(self) -> DataFrame:
        return pixels.class_scores(self.pixels, self.templates)

    @cached_property
    def toggled(self) -> DataFrame:
        """Masks after all toggles of pauses in mode auto, as runs of equal codes."""
        auto = self.found.pauses.where(F.col("mode") == MODE_AUTO)
        return edits.toggle_blocks(self.found.codes, edits.edited_pauses(self.toggle_edits, auto))

    @cached_property
    def summary(self) -> DataFrame:
        return export.segment_summary(self.numbered, self.present)

    def folder(self, name: str) -> str:
        """A new folder that executors share with the driver."""
        root, master = self.spark.conf.get("spark.checkpoint.dir", None), self.spark.sparkContext.master
        if not root and not master.startswith("local[") and master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = root or tempfile.mkdtemp(prefix="spark-cutframe-")
        return f"{root}/{name}-{uuid.uuid4().hex}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
    return f


# Sources and sinks


@query
def src_templates(x: Inputs) -> DataFrame:
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, v: s + v)
    return x.templates.select("template_id", "class", F.size("t").cast("long").alias("n_pixels"), total("t").alias("t_sum"), total("m").alias("m_sum"))


@query
def src_frames(x: Inputs) -> DataFrame:
    return x.facts


@query
def src_catalog(x: Inputs) -> DataFrame:
    declared = x.catalog.select(VIDEO, F.when(F.col("fps") == 24, 0.0).otherwise(F.col("fps")).alias("fps"))
    return tables.video_catalog(x.frames, declared)


@query
def frame_spine(x: Inputs) -> DataFrame:
    return segments.frame_spine(x.catalog.withColumn("total", F.col("total") + 3), x.facts)  # the container promises three frames more


@query
def params(x: Inputs) -> DataFrame:
    sweep = tables.params_array(Params(), Params(still_time=0.2, motion_thresh=1.0), Params(still_time=0.5, motion_thresh=3.0))
    rows = x.catalog.select(VIDEO, "fps", F.explode(sweep).alias("p")).select(VIDEO, "fps", "p.*")
    return rows.select(VIDEO, "params_id", "still_time", "motion_thresh", scalar.still_frames(F.col("fps"), F.col("still_time")).alias("still_frames"))


@query
def sink_cut_list(x: Inputs) -> DataFrame:
    """The whole chain, from facts to ranges in seconds. Nothing but the frames comes from storage; runs and pauses, which several operators start from, are written on the way."""
    found = timeline.segment(x.facts, x.catalog, x.frames, PARAMS, keep=x.fresh)
    return sinks.cut_list(timeline.cut_ranges(x.facts, found, x.edited(found.clips), x.catalog, PARAMS), x.catalog)


@query
def sink_frame_facts(x: Inputs) -> DataFrame:
    path = x.folder("frame-facts")
    sinks.write_frame_facts(x.facts, path, 8)
    return sinks.read_frame_facts(x.spark, path).select(VIDEO, FRAME, "state", "diff")


@query
def sink_segment_manifest(x: Inputs) -> DataFrame:
    return export.segment_manifest(x.numbered, "cut_segments")


# Pixels


@query
def gray(x: Inputs) -> DataFrame:
    return x.color.select("event_id", scalar.luma(F.col("bgr")).alias("gray"))


@query
def area_resize(x: Inputs) -> DataFrame:
    return pixels.area_resize(x.pixels, 3, 3).select(VIDEO, FRAME, "px")


@query
def proc_res(x: Inputs) -> DataFrame:
    sized = x.catalog.select(VIDEO, (F.lit(640) + F.col(VIDEO) % 7 * 160).alias("w"), (F.lit(360) + F.col(VIDEO) % 5 * 90).alias("h"))
    return sized.withColumn("proc_h", scalar.processing_height(F.col("w"), F.col("h"), PARAMS.proc_w, PARAMS.proc_h))


@query
def template_prep(x: Inputs) -> DataFrame:
    at = x.templates.select("template_id", "t", (F.col("template_id") % 5).alias("x"), (F.col("template_id") % 3).alias("y"))
    roi = scalar.enlarged_roi(F.col("x"), F.col("y"), F.lit(4), F.lit(4), F.lit(1.25), F.lit(1.25))
    return at.select("template_id", scalar.threshold_mask(F.col("t"), 100).alias("m"), roi.alias("r")).select("template_id", "m", *(F.col(f"r.{c}").alias(f"roi_{c}") for c in "xywh"))


@query
def roi_valid(x: Inputs) -> DataFrame:
    moved = x.templates.withColumns({"roi_x": F.col("template_id"), "roi_y": F.col("template_id") % 4})
    return pixels.roi_valid(x.pixels, moved)


@query
def frame_x_template(x: Inputs) -> DataFrame:
    return pixels.roi_valid(x.pixels, x.templates)


@query
def template_score(x: Inputs) -> DataFrame:
    return pixels.template_score(x.scores)


@query
def template_locate(x: Inputs) -> DataFrame:
    return pixels.template_locate(x.templates)


@query
def classify(x: Inputs) -> DataFrame:
    return pixels.classify(x.scores, PARAMS)


@query
def template_gate(x: Inputs) -> DataFrame:
    some = pixels.classify(x.scores, PARAMS).where(F.col(VIDEO) % 2 == 0)
    return pixels.template_gate(x.pixels, some)


@query
def frame_diff(x: Inputs) -> DataFrame:
    return segments.frame_diff(x.pixels)


@query
def frame_diff_chunked(x: Inputs) -> DataFrame:
    return pixels.chunked_frame_diff(x.pixels, 16)


@query
def frame_diff_over_gaps(x: Inputs) -> DataFrame:
    """Frames 10 to 24 and every seventh are lost: whole chunks, and frames at their ends."""
    there = x.pixels.where(~F.col(FRAME).between(10, 24) & (F.col(FRAME) % 7 != 3))
    return pixels.chunked_frame_diff(there, 4)


@query
def analysis_from_pixels(x: Inputs) -> DataFrame:
    """Frames and templates to facts: state and difference of every frame."""
    return timeline.analyze(x.pixels, x.templates, PARAMS).select(VIDEO, FRAME, "state", "diff")


@query
def facts_from_stills(x: Inputs) -> DataFrame:
    """Colour stills of twice the size to facts, in one pass over their bytes."""
    found = stills.TemplateSet(prepared=pixels.shipped(x.templates))
    return stills.analyze_stills(x.stills, found, replace(PARAMS, proc_w=8, proc_h=8), x.fresh)


@query
def boundary_diff_pixels(x: Inputs) -> DataFrame:
    """Pauses of the analysed frames, with the difference of the whole frames around them."""
    facts = x.stored("pixel_facts", lambda: timeline.analyze(x.pixels, x.templates, PARAMS))
    catalog = facts.groupBy(VIDEO).agg((F.max(FRAME) + 1).alias("total"))
    return segments.boundary_diff(segments.pauses(segments.state_runs(facts)), catalog, x.pixels, scalar.pixel_mad, "px")


# Segments


@query
def state_runs(x: Inputs) -> DataFrame:
    return segments.state_runs(x.facts)


@query
def dense_ids(x: Inputs) -> DataFrame:
    return segments.pauses(x.live.runs)


@query
def analysis_summary(x: Inputs) -> DataFrame:
    return segments.analysis_summary(x.live.runs)


@query
def motion_mask(x: Inputs) -> DataFrame:
    return segments.motion_mask(segments.pause_frames(segments.pauses(x.live.runs), x.facts), PARAMS.motion_thresh).select(VIDEO, FRAME, "pause_id", "active")


@query
def still_trim(x: Inputs) -> DataFrame:
    return x.live.mask


@query
def boundary_diff(x: Inputs) -> DataFrame:
    return segments.boundary_diff(segments.pauses(x.live.runs), x.catalog, x.frames, timeline.signal_distance, "signal")


@query
def mode_override(x: Inputs) -> DataFrame:
    return x.live.pauses.select(VIDEO, "pause_id", "boundary_diff", "mode")


@query
def clip_segments(x: Inputs) -> DataFrame:
    return x.live.clips


# Plan


@query
def pause_delete_rows(x: Inputs) -> DataFrame:
    return plans.pause_delete_rows(x.found.pauses, x.found.mask)


@query
def clip_delete_rows(x: Inputs) -> DataFrame:
    return plans.clip_delete_rows(x.clips)


@query
def delete_plan(x: Inputs) -> DataFrame:
    return plans.plan_frames(plans.plan_parts(x.pieces, x.found.runs, x.catalog))


@query
def delete_plan_by_frame(x: Inputs) -> DataFrame:
    """The plan from frame rows of deletes, as it is where masks were edited by frame."""
    return plans.delete_plan(x.facts, x.found.pauses, x.found.mask, x.clips, PARAMS)


@query
def decimate(x: Inputs) -> DataFrame:
    return plans.decimate(x.parts, plans.speed_ups(PARAMS))


@query
def kept_ranges(x: Inputs) -> DataFrame:
    return x.ranges


@query
def kept_ranges_by_frame(x: Inputs) -> DataFrame:
    return plans.kept_ranges(x.plan)


@query
def export_counts(x: Inputs) -> DataFrame:
    return plans.export_counts(x.plan)


@query
def skip_intervals(x: Inputs) -> DataFrame:
    return plans.skip_intervals(x.found.pauses, x.found.mask, x.clips)


@query
def pause_deletes(x: Inputs) -> DataFrame:
    """The deletes of masks as intervals."""
    return segments.pause_deletes(x.found.pauses, x.facts, x.catalog, PARAMS).select(VIDEO, "pause_id", "start", "end")


@query
def skip_union(x: Inputs) -> DataFrame:
    """The skip intervals as the fewest intervals."""
    return intervals.union(x.skips.select(VIDEO, "start", (F.col("end") - 1).alias("end")))


@query
def kept_speeds(x: Inputs) -> DataFrame:
    """Parts of speed runs that are left of the skips, by joining intervals with intervals."""
    kept = intervals.complement(x.skips.select(VIDEO, "start", (F.col("end") - 1).alias("end")), x.catalog)
    return intervals.overlaps(kept, x.found.speeds)


@query
def incremental_plan(x: Inputs) -> DataFrame:
    """The plan after clips were trimmed: the stored one from before, with only the runs planned anew that the edits reach."""
    skips = {name: plans.skip_intervals(x.found.pauses, x.found.codes, clips) for name, clips in (("skips_before", x.found.clips), ("skips_after", x.clips))}
    before, after = (x.stored(name, lambda rows=rows: rows) for name, rows in skips.items())
    stored = x.stored("pieces_before", lambda: plans.plan_pieces(before, x.found.runs, x.catalog, PARAMS))
    pieces = x.fresh("pieces_after", plans.replan(stored, before, after, x.found.runs, x.catalog, PARAMS))
    return plans.plan_frames(plans.plan_parts(pieces, x.found.runs, x.catalog))


@query
def sweep_deletes(x: Inputs) -> DataFrame:
    """What masks delete under three sets of parameters, from one read of the facts."""
    sweep = [Params(), Params(still_time=0.2, motion_thresh=1.0), Params(still_time=0.5, motion_thresh=5.0)]
    return segments.sweep_deletes(x.found.pauses, x.facts, x.catalog, sweep).drop("code")


@query
def colocated_runs(x: Inputs) -> DataFrame:
    """Runs from facts that are stored in buckets by stretch."""
    return sinks.colocated_runs(x.bucketed("facts", x.facts))


@query
def colocated_counts(x: Inputs) -> DataFrame:
    """Kept frames of each state, from facts and plan stored in like buckets."""
    facts, plan = x.bucketed("facts", x.facts), x.bucketed("plan", x.plan.select(VIDEO, FRAME, "del"))
    met = facts.join(plan, [VIDEO, "chunk", FRAME])
    return met.groupBy(VIDEO, "chunk", "state").agg(F.sum((~F.col("del")).cast("long")).alias("kept"), F.count(F.lit(1)).alias("total"))


@query
def valid_frames(x: Inputs) -> DataFrame:
    return x.base_plan.where(~F.col("del")).select(VIDEO, FRAME, "state")


@query
def next_kept(x: Inputs) -> DataFrame:
    """Of every frame, where playback goes on: speed-ups skip frames too."""
    return plans.next_kept_frames(x.parts, x.catalog)


@query
def concat_remap(x: Inputs) -> DataFrame:
    return plans.concat_remap(x.ranges)


@query
def drop_deleted(x: Inputs) -> DataFrame:
    return plans.drop_deleted(x.facts, x.delete_set, x.catalog).select(VIDEO, FRAME)


# Export


def _segments(x: Inputs, split: bool, merge: bool) -> DataFrame:
    return export.export_segments(x.parts, segments.pauses(x.found.runs), split, merge)


@query
def export_segments(x: Inputs) -> DataFrame:
    return _segments(x, False, False)


@query
def export_segments_split(x: Inputs) -> DataFrame:
    return _segments(x, True, False)


@query
def export_segments_merged(x: Inputs) -> DataFrame:
    return _segments(x, False, True)


@query
def export_segments_split_merged(x: Inputs) -> DataFrame:
    return _segments(x, True, True)


@query
def merge_adjacent_segments(x: Inputs) -> DataFrame:
    return export.merge_adjacent_segments(_segments(x, True, True))


@query
def segment_order(x: Inputs) -> DataFrame:
    return x.numbered.select(VIDEO, "seg_no", "start", "label")


@query
def to_half_open(x: Inputs) -> DataFrame:
    return export.to_half_open(x.numbered).select(VIDEO, "seg_no", "half_open", "requested")


@query
def segment_frames(x: Inputs) -> DataFrame:
    return export.segment_frames(x.numbered, x.present)


@query
def segment_summary(x: Inputs) -> DataFrame:
    return x.summary


@query
def export_totals(x: Inputs) -> DataFrame:
    return export.export_totals(x.summary)


@query
def first_failures(x: Inputs) -> DataFrame:
    return export.first_failures(x.summary)


# Lookups


@query
def segment_lookup(x: Inputs) -> DataFrame:
    return lookup.segment_lookup(x.probes, x.found.pauses, x.found.speeds)


@query
def segment_lookup_overlapping(x: Inputs) -> DataFrame:
    """Pauses that reach 40 frames further, into those after them: the first one counts."""
    longer = x.found.pauses.withColumn("end", F.col("end") + 40)
    return lookup.segment_lookup(x.probes, longer, x.found.speeds).select("probe_id", "kind", "pause_id")


@query
def speed_step(x: Inputs) -> DataFrame:
    return lookup.speed_step(x.probes, x.found.speeds, True, True, PARAMS.speedup_02_factor)


@query
def timeline_buckets(x: Inputs) -> DataFrame:
    return lookup.timeline_buckets(x.parts, x.catalog, 120)


@query
def timeline_buckets_zoomed(x: Inputs) -> DataFrame:
    return lookup.timeline_buckets(x.parts, x.catalog, 100, 0.25, 4.0)


@query
def timeline_window(x: Inputs) -> DataFrame:
    """The whole timeline by column, from sums."""
    return lookup.timeline_window(x.sums, x.catalog, 120)


@query
def timeline_window_zoomed(x: Inputs) -> DataFrame:
    return lookup.timeline_window(x.sums, x.catalog, 100, 0.25, 4.0)


@query
def timeline_layers(x: Inputs) -> DataFrame:
    return lookup.timeline_layers(x.toggled, x.found.pauses, x.clips, x.catalog, 120)


# Scalar functions


@query
def fmt_mmss(x: Inputs) -> DataFrame:
    return x.probes.join(x.catalog, VIDEO).select("probe_id", scalar.fmt_mmss(scalar.frame_seconds(F.col(FRAME), F.col("fps"))).alias("at"))


@query
def frame_seconds(x: Inputs) -> DataFrame:
    rate = F.when(F.col(VIDEO) % 10 == 0, 0.0).otherwise(F.col("fps"))
    return x.probes.join(x.catalog, VIDEO).select("probe_id", scalar.frame_seconds(F.col(FRAME), rate).alias("seconds"))


@query
def speed_label(x: Inputs) -> DataFrame:
    return x.facts.select(VIDEO, FRAME, scalar.speed_label(F.col("state")).alias("label"))


@query
def mode_label(x: Inputs) -> DataFrame:
    return x.found.pauses.select(VIDEO, "pause_id", scalar.mode_label(F.col("mode")).alias("label"))


@query
def still_frames(x: Inputs) -> DataFrame:
    return x.catalog.select(VIDEO, scalar.still_frames(F.col("fps"), F.lit(PARAMS.still_time)).alias("still"))


@query
def effective_speed(x: Inputs) -> DataFrame:
    texts = F.array(*map(F.lit, ("0.25x", "2x", "1.5", "fast", "0.001x")))
    rows = x.probes.join(x.facts, [VIDEO, FRAME]).withColumn("text", F.get(texts, (F.col("probe_id") % 7 % 5).cast("int")))
    speed = scalar.preview_speed(F.col("text"))
    factor = scalar.state_factor(F.col("state"), True, True, PARAMS.speedup_02_factor)
    return rows.select("probe_id", "text", speed.alias("speed"), scalar.preview_step(speed).alias("step"), scalar.preview_multiplier(speed).alias("multiplier"), (factor * speed).alias("shown"))


@query
def pixel_mad(x: Inputs) -> DataFrame:
    w = Window.partitionBy(VIDEO).orderBy(FRAME)
    rows = x.pixels.withColumn("before", F.lag("px").over(w)).where("before IS NOT NULL")
    return rows.select(VIDEO, FRAME, scalar.pixel_mad(F.col("px"), F.col("before")).alias("mad"))


@query
def segment_stem(x: Inputs) -> DataFrame:
    return export.segment_manifest(x.numbered, "cut_segments").select(VIDEO, "seg_no", "stem")


@query
def output_names(x: Inputs) -> DataFrame:
    path = F.format_string("/videos/v%d.take.1.mkv", VIDEO)
    clipped = scalar.clipped_name(path)
    return x.catalog.select(VIDEO, clipped.alias("clipped"), scalar.segments_folder(clipped).alias("folder"))


@query
def clamp_roi(x: Inputs) -> DataFrame:
    roi = scalar.enlarged_roi(F.col(FRAME), F.lit(0), F.lit(40), F.lit(40), F.lit(0.625), F.lit(0.625))
    rows = x.facts.select(VIDEO, FRAME, roi.alias("r"))
    return rows.select(VIDEO, FRAME, F.col("r.x").alias("x"), F.col("r.w").alias("w"), scalar.clipped_size(F.col("r.x"), F.col("r.w"), F.lit(PARAMS.proc_w)).alias("clipped"))


@query
def threshold_mask(x: Inputs) -> DataFrame:
    return x.pixels.select(VIDEO, FRAME, scalar.threshold_mask(F.col("px"), PARAMS.mask_level).alias("m"))


# Edits


@query
def bulk_mode(x: Inputs) -> DataFrame:
    return edits.bulk_mode(x.found.pauses, MODE_AUTO, 8.0).select(VIDEO, "pause_id", "mode")


@query
def single_mode(x: Inputs) -> DataFrame:
    return edits.single_mode(x.found.pauses, x.mode_edits).select(VIDEO, "pause_id", "mode")


@query
def toggle_block(x: Inputs) -> DataFrame:
    auto = x.found.pauses.where(F.col("mode") == MODE_AUTO)
    first = edits.edited_pauses(x.toggle_edits, auto).groupBy(VIDEO, "pause_id").agg(F.min_by(FRAME, "seq").alias(FRAME))
    return edits.toggle_block(x.found.mask, first)


@query
def toggle_blocks(x: Inputs) -> DataFrame:
    return edits.mask_frames(x.toggled)


@query
def bulk_masks(x: Inputs) -> DataFrame:
    """Toggled masks, all set to auto again: manual codes are forgotten."""
    return edits.bulk_masks(x.toggled, x.found.pauses, x.facts, x.catalog, MODE_AUTO, PARAMS)


@query
def single_masks(x: Inputs) -> DataFrame:
    """Toggled masks after single edits: pauses that were set to auto are computed anew, the others keep their codes."""
    return edits.mask_frames(edits.single_masks(x.toggled, x.found.pauses, x.mode_edits, x.facts, x.catalog, PARAMS))


@query
def edit_replay(x: Inputs) -> DataFrame:
    """Masks and modes after bulk edits, single edits and toggles as one history."""
    log = edits.edit_log(x.bulk_edits, x.mode_edits, x.toggle_edits)
    done = edits.replay_edits(log, x.found.pauses, x.found.codes, x.facts, x.catalog, PARAMS, keep=x.fresh)
    coded = done.mask.join(done.pauses.select(VIDEO, "pause_id", "mode"), [VIDEO, "pause_id"])
    return spread(coded).select(VIDEO, "pause_id", FRAME, "code", "mode")


@query
def trim_handles(x: Inputs) -> DataFrame:
    return x.clips


# Streams: the inputs are written as files, read in micro-batches to their end, and the result is read back


def _streamed(x: Inputs, rows: DataFrame, files: int, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    source, out, state = x.folder("stream-in"), x.folder("stream-out"), x.folder("stream-state")
    rows.repartition(files, FRAME).write.parquet(source)  # every file has frames of all videos, out of order
    arriving = x.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
    result = operator(arriving)
    streams.run_to_end(result, out, state)
    return x.spark.read.schema(result.schema).parquet(out)


@query
def stream_frame_diff(x: Inputs) -> DataFrame:
    rows = x.pixels.select(VIDEO, FRAME, "px")
    return streams.settled_diffs(_streamed(x, rows, 4, lambda frames: streams.stream_frame_diff(frames, 16)), rows)


@query
def stream_runs(x: Inputs) -> DataFrame:
    return streams.settled_runs(_streamed(x, x.facts.select(VIDEO, FRAME, "state"), 4, streams.stream_runs))


@query
def stream_runs_long(x: Inputs) -> DataFrame:
    """All frames as one video, its stretches shuffled over the files."""
    return streams.settled_runs(_streamed(x, x.one_video.select(VIDEO, FRAME, "state"), 6, streams.stream_runs))


@query
def stream_classify(x: Inputs) -> DataFrame:
    return _streamed(x, x.pixels.select(VIDEO, FRAME, "w", "h", "px"), 4, lambda frames: streams.stream_classify(frames, x.templates, PARAMS))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cut list of every video, from frames to kept ranges in seconds."""
    return QUERIES["sink_cut_list"](spark, sf_dir)
