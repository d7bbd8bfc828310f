"""From frames to facts, segments, delete plan and cut list: lazy chains of the operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import delete_plan as plans
from ..operators import pixels, segments
from ..operators.stills import analyze_stills, templates_from_images
from ..schema import FRAME, VIDEO, Params
from ..sources import tables


@dataclass(frozen=True)
class Segments:
    pauses: DataFrame  # with boundary_diff, both, mode
    mask: DataFrame
    speeds: DataFrame
    clips: DataFrame
    runs: DataFrame
    codes: DataFrame | None = None  # the mask as runs of equal codes


def analyze(frames: DataFrame, templates: DataFrame, params: Params) -> DataFrame:
    """Frame facts of pixel frames: states by templates, diffs to the frame before."""
    return pixels.states(frames, templates, params).join(pixels.chunked_frame_diff(frames), [VIDEO, FRAME])


def analyze_images(spark: SparkSession, stills: str, templates: str, params: Params, keep: Callable[[str, DataFrame], DataFrame]) -> DataFrame:
    """Frame facts from image files: stills as tables.image_frames and templates as tables.template_images read them. Without any template all frames are normal."""
    found = templates_from_images(tables.template_images(spark, templates), params.mask_level)
    return analyze_stills(tables.image_frames(spark, stills), found, params, keep)


def signal_distance(a, b):
    return F.abs(a - b)


def as_it_is(name: str, df: DataFrame) -> DataFrame:
    return df


def segment(facts: DataFrame, catalog: DataFrame, frames: DataFrame, params: Params, payload: str = "signal", distance=signal_distance, keep: Callable[[str, DataFrame], DataFrame] = as_it_is) -> Segments:
    """All segments of frame facts; `frames` has the payload that boundary frames are compared by.

    `keep(name, df)` may store a table and give it back: runs and pauses are few rows that several operators start from.
    """
    runs = keep("runs", segments.state_runs(facts))
    found = keep("pauses", segments.pauses(runs))
    measured = segments.boundary_diff(found, catalog, frames, distance, payload)
    return Segments(
        keep("moded", segments.mode_override(measured, params.boundary_thresh)),
        segments.pause_masks(found, facts, catalog, params),
        segments.speed_segments(runs),
        segments.clip_segments(found, catalog),
        runs,
        segments.pause_codes(found, facts, catalog, params),
    )


def cut_ranges(facts: DataFrame, found: Segments, clips: DataFrame, catalog: DataFrame, params: Params, mask: DataFrame | None = None) -> DataFrame:
    """Kept ranges of every video, on intervals. `mask` has the codes of frames where they were edited; else the pauses' deletes follow from their moving frames."""
    deletes = segments.pause_deletes(found.pauses, facts, catalog, params) if mask is None else mask
    skips = plans.skip_intervals(found.pauses, deletes, clips)
    return plans.ranges_of_pieces(plans.plan_pieces(skips, found.runs, catalog, params))
