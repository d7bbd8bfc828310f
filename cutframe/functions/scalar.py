"""Scalar functions on columns. None of them leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DEFAULT_FPS, SPEED_02X, SPEED_1X, SPEED_2X


def catalog_fps(fps: Column) -> Column:
    """Frames a second; unknown (0) reads as the default."""
    return F.when(fps == 0, F.lit(DEFAULT_FPS)).otherwise(fps)


def frame_seconds(frame: Column, fps: Column) -> Column:
    return F.when(fps != 0, frame / fps).otherwise(F.lit(0.0))


def fmt_mmss(seconds: Column) -> Column:
    """mm:ss of the whole seconds; minutes go beyond 59."""
    whole = seconds.cast("long")
    return F.format_string("%02d:%02d", F.floor(whole / 60).cast("long"), whole % 60)


def still_frames(fps: Column, still_time: Column) -> Column:
    """Frames that a still stretch keeps: at least 2, the product cut to an integer."""
    return F.greatest(F.lit(2), (fps * still_time).cast("int"))


def speed_label(state: Column) -> Column:
    return F.when(state == SPEED_2X, "2x").when(state == SPEED_1X, "1x").when(state == SPEED_02X, "0.2x").otherwise("other")


def mode_label(mode: Column) -> Column:
    """Display name of a pause mode; unknown modes have none."""
    return F.when(mode == "all", "delete all").when(mode == "keep", "keep all").when(mode == "auto", "trim by settings").otherwise("")


def state_factor(state: Column, speedup_1x: bool, speedup_02: bool, factor_02: int) -> Column:
    """Speed factor that an export applies to a state."""
    fast = F.lit(speedup_1x) & (state == SPEED_1X)
    slow = F.lit(speedup_02) & (state == SPEED_02X)
    return F.when(fast, 2).when(slow, factor_02).otherwise(1)


def state_step(state: Column, speedup_1x: bool, speedup_02: bool, factor_02: int) -> Column:
    """Frames that playback advances in a state; sped-up 0.2x advances by 2 at least."""
    fast = F.lit(speedup_1x) & (state == SPEED_1X)
    slow = F.lit(speedup_02) & (state == SPEED_02X)
    return F.when(fast, 2).when(slow, max(2, factor_02)).otherwise(1)


def preview_speed(text: Column) -> Column:
    """Number before a trailing x; 1.0 if there is none."""
    return F.coalesce(F.regexp_replace(text, "x+$", "").try_cast("double"), F.lit(1.0))


def preview_step(speed: Column) -> Column:
    return F.when(speed >= 1.0, F.greatest(F.lit(1), speed.cast("int"))).otherwise(1)


def preview_multiplier(speed: Column) -> Column:
    return F.when(speed >= 1.0, F.lit(1.0)).otherwise(1.0 / F.greatest(speed, F.lit(0.01)))


def segment_stem(index: Column, total: Column, label: Column) -> Column:
    """Index padded to the digits of the total, and the label."""
    return F.concat(F.lpad(index.cast("string"), F.greatest(F.length(total.cast("string")), F.length(index.cast("string"))), F.lit("0")), F.lit("_"), label)


def without_extension(path: Column) -> Column:
    """The path without its last extension; a leading dot of a file name is none."""
    return F.regexp_replace(path, r"(?<=[^/.])\.[^./]*$", "")


def clipped_name(path: Column) -> Column:
    """Default output beside the input."""
    return F.concat(without_extension(path), F.lit("_clipped.mp4"))


def segments_folder(path: Column) -> Column:
    """Folder for the segments of an output path."""
    folder, name = F.regexp_extract(path, r"^(.*/)?", 1), F.regexp_extract(path, r"([^/]*)$", 1)
    base = without_extension(name)
    return F.concat(folder, F.when(base == "", "segments").otherwise(base), F.lit("_segments"))


def processing_height(width: Column, height: Column, proc_w: int, proc_h: int, default_h: int = 225) -> Column:
    """The default height follows the video's aspect; another one stands."""
    return F.when(F.lit(proc_h == default_h), F.floor(F.lit(proc_w) * height / width).cast("int")).otherwise(F.lit(proc_h))


def enlarged_roi(x: Column, y: Column, w: Column, h: Column, scale_x: Column, scale_y: Column) -> Column:
    """Search area of twice the size about a match, at processing scale, its origin not below 0."""
    half = 0.5
    return F.struct(
        F.greatest(F.lit(0), (x * scale_x - w * scale_x * half).cast("int")).alias("x"),
        F.greatest(F.lit(0), (y * scale_y - h * scale_y * half).cast("int")).alias("y"),
        (w * scale_x * 2.0).cast("int").alias("w"),
        (h * scale_y * 2.0).cast("int").alias("h"),
    )


def clipped_size(origin: Column, size: Column, limit: Column) -> Column:
    """What is left of a span in a frame."""
    return F.least(limit - origin, size)


def threshold_mask(values: Column, level: int) -> Column:
    return F.transform(values, lambda x: F.when(x > level, 1).otherwise(0))


def pixel_mad(a: Column, b: Column) -> Column:
    """Mean absolute difference of two arrays of equal length, as double."""
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("long"))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x).cast("double") / F.size(a)


def luma(bgr: Column) -> Column:
    """Gray value of every BGR triple of an array, rounded half up."""
    pixels = F.sequence(F.lit(0), F.floor(F.size(bgr) / 3).cast("int") - 1)
    return F.transform(pixels, lambda i: F.floor(F.get(bgr, i * 3) * 0.114 + F.get(bgr, i * 3 + 1) * 0.587 + F.get(bgr, i * 3 + 2) * 0.299 + 0.5).cast("int"))
