"""Pixel operators: kernels on Arrow batches, frames spread over tasks, templates shipped with the task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pixels as kernel
from ..functions.scalar import clipped_size
from ..schema import CLASSES, FRAME, NORMAL, PAUSE, SPEED_02X, SPEED_1X, SPEED_2X, VIDEO, Params

#: Most templates that are shipped to the tasks, and most pixels of all of them.
MAX_TEMPLATES, MAX_PIXELS = 10_000, 20_000_000


def area_resize(frames: DataFrame, out_w: int, out_h: int) -> DataFrame:
    """Frames (w, h, px) at another size: video_id, frame_idx, w, h, px, the pixels as they came (BINARY or numbers)."""
    binary = dict(frames.dtypes)["px"] == "binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (w, h), rows in batch.groupby(["w", "h"], sort=False):
                planes = kernel.area_resize(np.stack([kernel.plane(px, w, h) for px in rows["px"]]), out_w, out_h)
                out = [p.tobytes() for p in planes] if binary else list(planes.reshape(len(rows), -1).astype(np.int32))
                yield pd.DataFrame({VIDEO: rows[VIDEO], FRAME: rows[FRAME], "w": np.int32(out_w), "h": np.int32(out_h), "px": pd.Series(out, index=rows.index, dtype=object)})

    return frames.select(VIDEO, FRAME, "w", "h", "px").mapInPandas(run, f"{VIDEO} long, {FRAME} long, w int, h int, px {'binary' if binary else 'array<int>'}")


def chunked_frame_diff(frames: DataFrame, chunk: int = 256) -> DataFrame:
    """Mean absolute difference to the frame before that is there, as float; 0 at a video's first frame, whatever frames are missing.

    A video is cut into chunks, each with the last frame of the one before that has any, so that pixels are neither sorted nor
    gathered by whole videos. Which frames these are comes from a scan of the frame numbers alone.
    """
    number = F.floor(F.col(FRAME) / chunk).alias("_chunk")
    ends = frames.groupBy(VIDEO, number).agg(F.max(FRAME).alias(FRAME)).withColumn("_next", F.lead("_chunk").over(Window.partitionBy(VIDEO).orderBy("_chunk")))
    marked = frames.select(VIDEO, FRAME, "px").join(ends.where("_next IS NOT NULL").select(VIDEO, FRAME, "_next"), [VIDEO, FRAME], "left")
    homes = F.filter(F.array(number, F.col("_next")), lambda c: c.isNotNull())
    dealt = marked.select(VIDEO, FRAME, "px", F.explode(homes).alias("chunk"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(FRAME, ignore_index=True)
        planes = np.stack([np.frombuffer(p, np.uint8) if isinstance(p, bytes) else np.asarray(p) for p in rows["px"]]).astype(np.int32)
        diff = np.r_[0.0, np.abs(np.diff(planes, axis=0)).sum(1) / planes.shape[1]]
        out = pd.DataFrame({VIDEO: rows[VIDEO], FRAME: rows[FRAME], "diff": diff.astype(np.float32)})
        return out[rows[FRAME] // chunk == rows["chunk"]]

    return dealt.groupBy(VIDEO, "chunk").applyInPandas(run, f"{VIDEO} long, {FRAME} long, diff float")


def shipped(templates: DataFrame) -> dict[str, list[dict]]:
    """Templates (class, roi_x, roi_y, roi_w, roi_h, t_w, t_h, t, m) by class, as arrays."""
    held = templates.agg(F.count(F.lit(1)), F.sum(F.col("t_w").cast("long") * F.col("t_h"))).first()
    if held[0] > MAX_TEMPLATES or (held[1] or 0) > MAX_PIXELS:
        raise ValueError(f"more than {MAX_TEMPLATES} templates or {MAX_PIXELS} pixels of templates")
    area = lambda r: {"x": r["roi_x"], "y": r["roi_y"], "w": r["roi_w"], "h": r["roi_h"], "t": np.array(r["t"]).reshape(r["t_h"], r["t_w"]), "m": np.array(r["m"]).reshape(r["t_h"], r["t_w"])}
    return by_class((r["class"], area(r)) for r in templates.collect())


def by_class(rows) -> dict[str, list[dict]]:
    by: dict[str, list[dict]] = {c: [] for c in CLASSES}
    for name, template in rows:
        by[name].append(template)
    return by


def cascade(planes: np.ndarray, shipped: dict[str, list[dict]], params: Params) -> np.ndarray:
    """State of each plane as `classify` gives it, in stages: only planes that no stage has decided go on to the next one."""
    out = np.full(len(planes), NORMAL, np.int8)
    left = np.arange(len(planes))
    hit = kernel.reaches(planes, shipped["pause"], params.threshold_pause)
    out[hit], left = PAUSE, left[~hit]
    if len(left) and (shipped["speed_1x"] or shipped["speed_2x"]):
        one, two = (kernel.best_scores(planes[left], shipped[c]) for c in ("speed_1x", "speed_2x"))
        is_one, is_two = (one >= params.threshold_speed_1x) & (one > two), (two >= params.threshold_speed_2x) & (two > one)
        out[left[is_one]], out[left[is_two]] = SPEED_1X, SPEED_2X
        left = left[~is_one & ~is_two]
    if len(left):
        out[left[kernel.reaches(planes[left], shipped["speed_0_2x"], params.threshold_speed_0_2x)]] = SPEED_02X
    return out


def states(frames: DataFrame, templates: DataFrame, params: Params) -> DataFrame:
    """video_id, frame_idx, state of gray frames (w, h, px), without the scores that do not matter for them. No shuffle."""
    held = shipped(templates)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (w, h), rows in batch.groupby(["w", "h"], sort=False):
                yield pd.DataFrame({VIDEO: rows[VIDEO], FRAME: rows[FRAME], "state": cascade(np.stack([kernel.plane(p, w, h) for p in rows["px"]]), held, params)})

    return frames.select(VIDEO, FRAME, "w", "h", "px").mapInPandas(run, f"{VIDEO} long, {FRAME} long, state tinyint")


def class_scores(frames: DataFrame, templates: DataFrame) -> DataFrame:
    """Best score of every frame for each class: video_id, frame_idx, and one column a class (-1.0 without a finite score). No shuffle."""
    return frames.select(VIDEO, FRAME, "w", "h", "px").mapInPandas(scorer(shipped(templates)), scores_schema())


def scores_schema() -> str:
    return f"{VIDEO} long, {FRAME} long, " + ", ".join(f"{c} double" for c in CLASSES)


def scorer(shipped: dict[str, list[dict]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for (w, h), rows in batch.groupby(["w", "h"], sort=False):
                planes = np.stack([kernel.plane(p, w, h) for p in rows["px"]])
                parts.append(pd.DataFrame({VIDEO: rows[VIDEO], FRAME: rows[FRAME], **{c: kernel.best_scores(planes, shipped[c]) for c in CLASSES}}))
            yield pd.concat(parts) if parts else pd.DataFrame({c: pd.Series(dtype="float64") for c in (VIDEO, FRAME, *CLASSES)})

    return run


def template_score(scores: DataFrame) -> DataFrame:
    """Scores as rows: video_id, frame_idx, class, score."""
    return scores.select(VIDEO, FRAME, F.explode(F.array(*(F.struct(F.lit(c).alias("class"), F.col(c).alias("score")) for c in CLASSES))).alias("x")).select(VIDEO, FRAME, "x.*")


def classify(scores: DataFrame, params: Params) -> DataFrame:
    """State of every frame: pause, then 1x against 2x (equal scores are neither), then 0.2x, else normal."""
    p, one, two, slow = (F.col(c) for c in CLASSES)
    state = (
        F.when(p >= params.threshold_pause, PAUSE)
        .when((one >= params.threshold_speed_1x) & (one > two), SPEED_1X)
        .when((two >= params.threshold_speed_2x) & (two > one), SPEED_2X)
        .when(slow >= params.threshold_speed_0_2x, SPEED_02X)
        .otherwise(NORMAL)
    )
    return scores.select(VIDEO, FRAME, state.cast("tinyint").alias("state"))


def template_gate(frames: DataFrame, classified: DataFrame) -> DataFrame:
    """Every frame with a state: those without scores (no templates at all) are normal."""
    return frames.select(VIDEO, FRAME).join(classified, [VIDEO, FRAME], "left").withColumn("state", F.coalesce("state", F.lit(NORMAL).cast("tinyint")))


def roi_valid(frames: DataFrame, templates: DataFrame) -> DataFrame:
    """Frames with the templates whose search area, cut at the frame, still holds the template: template_id, class, erw, erh.

    The templates ride along as one array of structs; there is no join.
    """
    rows = templates.select("template_id", "class", "roi_x", "roi_y", "roi_w", "roi_h", "t_w", "t_h").limit(MAX_TEMPLATES + 1).collect()
    if not rows or len(rows) > MAX_TEMPLATES:
        raise ValueError(f"between 1 and {MAX_TEMPLATES} templates are needed")
    each = F.explode(F.from_json(F.lit("[" + ",".join(_json(r) for r in rows) + "]"), "array<struct<template_id:int,class:string,roi_x:int,roi_y:int,roi_w:int,roi_h:int,t_w:int,t_h:int>>"))
    met = frames.select(VIDEO, FRAME, "w", "h", each.alias("t")).select(VIDEO, FRAME, "w", "h", "t.*")
    cut = met.withColumns({"erw": clipped_size(F.col("roi_x"), F.col("roi_w"), F.col("w")), "erh": clipped_size(F.col("roi_y"), F.col("roi_h"), F.col("h"))})
    return cut.where("erw > 0 AND erh > 0 AND erw >= t_w AND erh >= t_h").select(VIDEO, FRAME, "template_id", "class", "erw", "erh")


def _json(row) -> str:
    import json

    return json.dumps(row.asDict())


def template_locate(templates: DataFrame) -> DataFrame:
    """Best unmasked match of every template (t) in its source (src): template_id, x, y, score."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                found = kernel.best_place(np.asarray(r.src).reshape(r.src_h, r.src_w), np.asarray(r.t).reshape(r.t_h, r.t_w))
                rows.append((r.template_id, *(found or (None, None, None))))
            yield pd.DataFrame(rows, columns=["template_id", "x", "y", "score"])

    return templates.select("template_id", "src", "src_w", "src_h", "t", "t_w", "t_h").mapInPandas(run, "template_id int, x int, y int, score double")
