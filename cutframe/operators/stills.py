"""From stills to facts in one pass: every still is read once, brought to processing size, turned gray, scored, and compared to the one before it.

A task walks through its stills in order. Differences inside a stretch of following frames are taken there; pixels leave a task only at the ends of
its stretches, where the last frame of one meets the first of the next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pixels as kernel
from ..schema import FRAME, VIDEO, Params
from .pixels import MAX_PIXELS, MAX_TEMPLATES, by_class, cascade
from .templates import LOCATED, located, scaled

PASSED = f"{VIDEO} long, {FRAME} long, state tinyint, diff float, first binary, last binary, stretch long"


@dataclass
class TemplateSet:
    """Templates by class for any processing size, shipped with the tasks: the prepared ones as they are, or ones that are scaled when a size is first met."""

    prepared: dict[str, list[dict]] | None = None
    found: list[dict] = field(default_factory=list)
    mask_level: int = 10
    sizes: dict[tuple[int, int], dict[str, list[dict]]] = field(default_factory=dict)

    def at(self, w: int, h: int) -> dict[str, list[dict]]:
        if self.prepared is not None:
            return self.prepared
        if (w, h) not in self.sizes:
            self.sizes[w, h] = by_class((r["class"], scaled(r["plane"], r["x"], r["y"], r["src_w"], r["src_h"], w, h, self.mask_level)) for r in self.found)
        return self.sizes[w, h]


def templates_from_images(images: DataFrame, mask_level: int = 10) -> TemplateSet:
    """Templates of images (class, role, origin, w, h, channels, px), found in their sources; their number and pixels are checked before they are gathered."""
    rows = located(images)
    held = images.where("role = 'template'").agg(F.count(F.lit(1)), F.sum(F.col("w").cast("long") * F.col("h"))).first()
    if held[0] > MAX_TEMPLATES or (held[1] or 0) > MAX_PIXELS:
        raise ValueError(f"more than {MAX_TEMPLATES} templates or {MAX_PIXELS} pixels of templates")
    names = [c.split()[0] for c in LOCATED.split(", ")]
    return TemplateSet(found=[{n: r[n] for n in names if n != "gray"} | {"plane": np.frombuffer(r["gray"], np.uint8).reshape(r["h"], r["w"])} for r in rows.collect()], mask_level=mask_level)


def processing_size(w: int, h: int, params: Params) -> tuple[int, int]:
    """Size that frames are brought to: of the default one the height follows the frame's shape."""
    default = Params()
    return (params.proc_w, max(1, params.proc_w * h // w)) if params.proc_h == default.proc_h else (params.proc_w, params.proc_h)


def small_gray(px: bytes, w: int, h: int, channels: int, out_w: int, out_h: int) -> np.ndarray:
    """A still (row-major, 1, 3 or 4 channels in BGR order) as gray plane of another size: each channel is resized, then the luma is taken."""
    whole = np.frombuffer(px, np.uint8).reshape(h, w, channels)[..., :3].transpose(2, 0, 1)
    small = whole if (w, h) == (out_w, out_h) else kernel.area_resize(whole, out_w, out_h)
    return small[0] if len(small) < 3 else kernel.gray(np.ascontiguousarray(small.transpose(1, 2, 0)))


def one_pass(templates: TemplateSet, params: Params) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Task: stills (video_id, frame_idx, w, h, channels, px) to rows of PASSED. `first` and `last` hold the pixels at a stretch's ends, `stretch` its first frame."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before: tuple | None = None  # video, frame and plane of the last still, and its stretch
        row: dict | None = None  # of the last still, which may be the last of its stretch
        for batch in batches:
            batch = batch.sort_values([VIDEO, FRAME], ignore_index=True)
            planes, states = [], np.zeros(len(batch), np.int8)
            for r in batch.itertuples(index=False):
                planes.append(small_gray(r.px, r.w, r.h, r.channels, *processing_size(r.w, r.h, params)))
            shapes = pd.Series([p.shape for p in planes], dtype=object)
            for (h, w), at in shapes.groupby(shapes, sort=False).groups.items():
                states[at] = cascade(np.stack([planes[i] for i in at]), templates.at(w, h), params)
            out = []
            for video, frame, plane, state in zip(batch[VIDEO].tolist(), batch[FRAME].tolist(), planes, states.tolist()):
                if before is not None and before[:2] == (video, frame):
                    continue  # a repeated still counts once
                goes_on = before is not None and before[:2] == (video, frame - 1) and before[2].shape == plane.shape
                if row is not None:
                    row["last"] = None if goes_on else before[2].tobytes()
                    out.append(row)
                stretch = before[3] if goes_on else frame
                diff = kernel.mean_difference(plane, before[2]) if goes_on else None
                row = {VIDEO: video, FRAME: frame, "state": state, "diff": diff, "first": None if goes_on else plane.tobytes(), "last": None, "stretch": stretch}
                before = (video, frame, plane, stretch)
            yield _typed(out)
        if row is not None:
            row["last"] = before[2].tobytes()
            yield _typed([row])

    return run


def _typed(rows: list[dict]) -> pd.DataFrame:
    names = [c.split()[0] for c in PASSED.split(", ")]
    out = pd.DataFrame(rows, columns=names)
    return out.astype({VIDEO: "int64", FRAME: "int64", "state": "int8", "diff": "float32", "first": object, "last": object, "stretch": "int64"})


def analyze_stills(stills: DataFrame, templates: TemplateSet, params: Params, keep: Callable[[str, DataFrame], DataFrame]) -> DataFrame:
    """Frame facts (video_id, frame_idx, state, diff) of stills (video_id, frame_idx, w, h, channels, px).

    `keep(name, df)` stores the result of the pass over the pixels and gives it back, so that there is one. A frame after a gap is
    compared to the last one there was; a still of another size than the one before it starts anew with a difference of 0.
    """
    read = stills.select(VIDEO, FRAME, "w", "h", F.col("channels").alias("channels"), "px")
    passed = keep("stills-passed", read.mapInPandas(one_pass(templates, params), PASSED))
    heads = passed.where("first IS NOT NULL").select(VIDEO, FRAME, "first")
    tails = passed.where("last IS NOT NULL").select(VIDEO, F.col(FRAME).alias("_tail"), F.col("last").alias("_before"))
    w = Window.partitionBy(VIDEO).orderBy(FRAME, "_end").rowsBetween(Window.unboundedPreceding, -1)
    ends = heads.select(VIDEO, FRAME, F.lit(0).alias("_end")).unionByName(tails.select(VIDEO, F.col("_tail").alias(FRAME), F.lit(1).alias("_end")))  # numbers only: pixels wait until pairs are known
    pairs = ends.withColumn("_tail", F.max(F.when(F.col("_end") == 1, F.col(FRAME))).over(w)).where("_end = 0 AND _tail IS NOT NULL").select(VIDEO, FRAME, "_tail").distinct()
    met = pairs.join(heads.dropDuplicates([VIDEO, FRAME]), [VIDEO, FRAME]).join(tails.dropDuplicates([VIDEO, "_tail"]), [VIDEO, "_tail"])
    healed = met.mapInPandas(_differences, f"{VIDEO} long, {FRAME} long, _healed float")
    facts = passed.select(VIDEO, FRAME, "state", "diff").groupBy(VIDEO, FRAME).agg(F.min("state").alias("state"), F.max("diff").alias("diff"))
    return facts.join(healed, [VIDEO, FRAME], "left").select(VIDEO, FRAME, "state", F.coalesce("diff", "_healed", F.lit(0).cast("float")).alias("diff"))


def _differences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        pairs = ((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)) for a, b in zip(batch["first"], batch["_before"]))
        diffs = [kernel.mean_difference(a, b) if a.size == b.size else 0.0 for a, b in pairs]
        yield pd.DataFrame({VIDEO: batch[VIDEO], FRAME: batch[FRAME], "_healed": pd.Series(diffs, index=batch.index, dtype="float32")})
