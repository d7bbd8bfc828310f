"""Template images to the template table that scoring uses."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pixels as kernel

SCHEMA = "class string, template_id int, x int, y int, src_w int, src_h int, roi_x int, roi_y int, roi_w int, roi_h int, t_w int, t_h int, t array<int>, m array<int>"


def nearest(plane: np.ndarray, out_w: int, out_h: int) -> np.ndarray:
    """Plane at another size by its nearest pixels."""
    h, w = plane.shape
    return plane[np.arange(out_h) * h // out_h][:, np.arange(out_w) * w // out_w]


LOCATED = "class string, template_id int, x int, y int, src_w int, src_h int, w int, h int, gray binary"


def scaled(template: np.ndarray, x: int, y: int, src_w: int, src_h: int, proc_w: int, proc_h: int, mask_level: int) -> dict:
    """A template (x, y: its place in the source) at processing size, with its mask and its search area, twice its size about that place."""
    h, w = template.shape
    sx, sy = proc_w / src_w, proc_h / src_h
    tw, th = max(1, int(w * sx)), max(1, int(h * sy))
    area = {"x": max(0, int(x * sx - w * sx / 2)), "y": max(0, int(y * sy - h * sy / 2)), "w": int(w * sx * 2), "h": int(h * sy * 2)}
    return area | {"t": kernel.area_resize(template[None], tw, th)[0].astype(np.int32), "m": nearest((template > mask_level).astype(np.int32), tw, th)}


def located(images: DataFrame) -> DataFrame:
    """Rows of LOCATED from images (class, role, origin, w, h, channels, px): where each template is found in its class's source.

    Classes without a source have no templates, nor have templates larger than it.
    """
    source = images.where("role = 'source'").select("class", F.struct("w", "h", "channels", "px").alias("source"))
    number = (F.row_number().over(Window.partitionBy("class").orderBy("origin")) - 1).cast("int")
    rows = images.where("role = 'template'").withColumn("template_id", number).join(source, "class").select(F.col("class").alias("kind"), "template_id", "w", "h", "channels", "px", *(F.col(f"source.{c}").alias(f"src_{c}") for c in ("w", "h", "channels", "px")))

    def plane(px: bytes, w: int, h: int, channels: int) -> np.ndarray:
        flat = np.frombuffer(px, np.uint8).reshape(h, w, channels)
        return flat[..., 0] if channels == 1 else kernel.gray(flat[..., :3])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                template, whole = plane(r.px, r.w, r.h, r.channels), plane(r.src_px, r.src_w, r.src_h, r.src_channels)
                if r.w <= r.src_w and r.h <= r.src_h and (place := kernel.best_place(whole, template)):
                    out.append((r.kind, r.template_id, *place[:2], r.src_w, r.src_h, r.w, r.h, template.tobytes()))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in LOCATED.split(", ")])

    return rows.mapInPandas(run, LOCATED)


def prepare_templates(images: DataFrame, proc_w: int, proc_h: int, mask_level: int = 10) -> DataFrame:
    """Rows of SCHEMA from images (class, role, origin, w, h, channels, px): located templates at processing size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                s = scaled(np.frombuffer(r["gray"], np.uint8).reshape(r["h"], r["w"]), r["x"], r["y"], r["src_w"], r["src_h"], proc_w, proc_h, mask_level)
                out.append((*(r[c] for c in ("class", "template_id", "x", "y", "src_w", "src_h")), *(s[c] for c in "xywh"), *s["t"].shape[::-1], s["t"].ravel(), s["m"].ravel()))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return located(images).mapInPandas(run, SCHEMA)
