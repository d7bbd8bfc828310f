"""Arrow functions for SQL: pixel_mad, ncc_best, area_resize and gray, over binary payloads. A session gets them by register_functions()."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pixels as kernel


@F.pandas_udf(T.DoubleType())
def pixel_mad(a: pd.Series, b: pd.Series) -> pd.Series:
    """Mean absolute difference of two payloads of one size; null if either is null."""
    mad = lambda x, y: np.abs(np.frombuffer(x, np.uint8).astype(np.int32) - np.frombuffer(y, np.uint8)).mean()
    return pd.Series([None if x is None or y is None else mad(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.BinaryType())
def gray(bgr: pd.Series) -> pd.Series:
    """Gray payload of a BGR payload."""
    return pd.Series([None if p is None else kernel.gray(np.frombuffer(p, np.uint8).reshape(1, -1, 3)).tobytes() for p in bgr], dtype=object)


@F.pandas_udf(T.BinaryType())
def area_resize(px: pd.Series, w: pd.Series, h: pd.Series, out_w: pd.Series, out_h: pd.Series) -> pd.Series:
    """Gray payload of w x h at out_w x out_h."""
    return pd.Series([None if p is None else kernel.area_resize(kernel.plane(p, a, b)[None], c, d)[0].tobytes() for p, a, b, c, d in zip(px, w, h, out_w, out_h)], dtype=object)


@F.pandas_udf(T.DoubleType())
def ncc_best(px: pd.Series, w: pd.Series, h: pd.Series, t: pd.Series, m: pd.Series, t_w: pd.Series, t_h: pd.Series) -> pd.Series:
    """Best score of a template (gray payload and 0/1 mask payload) anywhere in a frame; -1.0 without a finite one."""

    def best(p, a, b, t, m, c, d) -> float:
        plane = kernel.plane(p, a, b)
        return float(kernel.best_scores(plane[None], [{"x": 0, "y": 0, "w": a, "h": b, "t": kernel.plane(t, c, d), "m": kernel.plane(m, c, d)}])[0])

    return pd.Series([None if any(x is None for x in row) else best(*row) for row in zip(px, w, h, t, m, t_w, t_h)], dtype="float64")


def register_functions(spark: SparkSession) -> None:
    for name, f in (("pixel_mad", pixel_mad), ("gray", gray), ("area_resize", area_resize), ("ncc_best", ncc_best)):
        spark.udf.register(name, f)
