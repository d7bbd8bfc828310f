"""NumPy kernels on pixels, for Arrow batches: luma, area resize, masked correlation. Frames come as binary or as integer arrays."""

from __future__ import annotations

import math

import numpy as np

#: Pixels that are turned gray at a time, so that they stay in the cache.
BLOCK = 65_536


def plane(px, w: int, h: int) -> np.ndarray:
    """Row-major gray plane of a payload."""
    flat = np.frombuffer(px, np.uint8) if isinstance(px, (bytes, bytearray, memoryview)) else np.asarray(px)
    return flat.reshape(h, w)


def gray(bgr: np.ndarray) -> np.ndarray:
    """Luma of H x W x 3 BGR, rounded half up.

    Thousandths of the luma are integers that single precision holds exactly. Where they stand on a half, doubles decide, as they
    do in the SQL form of the luma.
    """
    flat = bgr.reshape(-1, 3)
    out = np.empty(len(flat), np.uint8)
    for at in range(0, len(flat), BLOCK):
        part = flat[at : at + BLOCK]
        sums = part.astype(np.float32) @ np.array([114, 587, 299], np.float32) + np.float32(500)
        luma = (sums * np.float32(0.001) + np.float32(0.0001)).astype(np.uint8)
        ties = np.flatnonzero(sums == luma * np.float32(1000))
        b, g, r = part[ties].T.astype(np.float64)
        luma[ties] = np.floor(b * 0.114 + g * 0.587 + r * 0.299 + 0.5)
        out[at : at + BLOCK] = luma
    return out.reshape(bgr.shape[:-1])


def overlap(size: int, out: int) -> np.ndarray:
    """(out, size) overlaps of output cells with input cells, in 1/out of an input cell: integers that add up to `size` for each output."""
    lo = np.maximum.outer(np.arange(out) * size, np.arange(size) * out)
    hi = np.minimum.outer(np.arange(1, out + 1) * size, np.arange(1, size + 1) * out)
    return np.maximum(hi - lo, 0)


def area_resize(planes: np.ndarray, out_w: int, out_h: int) -> np.ndarray:
    """Area-weighted means of planes (n, h, w), rounded half to even.

    Cells meet again after every size / gcd(size, out) pixels, so each axis is cut into equal blocks that share one small matrix of
    overlaps. The weighted sums are integers, held in single precision as far as that is exact.
    """
    n, h, w = planes.shape
    rows, columns = math.gcd(h, out_h), math.gcd(w, out_w)
    block_h, block_w = h // rows, w // columns
    kind = np.float32 if 255 * block_h * block_w < 1 << 24 else np.float64
    down = overlap(block_h, out_h // rows).astype(kind) @ planes.reshape(n * rows, block_h, w).astype(kind)
    sums = down.reshape(-1, block_w) @ overlap(block_w, out_w // columns).T.astype(kind)
    return np.rint(sums.astype(np.float64) / (block_h * block_w)).astype(np.uint8).reshape(n, out_h, out_w)


def _correlate(planes: np.ndarray, kernels: np.ndarray) -> np.ndarray:
    """(n, k, y, x): sums of kernels (k, th, tw) at every offset in planes (n, h, w), in the planes' precision.

    Each kernel row is laid out as a band matrix, so that all frames and offsets of a row are one matrix product.
    """
    k, th, tw = kernels.shape
    n, h, w = planes.shape
    rows, columns = h - th + 1, w - tw + 1
    band = np.zeros((th, w, columns, k), planes.dtype)
    for i in range(columns):
        band[:, i : i + tw, i] = kernels.transpose(1, 2, 0)
    out = np.zeros((n * rows, columns * k), planes.dtype)
    for r in range(th):
        out += planes[:, r : r + rows].reshape(-1, w) @ band[r].reshape(w, -1)
    return out.reshape(n, rows, columns, k).transpose(0, 3, 1, 2)


def _box_sums(planes: np.ndarray, th: int, tw: int) -> np.ndarray:
    """(n, y, x): sums of every th x tw box of integer planes."""
    n, h, w = planes.shape
    total = np.zeros((n, h + 1, w + 1), np.int64)
    total[:, 1:, 1:] = planes.cumsum(1, dtype=np.int64).cumsum(2)
    return total[:, th:, tw:] - total[:, :-th, tw:] - total[:, th:, :-tw] + total[:, :-th, :-tw]


def ncc(planes: np.ndarray, t: np.ndarray, m: np.ndarray) -> np.ndarray:
    """(n, y, x): zero-mean normalised correlation of template `t` under the 0/1 mask `m`; NaN where a side is flat.

    Both sides are 8-bit values taken from 128, which changes no term of the result but keeps every sum of products of up to
    1,023 pixels below 2**24: single precision is exact up to that, doubles beyond.
    """
    kind = np.float32 if t.size < 1024 else np.float64
    planes, t, m = planes.astype(np.int16) - 128, (t.astype(np.int64) - 128) * m, m.astype(np.int64)
    n, t_sum, t_square = float(m.sum()), float(t.sum()), float((t * t).sum())
    if m.all():
        ti = _correlate(planes.astype(kind), t[None])[:, 0]
        i_sum, i_square = (_box_sums(x, *m.shape) for x in (planes, planes * planes))
    else:
        ti, i_sum = _correlate(planes.astype(kind), np.stack([t, m])).transpose(1, 0, 2, 3)
        i_square = _correlate((planes * planes).astype(kind), m[None])[:, 0]
    ti, i_sum, i_square = (x.astype(np.float64) for x in (ti, i_sum, i_square))
    spread = (n * t_square - t_sum * t_sum) * (n * i_square - i_sum * i_sum)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(spread > 0, (n * ti - t_sum * i_sum) / np.sqrt(spread), np.nan)


def best_scores(planes: np.ndarray, templates: list[dict]) -> np.ndarray:
    """Best finite score of each plane over templates of one class; -1.0 if there is none.

    A template has x, y, w, h (search area), t and m (2-D arrays). Areas are cut at the frame; those smaller than the template are left out.
    """
    best = np.full(len(planes), -1.0)
    _, fh, fw = planes.shape
    for s in templates:
        w, h = min(fw - s["x"], s["w"]), min(fh - s["y"], s["h"])
        if w <= 0 or h <= 0 or h < s["t"].shape[0] or w < s["t"].shape[1]:
            continue
        scores = ncc(planes[:, s["y"] : s["y"] + h, s["x"] : s["x"] + w], s["t"], s["m"]).reshape(len(planes), -1)
        best = np.fmax(best, np.fmax.reduce(scores, axis=1))
    return best


def reaches(planes: np.ndarray, templates: list[dict], threshold: float) -> np.ndarray:
    """Whether each plane's best score is at least `threshold`. A plane that a template has decided is not compared to the others."""
    hit = np.zeros(len(planes), bool)
    for s in templates:
        left = np.flatnonzero(~hit)
        if not len(left):
            break
        hit[left] = best_scores(planes[left] if len(left) < len(planes) else planes, [s]) >= threshold
    return hit


def mean_difference(a: np.ndarray, b: np.ndarray) -> np.float32:
    """Mean absolute difference of two planes of 8-bit values."""
    return np.float32(np.abs(a.astype(np.int16) - b).sum(dtype=np.int64) / a.size)


def best_place(plane: np.ndarray, t: np.ndarray) -> tuple[int, int, float] | None:
    """(x, y, score) of the best unmasked match; the first in rows then columns of equals."""
    scores = ncc(plane[None], t, np.ones_like(t))[0]
    if not np.isfinite(scores).any():
        return None
    at = int(np.nanargmax(scores))
    return at % scores.shape[1], at // scores.shape[1], float(scores.flat[at])
