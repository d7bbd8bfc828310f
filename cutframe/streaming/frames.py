"""Streaming forms of the frame operators, for frames that arrive in micro-batches in any order, however late.

State is kept for each stretch of a video, not for the video: (video, chunk). Nothing is dropped and nothing waits for an end of
input. A stretch says anew what it knows whenever frames of it arrive, and what was said last counts: `settled_runs` and
`settled_diffs` read that from the sink, and join what goes on over the border of two stretches. A stretch's state is at most a byte a
frame for runs; for differences a bit a frame and the pixels of the frames whose neighbours are still missing.

Repeated frames count once, the first to arrive. Frames that never come are gaps, as in the batch forms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.islands import joined_runs
from ..operators.pixels import states
from ..schema import FRAME, VIDEO, Params

#: Frames of a stretch: states are small, pixels are not.
RUN_CHUNK, PIXEL_CHUNK = 4_096, 256
#: Frames at the end of a stretch that the next one also gets: a gap of that many frames may lie on a border.
OVERLAP = 8
UNSEEN = -128


def _raw(px) -> bytes:
    """A frame's pixels as bytes, from BINARY or from an array of numbers."""
    return bytes(px) if isinstance(px, (bytes, bytearray, memoryview)) else np.asarray(px).astype(np.uint8).tobytes()


def runs_of(states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the maximal runs of equal values."""
    cuts = np.flatnonzero(np.diff(states)) + 1
    return np.concatenate([[0], cuts]), np.concatenate([cuts - 1, [len(states) - 1]])


def stream_runs(facts: DataFrame, chunk: int = RUN_CHUNK) -> DataFrame:
    """video_id, chunk, version, state, start, end of a stream of (video_id, frame_idx, state): all runs that a stretch has so far, at every batch that adds to it. For settled_runs."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, held = state.get if state.exists else (0, b"")
        now = np.frombuffer(held, np.int8).copy() if held else np.full(chunk, UNSEEN, np.int8)
        base, added = key[1] * chunk, False
        for batch in batches:
            at, values = batch[FRAME].to_numpy() - base, batch["state"].to_numpy().astype(np.int8)
            at, first = np.unique(at, return_index=True)
            new = now[at] == UNSEEN
            now[at[new]] = values[first][new]
            added |= bool(new.any())
        if added:
            state.update((version + 1, now.tobytes()))
            starts, ends = runs_of(now)
            there = now[starts] != UNSEEN
            yield pd.DataFrame({VIDEO: key[0], "chunk": key[1], "version": version, "state": now[starts[there]], "start": starts[there] + base, "end": ends[there] + base})

    dealt = facts.select(VIDEO, FRAME, "state", F.floor(F.col(FRAME) / chunk).alias("chunk"))
    return dealt.groupBy(VIDEO, "chunk").applyInPandasWithState(step, f"{VIDEO} long, chunk long, version long, state tinyint, start long, end long", "version long, held binary", "append", GroupStateTimeout.NoTimeout)


def settled_runs(said: DataFrame) -> DataFrame:
    """video_id, state, start, end: the maximal runs, from the output of stream_runs. Joins the newest runs of each stretch over its borders: one row a run and stretch meets in a window."""
    newest = said.withColumn("_newest", F.max("version").over(Window.partitionBy(VIDEO, "chunk"))).where("version = _newest")
    return joined_runs(newest)


def stream_frame_diff(frames: DataFrame, chunk: int = PIXEL_CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """video_id, frame_idx, before, diff of a stream of (video_id, frame_idx, px): the difference to the nearest earlier frame that has arrived, said again when a nearer one arrives.

    `before` is that frame, -1 if there is none in reach. For settled_diffs.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bits, held_at, held_px = state.get if state.exists else (b"", [], [])
        base = key[1] * chunk - overlap  # places count from the first frame that is handed over
        seen = np.unpackbits(np.frombuffer(bits, np.uint8), count=chunk + overlap).astype(bool) if bits else np.zeros(chunk + overlap, bool)
        pixels, fresh = dict(zip(held_at, held_px)), np.zeros(chunk + overlap, bool)
        for batch in batches:
            for at, px in zip((batch[FRAME] - base).tolist(), batch["px"]):
                if not seen[at]:
                    seen[at] = fresh[at] = True
                    pixels[at] = _raw(px)
        if not fresh.any():
            return
        there = np.flatnonzero(seen)
        pairs = zip([-1, *there[:-1].tolist()], there.tolist())
        out = []
        for p, f in pairs:
            if f < overlap or not (fresh[f] or (p >= 0 and fresh[p])):
                continue
            diff = 0.0
            if p >= 0:
                a, b = (np.frombuffer(pixels[i], np.uint8).astype(np.int16) for i in (p, f))
                diff = np.abs(a - b).sum() / len(b)
            out.append((key[0], f + base, p + base if p >= 0 else -1, diff))
        alone = [i for i in pixels if (i + 1 < len(seen) and not seen[i + 1]) or (i >= overlap and i + base > 0 and not seen[i - 1])]
        state.update((np.packbits(seen).tobytes(), alone, [pixels[i] for i in alone]))
        if out:
            yield pd.DataFrame(out, columns=[VIDEO, FRAME, "before", "diff"]).astype({VIDEO: "int64", FRAME: "int64", "before": "int64", "diff": "float32"})

    own = F.floor(F.col(FRAME) / chunk)
    homes = F.filter(F.array(own, F.when(F.col(FRAME) % chunk >= chunk - overlap, own + 1)), lambda c: c.isNotNull())
    dealt = frames.select(VIDEO, FRAME, "px", F.explode(homes).alias("chunk"))
    return dealt.groupBy(VIDEO, "chunk").applyInPandasWithState(step, f"{VIDEO} long, {FRAME} long, before long, diff float", "seen binary, at array<int>, px array<binary>", "append", GroupStateTimeout.NoTimeout)


def settled_diffs(said: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """video_id, frame_idx, diff from the output of stream_frame_diff: what was said against the nearest frame.

    After a gap over a stretch's border that is longer than the overlap a frame has met none before it. With `frames`, the stored pixels, such frames
    are compared to the last one there was; without, their difference is null. A video's first frame has 0.
    """
    best = said.groupBy(VIDEO, FRAME).agg(F.max("before").alias("before"), F.max_by("diff", "before").alias("diff"))
    first = best.groupBy(VIDEO).agg(F.min(FRAME).alias("_first"))
    known = best.join(first, VIDEO).withColumn("_open", (F.col("before") < 0) & (F.col(FRAME) > F.col("_first")))
    if frames is None:
        return known.select(VIDEO, FRAME, F.when(~F.col("_open"), F.col("diff")).alias("diff"))
    from ..functions.scalar import pixel_mad

    opened = known.where("_open").select(VIDEO, F.col(FRAME).alias("_at"))
    ends = known.select(VIDEO, FRAME).join(opened, VIDEO).where(F.col(FRAME) < F.col("_at")).groupBy(VIDEO, "_at").agg(F.max(FRAME).alias("_last"))
    one = frames.select(VIDEO, F.col(FRAME).alias("_at"), F.col("px").alias("_now"))
    two = frames.select(VIDEO, F.col(FRAME).alias("_last"), F.col("px").alias("_then"))
    healed = ends.join(one, [VIDEO, "_at"]).join(two, [VIDEO, "_last"]).select(VIDEO, F.col("_at").alias(FRAME), pixel_mad(F.col("_now"), F.col("_then")).cast("float").alias("_healed"))
    return known.join(healed, [VIDEO, FRAME], "left").select(VIDEO, FRAME, F.coalesce("_healed", "diff").alias("diff"))


def stream_classify(frames: DataFrame, templates: DataFrame, params: Params) -> DataFrame:
    """video_id, frame_idx, state of arriving frames (w, h, px); nothing is carried over."""
    return states(frames, templates, params)


def run_to_end(stream: DataFrame, out_path: str, checkpoint: str) -> None:
    """Process all that is there now, in micro-batches, into Parquet."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", out_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
