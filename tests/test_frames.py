"""Frame-timeline operators on hand-built videos and against plain loops on random ones."""

import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cutframe.functions import pixels as kernel
from cutframe.functions import scalar
from cutframe.operators import delete_plan as plans
from cutframe.operators import edits, export, intervals, lookup, pixels, segments
from cutframe.operators.islands import interval_join, run_bounds
from cutframe.plans import timeline
from cutframe.schema import Params
from cutframe.sources import sinks, tables
from cutframe.streaming import frames as streams

FACTS = "video_id long, frame_idx long, state tinyint, diff float, signal long"


def loop_runs(states):
    out, i = [], 0
    while i < len(states):
        s = i
        while i < len(states) and states[i] == states[s]:
            i += 1
        out.append((states[s], s, i - 1))
    return out


def loop_mask(s, e, diffs, still, thresh):
    """Delete codes of one pause, frame by frame."""
    n = e - s + 1
    active = [False] * n
    for k in range(1, n):
        if np.float32(diffs[s + k]) > np.float32(thresh):
            active[k] = active[k - 1] = True
    code = [0] * n
    if not any(active):
        if n > 2 * still:
            code[still : n - still] = [1] * (n - 2 * still)
        return code
    i = 0
    while i < n:
        j = i
        while j < n and active[j] == active[i]:
            j += 1
        if not active[i] and j - i > still:
            if i == 0:
                code[i : j - still] = [1] * (j - still - i)
            elif j == n:
                code[i + still : j] = [1] * (j - i - still)
            else:
                head = still // 2
                code[i + head : j - (still - head)] = [1] * (j - i - still)
        i = j
    return code


def loop_decimate(states, state, factor, gone):
    out, n = set(), 0
    for i, s in enumerate(states):
        n = n + 1 if s == state and not gone[i] else 0
        if n and n % factor != 1:
            out.add(i)
    return out


class Video:
    """A random video with everything the loops say about it."""

    def __init__(self, rng, fps, params):
        self.fps = fps
        self.states = [s for s in (rng.choice([0, 1, 1, 2, 3, 4]) for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(1, 25))]
        self.signal = [rng.choice([10, 10, 12, 14, 30]) for _ in self.states]
        self.diffs = [0.0, *(abs(a - b) for a, b in zip(self.signal, self.signal[1:]))]
        total = len(self.states)
        self.runs = loop_runs(self.states)
        still = max(2, int(fps * params.still_time))
        self.pauses, self.mask = [], {}
        for state, s, e in self.runs:
            if state == 1:
                gap = abs(self.signal[max(0, s - 1)] - self.signal[min(total - 1, e + 1)])
                self.pauses.append((s, e, "all" if gap < params.boundary_thresh else "auto", float(gap)))
                for k, c in enumerate(loop_mask(s, e, self.diffs, still, params.motion_thresh)):
                    self.mask[s + k] = c
        self.clips, prev = [], -1
        for s, e, *_ in [*self.pauses, (total, total)]:
            if s - 1 >= prev + 1:
                self.clips.append((prev + 1, s - 1))
            prev = e
        self.gone = [False] * total
        for s, e, mode, _ in self.pauses:
            for i in range(s, e + 1):
                self.gone[i] = mode == "all" or self.mask[i] in (1, 2)
        self.base = list(self.gone)
        for state, factor in ((2, 2), (4, params.speedup_02_factor)):
            for i in loop_decimate(self.states, state, factor, self.gone):
                self.gone[i] = True

    def kept_ranges(self):
        return [(s, e + 1) for v, s, e in loop_runs(self.gone) if not v]

    def segments(self, split, merge):
        label = lambda s: "pause" if s == 1 else {3: "2x", 2: "1x", 4: "0.2x"}.get(s, "other") if split else "normal"
        tags = [None if g else label(s) for g, s in zip(self.base, self.states)]
        parts = [(s, t, [(s, e)]) for t, s, e in loop_runs(tags) if t]
        if merge:
            out = [p for p in parts if p[1] != "pause"]
            for s, e, *_ in self.pauses:
                ranges = [r for _, t, rs in parts if t == "pause" for r in rs if s <= r[0] <= e]
                if ranges:
                    out.append((ranges[0][0], "pause_merged", ranges))
            parts = sorted(out)
        fused = []
        for s, t, rs in parts:
            if fused and fused[-1][1] == t and "pause" not in t:
                fused[-1][2].extend(rs)
            else:
                fused.append((s, t, list(rs)))
        return fused


PARAMS = Params(speedup_02_factor=3)


@pytest.fixture(scope="module")
def videos(spark):
    rng = random.Random(11)
    all_videos = {n: Video(rng, rng.choice([24.0, 29.97, 60.0, 0.5]), PARAMS) for n in range(60)}
    rows = [(n, i, s, float(v.diffs[i]), v.signal[i]) for n, v in all_videos.items() for i, s in enumerate(v.states)]
    frames = spark.createDataFrame(rows, FACTS).repartition(5).cache()
    catalog = spark.createDataFrame([(n, len(v.states), v.fps) for n, v in all_videos.items()], "video_id long, total long, fps double")
    found = timeline.segment(frames, catalog, frames, PARAMS)
    kept = timeline.Segments(*(getattr(found, n).cache() for n in ("pauses", "mask", "speeds", "clips", "runs")))
    return all_videos, frames, catalog, kept


def rows_of(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_runs_pauses_and_clips(videos):
    all_videos, _, _, found = videos
    assert rows_of(found.runs, "video_id", "state", "start", "end") == sorted((n, *r) for n, v in all_videos.items() for r in v.runs)
    assert rows_of(found.pauses, "video_id", "pause_id", "start", "end", "mode", "boundary_diff") == [(n, i, *p) for n, v in all_videos.items() for i, p in enumerate(v.pauses)]
    assert rows_of(found.clips, "video_id", "clip_id", "start", "end") == [(n, i, *c) for n, v in all_videos.items() for i, c in enumerate(v.clips)]
    assert rows_of(found.mask, "video_id", "frame_idx", "code") == sorted((n, i, c) for n, v in all_videos.items() for i, c in v.mask.items())


def test_plan_ranges_and_lookups(videos):
    all_videos, frames, catalog, found = videos
    plan = plans.delete_plan(frames, found.pauses, found.mask, found.clips, PARAMS).cache()
    assert rows_of(plan, "video_id", "frame_idx", "del") == [(n, i, g) for n, v in all_videos.items() for i, g in enumerate(v.gone)]
    ranges = plans.kept_ranges(plan)
    assert rows_of(ranges, "video_id", "range_idx", "start_frame", "end_frame") == [(n, i, *r) for n, v in all_videos.items() for i, r in enumerate(v.kept_ranges())]
    skips = plans.skip_intervals(found.pauses, found.mask, found.clips)
    after = {(r["video_id"], r["frame_idx"]): r["next"] for r in plans.next_kept(frames.select("video_id", "frame_idx"), skips).collect()}
    for n, v in all_videos.items():
        for i in range(len(v.base)):
            assert after[n, i] == next((j for j in range(i, len(v.base)) if not v.base[j]), len(v.base))
    moved = {(r["video_id"], r["frame_idx"]): r["out_frame"] for r in plans.concat_remap(ranges).collect()}
    for n, v in all_videos.items():
        kept = [i for i, g in enumerate(v.gone) if not g]
        assert [moved[n, i] for i in kept] == list(range(len(kept)))
    skipped = {(r["video_id"], f) for r in plans.skip_intervals(found.pauses, found.mask, found.clips).collect() for f in range(r["start"], r["end"])}
    assert skipped == {(n, i) for n, v in all_videos.items() for i, g in enumerate(v.base) if g}
    counts = {r["video_id"]: (r["kept"], r["total"], r["empty"]) for r in plans.export_counts(plan).collect()}
    assert counts == {n: (v.gone.count(False), len(v.gone), all(v.gone)) for n, v in all_videos.items()}


@pytest.mark.parametrize("split,merge", [(a, b) for a in (False, True) for b in (False, True)])
def test_export_segments(videos, split, merge):
    all_videos, frames, _, found = videos
    base = plans.delete_plan(frames, found.pauses, found.mask, found.clips, Params(speedup_1x=False, speedup_02=False))
    numbered = export.segment_order(export.merge_adjacent_segments(export.export_segments(base, found.pauses, split, merge)))
    got = sorted((r["video_id"], r["seg_no"], r["label"], [tuple(x) for x in r["ranges"]]) for r in numbered.collect())
    assert got == sorted((n, i + 1, t, rs) for n, v in all_videos.items() for i, (_, t, rs) in enumerate(v.segments(split, merge)))


def test_small_chunks_and_buckets_change_nothing(spark, videos):
    _, frames, _, found = videos
    big = rows_of(run_bounds(frames, ["state"]), "video_id", "state", "start", "end")
    for chunk in (1, 2, 3, 7):
        assert rows_of(run_bounds(frames, ["state"], chunk=chunk), "video_id", "state", "start", "end") == big
    held = rows_of(interval_join(frames.select("video_id", "frame_idx"), found.speeds), "video_id", "frame_idx", "type")
    assert rows_of(interval_join(frames.select("video_id", "frame_idx"), found.speeds, bucket=3), "video_id", "frame_idx", "type") == held
    gaps = spark.createDataFrame([(1, i) for i in (0, 1, 3, 4, 5, 9)], "video_id long, frame_idx long")
    assert rows_of(run_bounds(gaps, [], chunk=2), "start", "end") == [(0, 1), (3, 5), (9, 9)]


@pytest.mark.parametrize("factor", [2, 3, 10])
def test_decimation_keeps_the_first_of_each(spark, factor):
    states = [4] * 23 + [0] + [4] * 9 + [4] * 5
    gone = [i in (30, 31) for i in range(len(states))]
    plan = spark.createDataFrame([(1, i, s, g) for i, (s, g) in enumerate(zip(states, gone))], "video_id long, frame_idx long, state tinyint, del boolean")
    assert {r["frame_idx"] for r in plans.decimate(plan, {4: factor}).collect()} == loop_decimate(states, 4, factor, gone)


def test_missing_frames(spark):
    catalog = spark.createDataFrame([(1, 6, 30.0), (2, 0, 30.0)], "video_id long, total long, fps double")
    facts = spark.createDataFrame([(1, 0, 1, 0.0, 5), (1, 1, 1, 1.0, 6), (1, 2, 0, 1.0, 7)], FACTS)
    spine = segments.frame_spine(catalog, facts)
    assert rows_of(spine, "frame_idx", "state", "diff") == [(0, 1, 0.0), (1, 1, 1.0), (2, 0, 1.0), (3, 0, 0.0), (4, 0, 0.0), (5, 0, 0.0)]
    found = segments.pauses(segments.state_runs(facts))
    measured = segments.boundary_diff(found, catalog, facts.where("frame_idx <> 2"), timeline.signal_distance, "signal")
    row = segments.mode_override(measured, 5.0).first()
    assert (row["boundary_diff"], row["both"], row["mode"]) == (0.0, False, "auto")  # not forced at analysis
    assert edits.bulk_mode(segments.mode_override(measured, 5.0), "auto", 5.0).first()["mode"] == "all"  # but by the bulk edit
    numbered = spark.createDataFrame([(1, 1, "normal", [(0, 2), (4, 5)]), (1, 2, "pause", [(9, 9)])], "video_id long, seg_no int, label string, ranges array<struct<s:long,e:long>>")
    present = spark.createDataFrame([(1, f) for f in (0, 2, 4, 5)], "video_id long, frame_idx long")
    assert rows_of(export.segment_frames(numbered, present), "seg_no", "frame_idx") == [(1, 0), (1, 4), (1, 5)]
    summary = export.segment_summary(numbered, present)
    assert rows_of(summary, "seg_no", "requested", "written", "success") == [(1, 5, 3, True), (2, 1, 0, False)]
    assert [r["error"] for r in export.first_failures(summary).collect()] == ["pause: wrote 0 of 1 frames"]
    none = spark.createDataFrame([(1, 1, "x", [])], "video_id long, seg_no int, label string, ranges array<struct<s:long,e:long>>")
    assert export.to_half_open(none).first()["requested"] == 0


def test_a_video_without_pauses_and_one_that_is_a_pause(spark):
    catalog = spark.createDataFrame([(1, 4, 30.0), (2, 4, 30.0)], "video_id long, total long, fps double")
    facts = spark.createDataFrame([(v, i, v - 1, 0.0, 9) for v in (1, 2) for i in range(4)], FACTS)
    found = timeline.segment(facts, catalog, facts, Params())
    assert rows_of(found.clips, "video_id", "start", "end") == [(1, 0, 3)]
    assert rows_of(found.pauses, "video_id", "start", "end", "mode") == [(2, 0, 3, "all")]
    counts = plans.export_counts(plans.delete_plan(facts, found.pauses, found.mask, found.clips, Params()))
    assert rows_of(counts, "video_id", "kept", "empty") == [(1, 4, False), (2, 0, True)]


def test_motion_is_compared_as_floats(spark):
    thresh = 0.1  # as a double it is below its float
    facts = spark.createDataFrame([(1, i, 1, 0.1, 0) for i in range(4)], FACTS)
    found = segments.pauses(segments.state_runs(facts))
    masked = segments.motion_mask(segments.pause_frames(found, facts), thresh)
    assert not any(r["active"] for r in masked.collect())


# Edits


@pytest.mark.parametrize("missing", ["", "pause", "speed_1x", "speed_0_2x"])
def test_the_cascade_equals_all_scores(spark, missing):
    rng = np.random.default_rng(12)
    patches = {c: [rng.integers(0, 256, (4, 5)) for _ in range(2)] for c in ("pause", "speed_1x", "speed_2x", "speed_0_2x")}
    planes = rng.integers(0, 256, (60, 10, 14)).astype(np.uint8)
    for i, c in enumerate(list(patches) * 12):
        noise = rng.integers(-40, 40, (4, 5))
        planes[i, 2:6, 3:8] = np.clip(patches[c][i % 2] + noise, 0, 255)
    rows = [(c, 0, 0, 14, 10, 5, 4, p.ravel().tolist(), [1] * 20) for c, ps in patches.items() if c != missing for p in ps]
    templates = spark.createDataFrame(rows, "class string, roi_x int, roi_y int, roi_w int, roi_h int, t_w int, t_h int, t array<int>, m array<int>")
    frames = spark.createDataFrame([(1, i, 14, 10, bytearray(p.tobytes())) for i, p in enumerate(planes)], "video_id long, frame_idx long, w int, h int, px binary")
    want = rows_of(pixels.classify(pixels.class_scores(frames, templates), Params()), "frame_idx", "state")
    assert rows_of(pixels.states(frames, templates, Params()), "frame_idx", "state") == want and len({s for _, s in want}) > 3


def still_rows(rng, n, lost=()):
    planes = [rng.integers(0, 256, (6, 8)).astype(np.uint8) for _ in range(n)]
    return [(v, i, 16, 12, 3, bytearray(np.repeat(np.repeat(np.repeat(p, 2, 0), 2, 1)[..., None], 3, 2).tobytes())) for v in (1, 2) for i, p in enumerate(planes) if v == 2 or i not in lost], planes


@pytest.mark.parametrize("tasks,batch", [(1, 7), (5, 1000)])
def test_stills_to_facts_in_one_pass(spark, tmp_path, tasks, batch):
    from cutframe.operators import stills as ops

    rows, planes = still_rows(np.random.default_rng(3), 40, lost={7, 8, 20})
    random.Random(1).shuffle(rows)
    frames = spark.createDataFrame(rows + rows[:4], "video_id long, frame_idx long, w int, h int, channels int, px binary").repartition(tasks)
    if tasks == 1:
        frames = frames.sortWithinPartitions("video_id", "frame_idx")
    pause = {"x": 0, "y": 0, "w": 8, "h": 6, "t": planes[5].astype(int), "m": np.ones((6, 8), int)}
    kept = []

    def keep(name, df):
        kept.append(df)
        df.write.parquet(str(tmp_path / name))
        return spark.read.schema(df.schema).parquet(str(tmp_path / name))

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        facts = ops.analyze_stills(frames, ops.TemplateSet(prepared={"pause": [pause], "speed_1x": [], "speed_2x": [], "speed_0_2x": []}), Params(proc_w=8, proc_h=6, threshold_pause=0.99), keep)
        got = rows_of(facts, "video_id", "frame_idx", "state", "diff")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for v in (1, 2):
        before = None
        for i, p in enumerate(planes):
            if v == 2 or i not in {7, 8, 20}:
                want.append((v, i, int(i == 5), float(np.float32(np.abs(p.astype(int) - before).mean())) if before is not None else 0.0))
                before = p.astype(int)
    assert got == want and len(kept) == 1
    plan = facts._jdf.queryExecution().toString()
    assert plan.count("ExistingRDD") == 0  # the pixels are read once, by the pass that was kept
    if tasks == 1:
        assert kept[0].where("first IS NOT NULL").count() <= 2 * (2 + 3) + 12  # pixels leave the task at ends of stretches and batches alone


def test_image_files_to_facts(spark, tmp_path):
    rng = np.random.default_rng(4)
    scenes = [rng.integers(0, 256, (30, 40)).astype(np.uint8) for _ in range(3)]
    for i in range(9):
        path = tmp_path / "stills" / "7" / f"{i:05}.bmp"
        path.parent.mkdir(parents=True, exist_ok=True)
        write_bmp(path, scenes[i // 3])
    for name, plane in (("templates_1x/t.bmp", scenes[1][6:26, 10:30].copy()), ("source_images_1x/s.bmp", scenes[1])):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        write_bmp(tmp_path / name, plane)

    def keep(name, df):
        df.write.parquet(str(tmp_path / name))
        return spark.read.schema(df.schema).parquet(str(tmp_path / name))

    facts = timeline.analyze_images(spark, str(tmp_path / "stills"), str(tmp_path), Params(proc_w=20), keep)
    got = facts.orderBy("frame_idx").collect()
    assert [r["state"] for r in got] == [0, 0, 0, 2, 2, 2, 0, 0, 0]
    assert [r["diff"] > 0 for r in got] == [i in (3, 6) for i in range(9)]


def test_toggles_equal_a_loop(spark):
    rng = random.Random(4)
    masks = {p: [rng.choice([0, 0, 1, 1, 2, 3]) for _ in range(rng.randint(1, 12))] for p in range(30)}
    log = {p: [(q, rng.randint(0, len(m))) for q in range(rng.randint(0, 4))] for p, m in masks.items()}
    mask = spark.createDataFrame([(1, 100 * p + i, p, c) for p, m in masks.items() for i, c in enumerate(m)], "video_id long, frame_idx long, pause_id int, code tinyint")
    edit = spark.createDataFrame([(1, p, q, 100 * p + at) for p, es in log.items() for q, at in es], "video_id long, pause_id int, seq long, frame_idx long")
    want = {p: list(m) for p, m in masks.items()}
    for p, es in log.items():
        for _, at in es:
            m = want[p]
            if at < len(m):
                a = b = at
                while a > 0 and m[a - 1] == m[at]:
                    a -= 1
                while b < len(m) - 1 and m[b + 1] == m[at]:
                    b += 1
                m[a : b + 1] = [2 if m[at] in (0, 3) else 3] * (b - a + 1)
    flat = sorted((100 * p + i, c) for p, m in want.items() for i, c in enumerate(m))
    assert rows_of(edits.toggle_blocks(mask, edit), "frame_idx", "code") == flat
    one = edit.where("seq = 0")
    assert rows_of(edits.toggle_block(mask, one), "frame_idx", "code") == rows_of(edits.toggle_blocks(mask, one), "frame_idx", "code")


def test_handles_cross_and_push(spark):
    clips = spark.createDataFrame([(1, 0, 10, 20, 10, 20), (1, 1, 30, 40, 30, 40), (1, 2, 50, 60, 50, 60)], "video_id long, clip_id int, start long, end long, keep_in long, keep_out long")
    moves = spark.createDataFrame([(1, 0, 2, "out", 12), (1, 0, 1, "in", 15), (1, 1, 1, "in", 99), (1, 1, 2, "out", -5)], "video_id long, clip_id int, seq long, side string, tf long")
    out = edits.trim_handles(clips, moves)
    assert rows_of(out, "clip_id", "keep_in", "keep_out") == [(0, 13, 12), (1, 30, 29), (2, 50, 60)]
    assert rows_of(plans.clip_delete_rows(out), "frame_idx") == [(i,) for i in (*range(10, 21), *range(30, 41))]


def test_single_edits_recompute_only_their_pauses(spark):
    catalog = spark.createDataFrame([(1, 40, 30.0)], "video_id long, total long, fps double")
    facts = spark.createDataFrame([(1, i, 0 if i == 20 else 1, 0.0, 0) for i in range(40)], FACTS)
    found = timeline.segment(facts, catalog, facts, Params())
    manual = found.mask.withColumn("code", F.lit(2).cast("tinyint"))
    log = spark.createDataFrame([(1, 1, 3, "auto"), (1, 2, 3, "keep"), (1, 3, 20, "all")], "video_id long, seq long, frame_idx long, mode string")
    assert rows_of(edits.single_mode(found.pauses, log), "pause_id", "mode") == [(0, "keep"), (1, "all")]
    fresh = edits.single_masks(manual, found.pauses, log, facts, catalog, Params())
    codes = {r["frame_idx"]: r["code"] for r in fresh.collect()}
    assert codes[0] == 0 and codes[10] == 1 and all(codes[i] == 2 for i in range(21, 40))
    assert {r["code"] for r in edits.bulk_masks(manual, found.pauses, facts, catalog, "keep", Params()).collect()} == {2}


# Lookups, functions, sources, sinks


def test_lookups(videos, spark):
    all_videos, frames, catalog, found = videos
    probes = frames.select((F.col("video_id") * 1000 + F.col("frame_idx")).alias("probe_id"), "video_id", "frame_idx")
    for r in lookup.segment_lookup(probes, found.pauses, found.speeds).collect():
        state = all_videos[r["video_id"]].states[r["frame_idx"]]
        assert r["kind"] == ("pause" if state == 1 else "speed" if state > 1 else "normal") and (r["type"] == (state if state > 1 else None))
    for r in lookup.speed_step(probes, found.speeds, True, True, 1).collect():
        assert r["step"] == {2: 2, 4: 2}.get(all_videos[r["video_id"]].states[r["frame_idx"]], 1)


def test_scalar_functions(spark):
    df = spark.createDataFrame([("/a/b.c/in.x.mkv", "0.5xx", 3725.9), ("clip", "nan?", 59.0), ("/a/.hidden", "3x", 0.0), ("", "", 6000.0)], "p string, s string, t double")
    rows = df.select(scalar.clipped_name(F.col("p")).alias("c"), scalar.segments_folder(F.col("p")).alias("f"), scalar.preview_speed(F.col("s")).alias("v"), scalar.fmt_mmss(F.col("t")).alias("m")).collect()
    assert [tuple(r) for r in rows] == [("/a/b.c/in.x_clipped.mp4", "/a/b.c/in.x_segments", 0.5, "62:05"), ("clip_clipped.mp4", "clip_segments", 1.0, "00:59"), ("/a/.hidden_clipped.mp4", "/a/.hidden_segments", 3.0, "00:00"), ("_clipped.mp4", "segments_segments", 1.0, "100:00")]
    stems = spark.createDataFrame([(3, 120), (120, 120), (7, 9)], "i int, n int").select(scalar.segment_stem(F.col("i"), F.col("n"), F.lit("x")).alias("s"))
    assert [r["s"] for r in stems.collect()] == ["003_x", "120_x", "7_x"]
    assert spark.range(1).select(scalar.still_frames(F.lit(29.97), F.lit(0.1)).alias("n"), scalar.frame_seconds(F.lit(5), F.lit(0.0)).alias("z")).first() == (2, 0.0)
    assert [r["h"] for r in spark.createDataFrame([(1920, 1080), (640, 480)], "w int, h int").select(scalar.processing_height(F.col("w"), F.col("h"), 400, 225).alias("h")).collect()] == [225, 300]
    roi = spark.range(1).select(scalar.enlarged_roi(F.lit(1), F.lit(30), F.lit(10), F.lit(4), F.lit(0.5), F.lit(0.5)).alias("r")).first()["r"]
    assert tuple(roi) == (0, 14, 10, 4)


def write_bmp(path, gray):
    """A 24-bit bitmap of a gray plane."""
    h, w = gray.shape
    row = (3 * w + 3) // 4 * 4
    body = b"".join(np.repeat(line, 3).astype(np.uint8).tobytes().ljust(row, b"\0") for line in gray[::-1])
    path.write_bytes(b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + len(body), 0, 0, 54, 40, w, h, 1, 24, 0, len(body), 0, 0, 0, 0) + body)


def test_image_sources(spark, tmp_path):
    plane = np.arange(30, dtype=np.uint8).reshape(5, 6)
    for name in ("templates_pause/a.bmp", "templates_pause/B.BMP", "source_images_pause/z.bmp", "source_images_pause/y.bmp", "templates_other/a.bmp", "templates_speed_1x/broken.png", "templates_speed_1x/note.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        write_bmp(tmp_path / name, plane) if "bmp" in name.lower() else (tmp_path / name).write_bytes(b"no image")
    for folder in ("1x", "2x", "play"):  # folders that have other names than their class
        for name in (f"templates_{folder}/t.bmp", f"source_images_{folder}/s.bmp"):
            (tmp_path / "shipped" / name).parent.mkdir(parents=True, exist_ok=True)
            write_bmp(tmp_path / "shipped" / name, plane)
    named = tables.template_images(spark, str(tmp_path / "shipped")).collect()
    assert sorted((r["class"], r["role"]) for r in named) == sorted((c, r) for c in ("speed_1x", "speed_2x", "speed_0_2x") for r in ("source", "template"))
    rows = tables.template_images(spark, str(tmp_path)).where("origin NOT LIKE '%shipped%'").collect()
    assert sorted((r["class"], r["role"], r["origin"].rsplit("/", 1)[1]) for r in rows) == [("pause", "source", "y.bmp"), ("pause", "template", "B.BMP"), ("pause", "template", "a.bmp")]
    bgr = np.frombuffer(rows[0]["px"], np.uint8).reshape(5, 6, rows[0]["channels"])
    assert (kernel.gray(bgr) == plane).all()
    (tmp_path / "stills/7").mkdir(parents=True)
    write_bmp(tmp_path / "stills/7/00012.bmp", plane)
    r = tables.image_frames(spark, str(tmp_path / "stills")).first()
    assert (r["video_id"], r["frame_idx"], r["w"], r["h"]) == (7, 12, 6, 5)


def test_templates_from_images(spark, tmp_path):
    from cutframe.operators.templates import prepare_templates

    rng = np.random.default_rng(6)
    source = rng.integers(0, 256, (40, 80)).astype(np.uint8)
    patch = source[10:18, 30:42].copy()
    for name, plane in (("templates_pause/a.bmp", patch), ("source_images_pause/s.bmp", source), ("templates_speed_1x/b.bmp", patch), ("templates_speed_2x/c.bmp", source), ("source_images_speed_2x/d.bmp", patch)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        write_bmp(tmp_path / name, plane)
    ready = prepare_templates(tables.template_images(spark, str(tmp_path)), 40, 20)
    (r,) = ready.collect()  # the others lack a source or do not fit into it
    assert (r["class"], r["template_id"], r["x"], r["y"]) == ("pause", 0, 30, 10)
    assert (r["roi_x"], r["roi_y"], r["roi_w"], r["roi_h"], r["t_w"], r["t_h"]) == (12, 3, 12, 8, 6, 4)
    assert r["t"] == kernel.area_resize(patch[None], 6, 4)[0].ravel().tolist() and r["m"] == (patch[::2, ::2] > 10).astype(int).ravel().tolist()
    frame = kernel.area_resize(source[None], 40, 20)[0]
    frames = spark.createDataFrame([(1, 0, 40, 20, bytearray(frame.tobytes()))], "video_id long, frame_idx long, w int, h int, px binary")
    assert pixels.class_scores(frames, ready).first()["pause"] == pytest.approx(1.0)


def test_functions_for_sql(spark):
    from cutframe.functions.udfs import register_functions

    register_functions(spark)
    a, b = bytearray(range(12)), bytearray([5] * 12)
    spark.createDataFrame([(a, b), (None, b)], "a binary, b binary").createOrReplaceTempView("payloads")
    rows = spark.sql("SELECT pixel_mad(a, b) AS d, gray(b) AS g, area_resize(a, 4, 3, 2, 1) AS r, ncc_best(a, 4, 3, a, b, 4, 3) AS s FROM payloads").collect()
    assert rows[0]["d"] == pytest.approx(np.abs(np.arange(12) - 5).mean()) and bytes(rows[0]["g"]) == bytes([5] * 4) and len(rows[0]["r"]) == 2
    assert tuple(rows[1]) == (None, bytearray([5] * 4), None, None)


def test_sinks(spark, videos, tmp_path):
    _, frames, catalog, found = videos
    sinks.write_frame_facts(frames.select("video_id", "frame_idx", "state", "diff"), str(tmp_path / "facts"), 4)
    back = sinks.read_frame_facts(spark, str(tmp_path / "facts"))
    assert rows_of(back, "video_id", "frame_idx", "state") == rows_of(frames, "video_id", "frame_idx", "state")
    plan = spark.createDataFrame([(1, f, 0, f in (2, 3)) for f in range(9)], "video_id long, frame_idx long, state tinyint, del boolean")
    cuts = sinks.cut_list(plans.kept_ranges(plan), catalog)
    for fmt in ("parquet", "csv", "json"):
        sinks.write_rows(cuts, str(tmp_path / fmt), fmt)
        reader = spark.read.option("header", True) if fmt == "csv" else spark.read
        assert reader.format(fmt).load(str(tmp_path / fmt)).count() == cuts.count()
    facts = tables.frame_table(spark, str(tmp_path / "facts"))
    assert facts.columns == ["video_id", "frame_idx", "state", "diff"]
    assert tables.params_table(spark).first()["proc_w"] == 400


# Pixels


def plain_ncc(i, t, m):
    n = m.sum()
    tz, iz = (t - (t * m).sum() / n) * m, (i - (i * m).sum() / n) * m
    d = np.sqrt((tz**2).sum() * (iz**2).sum())
    return (tz * iz).sum() / d if d > 1e-9 else np.nan


def test_correlation_equals_its_definition():
    rng = np.random.default_rng(2)
    planes = rng.integers(0, 256, (3, 9, 11)).astype(float)
    planes[2, :5, :5] = 7  # flat: no score there
    t, m = rng.integers(0, 256, (4, 5)).astype(float), (rng.random((4, 5)) > 0.3).astype(float)
    got = kernel.ncc(planes, t, m)
    for f in range(3):
        for y in range(6):
            for x in range(7):
                want = plain_ncc(planes[f, y : y + 4, x : x + 5], t, m)
                assert got[f, y, x] == pytest.approx(want, nan_ok=True)


def test_best_scores_and_classes(spark):
    rng = np.random.default_rng(3)
    plane = rng.integers(0, 256, (12, 16))
    t = plane[3:7, 5:10]
    m = np.ones_like(t)
    area = {"x": 2, "y": 1, "w": 99, "h": 99, "t": t, "m": m}
    small = {"x": 13, "y": 0, "w": 99, "h": 99, "t": t, "m": m}
    assert kernel.best_scores(plane[None], [area])[0] == pytest.approx(1.0) and kernel.best_scores(plane[None], [small])[0] == -1.0
    assert kernel.best_scores(np.full((1, 12, 16), 9), [area])[0] == -1.0
    assert kernel.best_place(plane, t)[:2] == (5, 3)
    scores = spark.createDataFrame([(1, 0, 0.7, 0.9, 0.9, 0.9), (1, 1, 0.6, 0.8, 0.8, 0.71), (1, 2, 0.6, 0.75, 0.72, 0.9), (1, 3, 0.6, 0.72, 0.8, 0.9), (1, 4, -1.0, 0.72, 0.69, 0.1), (1, 5, 0.0, 0.69, 0.75, 0.9), (1, 6, 0.0, 0.1, 0.2, 0.3)], "video_id long, frame_idx long, pause double, speed_1x double, speed_2x double, speed_0_2x double")
    assert [r["state"] for r in pixels.classify(scores, Params()).orderBy("frame_idx").collect()] == [1, 4, 2, 3, 2, 3, 0]
    raised = Params(threshold_speed_2x=0.9)
    assert pixels.classify(scores.where("frame_idx = 3"), raised).first()["state"] == 4  # 1x loses to a 2x that misses its own bound


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(1, 12), st.integers(1, 12), st.integers(1, 12))
def test_area_resize_conserves_the_mean(h, w, oh, ow):
    assert (kernel.overlap(h, oh).sum(1) == h).all() and (kernel.overlap(w, ow).sum(0) == ow).all()
    flat = np.full((1, h, w), 77, np.uint8)
    assert (kernel.area_resize(flat, ow, oh) == 77).all()


def test_whole_analysis_from_pixels(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 256, (4, 8, 8))
    frames = spark.createDataFrame([(1, i, 8, 8, bytearray(base[i // 5].astype(np.uint8).tobytes())) for i in range(20)], "video_id long, frame_idx long, w int, h int, px binary")
    t = base[1][2:6, 2:6].ravel().tolist()
    templates = spark.createDataFrame([("pause", 0, 0, 8, 8, 4, 4, t, [1] * 16)], "class string, roi_x int, roi_y int, roi_w int, roi_h int, t_w int, t_h int, t array<int>, m array<int>")
    facts = timeline.analyze(frames, templates, Params(threshold_pause=0.99))
    assert [r["state"] for r in facts.orderBy("frame_idx").collect()] == [0] * 5 + [1] * 5 + [0] * 10
    hot = {r["frame_idx"] for r in facts.where("diff > 0").collect()}
    assert hot == {5, 10, 15}
    assert {r["state"] for r in pixels.template_gate(frames, pixels.classify(pixels.class_scores(frames, templates.limit(0)), Params())).collect()} == {0}
    spread = pixels.chunked_frame_diff(frames, 3)
    assert rows_of(spread, "frame_idx", "diff") == rows_of(pixels.chunked_frame_diff(frames, 256), "frame_idx", "diff")


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 40), st.integers(1, 12), st.integers(1, 12), st.integers(0, 1000))
def test_area_resize_against_plain_weights(h, w, oh, ow, seed):
    planes = np.random.default_rng(seed).integers(0, 256, (2, h, w), np.uint8)
    sums = kernel.overlap(h, oh) @ planes.astype(np.int64) @ kernel.overlap(w, ow).T
    assert (kernel.area_resize(planes, ow, oh) == np.rint(sums / (h * w))).all()


def test_gray_of_every_other_colour():
    b, g, r = (x.ravel() for x in np.meshgrid(np.arange(0, 256, 2), np.arange(256), np.arange(256), indexing="ij"))
    plain = np.floor(b * 0.114 + g * 0.587 + r * 0.299 + 0.5)
    assert (kernel.gray(np.stack([b, g, r], 1).astype(np.uint8)) == plain).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 7), st.integers(1, 7), st.booleans(), st.integers(0, 1000))
def test_ncc_against_a_loop(th, tw, whole, seed):
    rng = np.random.default_rng(seed)
    plane, t = rng.integers(0, 256, (th + 2, tw + 3), np.uint8), rng.integers(0, 256, (th, tw))
    m = np.ones_like(t) if whole else rng.integers(0, 2, (th, tw))
    found = kernel.ncc(plane[None], t, m)[0]
    for y, x in np.ndindex(3, 4):
        patch, shape = plane[y : y + th, x : x + tw][m > 0].astype(float), t[m > 0].astype(float)
        if len(shape) and patch.std() and shape.std():
            a, b = patch - patch.mean(), shape - shape.mean()
            assert found[y, x] == pytest.approx((a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()), abs=1e-9)
        else:
            assert np.isnan(found[y, x])


# Overlaps, repeated frames, gaps


def test_the_first_of_overlapping_segments_wins(spark):
    rng = random.Random(6)
    pauses = sorted({(s, s + rng.randrange(60)) for s in (rng.randrange(300) for _ in range(25))})
    rows = [(1, i, "auto", 0.0, s, e) for i, (s, e) in enumerate(pauses)]
    held = spark.createDataFrame(rows, "video_id long, pause_id int, mode string, boundary_diff double, start long, end long")
    speeds = spark.createDataFrame([(1, 2, 0, 400), (1, 4, 100, 200)], "video_id long, type tinyint, start long, end long")
    probes = spark.createDataFrame([(i, 1, i) for i in range(400)], "probe_id long, video_id long, frame_idx long")
    found = lookup.segment_lookup(probes, held, speeds).collect()
    assert len(found) == 400
    for r in found:
        want = next((i for i, (s, e) in enumerate(pauses) if s <= r["frame_idx"] <= e), None)
        assert r["pause_id"] == want and r["kind"] == ("speed" if want is None else "pause") and r["type"] == (2 if want is None else None)
    assert {r["step"] for r in lookup.speed_step(probes, speeds, True, True, 10).collect()} == {2}


def test_repeated_frames_count_once(spark):
    facts = spark.createDataFrame([(1, f, s, 0.0, 0) for f, s in ((0, 1), (0, 1), (1, 1), (1, 1), (2, 1), (3, 0), (5, 0), (5, 0))], FACTS)
    for chunk in (2, 4, 100):
        assert rows_of(run_bounds(facts, ["state"], chunk=chunk), "state", "start", "end") == [(0, 3, 3), (0, 5, 5), (1, 0, 2)]


def test_differences_over_gaps(spark):
    there = [0, 1, 5, 6, 7, 30, 31, 64]
    frames = spark.createDataFrame([(1, f, 1, 1, [f * 3]) for f in there], "video_id long, frame_idx long, w int, h int, px array<int>")
    want = [(f, float(3 * (f - b))) for b, f in zip([there[0], *there], there)]
    for chunk in (1, 2, 4, 16, 256):
        assert rows_of(pixels.chunked_frame_diff(frames, chunk), "frame_idx", "diff") == want
    assert rows_of(segments.frame_diff(frames), "frame_idx", "diff") == want


def loop_set(rows):
    return {(v, f) for v, s, e in rows for f in range(s, e + 1)}


def loop_intervals(points):
    out = []
    for v, f in sorted(points):
        if out and out[-1][0] == v and out[-1][2] == f - 1:
            out[-1] = (v, out[-1][1], f)
        else:
            out.append((v, f, f))
    return out


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_interval_algebra_equals_sets_of_frames(spark, chunk):
    rng = random.Random(chunk)
    draw = lambda n: [(v, s, s + rng.choice([-1, 0, 1, 3, 20])) for v in (1, 2, 3) for s in (rng.randrange(-5, 60) for _ in range(n))]
    one, other = draw(12), draw(6)
    make = lambda rows: spark.createDataFrame(rows, "video_id long, start long, end long")
    catalog = spark.createDataFrame([(1, 50), (2, 7), (3, 0), (4, 15)], "video_id long, total long")
    inside = loop_set([(1, 0, 49), (2, 0, 6), (4, 0, 14)])
    got = lambda df: rows_of(df, "video_id", "start", "end")
    assert got(intervals.union(make(one).where("start >= 0"), chunk)) == loop_intervals(loop_set([r for r in one if r[1] >= 0]))
    assert got(intervals.complement(make(one), catalog, chunk)) == loop_intervals(inside - loop_set(one))
    assert got(intervals.difference(make(one), make(other), catalog, chunk)) == loop_intervals(loop_set(one) & inside - loop_set(other))
    pairs = intervals.overlaps(make(one).withColumn("a", F.monotonically_increasing_id()), make(other).withColumn("b", F.monotonically_increasing_id()), chunk)
    want = sorted((v, max(s, t), min(e, f)) for v, s, e in one for w, t, f in other if v == w and s <= e and t <= f and max(s, t) <= min(e, f))
    assert got(pairs) == want


@pytest.mark.parametrize("params", [PARAMS, Params(), Params(speedup_1x=False, speedup_02=False), Params(speedup_02_factor=2)])
def test_plans_on_intervals_equal_plans_of_frames(videos, params):
    _, frames, catalog, found = videos
    plan = plans.delete_plan(frames, found.pauses, found.mask, found.clips, params)
    deletes = segments.pause_deletes(found.pauses, frames, catalog, params)
    assert rows_of(spread_codes(deletes), "video_id", "frame_idx") == rows_of(found.mask.where("code = 1"), "video_id", "frame_idx")
    for mask in (deletes, found.mask):
        pieces = plans.plan_pieces(plans.skip_intervals(found.pauses, mask, found.clips), found.runs, catalog, params).cache()
        assert rows_of(plans.plan_of_pieces(frames, pieces), "video_id", "frame_idx", "state", "del") == rows_of(plan, "video_id", "frame_idx", "state", "del")
        assert rows_of(plans.ranges_of_pieces(pieces), "video_id", "range_idx", "start_frame", "end_frame") == rows_of(plans.kept_ranges(plan), "video_id", "range_idx", "start_frame", "end_frame")


def spread_codes(deletes):
    return deletes.select("video_id", F.explode(F.sequence("start", "end")).alias("frame_idx"))


def test_segment_summary_equals_its_frames(videos):
    _, frames, _, found = videos
    base = plans.delete_plan(frames, found.pauses, found.mask, found.clips, Params(speedup_1x=False, speedup_02=False))
    numbered = export.segment_order(export.merge_adjacent_segments(export.export_segments(base, found.pauses, True, True))).cache()
    present = frames.where("frame_idx % 11 <> 5").select("video_id", "frame_idx")
    written = export.segment_frames(numbered, present).groupBy("video_id", "seg_no").count()
    got = {(r["video_id"], r["seg_no"]): r["written"] for r in export.segment_summary(numbered, present).collect() if r["written"]}
    assert got == {(r["video_id"], r["seg_no"]): r["count"] for r in written.collect()}


def test_a_null_state_stays_in_the_plan(spark):
    facts = spark.createDataFrame([(1, 0, None), (1, 1, 2), (1, 2, 2), (1, 3, None)], "video_id long, frame_idx long, state tinyint")
    deletes = spark.createDataFrame([(1, 3), (1, 9)], "video_id long, frame_idx long")
    assert rows_of(plans.mark_deletes(facts, deletes), "frame_idx", "del") == [(0, False), (1, False), (2, False), (3, True)]
    skips = spark.createDataFrame([(1, 3, 4)], "video_id long, start long, end long")
    catalog = spark.createDataFrame([(1, 4)], "video_id long, total long")
    pieces = plans.plan_pieces(skips, segments.state_runs(facts), catalog, PARAMS)
    assert rows_of(plans.plan_of_pieces(facts, pieces), "frame_idx", "del") == [(0, False), (1, False), (2, True), (3, True)]


def loop_replay(log, pauses, masks, thresh):
    """Mode and codes of each pause, edit by edit."""
    modes, codes = {p[0]: p[3] for p in pauses}, {p[0]: list(masks[p[0]]) for p in pauses}
    for seq, kind, frame, mode in sorted(log, key=lambda e: (e[0], e[1])):
        for pid, s, e, _, diff in pauses:
            if kind != "bulk" and not s <= frame <= e:
                continue
            if kind == "toggle":
                if modes[pid] == "auto":
                    c, i = codes[pid], frame - s
                    a = b = i
                    while a > 0 and c[a - 1] == c[i]:
                        a -= 1
                    while b < len(c) - 1 and c[b + 1] == c[i]:
                        b += 1
                    c[a : b + 1] = [2 if c[i] in (0, 3) else 3] * (b + 1 - a)
                continue
            if mode == "auto":
                codes[pid] = list(masks[pid])
            modes[pid] = ("all" if diff < thresh else "auto") if kind == "bulk" and mode == "auto" else mode
    return modes, codes


@pytest.mark.parametrize("seed", range(4))
def test_edit_history_equals_a_loop_on_the_lazy_chain(spark, videos, seed):
    """Pauses and masks come straight from timeline.segment, unsaved."""
    all_videos, frames, catalog, _ = videos
    rng = random.Random(seed)
    log = []
    for n, v in all_videos.items():
        for seq in range(rng.choice([0, 3, 15])):
            kind = rng.choice(["bulk", "single", "toggle", "toggle", "toggle"])
            log.append((n, seq, kind, None if kind == "bulk" else rng.randrange(len(v.states)), None if kind == "toggle" else rng.choice(["auto", "auto", "keep", "all"])))
    found = timeline.segment(frames, catalog, frames, PARAMS)
    done = edits.replay_edits(spark.createDataFrame(log, "video_id long, seq long, kind string, frame_idx long, mode string"), found.pauses, found.mask, frames, catalog, PARAMS)
    modes, codes = rows_of(done.pauses, "video_id", "pause_id", "mode"), rows_of(done.mask, "video_id", "frame_idx", "code")
    want_modes, want_codes = [], []
    for n, v in all_videos.items():
        pauses = [(i, s, e, mode, diff) for i, (s, e, mode, diff) in enumerate(v.pauses)]
        m, c = loop_replay([x[1:] for x in log if x[0] == n], pauses, {i: [v.mask[f] for f in range(s, e + 1)] for i, s, e, *_ in pauses}, PARAMS.boundary_thresh)
        want_modes += [(n, i, m[i]) for i, *_ in pauses]
        want_codes += [(n, s + k, code) for i, s, *_ in pauses for k, code in enumerate(c[i])]
    assert modes == sorted(want_modes) and codes == sorted(want_codes)


def test_every_operator_on_the_lazy_chain(spark, videos):
    _, frames, catalog, _ = videos
    found = timeline.segment(frames, catalog, frames, PARAMS)
    some = frames.where("frame_idx % 5 = 0").select("video_id", "frame_idx", F.col("frame_idx").alias("seq"))
    auto = found.pauses.where("mode = 'auto'")
    located = edits.edited_pauses(some, auto)
    modes = some.withColumn("mode", F.lit("auto"))
    moves = interval_join(some, found.clips.select("video_id", "clip_id", "start", "end")).select("video_id", "clip_id", "seq", F.lit("in").alias("side"), F.col("frame_idx").alias("tf"))
    clips = edits.trim_handles(found.clips, moves)
    toggled = edits.toggle_blocks(found.mask, located)
    plan = plans.delete_plan(frames, found.pauses, toggled, clips, PARAMS)
    chains = [
        toggled, edits.toggle_block(found.mask, located.dropDuplicates(["video_id", "pause_id"])), edits.single_mode(found.pauses, modes), edits.single_masks(toggled, found.pauses, modes, frames, catalog, PARAMS),
        edits.bulk_masks(toggled, found.pauses, frames, catalog, "auto", PARAMS), plan, plans.ranges_of_pieces(plans.plan_pieces(plans.skip_intervals(found.pauses, toggled, clips), found.runs, catalog, PARAMS)),
        lookup.segment_lookup(some.withColumnRenamed("seq", "probe_id"), found.pauses, found.speeds), lookup.timeline_layers(toggled, found.pauses, clips, catalog, 20), lookup.timeline_buckets(plan, catalog, 20),
        export.export_segments(plans.base_plan(frames, found.pauses, found.mask, clips), found.pauses, True, True), plans.next_kept(some, plans.skip_intervals(found.pauses, toggled, clips)),
    ]
    for chain in chains:
        chain.write.format("noop").mode("overwrite").save()
    assert rows_of(plans.ranges_of_pieces(plans.plan_pieces(plans.skip_intervals(found.pauses, toggled, clips), found.runs, catalog, PARAMS)), "video_id", "range_idx", "start_frame", "end_frame") == rows_of(plans.kept_ranges(plan), "video_id", "range_idx", "start_frame", "end_frame")


def streamed(spark, tmp_path, rows, operator, files=6, trigger=2):
    source = str(tmp_path / "in")
    rows.repartition(files).write.parquet(source)
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", trigger).parquet(source)
    result = operator(arriving)
    streams.run_to_end(result, str(tmp_path / "out"), str(tmp_path / "state"))
    return spark.read.schema(result.schema).parquet(str(tmp_path / "out"))


def test_streamed_runs_of_a_long_video(spark, tmp_path):
    """100,000 frames dealt at random over the files: all runs, and no frame lost."""
    facts = spark.range(100_000).select(F.lit(1).cast("long").alias("video_id"), F.col("id").alias("frame_idx"), F.expr("CAST((id div 1000 + IF(id % 5003 = 7, 1, 0)) % 5 AS TINYINT)").alias("state"))
    said = streamed(spark, tmp_path, facts.orderBy(F.rand(3)), streams.stream_runs)
    got = streams.settled_runs(said)
    assert got.agg(F.sum(F.expr("end - start + 1"))).first()[0] == 100_000
    assert rows_of(got, "state", "start", "end") == rows_of(segments.state_runs(facts), "state", "start", "end")


@pytest.mark.parametrize("payload", ["array<int>", "binary"])
def test_streamed_differences_in_any_order_and_over_gaps(spark, tmp_path, payload):
    rng = random.Random(5)
    lost = {3, 4, *range(28, 38), *range(60, 90), 96}
    rows = [(v, f, [rng.randrange(256) for _ in range(6)]) for v in (1, 2) for f in range(v - 1, 140) if f not in lost or v == 2]
    rng.shuffle(rows)
    data = [(v, f, bytearray(px) if payload == "binary" else px) for v, f, px in rows]
    frames = spark.createDataFrame(data + data[:9], f"video_id long, frame_idx long, px {payload}")
    said = streamed(spark, tmp_path, frames, lambda s: streams.stream_frame_diff(s, 16, 2))
    distinct = spark.createDataFrame(rows, "video_id long, frame_idx long, px array<int>")
    want = rows_of(pixels.chunked_frame_diff(distinct, 16), "video_id", "frame_idx", "diff")
    assert rows_of(streams.settled_diffs(said, distinct), "video_id", "frame_idx", "diff") == want
    without = {(r["video_id"], r["frame_idx"]): r["diff"] for r in streams.settled_diffs(said).collect()}
    assert {k for k, d in without.items() if d is None} == {(1, 38), (1, 90)}  # gaps over a border that are longer than the overlap


def test_late_frames_join_runs_of_an_earlier_batch(spark, tmp_path):
    """Ten batches, the first of which has only every tenth frame."""
    for n, part in enumerate([range(0, 400, 10), [i for i in range(400) if i % 10 and i not in (205, 206)]]):
        spark.createDataFrame([(1, i, int(i >= 200)) for i in part], "video_id long, frame_idx long, state int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema("video_id long, frame_idx long, state int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    result = streams.stream_runs(arriving, 64)
    streams.run_to_end(result, str(tmp_path / "out"), str(tmp_path / "state"))
    got = streams.settled_runs(spark.read.schema(result.schema).parquet(str(tmp_path / "out")))
    assert rows_of(got, "state", "start", "end") == [(0, 0, 199), (1, 200, 204), (1, 207, 399)]


def test_windows_of_the_timeline_from_sums(spark, videos):
    _, frames, catalog, found = videos
    rng = random.Random(2)
    plan = plans.delete_plan(frames, found.pauses, found.mask, found.clips, PARAMS).cache()
    sums = lookup.timeline_sums(plans.skip_intervals(found.pauses, found.mask, found.clips), found.runs, catalog, PARAMS).cache()
    for width, scroll, zoom in [(7, 0.0, 1.0), (120, 0.0, 1.0), *((rng.randint(1, 90), rng.random(), rng.choice([1.0, 1.7, 4.0, 33.3])) for _ in range(4))]:
        got, want = lookup.timeline_window(sums, catalog, width, scroll, zoom), lookup.timeline_buckets(plan, catalog, width, scroll, zoom)
        assert rows_of(got, *want.columns) == rows_of(want, *want.columns)


def test_a_plan_after_edits_is_the_full_plan(spark, videos):
    _, frames, catalog, found = videos
    before = plans.skip_intervals(found.pauses, found.mask, found.clips)
    stored = plans.plan_pieces(before, found.runs, catalog, PARAMS).cache()
    pauses = found.pauses.withColumn("mode", F.when((F.col("video_id") % 3 == 0) & (F.col("pause_id") % 2 == 0), "keep").otherwise(F.col("mode")))
    clips = found.clips.withColumn("keep_in", F.when((F.col("video_id") % 5 == 1) & (F.col("clip_id") == 1), F.col("keep_in") + 2).otherwise(F.col("keep_in")))
    after = plans.skip_intervals(pauses, found.mask, clips)
    names = ("video_id", "start", "end", "state", "step")
    full = rows_of(plans.plan_pieces(after, found.runs, catalog, PARAMS), *names)
    assert rows_of(plans.replan(stored, before, after, found.runs, catalog, PARAMS), *names) == full != rows_of(stored, *names)
    assert rows_of(plans.replan(stored, before, before, found.runs, catalog, PARAMS), *names) == rows_of(stored, *names)


def test_a_sweep_is_each_set_alone(videos):
    _, frames, catalog, found = videos
    sweep = [PARAMS, Params(still_time=0.4), Params(motion_thresh=3.5), Params(motion_thresh=3.5, still_time=0.0)]
    got = segments.sweep_deletes(found.pauses, frames, catalog, sweep)
    want = sorted((n, *r) for n, p in enumerate(sweep) for r in rows_of(segments.pause_deletes(found.pauses, frames, catalog, p), "video_id", "pause_id", "start", "end"))
    assert rows_of(got, "params_id", "video_id", "pause_id", "start", "end") == want


def test_colocated_tables_need_no_exchange(spark, videos, tmp_path):
    _, frames, _, found = videos
    plan = plans.delete_plan(frames, found.pauses, found.mask, found.clips, PARAMS)
    facts = sinks.store_colocated(frames.select("video_id", "frame_idx", "state"), "facts_here", str(tmp_path / "facts"), 8, 16)
    deletes = sinks.store_colocated(plan.select("video_id", "frame_idx", "del"), "plan_here", str(tmp_path / "plan"), 8, 16)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set(sinks.COLOCATED, "false")
    try:
        met = facts.join(deletes, ["video_id", "chunk", "frame_idx"]).groupBy("video_id", "chunk").agg(F.sum((~F.col("del")).cast("int")).alias("kept"))
        shown = met._jdf.queryExecution().executedPlan().toString()
        kept = met.agg(F.sum("kept")).first()[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset(sinks.COLOCATED)
    assert "Exchange" not in shown and kept == plan.where("NOT del").count()
    runs = sinks.colocated_runs(facts, 16)
    shown = runs._jdf.queryExecution().executedPlan().toString()
    assert rows_of(runs, "video_id", "state", "start", "end") == rows_of(found.runs, "video_id", "state", "start", "end")
    assert shown.count("Exchange hashpartitioning") == 1  # of the stretches' runs, not of frames
    pruned = facts.where("video_id = 3 AND frame_idx BETWEEN 20 AND 30")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(frame_idx,20)" in pruned
    spark.sql("DROP TABLE facts_here")
    spark.sql("DROP TABLE plan_here")


def test_a_long_video_is_written_by_many_tasks(spark, tmp_path):
    facts = spark.range(1000).select(F.lit(1).cast("long").alias("video_id"), F.col("id").alias("frame_idx"), F.lit(0).cast("tinyint").alias("state"), F.lit(0.0).cast("float").alias("diff"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_frame_facts(facts, str(tmp_path / "facts"), 4, 100)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = spark.read.parquet(str(tmp_path / "facts"))
    assert back.count() == 1000 and len(back.inputFiles()) > 1
