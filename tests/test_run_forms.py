"""Operators on runs and parts give what they give on frames, and large steps move no frames."""

from cutframe import fixtures
from cutframe.operators import delete_plan as plans
from cutframe.operators import edits, export, lookup, segments
from cutframe.operators.islands import joined_runs, run_bounds
from cutframe.schema import Params

FACTS = "video_id long, frame_idx long, state tinyint, diff float"
STATES = [1] * 9 + [4] * 12 + [2] * 5 + [0, 0] + [1] * 8 + [3] * 3 + [2] * 4


def table(spark):
    rows = [(v, i, s, 9.0 if (i * 7 + v) % 5 == 0 else 0.0) for v in (1, 2, 10) for i, s in enumerate(STATES)]
    catalog = spark.createDataFrame([(v, len(STATES), 24.0) for v in (1, 2, 10)], "video_id long, total long, fps double")
    return spark.createDataFrame(rows, FACTS), catalog


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_codes_as_runs_and_their_edits(spark):
    facts, catalog = table(spark)
    found = segments.pauses(segments.state_runs(facts))
    mask, codes = (f(found, facts, catalog, Params()) for f in (segments.pause_masks, segments.pause_codes))
    assert rows_of(edits.mask_frames(codes)) == rows_of(mask)
    moves = spark.createDataFrame([(1, 0, 5, 2), (1, 0, 7, 3), (2, 0, 1, 0), (2, 1, 2, 30), (2, 1, 3, 31)], "video_id long, pause_id int, seq long, frame_idx long")
    toggled = edits.toggle_blocks(codes, moves)
    assert rows_of(edits.mask_frames(toggled)) == rows_of(edits.toggle_blocks(mask, moves)) != rows_of(mask)
    assert "FlatMapGroupsInPandas" not in plan_text(edits.toggle_blocks(mask, moves))  # no call of Python for every pause
    again = spark.createDataFrame([(1, 3, 9, "auto")], "video_id long, frame_idx long, seq long, mode string")
    measured = found.selectExpr("*", "'auto' AS mode")
    assert rows_of(edits.mask_frames(edits.single_masks(toggled, measured, again, facts, catalog, Params()))) == rows_of(edits.single_masks(edits.mask_frames(toggled), measured, again, facts, catalog, Params()))


def test_plan_as_parts(spark):
    facts, catalog = table(spark)
    runs = segments.state_runs(facts).localCheckpoint()
    skips = spark.createDataFrame([(1, "clip", 11, 13), (2, "pause", 0, 9), (10, "clip", 38, 41)], "video_id long, source string, start long, end long")
    parts = plans.plan_parts(plans.plan_pieces(skips, runs, catalog, Params()), runs, catalog).localCheckpoint()
    base, plan = plans.base_frames(parts), plans.plan_frames(parts)
    gone = {(v, i) for v, a, b in ((1, 11, 13), (2, 0, 9), (10, 38, 41)) for i in range(a, min(b, len(STATES)))}
    assert {(r["video_id"], r["frame_idx"]) for r in base.where("del").collect()} == gone
    assert rows_of(plan) == rows_of(plans.with_speed_ups(base, Params()))
    factors = plans.speed_ups(Params())
    assert rows_of(plans.decimate(parts, factors)) == rows_of(plans.decimate(base, factors))
    for window in ((20,), (10, 0.25, 2.0)):
        assert rows_of(lookup.timeline_buckets(parts, catalog, *window)) == rows_of(lookup.timeline_buckets(plan, catalog, *window))
    pauses = segments.pauses(runs)
    for split, merge in ((False, False), (True, True)):
        assert rows_of(export.export_segments(parts, pauses, split, merge)) == rows_of(export.export_segments(base, pauses, split, merge))
    kept = {v: [r["frame_idx"] for r in plan.where(f"NOT del AND video_id = {v}").collect()] for v in (1, 2, 10)}
    want = sorted((i, min([k for k in kept[v] if k >= i], default=len(STATES)), v) for v in kept for i in range(len(STATES)))
    assert rows_of(plans.next_kept_frames(parts, catalog)) == want  # frames that speed-ups drop are skipped too


def test_segment_frames_from_runs(spark):
    numbered = spark.createDataFrame([(1, 1, "other", [(0, 3), (6, 9)]), (1, 2, "pause", [(10, 12)])], "video_id long, seg_no int, label string, ranges array<struct<s:long,e:long>>")
    present = spark.createDataFrame([(1, i) for i in (0, 1, 3, 6, 7, 8, 9, 10)], "video_id long, frame_idx long")
    got = export.segment_frames(numbered, present)
    assert rows_of(got) == rows_of(export.segment_frames(numbered, run_bounds(present, []))) == sorted((f, r, s, 1) for s, r, f in ((1, 0, 0), (1, 0, 1), (1, 1, 6), (1, 1, 7), (1, 1, 8), (1, 1, 9), (2, 0, 10)))


def test_runs_of_stretches_meet_by_their_ends(spark):
    pieces = spark.createDataFrame([(0, 0, 1, 0, 2), (0, 0, 2, 3, 4), (0, 0, 1, 5, 7), (0, 1, 1, 8, 15), (0, 2, 1, 16, 17), (0, 2, 3, 19, 20)], "video_id long, chunk long, state tinyint, start long, end long")
    got = joined_runs(pieces)
    assert rows_of(got) == rows_of(joined_runs(pieces.drop("chunk"))) == sorted([(2, 0, 1, 0), (4, 3, 2, 0), (17, 5, 1, 0), (20, 19, 3, 0)])
    assert "_home" in plan_text(got)  # the runs inside a stretch stay with it


def test_frames_are_made_where_their_event_lies(spark, tmp_path):
    events = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    rows = spark.createDataFrame([(3, None, 1, "click", 7.5, ""), (3, None, 1, "click", 7.5, ""), (5, None, 1, "error", None, ""), (8, None, 2, "view", 300.0, "")], events)
    rows.write.parquet(str(tmp_path / "events.parquet"))
    frames = fixtures.frames(spark, str(tmp_path))
    text = plan_text(frames)
    assert text.index("Generate explode") < text.index("Exchange")  # events are shuffled, not frames
    got = rows_of(frames.where("video_id = 1").select("frame_idx", "signal"))
    size, jitter = {3: 2 + 21, 5: 2 + 35 % 23}, lambda e, k: 4 if e % 3 and (e + k) % 9 == 0 else 0
    assert got == [(i, s) for i, s in enumerate([7 + jitter(3, k) for k in range(size[3]) for _ in range(2)] + [None] * size[5])]
