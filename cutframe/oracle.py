"""SQL (DuckDB dialect) that states each query's result in its own way, on the driver's tables."""

from __future__ import annotations

import re

#: Named parts; each may use the ones before it.
PARTS = {
    "fx_frames": """
        WITH x AS (SELECT user_id AS video_id, ts, event_id, unnest(range(0, 2 + (event_id * 7) % 23)) AS k,
                          CASE event_type WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 ELSE 0 END AS state,
                          CAST(floor(value) AS BIGINT) AS lv FROM events),
        y AS (SELECT video_id, state, row_number() OVER (PARTITION BY video_id ORDER BY ts, event_id, k) - 1 AS frame_idx,
                     lv % 250 + CASE WHEN event_id % 3 > 0 AND (event_id + k) % 9 = 0 THEN 4 ELSE 0 END AS signal FROM x)
        SELECT video_id, frame_idx, CAST(state AS TINYINT) AS state, signal,
               CAST(coalesce(abs(signal - lag(signal) OVER (PARTITION BY video_id ORDER BY frame_idx)), 0) AS FLOAT) AS diff FROM y""",
    "fx_catalog": """
        SELECT video_id, max(frame_idx) + 1 AS total,
               CASE video_id % 4 WHEN 0 THEN 24.0::DOUBLE WHEN 1 THEN 29.97::DOUBLE WHEN 2 THEN 30.0::DOUBLE ELSE 60.0::DOUBLE END AS fps
        FROM fx_frames GROUP BY video_id""",
    "fx_pixels": """
        SELECT vec_id // 50 AS video_id, vec_id % 50 AS frame_idx, label,
               list_transform(embedding, lambda x: least(255, greatest(0, CAST(floor(CAST(x AS DOUBLE) * 256) AS INT) + 128))) AS px FROM embeddings""",
    "fx_templates": """
        WITH f AS (SELECT label, min_by(px, video_id * 50 + frame_idx) AS src FROM fx_pixels GROUP BY label),
        t AS (SELECT label, src, list_transform(range(0, 16), lambda i: src[(2 + i // 4) * 8 + 2 + i % 4 + 1]) AS t FROM f)
        SELECT label AS template_id, CASE label % 4 WHEN 0 THEN 'pause' WHEN 1 THEN 'speed_1x' WHEN 2 THEN 'speed_2x' ELSE 'speed_0_2x' END AS class,
               src, t, list_transform(t, lambda v: CASE WHEN v > 100 THEN 1 ELSE 0 END) AS m FROM t""",
    "with_total": "SELECT event_id, user_id AS video_id, total FROM events JOIN fx_catalog ON user_id = video_id",
    "fx_probes": "SELECT event_id AS probe_id, video_id, (event_id * 31) % total AS frame_idx FROM with_total",
    "fx_delete_set": "SELECT DISTINCT video_id, (event_id * 11) % (total + 50) - 25 AS frame_idx FROM with_total WHERE event_id % 7 = 0",
    "fx_mode_edits": """
        SELECT video_id, event_id AS seq, (event_id * 37) % total AS frame_idx,
               CASE event_id % 3 WHEN 0 THEN 'keep' WHEN 1 THEN 'auto' ELSE 'all' END AS mode FROM with_total WHERE event_id % 5 = 0""",
    "fx_bulk_edits": "SELECT user_id AS video_id, event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'keep' ELSE 'all' END AS mode FROM events WHERE event_id % 25 = 7",
    "fx_toggle_edits": "SELECT video_id, event_id AS seq, (event_id * 41) % total AS frame_idx FROM with_total WHERE event_id % 5 = 3",
    "fx_clip_edits": """
        SELECT video_id, event_id AS seq, (event_id * 53) % total AS anchor_idx, CASE WHEN (event_id // 10) % 2 = 0 THEN 'in' ELSE 'out' END AS side,
               (event_id * 53) % total + (event_id * 13) % 41 - 20 AS tf FROM with_total WHERE event_id % 2 = 1""",
    "runs": """
        SELECT video_id, state, min(frame_idx) AS s, max(frame_idx) AS e
        FROM (SELECT *, frame_idx - row_number() OVER (PARTITION BY video_id, state ORDER BY frame_idx) AS g FROM fx_frames) GROUP BY video_id, state, g""",
    "pauses": "SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY s) - 1 AS INT) AS pause_id, s, e FROM runs WHERE state = 1",
    "speeds": "SELECT video_id, state AS type, s, e FROM runs WHERE state >= 2",
    "measured": """
        SELECT p.*, CAST(abs(a.signal - b.signal) AS DOUBLE) AS bd FROM pauses p JOIN fx_catalog c USING (video_id)
        JOIN fx_frames b ON b.video_id = p.video_id AND b.frame_idx = greatest(0, p.s - 1)
        JOIN fx_frames a ON a.video_id = p.video_id AND a.frame_idx = least(c.total - 1, p.e + 1)""",
    "moded": "SELECT *, CASE WHEN bd < 5 THEN 'all' ELSE 'auto' END AS mode FROM measured",
    "active": """
        SELECT video_id, frame_idx, pause_id, s, e, hot OR coalesce(lead(hot) OVER (PARTITION BY video_id, pause_id ORDER BY frame_idx), false) AS active
        FROM (SELECT f.video_id, f.frame_idx, pause_id, s, e, diff > 2 AND frame_idx > s AS hot FROM fx_frames f JOIN pauses p ON f.video_id = p.video_id AND frame_idx BETWEEN s AND e)""",
    "mask": """
        WITH g AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY video_id, pause_id, active ORDER BY frame_idx) AS g FROM active),
        r AS (SELECT *, min(frame_idx) OVER (PARTITION BY video_id, pause_id, active, g) - s AS a, max(frame_idx) OVER (PARTITION BY video_id, pause_id, active, g) - s AS b,
                     bool_or(active) OVER (PARTITION BY video_id, pause_id) AS any_active, frame_idx - s AS k, e - s + 1 AS n FROM g),
        k AS (SELECT r.*, greatest(2, CAST(floor(fps * 0.1::DOUBLE) AS INT)) AS st FROM r JOIN fx_catalog USING (video_id))
        SELECT video_id, frame_idx, pause_id, CAST(CASE WHEN
            CASE WHEN NOT any_active THEN n > 2 * st AND k >= st AND k < n - st
                 WHEN active OR b - a + 1 <= st THEN false
                 WHEN a = 0 THEN k <= b - st
                 WHEN b = n - 1 THEN k >= a + st
                 ELSE k BETWEEN a + st // 2 AND b - (st - st // 2) END THEN 1 ELSE 0 END AS TINYINT) AS code FROM k""",
    "clips": """
        WITH g AS (SELECT video_id, coalesce(lag(e) OVER w, -1) + 1 AS s, s - 1 AS e
                   FROM (SELECT video_id, s, e FROM pauses UNION ALL SELECT video_id, total, total FROM fx_catalog) WINDOW w AS (PARTITION BY video_id ORDER BY s))
        SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY s) - 1 AS INT) AS clip_id, s, e FROM g WHERE e >= s""",
    "clip_moves": """
        SELECT c.*, row_number() OVER (PARTITION BY c.video_id, clip_id ORDER BY seq) AS n, seq, side, tf
        FROM clips c JOIN fx_clip_edits d ON c.video_id = d.video_id AND anchor_idx BETWEEN s AND e""",
    "edited_clips": """
        SELECT c.video_id, c.clip_id, c.s, c.e, coalesce(arg_max(h.ki, h.n), c.s) AS ki, coalesce(arg_max(h.ko, h.n), c.e) AS ko
        FROM clips c LEFT JOIN handles h USING (video_id, clip_id) GROUP BY c.video_id, c.clip_id, c.s, c.e""",
    "pause_deletes": """
        SELECT m.video_id, m.frame_idx FROM mask m JOIN moded p USING (video_id, pause_id) WHERE mode = 'all' OR (mode = 'auto' AND code IN (1, 2))""",
    "clip_deletes": """
        SELECT f.video_id, f.frame_idx FROM fx_frames f JOIN edited_clips c ON f.video_id = c.video_id AND frame_idx BETWEEN s AND e WHERE ki > ko OR frame_idx < ki OR frame_idx > ko""",
    "base_plan": """
        SELECT f.video_id, f.frame_idx, f.state, d.frame_idx IS NOT NULL AS del FROM fx_frames f
        LEFT JOIN (SELECT * FROM pause_deletes UNION SELECT * FROM clip_deletes) d USING (video_id, frame_idx)""",
    "decimated": """
        WITH g AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY video_id, state ORDER BY frame_idx) AS g FROM base_plan WHERE NOT del AND state IN (2, 4)),
        n AS (SELECT *, row_number() OVER (PARTITION BY video_id, state, g ORDER BY frame_idx) AS n FROM g)
        SELECT video_id, frame_idx FROM n WHERE (state = 2 AND n % 2 = 0) OR (state = 4 AND n % 10 <> 1)""",
    "plan": "SELECT b.video_id, b.frame_idx, state, del OR d.frame_idx IS NOT NULL AS del FROM base_plan b LEFT JOIN decimated d USING (video_id, frame_idx)",
    "ranges": """
        WITH g AS (SELECT video_id, frame_idx, frame_idx - row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS g FROM plan WHERE NOT del)
        SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY min(frame_idx)) - 1 AS INT) AS range_idx, min(frame_idx) AS start_frame, max(frame_idx) + 1 AS end_frame
        FROM g GROUP BY video_id, g""",
    "skips": """
        WITH g AS (SELECT m.*, frame_idx - row_number() OVER (PARTITION BY m.video_id, pause_id ORDER BY frame_idx) AS g
                   FROM mask m JOIN moded p USING (video_id, pause_id) WHERE mode = 'auto' AND code IN (1, 2))
        SELECT video_id, 'pause' AS source, min(frame_idx) AS "start", max(frame_idx) + 1 AS "end" FROM g GROUP BY video_id, pause_id, g
        UNION ALL SELECT video_id, 'pause', s, e + 1 FROM moded WHERE mode = 'all'
        UNION ALL SELECT video_id, 'clip', s, e + 1 FROM edited_clips WHERE ki > ko
        UNION ALL SELECT video_id, 'clip', s, ki FROM edited_clips WHERE ki <= ko AND ki > s
        UNION ALL SELECT video_id, 'clip', ko + 1, e + 1 FROM edited_clips WHERE ki <= ko AND ko < e""",
    "present": "SELECT f.video_id, f.frame_idx FROM fx_frames f JOIN fx_catalog c USING (video_id) WHERE NOT (f.video_id % 10 = 0 AND frame_idx >= total - 3)",
    "scores": """
        WITH o AS (SELECT unnest(range(0, 5)) AS oy), p AS (SELECT unnest(range(0, 5)) AS ox), i AS (SELECT unnest(range(0, 16)) AS i),
        v AS (SELECT f.video_id, f.frame_idx, template_id, class, oy, ox, CAST(m[i + 1] AS BIGINT) AS m, CAST(t[i + 1] AS BIGINT) AS t, CAST(px[(oy + i // 4) * 8 + ox + i % 4 + 1] AS BIGINT) AS x
              FROM fx_pixels f, fx_templates, o, p, i),
        s AS (SELECT video_id, frame_idx, template_id, class, oy, ox, sum(m) AS n, sum(m * t * x) AS tx, sum(m * t) AS t, sum(m * x) AS x, sum(m * t * t) AS tt, sum(m * x * x) AS xx FROM v GROUP BY ALL),
        c AS (SELECT *, CAST((n * tt - t * t) * (n * xx - x * x) AS DOUBLE) AS d FROM s)
        SELECT video_id, frame_idx, class, greatest(-1.0::DOUBLE, max(CASE WHEN d > 0 THEN CAST(n * tx - t * x AS DOUBLE) / sqrt(d) END)) AS score FROM c GROUP BY video_id, frame_idx, class""",
    "wide_scores": """
        SELECT video_id, frame_idx, max(score) FILTER (class = 'pause') AS p, max(score) FILTER (class = 'speed_1x') AS x1, max(score) FILTER (class = 'speed_2x') AS x2, max(score) FILTER (class = 'speed_0_2x') AS x02
        FROM scores GROUP BY video_id, frame_idx""",
    "states": """
        SELECT video_id, frame_idx, CAST(CASE WHEN p >= 0.7::DOUBLE THEN 1 WHEN x1 >= 0.7::DOUBLE AND x1 > x2 THEN 2 WHEN x2 >= 0.7::DOUBLE AND x2 > x1 THEN 3 WHEN x02 >= 0.7::DOUBLE THEN 4 ELSE 0 END AS TINYINT) AS state FROM wide_scores""",
    "pixel_diffs": """
        SELECT video_id, frame_idx, CAST(coalesce(list_sum(list_transform(list_zip(px, b), lambda z: abs(z[1] - z[2]))) / 64.0::DOUBLE, 0) AS FLOAT) AS diff
        FROM (SELECT *, lag(px) OVER (PARTITION BY video_id ORDER BY frame_idx) AS b FROM fx_pixels)""",
    "edited_modes": """
        SELECT p.*, coalesce(x.mode2, p.mode) AS new_mode FROM moded p LEFT JOIN (
            SELECT p.video_id, p.pause_id, arg_max(d.mode, d.seq) AS mode2 FROM pauses p JOIN fx_mode_edits d ON p.video_id = d.video_id AND frame_idx BETWEEN s AND e GROUP BY p.video_id, p.pause_id) x USING (video_id, pause_id)""",
    "toggle_moves": """
        SELECT p.video_id, p.pause_id, frame_idx - s + 1 AS k, row_number() OVER (PARTITION BY p.video_id, p.pause_id ORDER BY seq) AS n
        FROM fx_toggle_edits d JOIN moded p ON p.video_id = d.video_id AND frame_idx BETWEEN s AND e WHERE mode = 'auto'""",
    "toggle_starts": "SELECT video_id, pause_id, CAST(0 AS BIGINT) AS n, list(CAST(code AS INT) ORDER BY frame_idx) AS codes FROM mask WHERE (video_id, pause_id) IN (SELECT video_id, pause_id FROM toggle_moves) GROUP BY video_id, pause_id",
    "toggled": """
        WITH last AS (SELECT video_id, pause_id, arg_max(codes, n) AS codes FROM toggling GROUP BY video_id, pause_id)
        SELECT m.video_id, m.frame_idx, m.pause_id, CAST(coalesce(codes[m.frame_idx - p.s + 1], code) AS TINYINT) AS code
        FROM mask m JOIN pauses p USING (video_id, pause_id) LEFT JOIN last USING (video_id, pause_id)""",
    "history": """
        SELECT *, row_number() OVER (PARTITION BY video_id, pause_id ORDER BY seq) AS n FROM (
            SELECT p.video_id, pause_id, seq, 'single' AS kind, d.mode, NULL AS k FROM fx_mode_edits d JOIN moded p ON p.video_id = d.video_id AND frame_idx BETWEEN s AND e
            UNION ALL SELECT p.video_id, pause_id, seq, 'toggle', NULL, frame_idx - s + 1 FROM fx_toggle_edits d JOIN moded p ON p.video_id = d.video_id AND frame_idx BETWEEN s AND e
            UNION ALL SELECT video_id, pause_id, seq, 'bulk', d.mode, NULL FROM fx_bulk_edits d JOIN moded p USING (video_id))""",
    "history_starts": """
        SELECT video_id, pause_id, CAST(0 AS BIGINT) AS n, any_value(mode) AS mode, any_value(bd) AS bd, list(CAST(code AS INT) ORDER BY frame_idx) AS base, list(CAST(code AS INT) ORDER BY frame_idx) AS codes
        FROM mask JOIN moded USING (video_id, pause_id) GROUP BY video_id, pause_id""",
    "replayed": """
        WITH last AS (SELECT video_id, pause_id, arg_max(mode, n) AS mode, arg_max(codes, n) AS codes FROM replaying GROUP BY video_id, pause_id)
        SELECT m.video_id, m.frame_idx, m.pause_id, CAST(codes[m.frame_idx - p.s + 1] AS TINYINT) AS code, l.mode FROM mask m JOIN pauses p USING (video_id, pause_id) JOIN last l USING (video_id, pause_id)""",
    "px_runs": """
        SELECT video_id, state, min(frame_idx) AS s, max(frame_idx) AS e
        FROM (SELECT *, frame_idx - row_number() OVER (PARTITION BY video_id, state ORDER BY frame_idx) AS g FROM states) GROUP BY video_id, state, g""",
}
_TOGGLES = """toggling AS (
    SELECT * FROM toggle_starts
    UNION ALL
    SELECT t.video_id, t.pause_id, m.n,
           list_transform(range(1, len(codes) + 1), lambda i: CASE WHEN i > coalesce(list_max(list_filter(range(1, k), lambda j: codes[j] <> codes[k])), 0)
               AND i < coalesce(list_min(list_filter(range(k + 1, len(codes) + 1), lambda j: codes[j] <> codes[k])), len(codes) + 1) THEN CASE WHEN codes[k] IN (0, 3) THEN 2 ELSE 3 END ELSE codes[i] END)
    FROM toggling t JOIN toggle_moves m ON m.video_id = t.video_id AND m.pause_id = t.pause_id AND m.n = t.n + 1)"""
_HISTORY = """replaying AS (
    SELECT * FROM history_starts
    UNION ALL
    SELECT t.video_id, t.pause_id, m.n, CASE WHEN kind = 'toggle' THEN t.mode WHEN kind = 'bulk' AND m.mode = 'auto' THEN CASE WHEN bd < 5 THEN 'all' ELSE 'auto' END ELSE m.mode END, bd, base,
           CASE WHEN m.mode = 'auto' THEN base WHEN kind <> 'toggle' OR t.mode <> 'auto' THEN codes
                ELSE list_transform(range(1, len(codes) + 1), lambda i: CASE WHEN i > coalesce(list_max(list_filter(range(1, k), lambda j: codes[j] <> codes[k])), 0)
                     AND i < coalesce(list_min(list_filter(range(k + 1, len(codes) + 1), lambda j: codes[j] <> codes[k])), len(codes) + 1) THEN CASE WHEN codes[k] IN (0, 3) THEN 2 ELSE 3 END ELSE codes[i] END) END
    FROM replaying t JOIN history m ON m.video_id = t.video_id AND m.pause_id = t.pause_id AND m.n = t.n + 1)"""
_HANDLES = """handles AS (
    SELECT video_id, clip_id, s, e, CAST(0 AS BIGINT) AS n, s AS ki, e AS ko FROM clips
    UNION ALL
    SELECT h.video_id, h.clip_id, h.s, h.e, m.n,
           CASE WHEN m.side = 'in' THEN greatest(h.s, least(m.tf, h.e + 1)) WHEN least(h.e, greatest(m.tf, h.s - 1)) < h.ki THEN greatest(least(h.e, greatest(m.tf, h.s - 1)) + 1, h.s) ELSE h.ki END,
           CASE WHEN m.side = 'out' THEN least(h.e, greatest(m.tf, h.s - 1)) WHEN greatest(h.s, least(m.tf, h.e + 1)) > h.ko THEN least(greatest(h.s, least(m.tf, h.e + 1)) - 1, h.e) ELSE h.ko END
    FROM handles h JOIN clip_moves m ON m.video_id = h.video_id AND m.clip_id = h.clip_id AND m.n = h.n + 1)"""

#: Recursive parts that stand before the parts that use them.
RECURSIVE = {"edited_clips": _HANDLES, "toggled": _TOGGLES, "replayed": _HISTORY}

_LABEL = "CASE {s} WHEN 3 THEN '2x' WHEN 2 THEN '1x' WHEN 4 THEN '0.2x' ELSE 'other' END"


def _segment_sql(split: bool, merge: bool) -> str:
    """Export segments (video_id, start, label, ranges) of the base plan."""
    label = _LABEL.format(s="state") if split else "'normal'"
    base = f"""l AS (SELECT video_id, frame_idx, CASE WHEN state = 1 THEN 'pause' ELSE {label} END AS label FROM base_plan WHERE NOT del),
        b AS (SELECT *, CASE WHEN lag(frame_idx) OVER w = frame_idx - 1 AND lag(label) OVER w = label THEN 0 ELSE 1 END AS fresh FROM l WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx)),
        r AS (SELECT video_id, label, min(frame_idx) AS s, max(frame_idx) AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY frame_idx) AS g FROM b) GROUP BY video_id, label, g)"""
    if merge:
        seg = """seg AS (SELECT video_id, s AS "start", label, [{'s': s, 'e': e}] AS ranges FROM r WHERE label <> 'pause'
            UNION ALL SELECT r.video_id, min(r.s), 'pause_merged', list({'s': r.s, 'e': r.e} ORDER BY r.s) FROM r JOIN pauses p ON r.video_id = p.video_id AND r.s BETWEEN p.s AND p.e WHERE label = 'pause' GROUP BY r.video_id, pause_id)"""
    else:
        seg = """seg AS (SELECT video_id, s AS "start", label, [{'s': s, 'e': e}] AS ranges FROM r)"""
    return f"{base}, {seg}"


_MERGED = """mseg AS (SELECT video_id, min("start") AS "start", label, flatten(list(ranges ORDER BY "start")) AS ranges FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY "start") AS g FROM (
            SELECT *, CASE WHEN lag(label) OVER (PARTITION BY video_id ORDER BY "start") = label AND label NOT LIKE '%pause%' THEN 0 ELSE 1 END AS fresh FROM seg)) GROUP BY video_id, label, g),
    num AS (SELECT *, CAST(row_number() OVER (PARTITION BY video_id ORDER BY "start") AS INT) AS seg_no FROM mseg)"""
_NUMBERED = _segment_sql(True, True) + ", " + _MERGED
_SUMMARY = _NUMBERED + """,
    asked AS (SELECT video_id, seg_no, label, unnest(range(1, len(ranges) + 1)) AS r, ranges FROM num),
    f AS (SELECT a.video_id, a.seg_no, a.r, unnest(range(ranges[r].s, ranges[r].e + 1)) AS frame_idx FROM asked a),
    h AS (SELECT f.*, p.frame_idx IS NULL AS missing FROM f LEFT JOIN present p USING (video_id, frame_idx)),
    w AS (SELECT *, bool_or(missing) OVER (PARTITION BY video_id, seg_no, r ORDER BY frame_idx) AS after_gap FROM h),
    written AS (SELECT video_id, seg_no, count(*) AS written FROM w WHERE NOT after_gap GROUP BY video_id, seg_no),
    summary AS (SELECT num.video_id, num.seg_no, num.label, CAST(list_sum(list_transform(ranges, lambda x: x.e - x.s + 1)) AS BIGINT) AS requested, coalesce(written, 0) AS written, coalesce(written, 0) > 0 AS success
                FROM num LEFT JOIN written USING (video_id, seg_no))"""


def sql(body: str, extra: str = "") -> str:
    """`body` (after the CTEs `extra`) with the parts that it needs, in order."""
    need: set[str] = set()

    def add(text: str) -> None:
        for name in PARTS:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                add(PARTS[name] + RECURSIVE.get(name, ""))

    add(body + extra)
    ctes = []
    for name in (n for n in PARTS if n in need):
        ctes += ([RECURSIVE[name]] if name in RECURSIVE else []) + [f"{name} AS ({PARTS[name]})"]
    ctes += [extra] * bool(extra)
    return f"WITH RECURSIVE {', '.join(ctes)} {body}" if ctes else body


_SEG = "SELECT video_id, \"start\", label, ranges FROM "

ORACLE = {
    "src_templates": sql("SELECT template_id, class, len(t) AS n_pixels, list_sum(t)::BIGINT AS t_sum, list_sum(m)::BIGINT AS m_sum FROM fx_templates"),
    "src_frames": sql("SELECT video_id, frame_idx, state, diff FROM fx_frames"),
    "src_catalog": sql("SELECT video_id, total, CASE WHEN fps = 24 THEN 30.0::DOUBLE ELSE fps END AS fps FROM fx_catalog"),
    "frame_spine": sql("SELECT c.video_id, r.frame_idx, coalesce(f.state, 0)::TINYINT AS state, coalesce(f.diff, 0)::FLOAT AS diff FROM (SELECT video_id, unnest(range(0, total + 3)) AS frame_idx FROM fx_catalog) r JOIN fx_catalog c USING (video_id) LEFT JOIN fx_frames f ON f.video_id = r.video_id AND f.frame_idx = r.frame_idx"),
    "params": sql("SELECT video_id, params_id, still_time, motion_thresh, greatest(2, CAST(floor(fps * still_time) AS INT)) AS still_frames FROM fx_catalog, (VALUES (0, 0.1::DOUBLE, 2.0::DOUBLE), (1, 0.2::DOUBLE, 1.0::DOUBLE), (2, 0.5::DOUBLE, 3.0::DOUBLE)) v(params_id, still_time, motion_thresh)"),
    "sink_cut_list": sql("SELECT video_id, range_idx, start_frame, end_frame, printf('%.9f', start_frame / fps) AS start_sec, printf('%.9f', end_frame / fps) AS end_sec FROM ranges JOIN fx_catalog USING (video_id)"),
    "sink_frame_facts": sql("SELECT video_id, frame_idx, state, diff FROM fx_frames"),
    "sink_segment_manifest": sql("SELECT video_id, seg_no, label, lpad(seg_no::VARCHAR, len(n::VARCHAR)::INT, '0') || '_' || label AS stem, 'cut_segments/' || lpad(seg_no::VARCHAR, len(n::VARCHAR)::INT, '0') || '_' || label || '.mp4' AS path, len(ranges) AS n_ranges FROM (SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM num)", _NUMBERED),
    "gray": "SELECT event_id, list_transform(range(0, 4), lambda p: CAST(floor(CAST((event_id * 31 + p * 3 * 57) % 256 AS DOUBLE) * 0.114::DOUBLE + CAST((event_id * 31 + (p * 3 + 1) * 57) % 256 AS DOUBLE) * 0.587::DOUBLE + CAST((event_id * 31 + (p * 3 + 2) * 57) % 256 AS DOUBLE) * 0.299::DOUBLE + 0.5::DOUBLE) AS INT)) AS gray FROM events",
    "area_resize": sql("""
        SELECT video_id, frame_idx, list(v ORDER BY oy, ox) AS px FROM (
            SELECT video_id, frame_idx, oy, ox, CAST(round_even(sum(wy * wx * px[y * 8 + x + 1]) / 64.0::DOUBLE, 0) AS INT) AS v
            FROM fx_pixels, (SELECT oy, y, least(8 * (oy + 1), 3 * (y + 1)) - greatest(8 * oy, 3 * y) AS wy FROM (SELECT unnest(range(0, 3)) AS oy), (SELECT unnest(range(0, 8)) AS y) WHERE least(8 * (oy + 1), 3 * (y + 1)) > greatest(8 * oy, 3 * y)),
                 (SELECT ox, x, least(8 * (ox + 1), 3 * (x + 1)) - greatest(8 * ox, 3 * x) AS wx FROM (SELECT unnest(range(0, 3)) AS ox), (SELECT unnest(range(0, 8)) AS x) WHERE least(8 * (ox + 1), 3 * (x + 1)) > greatest(8 * ox, 3 * x))
            GROUP BY video_id, frame_idx, oy, ox) GROUP BY video_id, frame_idx"""),
    "proc_res": sql("SELECT video_id, w, h, CAST(floor(400 * h / w) AS INT) AS proc_h FROM (SELECT video_id, 640 + video_id % 7 * 160 AS w, 360 + video_id % 5 * 90 AS h FROM fx_catalog)"),
    "template_prep": sql("SELECT template_id, list_transform(t, lambda x: CASE WHEN x > 100 THEN 1 ELSE 0 END) AS m, greatest(0, CAST(trunc(x * 1.25::DOUBLE - 4 * 1.25::DOUBLE * 0.5) AS INT)) AS roi_x, greatest(0, CAST(trunc(y * 1.25::DOUBLE - 4 * 1.25::DOUBLE * 0.5) AS INT)) AS roi_y, CAST(trunc(4 * 1.25::DOUBLE * 2) AS INT) AS roi_w, CAST(trunc(4 * 1.25::DOUBLE * 2) AS INT) AS roi_h FROM (SELECT *, template_id % 5 AS x, template_id % 3 AS y FROM fx_templates)"),
    "roi_valid": sql("SELECT video_id, frame_idx, template_id, class, least(8 - x, 8) AS erw, least(8 - y, 8) AS erh FROM fx_pixels, (SELECT *, template_id AS x, template_id % 4 AS y FROM fx_templates) WHERE least(8 - x, 8) >= 4 AND least(8 - y, 8) >= 4"),
    "frame_x_template": sql("SELECT video_id, frame_idx, template_id, class, 8 AS erw, 8 AS erh FROM fx_pixels, fx_templates"),
    "classify": sql("SELECT * FROM states"),
    "template_gate": sql("SELECT video_id, frame_idx, CAST(CASE WHEN video_id % 2 = 0 THEN state ELSE 0 END AS TINYINT) AS state FROM states"),
    "template_score": sql("SELECT * FROM scores"),
    "template_locate": sql("""
        SELECT template_id, CAST(arg_min(ox, (-score, oy, ox)) AS INT) AS x, CAST(arg_min(oy, (-score, oy, ox)) AS INT) AS y, max(score) AS score FROM (
            SELECT template_id, oy, ox, CAST(16 * sum(t * x) - sum(t) * sum(x) AS DOUBLE) / sqrt(CAST((16 * sum(t * t) - sum(t) * sum(t)) * (16 * sum(x * x) - sum(x) * sum(x)) AS DOUBLE)) AS score FROM (
                SELECT template_id, oy, ox, CAST(t[i + 1] AS BIGINT) AS t, CAST(src[(oy + i // 4) * 8 + ox + i % 4 + 1] AS BIGINT) AS x
                FROM fx_templates, (SELECT unnest(range(0, 5)) AS oy), (SELECT unnest(range(0, 5)) AS ox), (SELECT unnest(range(0, 16)) AS i)) GROUP BY template_id, oy, ox) GROUP BY template_id"""),
    "boundary_diff": sql('SELECT video_id, pause_id, s AS "start", e AS "end", bd AS boundary_diff, true AS "both" FROM measured'),
    "mode_override": sql("SELECT video_id, pause_id, bd AS boundary_diff, mode FROM moded"),
    "pause_delete_rows": sql("SELECT * FROM pause_deletes"),
    "clip_delete_rows": sql("SELECT * FROM clip_deletes"),
    "segment_lookup": sql("""
        SELECT probe_id, q.video_id, frame_idx, CASE WHEN pause_id IS NOT NULL THEN 'pause' WHEN type IS NOT NULL THEN 'speed' ELSE 'normal' END AS kind, pause_id, mode, bd AS boundary_diff, type
        FROM fx_probes q LEFT JOIN moded p ON p.video_id = q.video_id AND frame_idx BETWEEN p.s AND p.e LEFT JOIN speeds v ON v.video_id = q.video_id AND frame_idx BETWEEN v.s AND v.e"""),
    "segment_lookup_overlapping": sql("""
        SELECT probe_id, CASE WHEN any_value(p.pause_id) IS NOT NULL THEN 'pause' WHEN any_value(type) IS NOT NULL THEN 'speed' ELSE 'normal' END AS kind, arg_min(p.pause_id, p.s) AS pause_id
        FROM fx_probes q LEFT JOIN pauses p ON p.video_id = q.video_id AND frame_idx BETWEEN p.s AND p.e + 40 LEFT JOIN speeds v ON v.video_id = q.video_id AND frame_idx BETWEEN v.s AND v.e GROUP BY probe_id"""),
    "frame_diff_over_gaps": sql("""
        SELECT video_id, frame_idx, CAST(coalesce(list_sum(list_transform(list_zip(px, b), lambda z: abs(z[1] - z[2]))) / 64.0::DOUBLE, 0) AS FLOAT) AS diff
        FROM (SELECT *, lag(px) OVER (PARTITION BY video_id ORDER BY frame_idx) AS b FROM fx_pixels WHERE NOT frame_idx BETWEEN 10 AND 24 AND frame_idx % 7 <> 3)"""),
    "analysis_from_pixels": sql("SELECT video_id, frame_idx, state, diff FROM states JOIN pixel_diffs USING (video_id, frame_idx)"),
    "facts_from_stills": sql("SELECT video_id, frame_idx, state, diff FROM states JOIN pixel_diffs USING (video_id, frame_idx)"),
    "boundary_diff_pixels": sql("""
        SELECT r.video_id, CAST(row_number() OVER (PARTITION BY r.video_id ORDER BY s) - 1 AS INT) AS pause_id, s AS "start", e AS "end",
               coalesce(list_sum(list_transform(list_zip(a.px, b.px), lambda z: abs(z[1] - z[2]))) / 64.0::DOUBLE, 0) AS boundary_diff, a.px IS NOT NULL AND b.px IS NOT NULL AS "both"
        FROM px_runs r JOIN (SELECT video_id, max(frame_idx) AS z FROM states GROUP BY video_id) l USING (video_id)
        LEFT JOIN fx_pixels a ON a.video_id = r.video_id AND a.frame_idx = greatest(s - 1, 0) LEFT JOIN fx_pixels b ON b.video_id = r.video_id AND b.frame_idx = least(e + 1, z) WHERE state = 1"""),
    "speed_step": sql("SELECT probe_id, q.video_id, q.frame_idx, CASE state WHEN 2 THEN 2 WHEN 4 THEN 10 ELSE 1 END AS step FROM fx_probes q JOIN fx_frames f USING (video_id, frame_idx)"),
    "drop_deleted": sql("SELECT f.video_id, f.frame_idx FROM fx_frames f WHERE NOT EXISTS (SELECT 1 FROM fx_delete_set d WHERE d.video_id = f.video_id AND d.frame_idx = f.frame_idx)"),
    "segment_frames": sql("SELECT video_id, seg_no, CAST(r - 1 AS INT) AS range_no, frame_idx FROM w WHERE NOT after_gap", _SUMMARY),
    "state_runs": sql('SELECT video_id, state, s AS "start", e AS "end" FROM runs'),
    "kept_ranges": sql("SELECT * FROM ranges"),
    "export_counts": sql("SELECT video_id, count(*) FILTER (NOT del) AS kept, count(*) AS total, count(*) FILTER (NOT del) / count(*) AS ratio, count(*) FILTER (NOT del) = 0 AS empty FROM plan GROUP BY video_id"),
    "segment_summary": sql("SELECT * FROM summary", _SUMMARY),
    "export_totals": sql("SELECT video_id, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed FROM summary GROUP BY video_id", _SUMMARY),
    "first_failures": sql("SELECT video_id, seg_no, label || ': wrote 0 of ' || requested || ' frames' AS error FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY seg_no) AS n FROM summary WHERE NOT success) WHERE n <= 3", _SUMMARY),
    "analysis_summary": sql("SELECT video_id, count(*) FILTER (state = 1) AS n_pauses, count(*) FILTER (state >= 2) AS n_speeds FROM runs GROUP BY video_id"),
    "timeline_buckets": sql("""
        SELECT video_id, (frame_idx * 120) // total AS bucket, count(*) AS frames, count(*) FILTER (state = 0) AS state_0, count(*) FILTER (state = 1) AS state_1, count(*) FILTER (state = 2) AS state_2,
               count(*) FILTER (state = 3) AS state_3, count(*) FILTER (state = 4) AS state_4, count(*) FILTER (NOT del) AS kept FROM plan JOIN fx_catalog USING (video_id) GROUP BY ALL"""),
    "timeline_buckets_zoomed": sql("""
        SELECT video_id, bucket, count(*) AS frames, count(*) FILTER (state = 0) AS state_0, count(*) FILTER (state = 1) AS state_1, count(*) FILTER (state = 2) AS state_2,
               count(*) FILTER (state = 3) AS state_3, count(*) FILTER (state = 4) AS state_4, count(*) FILTER (NOT del) AS kept
        FROM (SELECT *, CAST(floor((frame_idx / total - 0.25::DOUBLE) * 4.0::DOUBLE * 100) AS BIGINT) AS bucket FROM plan JOIN fx_catalog USING (video_id)) WHERE bucket BETWEEN 0 AND 99 GROUP BY video_id, bucket"""),
    "frame_diff": sql("SELECT * FROM pixel_diffs"),
    "frame_diff_chunked": sql("SELECT * FROM pixel_diffs"),
    "motion_mask": sql("SELECT video_id, frame_idx, pause_id, active FROM active"),
    "still_trim": sql("SELECT * FROM mask"),
    "decimate": sql("SELECT * FROM decimated"),
    "next_kept": sql("SELECT p.video_id, p.frame_idx, coalesce(min(CASE WHEN NOT del THEN frame_idx END) OVER (PARTITION BY p.video_id ORDER BY frame_idx DESC ROWS UNBOUNDED PRECEDING), total) AS next FROM plan p JOIN fx_catalog USING (video_id)"),
    "concat_remap": sql("SELECT p.video_id, frame_idx, range_idx, row_number() OVER (PARTITION BY p.video_id ORDER BY frame_idx) - 1 AS out_frame, row_number() OVER (PARTITION BY p.video_id ORDER BY frame_idx) - 1 - (frame_idx - start_frame) AS out_start FROM plan p JOIN ranges r ON p.video_id = r.video_id AND frame_idx >= start_frame AND frame_idx < end_frame WHERE NOT del"),
    "dense_ids": sql('SELECT video_id, pause_id, s AS "start", e AS "end" FROM pauses'),
    "clip_segments": sql('SELECT video_id, clip_id, s AS "start", e AS "end", s AS keep_in, e AS keep_out FROM clips'),
    "export_segments": sql(_SEG + "seg", _segment_sql(False, False)),
    "export_segments_split": sql(_SEG + "seg", _segment_sql(True, False)),
    "export_segments_merged": sql(_SEG + "seg", _segment_sql(False, True)),
    "export_segments_split_merged": sql(_SEG + "seg", _segment_sql(True, True)),
    "merge_adjacent_segments": sql(_SEG + "mseg", _NUMBERED),
    "segment_order": sql('SELECT video_id, seg_no, "start", label FROM num', _NUMBERED),
    "delete_plan": sql("SELECT * FROM plan"),
    "incremental_plan": sql("SELECT * FROM plan"),
    "sweep_deletes": sql('SELECT params_id, video_id, pause_id, min(frame_idx) AS "start", max(frame_idx) AS "end" FROM gone GROUP BY params_id, video_id, pause_id, g', """
        sets(params_id, still, thresh) AS (VALUES (0, 0.1::DOUBLE, 2.0::FLOAT), (1, 0.2::DOUBLE, 1.0::FLOAT), (2, 0.5::DOUBLE, 5.0::FLOAT)),
        warm AS (SELECT params_id, f.video_id, f.frame_idx, pause_id, s, e, diff > thresh AND frame_idx > s AS hot FROM fx_frames f JOIN pauses p ON f.video_id = p.video_id AND frame_idx BETWEEN s AND e, sets),
        live AS (SELECT *, hot OR coalesce(lead(hot) OVER (PARTITION BY params_id, video_id, pause_id ORDER BY frame_idx), false) AS act FROM warm),
        islands AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY params_id, video_id, pause_id, act ORDER BY frame_idx) AS isle FROM live),
        placed AS (SELECT i.*, min(frame_idx) OVER (PARTITION BY params_id, video_id, pause_id, act, isle) - s AS a, max(frame_idx) OVER (PARTITION BY params_id, video_id, pause_id, act, isle) - s AS b,
                          bool_or(act) OVER (PARTITION BY params_id, video_id, pause_id) AS moves, frame_idx - s AS k, e - s + 1 AS n FROM islands i),
        timed AS (SELECT placed.*, greatest(2, CAST(floor(fps * still) AS INT)) AS st FROM placed JOIN sets USING (params_id) JOIN fx_catalog USING (video_id)),
        gone AS (SELECT params_id, video_id, pause_id, frame_idx, frame_idx - row_number() OVER (PARTITION BY params_id, video_id, pause_id ORDER BY frame_idx) AS g FROM timed WHERE
            CASE WHEN NOT moves THEN n > 2 * st AND k >= st AND k < n - st WHEN act OR b - a + 1 <= st THEN false WHEN a = 0 THEN k <= b - st WHEN b = n - 1 THEN k >= a + st ELSE k BETWEEN a + st // 2 AND b - (st - st // 2) END)"""),
    "colocated_runs": sql('SELECT video_id, state, s AS "start", e AS "end" FROM runs'),
    "colocated_counts": sql("SELECT video_id, frame_idx // 256 AS chunk, state, count(*) FILTER (NOT del) AS kept, count(*) AS total FROM plan GROUP BY ALL"),
    "delete_plan_by_frame": sql("SELECT * FROM plan"),
    "kept_ranges_by_frame": sql("SELECT * FROM ranges"),
    "pause_deletes": sql("""
        SELECT video_id, pause_id, min(frame_idx) AS "start", max(frame_idx) AS "end"
        FROM (SELECT *, frame_idx - row_number() OVER (PARTITION BY video_id, pause_id ORDER BY frame_idx) AS g FROM mask WHERE code = 1) GROUP BY video_id, pause_id, g"""),
    "skip_union": sql("""
        SELECT video_id, min(frame_idx) AS "start", max(frame_idx) AS "end"
        FROM (SELECT *, frame_idx - row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS g FROM base_plan WHERE del) GROUP BY video_id, g"""),
    "kept_speeds": sql("""
        SELECT video_id, state AS type, min(frame_idx) AS "start", max(frame_idx) AS "end"
        FROM (SELECT *, frame_idx - row_number() OVER (PARTITION BY video_id, state ORDER BY frame_idx) AS g FROM base_plan WHERE NOT del AND state >= 2) GROUP BY video_id, state, g"""),
    "skip_intervals": sql("SELECT * FROM skips"),
    "valid_frames": sql("SELECT video_id, frame_idx, state FROM base_plan WHERE NOT del"),
    "to_half_open": sql("SELECT video_id, seg_no, list_transform(ranges, lambda x: {'s': x.s, 'e': x.e + 1}) AS half_open, CAST(list_sum(list_transform(ranges, lambda x: x.e - x.s + 1)) AS BIGINT) AS requested FROM num", _NUMBERED),
    "fmt_mmss": sql("SELECT probe_id, printf('%02d:%02d', CAST(floor(frame_idx / fps) AS BIGINT) // 60, CAST(floor(frame_idx / fps) AS BIGINT) % 60) AS at FROM fx_probes JOIN fx_catalog USING (video_id)"),
    "frame_seconds": sql("SELECT probe_id, CASE WHEN video_id % 10 = 0 THEN 0.0::DOUBLE ELSE frame_idx / fps END AS seconds FROM fx_probes JOIN fx_catalog USING (video_id)"),
    "speed_label": sql(f"SELECT video_id, frame_idx, {_LABEL.format(s='state')} AS label FROM fx_frames"),
    "mode_label": sql("SELECT video_id, pause_id, CASE mode WHEN 'all' THEN 'delete all' ELSE 'trim by settings' END AS label FROM moded"),
    "still_frames": sql("SELECT video_id, greatest(2, CAST(floor(fps * 0.1::DOUBLE) AS INT)) AS still FROM fx_catalog"),
    "effective_speed": sql("""
        SELECT probe_id, text, v AS speed, CASE WHEN v >= 1 THEN greatest(1, CAST(trunc(v) AS INT)) ELSE 1 END AS step, CASE WHEN v >= 1 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / greatest(v, 0.01::DOUBLE) END AS multiplier, f * v AS shown FROM (
            SELECT probe_id, text, CASE text WHEN '0.25x' THEN 0.25::DOUBLE WHEN '2x' THEN 2.0::DOUBLE WHEN '1.5' THEN 1.5::DOUBLE WHEN '0.001x' THEN 0.001::DOUBLE ELSE 1.0::DOUBLE END AS v, CASE state WHEN 2 THEN 2 WHEN 4 THEN 10 ELSE 1 END AS f FROM (
                SELECT probe_id, state, ['0.25x', '2x', '1.5', 'fast', '0.001x'][probe_id % 7 % 5 + 1] AS text FROM fx_probes JOIN fx_frames USING (video_id, frame_idx)))"""),
    "pixel_mad": sql("SELECT video_id, frame_idx, CAST(list_sum(list_transform(list_zip(px, b), lambda z: abs(z[1] - z[2]))) AS BIGINT) / 64.0::DOUBLE AS mad FROM (SELECT *, lag(px) OVER (PARTITION BY video_id ORDER BY frame_idx) AS b FROM fx_pixels) WHERE b IS NOT NULL"),
    "segment_stem": sql("SELECT video_id, seg_no, lpad(seg_no::VARCHAR, len(n::VARCHAR)::INT, '0') || '_' || label AS stem FROM (SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM num)", _NUMBERED),
    "output_names": sql("SELECT video_id, '/videos/v' || video_id || '.take.1_clipped.mp4' AS clipped, '/videos/v' || video_id || '.take.1_clipped_segments' AS folder FROM fx_catalog"),
    "clamp_roi": sql("SELECT video_id, frame_idx, greatest(0, CAST(trunc(frame_idx * 0.625::DOUBLE - 40 * 0.625::DOUBLE * 0.5) AS INT)) AS x, 50 AS w, least(400 - greatest(0, CAST(trunc(frame_idx * 0.625::DOUBLE - 40 * 0.625::DOUBLE * 0.5) AS INT)), 50) AS clipped FROM fx_frames"),
    "threshold_mask": sql("SELECT video_id, frame_idx, list_transform(px, lambda x: CASE WHEN x > 10 THEN 1 ELSE 0 END) AS m FROM fx_pixels"),
    "bulk_mode": sql("SELECT video_id, pause_id, CASE WHEN bd < 8 THEN 'all' ELSE 'auto' END AS mode FROM measured"),
    "single_mode": sql("SELECT video_id, pause_id, new_mode AS mode FROM edited_modes"),
    "toggle_block": sql("""
        SELECT video_id, frame_idx, pause_id, CAST(CASE WHEN max(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, pause_id, code, g) = 1 THEN CASE WHEN code = 0 THEN 2 ELSE 3 END ELSE code END AS TINYINT) AS code FROM (
            SELECT m.*, m.frame_idx - row_number() OVER (PARTITION BY m.video_id, m.pause_id, code ORDER BY m.frame_idx) AS g, x.frame_idx IS NOT NULL AS hit FROM mask m LEFT JOIN (
                SELECT p.video_id, p.pause_id, arg_min(frame_idx, seq) AS frame_idx FROM fx_toggle_edits d JOIN moded p ON p.video_id = d.video_id AND frame_idx BETWEEN s AND e WHERE mode = 'auto' GROUP BY p.video_id, p.pause_id) x
            ON x.video_id = m.video_id AND x.pause_id = m.pause_id AND x.frame_idx = m.frame_idx)"""),
    "timeline_layers": sql("""
        SELECT video_id, bucket, count(*) FILTER (code = 0) AS code_0, count(*) FILTER (code = 1) AS code_1, count(*) FILTER (code = 2) AS code_2, count(*) FILTER (code = 3) AS code_3,
               count(*) FILTER (mode = 'auto') AS mode_auto, count(*) FILTER (mode = 'keep') AS mode_keep, count(*) FILTER (mode = 'all') AS mode_all,
               count(*) FILTER (part = 'keep') AS clip_keep, count(*) FILTER (part = 'del') AS clip_del
        FROM (SELECT t.video_id, t.frame_idx * 120 // total AS bucket, t.code, p.mode, NULL AS part FROM toggled t JOIN moded p ON p.video_id = t.video_id AND p.pause_id = t.pause_id JOIN fx_catalog c ON c.video_id = t.video_id
              UNION ALL SELECT f.video_id, f.frame_idx * 120 // total, NULL, NULL, CASE WHEN ki > ko OR f.frame_idx < ki OR f.frame_idx > ko THEN 'del' ELSE 'keep' END
              FROM fx_frames f JOIN edited_clips e ON e.video_id = f.video_id AND f.frame_idx BETWEEN e.s AND e.e JOIN fx_catalog c ON c.video_id = f.video_id) GROUP BY video_id, bucket"""),
    "toggle_blocks": sql("SELECT * FROM toggled"),
    "bulk_masks": sql("SELECT video_id, frame_idx, pause_id, code FROM mask"),
    "single_masks": sql("""
        SELECT t.video_id, t.frame_idx, t.pause_id, CASE WHEN a.pause_id IS NOT NULL THEN m.code ELSE t.code END AS code FROM toggled t JOIN mask m USING (video_id, pause_id, frame_idx)
        LEFT JOIN (SELECT DISTINCT p.video_id, p.pause_id FROM pauses p JOIN fx_mode_edits d ON p.video_id = d.video_id AND frame_idx BETWEEN s AND e WHERE d.mode = 'auto') a
        ON a.video_id = t.video_id AND a.pause_id = t.pause_id"""),
    "edit_replay": sql("SELECT * FROM replayed"),
    "trim_handles": sql('SELECT video_id, clip_id, s AS "start", e AS "end", ki AS keep_in, ko AS keep_out FROM edited_clips'),
    "stream_frame_diff": sql("SELECT * FROM pixel_diffs"),
    "stream_runs": sql('SELECT video_id, state, s AS "start", e AS "end" FROM runs'),
    "stream_runs_long": sql('SELECT CAST(0 AS BIGINT) AS video_id, state, min(place) AS "start", max(place) AS "end" FROM joined GROUP BY state, g', """
        f AS (SELECT state, row_number() OVER (ORDER BY video_id, frame_idx) - 1 AS place FROM fx_frames),
        joined AS (SELECT *, place - row_number() OVER (PARTITION BY state ORDER BY place) AS g FROM f)"""),
    "stream_classify": sql("SELECT * FROM states"),
}

ORACLE |= {"timeline_window": ORACLE["timeline_buckets"], "timeline_window_zoomed": ORACLE["timeline_buckets_zoomed"]}
