"""Queries of the general problems 1 to 4 and the SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators.intervals import merge_intervals, visit_intervals
from trackloom.operators.orphans import orphan_counts, orphan_references
from trackloom.operators.sessions import presence_sessions
from trackloom.operators.spikes import box_faults
from trackloom.sources.tables import Tables

#: The slug rule in SQL; ``{0}`` is the column.
SLUG = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '_')"
#: True in SQL where a zone id means "outside".
OUTSIDE = r"({0} IS NULL OR regexp_full_match({0}, '[\s\p{{Z}}]*'))"


def p1_found(spark, d):
    return presence_sessions(Tables(spark, d).tracks).select("clip_id", "global_id", "start_ms", "end_ms")


def p1_sessions(spark, d):
    return presence_sessions(Tables(spark, d).tracks)


def _orphans(spark, d):
    t = Tables(spark, d)
    return orphan_references(t.tracks, t.visit_events, t.reentry_decisions, t.zones, t.tracklets)


def p2_found(spark, d):
    return _orphans(spark, d).select("table_name", "id")


def p2_counts(spark, d):
    return orphan_counts(_orphans(spark, d)).withColumn("day", F.col("day").cast("string"))


def p3_found(spark, d):
    t = Tables(spark, d)
    return box_faults(t.tracks, t.cameras).select("id").distinct()


def p3_faults(spark, d):
    t = Tables(spark, d)
    return box_faults(t.tracks, t.cameras).groupBy("fault").agg(F.countDistinct("id").alias("n_boxes"))


def p4_found(spark, d):
    return merge_intervals(visit_intervals(Tables(spark, d).visit_events))


_SESSIONS = """
WITH a AS (SELECT clip_id, global_id, CAST(round(1000 * ts) AS BIGINT) AS ms FROM tracks WHERE global_id > 0 AND ts IS NOT NULL),
b AS (SELECT *, CASE WHEN ms - lag(ms) OVER w > 30000 THEN 1 ELSE 0 END AS cut FROM a WINDOW w AS (PARTITION BY clip_id, global_id ORDER BY ms)),
c AS (SELECT *, sum(cut) OVER (PARTITION BY clip_id, global_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS s FROM b),
r AS (SELECT clip_id, global_id, min(ms) AS start_ms, max(ms) AS end_ms, max(ms) - min(ms) AS duration_ms, count(*) AS n_boxes FROM c GROUP BY clip_id, global_id, s)
"""

_CAM, _ZONE = SLUG.format("camera_id"), SLUG.format("zone_id")
_ORPHANS = f"""
WITH z AS (SELECT {_CAM} AS ck, {_ZONE} AS zk, added_at, removed_at FROM zones WHERE camera_id IS NOT NULL AND NOT {OUTSIDE.format('zone_id')}),
c AS (SELECT 'tracks' AS table_name, id, {_CAM} AS ck, {_ZONE} AS zk, captured_at FROM tracks WHERE NOT {OUTSIDE.format('zone_id')}
      UNION ALL SELECT 'visit_events', id, {_CAM}, {_ZONE}, captured_at FROM visit_events WHERE NOT {OUTSIDE.format('zone_id')}),
p AS (SELECT clip_id, tracklet_id, min(start_frame) AS first FROM tracklets GROUP BY clip_id, tracklet_id),
r AS (SELECT table_name, id, CAST(captured_at AS DATE) AS day FROM c WHERE NOT EXISTS (
        SELECT 1 FROM z WHERE z.ck = c.ck AND z.zk = c.zk AND z.added_at <= c.captured_at AND (z.removed_at IS NULL OR c.captured_at < z.removed_at))
      UNION ALL SELECT 'reentry_decisions', d.id, NULL FROM reentry_decisions d
        LEFT JOIN p ON p.clip_id = d.clip_id AND p.tracklet_id = d.best_prev_tracklet_id AND p.first < d.start_frame
        WHERE d.best_prev_tracklet_id <> 0 AND p.clip_id IS NULL)
"""

_FAULTS = f"""
WITH k AS (SELECT {SLUG.format('camera_id')} AS cam, max(frame_w) AS w, max(frame_h) AS h, max(fps) AS fps FROM cameras GROUP BY 1),
t AS (SELECT t.*, k.w, k.h, k.fps, k.cam, coalesce(x2 - x1 <= 0, false) OR coalesce(y2 - y1 <= 0, false)
        OR coalesce(least(x1, x2) < -w / 4.0, false) OR coalesce(greatest(x1, x2) > w + w / 4.0, false)
        OR coalesce(least(y1, y2) < -h / 4.0, false) OR coalesce(greatest(y1, y2) > h + h / 4.0, false) AS bad
      FROM tracks t LEFT JOIN k ON k.cam = {SLUG.format('t.camera_id')}),
one AS (SELECT clip_id, global_id, frame_idx, arg_min(struct_pack(x1, y1, x2, y2, bad, cam, fps), id) AS v FROM t WHERE global_id > 0 AND frame_idx IS NOT NULL GROUP BY ALL),
f AS (SELECT clip_id, global_id, frame_idx, v.* FROM one),
same AS (SELECT *, CASE WHEN x1 = lag(x1) OVER w AND y1 = lag(y1) OVER w AND x2 = lag(x2) OVER w AND y2 = lag(y2) OVER w THEN 0 ELSE 1 END AS fresh
         FROM f WINDOW w AS (PARTITION BY clip_id, global_id ORDER BY frame_idx)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY clip_id, global_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS run FROM same),
stuck AS (SELECT clip_id, global_id, frame_idx FROM (SELECT *, count(*) OVER (PARTITION BY clip_id, global_id, run) AS len FROM runs) WHERE len >= 8),
steps AS (SELECT cam, unnest([abs(x1 - lag(x1) OVER w), abs(y1 - lag(y1) OVER w), abs(x2 - lag(x2) OVER w), abs(y2 - lag(y2) OVER w)]) AS step
          FROM f WINDOW w AS (PARTITION BY clip_id, global_id ORDER BY frame_idx)),
unit AS (SELECT cam, median(step) AS u FROM steps WHERE step IS NOT NULL GROUP BY cam),
good AS (SELECT f.*, u, row_number() OVER (PARTITION BY clip_id, global_id ORDER BY frame_idx) AS i FROM f JOIN unit USING (cam)
         WHERE NOT bad AND x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL),
long AS (SELECT clip_id, global_id, frame_idx, i, u, 2 * fps AS pause, unnest([1, 2, 3, 4]) AS c, unnest([x1, y1, x2, y2]) AS x FROM good),
near AS (SELECT *, lag(x, 1) OVER w AS b1, lag(x, 2) OVER w AS b2, lag(x, 3) OVER w AS b3, lead(x, 1) OVER w AS a1, lead(x, 2) OVER w AS a2, lead(x, 3) OVER w AS a3,
         lag(frame_idx, 1) OVER w AS g1, lag(frame_idx, 2) OVER w AS g2, lag(frame_idx, 3) OVER w AS g3, lead(frame_idx, 1) OVER w AS h1, lead(frame_idx, 2) OVER w AS h2, lead(frame_idx, 3) OVER w AS h3
         FROM long WINDOW w AS (PARTITION BY clip_id, global_id, c ORDER BY i)),
far AS (SELECT *, 20 * u AS t, frame_idx - g1 <= pause AS pb1, g1 - g2 <= pause AS pb2, g2 - g3 <= pause AS pb3, h1 - frame_idx <= pause AS pa1, h2 - h1 <= pause AS pa2, h3 - h2 <= pause AS pa3 FROM near),
spike AS (SELECT DISTINCT clip_id, global_id, frame_idx FROM far WHERE
   -- alone; first, second of two; first, second, third of three
   (pb1 AND pa1 AND abs(x - b1) > t AND abs(x - a1) > t AND NOT coalesce(abs(b1 - b2) > t AND abs(a1 - a2) > t AND abs(b2 - x) < t AND abs(a2 - x) < t, false))
   OR (pb1 AND pa1 AND pa2 AND abs(x - b1) > t AND abs(x - a2) > t AND abs(a1 - b1) > t AND abs(a1 - a2) > t)
   OR (pb2 AND pb1 AND pa1 AND abs(b1 - b2) > t AND abs(b1 - a1) > t AND abs(x - b2) > t AND abs(x - a1) > t)
   OR (pb1 AND pa1 AND pa2 AND pa3 AND abs(x - b1) > t AND abs(x - a3) > t AND abs(a1 - b1) > t AND abs(a1 - a3) > t AND abs(a2 - b1) > t AND abs(a2 - a3) > t)
   OR (pb2 AND pb1 AND pa1 AND pa2 AND abs(b1 - b2) > t AND abs(b1 - a2) > t AND abs(x - b2) > t AND abs(x - a2) > t AND abs(a1 - b2) > t AND abs(a1 - a2) > t)
   OR (pb3 AND pb2 AND pb1 AND pa1 AND abs(b2 - b3) > t AND abs(b2 - a1) > t AND abs(b1 - b3) > t AND abs(b1 - a1) > t AND abs(x - b3) > t AND abs(x - a1) > t)),
r AS (SELECT id, 'impossible' AS fault FROM t WHERE bad
      UNION ALL SELECT t.id, 'stuck' FROM t JOIN stuck s ON t.clip_id = s.clip_id AND t.global_id = s.global_id AND t.frame_idx = s.frame_idx
      UNION ALL SELECT t.id, 'spike' FROM t JOIN spike s ON t.clip_id = s.clip_id AND t.global_id = s.global_id AND t.frame_idx = s.frame_idx)
"""

_INTERVALS = f"""
WITH a AS (SELECT clip_id, global_id, {_ZONE} AS zone_key, CAST(round(1000 * t_enter) AS BIGINT) AS s, CAST(round(1000 * t_exit) AS BIGINT) AS e
           FROM visit_events WHERE global_id > 0 AND NOT {OUTSIDE.format('zone_id')} AND round(1000 * t_exit) > round(1000 * t_enter)),
b AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY clip_id, global_id, zone_key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS cut FROM a),
c AS (SELECT *, sum(cut) OVER (PARTITION BY clip_id, global_id, zone_key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM b),
p AS (SELECT clip_id, global_id, zone_key, min(s) AS start_ms, max(e) AS end_ms FROM c GROUP BY clip_id, global_id, zone_key, k),
g AS (SELECT *, lead(start_ms) OVER (PARTITION BY clip_id, global_id, zone_key ORDER BY start_ms) AS next_ms FROM p)
SELECT clip_id, global_id, zone_key, 'period' AS kind, start_ms, end_ms FROM p
UNION ALL SELECT clip_id, global_id, zone_key, 'gap', end_ms, next_ms FROM g WHERE next_ms - end_ms <= 3600000
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_sessions": p1_sessions,
    "p2_found": p2_found,
    "p2_counts": p2_counts,
    "p3_found": p3_found,
    "p3_faults": p3_faults,
    "p4_found": p4_found,
}

SQL = {
    "p1_found": _SESSIONS + "SELECT clip_id, global_id, start_ms, end_ms FROM r",
    "p1_sessions": _SESSIONS + "SELECT * FROM r",
    "p2_found": _ORPHANS + "SELECT table_name, id FROM r",
    "p2_counts": _ORPHANS + "SELECT table_name, CAST(day AS VARCHAR) AS day, count(*) AS n_orphans FROM r GROUP BY ALL",
    "p3_found": _FAULTS + "SELECT DISTINCT id FROM r",
    "p3_faults": _FAULTS + "SELECT fault, count(DISTINCT id) AS n_boxes FROM r GROUP BY fault",
    "p4_found": _INTERVALS,
}
