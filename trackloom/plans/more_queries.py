"""Queries that combine operators, the tracker, and the parsing of text rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators import hygiene, linking, pairs, tracker, visits, zones
from trackloom.plans import visit_queries
from trackloom.plans.base import framed_view, tracks_view, with_cte, zones_view
from trackloom.plans.link_queries import _REENTRY
from trackloom.plans.track_queries import _PAIRS, _ZONED
from trackloom.sources.tables import Tables
from trackloom.sources.tracks import parsed


def scan_tracks(spark, d):
    t = Tables(spark, d).tracks
    text = t.select(
        F.col("id").cast("string").alias("row"),
        F.concat(F.lit(" "), F.col("frame_idx").cast("string")).alias("frame_idx"),
        F.col("ts").cast("string").alias("ts_sec"),
        F.when(F.col("global_id") == 0, "").otherwise(F.concat(F.col("global_id").cast("string"), F.lit(".0"))).alias("global_id"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("n/a")).alias(c) for c in ("x1", "y1", "x2", "y2")],
    )
    return parsed(text).select(F.col("row").cast("bigint").alias("id"), "frame_idx", "ts_sec", "global_id", "x1", "y1", "x2", "y2")


def tracker_ids(spark, d):
    return tracker.tracked(framed_view(Tables(spark, d)).withColumn("frame_is_bad", F.lit(False)))


def tracker_summary(spark, d):
    return tracker_ids(spark, d).where("local_id > 0").groupBy("clip_id").agg(F.countDistinct("local_id").alias("n_tracks"), F.count(F.lit(1)).alias("n_rows"))


def bad_frame_hold(spark, d):
    fr = framed_view(Tables(spark, d))
    return tracker.tracked(fr.withColumn("frame_is_bad", F.col("frame_idx") * 13 % 100 >= 90))


def recompute(spark, d):
    t = Tables(spark, d)
    rows = zones.assign_zone(framed_view(t), zones_view(t)).where("global_id > 0").withColumn("zone_key", F.col("found_zone"))
    return visits.held_visits(rows)


def clean_rows(spark, d):
    fr = framed_view(Tables(spark, d))
    return pairs.clean_boxes(fr, 5)


def consecutive_runs(spark, d):
    return hygiene.segments(framed_view(Tables(spark, d)), 1).where("n_rows > 1").select("clip_id", "global_id", "start_frame", "end_frame", "n_rows")


def ambiguity_report(spark, d):
    return linking.ambiguity(Tables(spark, d).tracklets)


def presence_by_hour(spark, d):
    tk = tracks_view(Tables(spark, d)).where("global_id > 0 AND captured_at IS NOT NULL")
    hour = F.date_format(F.date_trunc("hour", F.col("captured_at").cast("timestamp")), "yyyy-MM-dd HH")
    return tk.groupBy("camera", hour.alias("hour")).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("clip_id", "global_id").alias("n_persons"))


QUERIES = {
    "scan_tracks": scan_tracks,
    "tracker": tracker_ids,
    "tracker_summary": tracker_summary,
    "bad_frame_hold": bad_frame_hold,
    "recompute": recompute,
    "clean_rows": clean_rows,
    "consecutive_runs": consecutive_runs,
    "ambiguity_report": ambiguity_report,
    "presence_by_hour": presence_by_hour,
}

SQL = {
    "scan_tracks": "SELECT id, frame_idx, ts AS ts_sec, global_id, x1, y1, x2, y2 FROM tracks WHERE frame_idx IS NOT NULL AND global_id IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL",
    # The visits with hysteresis, of boxes with the zones found anew.
    "recompute": visit_queries.SQL["visits_hysteresis"].replace("a AS (SELECT *, CASE WHEN zone_key", _ZONED.rstrip() + ", zt AS (SELECT fr.clip_id, fr.global_id, fr.ms, fr.row_idx, fz.found_zone AS zone_key FROM fr JOIN fz ON fz.row_idx = fr.row_idx), a AS (SELECT *, CASE WHEN zone_key", 1).replace("FROM tk WHERE ms IS NOT NULL AND global_id > 0 WINDOW", "FROM zt WHERE ms IS NOT NULL AND global_id > 0 WINDOW", 1),
    "clean_rows": with_cte(_PAIRS + ", r AS (SELECT fr.row_idx, clip_id, global_id, row_number() OVER (PARTITION BY clip_id, global_id ORDER BY overlap, greatest(x2 - x1, 0) * greatest(y2 - y1, 0) DESC, fr.row_idx) AS r FROM fr JOIN ov ON ov.row_idx = fr.row_idx WHERE global_id > 0) SELECT row_idx, clip_id, global_id FROM r WHERE r <= 5"),
    "consecutive_runs": with_cte("""a AS (SELECT *, CASE WHEN frame_idx - lag(frame_idx) OVER q <= 1 THEN 0 ELSE 1 END AS cut FROM fr WHERE global_id > 0 WINDOW q AS (PARTITION BY clip_id, global_id ORDER BY frame_idx, row_idx)),
        b AS (SELECT *, sum(cut) OVER (PARTITION BY clip_id, global_id ORDER BY frame_idx, row_idx ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT clip_id, global_id, min(frame_idx) AS start_frame, max(frame_idx) AS end_frame, count(*) AS n_rows FROM b GROUP BY clip_id, global_id, s HAVING count(*) > 1"""),
    "ambiguity_report": _REENTRY + """, k AS (SELECT clip_id, c_tracklet_id, count(*) AS n_candidates, count(*) FILTER (reason IS NULL) AS n_passing, count(*) FILTER (reason = 'entry_exit_side_incompatible') AS n_side, count(*) FILTER (reason = 'size_ratio_implausible') AS n_size FROM sc GROUP BY ALL),
        m AS (SELECT clip_id, c_tracklet_id, margin FROM rr WHERE rank = 1) SELECT t.clip_id, t.tracklet_id, coalesce(n_candidates, 0) AS n_candidates, coalesce(n_passing, 0) AS n_passing, coalesce(n_side, 0) AS n_side, coalesce(n_size, 0) AS n_size, round(margin, 6) AS margin,
        CASE WHEN n_candidates IS NULL THEN 'no_candidate' WHEN n_passing = 0 THEN 'all_gated' WHEN margin < 0.045 THEN 'ambiguous' ELSE 'clear' END AS verdict
        FROM tracklets t LEFT JOIN k ON k.clip_id = t.clip_id AND k.c_tracklet_id = t.tracklet_id LEFT JOIN m ON m.clip_id = t.clip_id AND m.c_tracklet_id = t.tracklet_id""",
    "presence_by_hour": with_cte("SELECT camera, strftime(date_trunc('hour', captured_at), '%Y-%m-%d %H') AS hour, count(*) AS n_rows, count(DISTINCT (clip_id, global_id)) AS n_persons FROM tk WHERE global_id > 0 AND captured_at IS NOT NULL GROUP BY ALL"),
}
