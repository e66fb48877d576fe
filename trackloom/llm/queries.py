"""Queries of the problems tagged llm and the SQL of those that SQL can state."""

from __future__ import annotations

from trackloom.llm.encode import encoded
from trackloom.llm.leaks import leaked_items
from trackloom.llm.quality import prose_scores
from trackloom.llm.stays import zone_stays
from trackloom.llm.topn import top_pairs
from trackloom.sources.tables import Tables


def p5_found(spark, d):
    return top_pairs(Tables(spark, d).cross_camera_pair_scores).select("cam1_gid", "cam2_gid")


def p5_top10(spark, d):
    return top_pairs(Tables(spark, d).cross_camera_pair_scores, 10)


def p6_found(spark, d):
    return zone_stays(Tables(spark, d).tracks).select("clip_id", "global_id", "zone_key", "start_frame", "end_frame")


def p6_stays(spark, d):
    return zone_stays(Tables(spark, d).tracks)


def p7_ids(spark, d):
    return encoded(Tables(spark, d).documents)


def p8_found(spark, d):
    # The search for windows with up to two edits, and of what it finds the windows without any.
    t = Tables(spark, d)
    return leaked_items(t.documents, t.eval_items).where("edits = 0").select("doc_id", "item_id")


def p8_near(spark, d):
    t = Tables(spark, d)
    return leaked_items(t.documents, t.eval_items)


def p9_found(spark, d):
    t = Tables(spark, d)
    return prose_scores(t.documents, t.doc_labels).where("not_prose_score > 0").select("doc_id")


def p9_quality(spark, d):
    t = Tables(spark, d)
    return prose_scores(t.documents, t.doc_labels)


_TOP = """
WITH p AS (SELECT cam1_gid, cam2_gid, max(score) AS score FROM cross_camera_pair_scores WHERE score BETWEEN 0 AND 1 AND NOT isnan(score) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY cam1_gid ORDER BY score DESC, cam2_gid NULLS FIRST) AS rank FROM p)
"""

_STAYS = r"""
WITH a AS (SELECT clip_id, global_id, frame_idx, arg_min(struct_pack(ms := CAST(round(1000 * ts) AS BIGINT), z := zone_id), id) AS e
           FROM tracks WHERE global_id > 0 AND ts IS NOT NULL AND frame_idx IS NOT NULL GROUP BY ALL),
b AS (SELECT clip_id, global_id, frame_idx, e.ms AS ms, CASE WHEN NOT (e.z IS NULL OR regexp_full_match(e.z, '[\s\p{Z}]*'))
        THEN trim(regexp_replace(lower(e.z), '[^a-z0-9]+', '_', 'g'), '_') END AS zone_key FROM a),
c AS (SELECT *, CASE WHEN zone_key = lag(zone_key) OVER (PARTITION BY clip_id, global_id ORDER BY frame_idx) THEN 0 ELSE 1 END AS cut FROM b),
d AS (SELECT *, sum(cut) OVER (PARTITION BY clip_id, global_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS run FROM c),
r AS (SELECT clip_id, global_id, zone_key, min(frame_idx) AS start_frame, max(frame_idx) AS end_frame, count(*) AS n_events, arg_min(ms, frame_idx) AS start_ms, arg_max(ms, frame_idx) AS end_ms
      FROM d WHERE zone_key IS NOT NULL GROUP BY clip_id, global_id, run, zone_key HAVING count(*) >= 2)
"""

QUERIES = {
    "p5_found": p5_found,
    "p5_top10": p5_top10,
    "p6_found": p6_found,
    "p6_stays": p6_stays,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p8_near": p8_near,
    "p9_found": p9_found,
    "p9_quality": p9_quality,
}

SQL = {
    "p5_found": _TOP + "SELECT cam1_gid, cam2_gid FROM r WHERE rank <= 3",
    "p5_top10": _TOP + "SELECT * FROM r WHERE rank <= 10",
    "p6_found": _STAYS + "SELECT clip_id, global_id, zone_key, start_frame, end_frame FROM r",
    "p6_stays": _STAYS + "SELECT *, end_ms - start_ms AS duration_ms FROM r",
}
