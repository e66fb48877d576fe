"""Queries over boxes: geometry, zones, pairs of boxes and the cleaning of identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import geometry as g
from trackloom.operators import hygiene, pairs, zones
from trackloom.plans.base import framed_view, tracks_view, with_cte, zones_view
from trackloom.sources.tables import Tables


def _fr(spark, d):
    return framed_view(Tables(spark, d))


def _r(c, digits=4):
    return F.round(c, digits)


def bbox_points(spark, d):
    fr = _fr(spark, d)
    out = {f"{k}_{axis}": _r(p) for k in ("foot", "ankle", "center") for axis, p in zip("xy", g.anchor_point(g.box(), k))}
    return fr.select("row_idx", *[v.alias(k) for k, v in out.items()])


def assign_zone(spark, d):
    t = Tables(spark, d)
    return zones.assign_zone(framed_view(t), zones_view(t)).select("row_idx", "found_zone")


def zone_backfill(spark, d):
    t = Tables(spark, d)
    return zones.backfilled(framed_view(t), zones_view(t)).groupBy("camera", "zone_key").agg(F.count(F.lit(1)).alias("n_rows"))


def point_in_polygon(spark, d):
    t = Tables(spark, d)
    z = zones_view(t).select("camera", "zone_key", F.from_json("polygon", "array<array<double>>").alias("polygon"))
    spots = z.select("camera", F.explode("polygon").alias("p")).distinct().select("camera", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
    hit = g.in_polygon(F.col("x"), F.col("y"), F.col("polygon"))
    return spots.join(z.distinct(), "camera").where(hit).groupBy("camera", "zone_key").agg(F.count(F.lit(1)).alias("n_corners"))


def zone_upsert(spark, d):
    z = zones_view(Tables(spark, d)).where("camera IS NOT NULL")
    return zones.upserted(z.where("removed_at IS NOT NULL").dropDuplicates(["camera", "zone_key"]), z.where("removed_at IS NULL"), keep_polygon=True)


def zone_sync_anti(spark, d):
    z = zones_view(Tables(spark, d))
    return zones.synchronised(z, z.where("removed_at IS NULL AND camera <> 'cam_03'")).select("camera", "zone_key", "zone_name")


def zone_bbox_overlap(spark, d):
    return zones.overlapping_zones(zones_view(Tables(spark, d)))


def frame_side(spark, d):
    fr = _fr(spark, d)
    cx, cy = g.centre(g.box())
    return fr.groupBy("camera", g.frame_side(cx, cy, F.col("w"), F.col("h")).alias("side")).agg(F.count(F.lit(1)).alias("n_rows"))


def side_score(spark, d):
    t = Tables(spark, d).tracklets
    return t.select("clip_id", "tracklet_id", g.side_score(F.col("exit_side"), F.col("entry_side")).alias("score"))


def shape_vec(spark, d):
    fr = _fr(spark, d)
    v = g.shape_vector(g.box(), F.col("w"), F.col("h"))
    return fr.select("row_idx", *[_r(v[i], 6).alias(f"s{i}") for i in range(4)])


def filter_detections(spark, d):
    fr = _fr(spark, d)
    w, h = g.width(g.box()), g.height(g.box())
    keep = (h / F.col("h") >= 0.08) & (w / F.col("w") >= 0.015) & (w / F.greatest(h, F.lit(1.0))).between(0.16, 1.25) & (F.coalesce("conf", F.lit(0.0)) >= 0.3)
    return fr.where(keep).groupBy("camera").agg(F.count(F.lit(1)).alias("n_kept"))


def _blur():
    """A stand-in for measured sharpness, which the tables do not hold."""
    return F.pmod(F.col("row_idx") * 37, F.lit(200)).cast("double")


def det_quality(spark, d):
    fr = _fr(spark, d)
    q = g.detection_quality(g.box(), F.coalesce("conf", F.lit(0.0)), _blur(), F.col("w"), F.col("h"))
    return fr.withColumn("q", q).select("row_idx", _r(F.col("q"), 6).alias("quality"), g.detection_mode(g.box(), F.col("q"), F.col("h")).cast("bigint").alias("mode"))


def crop_quality(spark, d):
    fr = _fr(spark, d)
    both = fr.join(pairs.largest_overlap(fr), "row_idx")
    return both.select("row_idx", _r(g.crop_quality(g.box(), F.col("overlap"), _blur(), F.col("w"), F.col("h")), 6).alias("quality"))


def _gray(spark, d):
    """Stand-ins for measured brightness of frames: whole numbers from frame numbers."""
    f = _fr(spark, d).select("clip_id", "frame_idx").distinct()
    k = F.col("frame_idx")
    return f.select("clip_id", "frame_idx", F.pmod(k * 31, F.lit(256)).cast("double").alias("mean_gray"), F.pmod(k * 17, F.lit(90)).cast("double").alias("std_gray"), (F.pmod(k * 13, F.lit(100)) / 400.0).alias("white_ratio"))


def frame_quality(spark, d):
    return _gray(spark, d).select("clip_id", "frame_idx", g.frame_flag(F.col("mean_gray"), F.col("std_gray"), F.col("white_ratio")).alias("reason"))


def quality_summary(spark, d):
    flagged = _gray(spark, d).withColumn("reason", g.frame_flag(F.col("mean_gray"), F.col("std_gray"), F.col("white_ratio")))
    count = lambda r: F.count_if(F.col("reason") == r).alias(f"n_{r}")
    return flagged.groupBy("clip_id").agg(
        F.count(F.lit(1)).alias("n_frames"), F.count("reason").alias("n_bad"), _r(100 * F.count("reason") / F.count(F.lit(1))).alias("bad_pct"), _r(F.avg("mean_gray")).alias("mean_gray"), *[count(r) for r in ("white_ratio", "mean_gray", "mean_and_std_gray", "std_gray")]
    )


def iou_pairs(spark, d):
    return pairs.overlapping_pairs(_fr(spark, d))


def row_overlap_max(spark, d):
    return pairs.largest_overlap(_fr(spark, d))


def cooccurrence(spark, d):
    return pairs.shared_frames(_fr(spark, d))


def track_overlap_stats(spark, d):
    return pairs.overlap_statistics(_fr(spark, d))


def disjoint_pairs(spark, d):
    return pairs.disjoint_pairs(_fr(spark, d))


def contained_pairs(spark, d):
    return pairs.contained_pairs(_fr(spark, d)).select("row_a", "row_b", "hits")


def contained_dups(spark, d):
    return pairs.contained_duplicates(_fr(spark, d))


def asof_last_position(spark, d):
    t = Tables(spark, d)
    asked = t.tracklets.select(F.concat_ws("/", "clip_id", F.col("tracklet_id").cast("string")).alias("name"), "clip_id", F.col("final_gid").alias("global_id"), F.col("start_frame").alias("frame_idx"))
    asked = asked.withColumn("ask_id", F.xxhash64("name"))
    found = pairs.last_positions(framed_view(t), asked)
    return asked.join(found, "ask_id").select("name", "last_frame", "last_row", "x1", "y1", "x2", "y2")


def crowd_windows(spark, d):
    return pairs.crowd_windows(_fr(spark, d), 2, 0.05)


def uniq_per_frame(spark, d):
    return hygiene.unique_per_frame(_fr(spark, d)).select("row_idx", "global_id")


def dup_suppress(spark, d):
    return hygiene.suppress_duplicates(_fr(spark, d)).select("row_idx", "global_id")


def uniq_largest(spark, d):
    return hygiene.largest_per_frame(_fr(spark, d)).select("row_idx", "global_id")


def dup_count(spark, d):
    return hygiene.duplicate_count(_fr(spark, d))


def tiny_ids(spark, d):
    return hygiene.tiny_ids(_fr(spark, d))


def identity_summary(spark, d):
    return hygiene.summary(_fr(spark, d))


def identity_metrics(spark, d):
    return hygiene.id_metrics(_fr(spark, d))


def gid_distribution(spark, d):
    return hygiene.id_distribution(tracks_view(Tables(spark, d)))


def ghost_boxes(spark, d):
    return hygiene.ghost_boxes(_fr(spark, d)).select("row_idx", "global_id")


def border_ghosts(spark, d):
    return hygiene.border_ghosts(_fr(spark, d))


def edge_ghosts(spark, d):
    return hygiene.edge_ghosts(_fr(spark, d), 20)


def stationary_suppress(spark, d):
    return hygiene.stationary_ids(_fr(spark, d))


def motion_of_ids(spark, d):
    return hygiene.motion_of_ids(_fr(spark, d))


def static_drop(spark, d):
    return hygiene.static_ids(_fr(spark, d), 20)


def compact_ids(spark, d):
    return hygiene.compact_ids(_fr(spark, d))


def canonicalize(spark, d):
    return hygiene.canonical_numbers(_fr(spark, d))


def canonical_enforce(spark, d):
    return hygiene.enforce_canonical(_fr(spark, d), 4)


def converge(spark, d):
    return hygiene.converge(_fr(spark, d))


def max_ids(spark, d):
    return hygiene.keep_largest(_fr(spark, d), 5)


def gid_remap(spark, d):
    fr = _fr(spark, d)
    return hygiene.remapped(fr, hygiene.compact_ids(fr)).select("row_idx", "global_id")


def tracklets(spark, d):
    return hygiene.segments(_fr(spark, d), 10)


def segments(spark, d):
    return hygiene.segments(_fr(spark, d), 24).groupBy("clip_id", "global_id").agg(F.count(F.lit(1)).alias("n_segments"), F.max("n_rows").alias("longest"))


def jump_split(spark, d):
    return hygiene.jump_splits(_fr(spark, d))


def split_recycled(spark, d):
    return hygiene.largest_gaps(_fr(spark, d))


def spatial_pred(spark, d):
    return hygiene.predicted(_fr(spark, d))


def sample_rows(spark, d):
    return hygiene.sampled(_fr(spark, d))


QUERIES = {f.__name__: f for f in (
    bbox_points, assign_zone, zone_backfill, point_in_polygon, zone_upsert, zone_sync_anti, zone_bbox_overlap, frame_side, side_score, shape_vec, filter_detections, det_quality, crop_quality, frame_quality, quality_summary,
    iou_pairs, row_overlap_max, cooccurrence, track_overlap_stats, disjoint_pairs, contained_pairs, contained_dups, asof_last_position, crowd_windows, uniq_per_frame, dup_suppress, uniq_largest, dup_count, tiny_ids,
    identity_summary, identity_metrics, gid_distribution, ghost_boxes, border_ghosts, edge_ghosts, stationary_suppress, motion_of_ids, static_drop, compact_ids, canonicalize, canonical_enforce, converge, max_ids, gid_remap,
    tracklets, segments, jump_split, split_recycled, spatial_pred, sample_rows,
)}

_IOU = """(greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0))
  / (greatest(a.x2 - a.x1, 0) * greatest(a.y2 - a.y1, 0) + greatest(b.x2 - b.x1, 0) * greatest(b.y2 - b.y1, 0) - greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) + 1e-6)"""
_PAIRS = f"""fp AS (SELECT a.clip_id, a.frame_idx, a.row_idx AS row_a, b.row_idx AS row_b, a.global_id AS gid_a, b.global_id AS gid_b, {_IOU} AS v FROM fr a JOIN fr b ON a.clip_id = b.clip_id AND a.frame_idx = b.frame_idx AND a.row_idx < b.row_idx),
ov AS (SELECT fr.row_idx, round(coalesce(max(v), 0), 6) AS overlap FROM fr LEFT JOIN (SELECT row_a AS r, v FROM fp UNION ALL SELECT row_b, v FROM fp) e ON e.r = fr.row_idx GROUP BY fr.row_idx)
"""
_EXT = "ex AS (SELECT clip_id, global_id, count(*) AS n_rows, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame, max(frame_idx) - min(frame_idx) + 1 AS span FROM fr WHERE global_id > 0 GROUP BY ALL)\n"
_BW, _BH = "greatest(x2 - x1, 1)", "greatest(y2 - y1, 1)"
_BLURQ = "CAST((row_idx * 37) % 200 AS DOUBLE)"
_UNIT = lambda x: f"least(greatest({x}, 0), 1)"
_GRAY = """f AS (SELECT DISTINCT clip_id, frame_idx FROM fr), gr AS (SELECT clip_id, frame_idx, CAST((frame_idx * 31) % 256 AS DOUBLE) AS m, CAST((frame_idx * 17) % 90 AS DOUBLE) AS s, ((frame_idx * 13) % 100) / 400.0 AS wr FROM f),
fl AS (SELECT *, CASE WHEN wr >= 0.16 THEN 'white_ratio' WHEN m >= 225 THEN 'mean_gray' WHEN m >= 205 AND s <= 45 THEN 'mean_and_std_gray' WHEN s <= 8 THEN 'std_gray' END AS reason FROM gr)
"""
_PIP = """pg AS (SELECT DISTINCT camera, zone_key, added_at, removed_at, polygon, from_json(polygon, '[["DOUBLE"]]') AS p FROM zn WHERE camera IS NOT NULL),
eg AS (SELECT camera, zone_key, added_at, removed_at, p[i][1] AS px, p[i][2] AS py, p[i % len(p) + 1][1] AS qx, p[i % len(p) + 1][2] AS qy FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM pg WHERE len(p) >= 3))
"""
_CROSS = "((py > y) <> (qy > y)) AND x < (qx - px) * (y - py) / (qy - py + 1e-12) + px"
_ZONED = _PIP + f""", pt AS (SELECT row_idx, camera, zone_key, captured_at, (x1 + x2) / 2 AS x, y2 - 2 AS y FROM fr),
hit AS (SELECT row_idx, eg.zone_key AS z FROM pt JOIN eg ON eg.camera = pt.camera AND coalesce(added_at <= captured_at, true) AND coalesce(captured_at < removed_at, true) GROUP BY row_idx, eg.zone_key, added_at HAVING count(*) FILTER ({_CROSS}) % 2 = 1),
fz AS (SELECT pt.row_idx, pt.camera, pt.zone_key, min(z) AS found_zone FROM pt LEFT JOIN hit ON hit.row_idx = pt.row_idx GROUP BY ALL)
"""


def _dedup(score: str) -> str:
    return with_cte(_EXT + f""", s AS (SELECT row_idx, fr.global_id, fr.clip_id, frame_idx, {score} AS sc FROM fr LEFT JOIN ex ON ex.clip_id = fr.clip_id AND ex.global_id = fr.global_id)
        SELECT row_idx, CASE WHEN global_id > 0 AND row_number() OVER (PARTITION BY clip_id, frame_idx, global_id ORDER BY sc DESC, row_idx) > 1 THEN 0 ELSE global_id END AS global_id FROM s""")  # fmt: skip


_FITS = f"CASE WHEN {_BW} / {_BH} BETWEEN 0.18 AND 1.10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
_BORDER = lambda m: f"(x1 <= greatest(2, floor({m} * w)) OR y1 <= greatest(2, floor({m} * h)) OR x2 >= w - greatest(2, floor({m} * w)) OR y2 >= h - greatest(2, floor({m} * h)))"
_MOTION = f"""o AS (SELECT clip_id, global_id, frame_idx, row_idx, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, {_BH} AS hh FROM fr WHERE global_id > 0),
s AS (SELECT *, sqrt((cx - lag(cx) OVER q) ** 2 + (cy - lag(cy) OVER q) ** 2) AS st FROM o WINDOW q AS (PARTITION BY clip_id, global_id ORDER BY frame_idx, row_idx)),
mo AS (SELECT clip_id, global_id, count(*) AS n_rows, round(coalesce(sum(st), 0) / median(hh), 4) AS way_norm,
  round(sqrt((arg_max(cx, struct_pack(frame_idx, row_idx)) - arg_min(cx, struct_pack(frame_idx, row_idx))) ** 2 + (arg_max(cy, struct_pack(frame_idx, row_idx)) - arg_min(cy, struct_pack(frame_idx, row_idx))) ** 2) / median(hh), 4) AS far_norm,
  round(stddev_pop(cx), 4) AS spread_x, round(stddev_pop(cy), 4) AS spread_y FROM s GROUP BY ALL)
"""


def _segs(gap: int) -> str:
    return f"""o AS (SELECT clip_id, global_id, frame_idx, row_idx, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, CASE WHEN frame_idx - lag(frame_idx) OVER q <= {gap} THEN 0 ELSE 1 END AS cut FROM fr WHERE global_id > 0 WINDOW q AS (PARTITION BY clip_id, global_id ORDER BY frame_idx, row_idx)),
    p AS (SELECT *, sum(cut) OVER (PARTITION BY clip_id, global_id ORDER BY frame_idx, row_idx ROWS UNBOUNDED PRECEDING) AS seg FROM o),
    sg AS (SELECT clip_id, global_id, CAST(seg AS BIGINT) AS seg, min(frame_idx) AS start_frame, max(frame_idx) AS end_frame, count(*) AS n_rows, round(arg_min(cx, struct_pack(frame_idx, row_idx)), 4) AS start_cx, round(arg_min(cy, struct_pack(frame_idx, row_idx)), 4) AS start_cy,
      round(arg_max(cx, struct_pack(frame_idx, row_idx)), 4) AS end_cx, round(arg_max(cy, struct_pack(frame_idx, row_idx)), 4) AS end_cy FROM p GROUP BY clip_id, global_id, seg)
    """


SQL = {
    "bbox_points": with_cte("SELECT row_idx, round((x1 + x2) / 2, 4) AS foot_x, round(y2, 4) AS foot_y, round((x1 + x2) / 2, 4) AS ankle_x, round(y2 - 2, 4) AS ankle_y, round((x1 + x2) / 2, 4) AS center_x, round((y1 + y2) / 2, 4) AS center_y FROM fr"),
    "assign_zone": with_cte(_ZONED + "SELECT row_idx, found_zone FROM fz"),
    "zone_backfill": with_cte(_ZONED + "SELECT camera, coalesce(zone_key, found_zone) AS zone_key, count(*) AS n_rows FROM fz GROUP BY ALL"),
    "point_in_polygon": with_cte(_PIP + f""", c AS (SELECT DISTINCT camera, unnest(p) AS c FROM pg), s AS (SELECT camera, c[1] AS x, c[2] AS y FROM c), z AS (SELECT DISTINCT camera, zone_key, px, py, qx, qy FROM eg),
        i AS (SELECT s.camera, zone_key, x, y FROM s JOIN z ON z.camera = s.camera GROUP BY ALL HAVING count(*) FILTER ({_CROSS}) % 2 = 1) SELECT camera, zone_key, count(*) AS n_corners FROM i GROUP BY ALL"""),
    "zone_upsert": with_cte("""o AS (SELECT camera, zone_key, any_value(zone_name) AS zone_name, any_value(zone_type) AS zone_type, any_value(polygon) AS polygon FROM zn WHERE removed_at IS NOT NULL AND camera IS NOT NULL GROUP BY ALL), n AS (SELECT * FROM zn WHERE removed_at IS NULL AND camera IS NOT NULL)
        SELECT coalesce(n.camera, o.camera) AS camera, coalesce(n.zone_key, o.zone_key) AS zone_key, CASE WHEN n.camera IS NULL THEN o.zone_name ELSE n.zone_name END AS zone_name, CASE WHEN n.camera IS NULL THEN o.zone_type ELSE n.zone_type END AS zone_type, coalesce(o.polygon, n.polygon) AS polygon
        FROM o FULL JOIN n ON o.camera = n.camera AND o.zone_key = n.zone_key"""),
    "zone_sync_anti": with_cte("wt AS (SELECT camera, zone_key FROM zn WHERE removed_at IS NULL AND camera <> 'cam_03') SELECT camera, zone_key, zone_name FROM zn WHERE camera IS NULL OR camera NOT IN (SELECT camera FROM wt) OR EXISTS (SELECT 1 FROM wt WHERE wt.camera = zn.camera AND wt.zone_key = zn.zone_key)"),
    "zone_bbox_overlap": with_cte(_PIP + """, b AS (SELECT DISTINCT camera, zone_key, list_min(list_transform(p, lambda c: c[1])) AS x1, list_min(list_transform(p, lambda c: c[2])) AS y1, list_max(list_transform(p, lambda c: c[1])) AS x2, list_max(list_transform(p, lambda c: c[2])) AS y2 FROM pg)
        SELECT a.camera, a.zone_key AS zone_a, b.zone_key AS zone_b, (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS overlap_area FROM b a JOIN b ON a.camera = b.camera AND a.zone_key < b.zone_key
        WHERE least(a.x2, b.x2) > greatest(a.x1, b.x1) AND least(a.y2, b.y2) > greatest(a.y1, b.y1)"""),
    "frame_side": with_cte("SELECT camera, CASE WHEN (x1 + x2) / 2 <= 0.18 * w THEN 'left' WHEN (x1 + x2) / 2 >= (1 - 0.18::DOUBLE) * w THEN 'right' WHEN (y1 + y2) / 2 <= 0.20 * h THEN 'top' WHEN (y1 + y2) / 2 >= (1 - 0.20::DOUBLE) * h THEN 'bottom' ELSE 'center' END AS side, count(*) AS n_rows FROM fr GROUP BY ALL"),
    "side_score": "SELECT clip_id, tracklet_id, CAST(CASE WHEN exit_side = entry_side THEN 1.0 WHEN exit_side = 'center' OR entry_side = 'center' THEN 0.62 WHEN (exit_side, entry_side) IN (('left','right'),('right','left'),('top','bottom'),('bottom','top')) THEN 0.28 ELSE 0.40 END AS DOUBLE) AS score FROM tracklets",
    "shape_vec": with_cte(f"v AS (SELECT row_idx, {_BW} / {_BH} AS a, {_BH} / h AS b, sqrt({_BW} * {_BH}) / sqrt(h * w) AS c, ({_BW} + {_BH}) / (h + w) AS d FROM fr), n AS (SELECT *, sqrt(a * a + b * b + c * c + d * d) AS l FROM v) SELECT row_idx, round(a / l, 6) AS s0, round(b / l, 6) AS s1, round(c / l, 6) AS s2, round(d / l, 6) AS s3 FROM n"),
    "filter_detections": with_cte("SELECT camera, count(*) AS n_kept FROM fr WHERE (y2 - y1) / h >= 0.08 AND (x2 - x1) / w >= 0.015 AND (x2 - x1) / greatest(y2 - y1, 1) BETWEEN 0.16 AND 1.25 AND coalesce(conf, 0) >= 0.3 GROUP BY camera"),
    "det_quality": with_cte(f"""q AS (SELECT row_idx, y2, h, 0.36::DOUBLE * {_UNIT('(coalesce(conf, 0) - 0.42::DOUBLE) / (1 - 0.42::DOUBLE)')} + 0.28::DOUBLE * {_UNIT('greatest(x2 - x1, 0) * greatest(y2 - y1, 0) / (w * h) / 0.010::DOUBLE')} + 0.20::DOUBLE * {_UNIT(f'({_BLURQ} - 35.0::DOUBLE) / 70.0::DOUBLE')}
        + 0.16::DOUBLE * CASE WHEN x1 <= floor(w * 0.015) OR y1 <= floor(h * 0.015) OR x2 >= floor(w * (1 - 0.015)) OR y2 >= floor(h * (1 - 0.015)) THEN 0 ELSE 1 END AS q FROM fr)
        SELECT row_idx, round(q, 6) AS quality, CAST(CASE WHEN q < 0.34 OR y2 / h < 0.42 THEN 0 WHEN y2 / h < 0.62 THEN 1 ELSE 2 END AS BIGINT) AS mode FROM q"""),
    "crop_quality": with_cte(_PAIRS + f""", c AS (SELECT fr.row_idx, w, h, overlap, {_BLURQ.replace('row_idx', 'fr.row_idx')} AS bl, greatest(0, least(w - 1, trunc(x1))) AS a1, greatest(0, least(h - 1, trunc(y1))) AS b1, greatest(0, least(w - 1, trunc(x2))) AS a2, greatest(0, least(h - 1, trunc(y2))) AS b2 FROM fr JOIN ov ON ov.row_idx = fr.row_idx),
        e AS (SELECT *, (a2 - a1) * (b2 - b1) / (w * h) AS sh, a1 <= floor(w * 0.008) OR b1 <= floor(h * 0.008) OR a2 >= floor(w * (1 - 0.008)) OR b2 >= floor(h * (1 - 0.008)) AS bo FROM c)
        SELECT row_idx, CASE WHEN a2 <= a1 + 6 OR b2 <= b1 + 10 OR sh < 0.55::DOUBLE * 0.008::DOUBLE OR (bo AND sh < 0.008) OR overlap > 0.72 OR bl < 8.0 THEN 0 ELSE
          round({_UNIT(f"(0.40::DOUBLE * {_UNIT('sh / (0.008::DOUBLE * 3.5::DOUBLE)')} + 0.35::DOUBLE * {_UNIT('(bl - 0.35::DOUBLE * 24) / (1.8::DOUBLE * 24)')} + 0.25::DOUBLE * {_UNIT('1 - overlap / (1.35::DOUBLE * 0.55::DOUBLE)')}) * CASE WHEN bo THEN 0.62::DOUBLE ELSE 1 END")}, 6) END AS quality FROM e"""),
    "frame_quality": with_cte(_GRAY + "SELECT clip_id, frame_idx, reason FROM fl"),
    "quality_summary": with_cte(_GRAY + """SELECT clip_id, count(*) AS n_frames, count(reason) AS n_bad, round(100.0::DOUBLE * count(reason) / count(*), 4) AS bad_pct, round(avg(m), 4) AS mean_gray, count(*) FILTER (reason = 'white_ratio') AS n_white_ratio, count(*) FILTER (reason = 'mean_gray') AS n_mean_gray,
        count(*) FILTER (reason = 'mean_and_std_gray') AS n_mean_and_std_gray, count(*) FILTER (reason = 'std_gray') AS n_std_gray FROM fl GROUP BY clip_id"""),
    "iou_pairs": with_cte(_PAIRS + "SELECT row_a, row_b, round(v, 6) AS iou FROM fp WHERE v >= 0.1"),
    "row_overlap_max": with_cte(_PAIRS + "SELECT row_idx, overlap FROM ov"),
    "cooccurrence": with_cte("s AS (SELECT DISTINCT clip_id, frame_idx, global_id FROM fr WHERE global_id > 0) SELECT a.clip_id, a.global_id AS gid_a, b.global_id AS gid_b, count(*) AS n_frames FROM s a JOIN s b ON a.clip_id = b.clip_id AND a.frame_idx = b.frame_idx AND a.global_id < b.global_id GROUP BY ALL"),
    "track_overlap_stats": with_cte(f"""o AS (SELECT *, row_number() OVER (PARTITION BY clip_id, frame_idx, global_id ORDER BY greatest(x2 - x1, 0) * greatest(y2 - y1, 0) DESC, row_idx) AS r FROM fr WHERE global_id > 0), u AS (SELECT * FROM o WHERE r = 1),
        n AS (SELECT clip_id, global_id, count(*) AS n FROM u GROUP BY ALL), p AS (SELECT a.clip_id, a.global_id AS gid_a, b.global_id AS gid_b, count(*) AS n_frames, avg({_IOU}) AS m, max({_IOU}) AS x FROM u a JOIN u b ON a.clip_id = b.clip_id AND a.frame_idx = b.frame_idx AND a.global_id < b.global_id GROUP BY a.clip_id, a.global_id, b.global_id)
        SELECT p.clip_id, gid_a, gid_b, n_frames, round(n_frames / least(na.n, nb.n), 6) AS share, round(m, 6) AS mean_iou, round(x, 6) AS max_iou FROM p JOIN n na ON na.clip_id = p.clip_id AND na.global_id = gid_a JOIN n nb ON nb.clip_id = p.clip_id AND nb.global_id = gid_b"""),
    "disjoint_pairs": with_cte("""i AS (SELECT DISTINCT clip_id, global_id FROM fr WHERE global_id > 0), s AS (SELECT DISTINCT a.clip_id, a.global_id AS ga, b.global_id AS gb FROM fr a JOIN fr b ON a.clip_id = b.clip_id AND a.frame_idx = b.frame_idx AND a.global_id < b.global_id WHERE a.global_id > 0)
        SELECT a.clip_id, a.global_id AS gid_a, b.global_id AS gid_b FROM i a JOIN i b ON a.clip_id = b.clip_id AND a.global_id < b.global_id WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.clip_id = a.clip_id AND ga = a.global_id AND gb = b.global_id)"""),
    "contained_pairs": with_cte("""e AS (SELECT a.clip_id, a.row_idx AS row_a, b.row_idx AS row_b, least(a.global_id, b.global_id) AS g, greatest(a.global_id, b.global_id) AS hh, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS i,
          greatest(a.x2 - a.x1, 0) * greatest(a.y2 - a.y1, 0) AS aa, greatest(b.x2 - b.x1, 0) * greatest(b.y2 - b.y1, 0) AS ab, sqrt(((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2) ** 2 + ((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2) ** 2) / greatest(a.y2 - a.y1, b.y2 - b.y1, 1) AS cd
          FROM fr a JOIN fr b ON a.clip_id = b.clip_id AND a.frame_idx = b.frame_idx AND a.row_idx < b.row_idx AND a.global_id <> b.global_id WHERE a.global_id > 0 AND b.global_id > 0),
        f AS (SELECT * FROM e WHERE i > 0 AND aa > 1 AND ab > 1 AND (i / (aa + ab - i + 1e-6) >= 0.48 OR greatest(i / aa, i / ab) >= 0.84) AND cd <= 0.42), c AS (SELECT *, count(*) OVER (PARTITION BY clip_id, g, hh) AS hits FROM f) SELECT row_a, row_b, hits FROM c WHERE hits >= 2"""),
    "asof_last_position": with_cte("""h AS (SELECT clip_id, global_id, frame_idx, min(row_idx) AS row_idx FROM fr WHERE global_id > 0 GROUP BY ALL), k AS (SELECT h.*, x1, y1, x2, y2 FROM h JOIN fr USING (row_idx))
        SELECT concat_ws('/', t.clip_id, CAST(tracklet_id AS VARCHAR)) AS name, k.frame_idx AS last_frame, k.row_idx AS last_row, x1, y1, x2, y2 FROM tracklets t ASOF LEFT JOIN k ON k.clip_id = t.clip_id AND k.global_id = t.final_gid AND k.frame_idx < t.start_frame"""),
    "crowd_windows": with_cte(_PAIRS + """, p AS (SELECT clip_id, frame_idx, count(*) AS n, avg(overlap) AS v FROM fr JOIN ov ON ov.row_idx = fr.row_idx GROUP BY ALL), c AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY clip_id ORDER BY frame_idx) AS isl FROM p WHERE n >= 2 AND v >= 0.05)
        SELECT clip_id, min(frame_idx) AS start_frame, max(frame_idx) AS end_frame, round(sum(n * v), 4) AS pressure FROM c GROUP BY clip_id, isl"""),
    "uniq_per_frame": _dedup(f"0.58::DOUBLE * ({_BW} * {_BH}) + 0.20::DOUBLE * coalesce(n_rows, 0) + 0.14::DOUBLE * coalesce(span, 1) + 0.08::DOUBLE * {_FITS}"),
    "dup_suppress": _dedup(f"0.60::DOUBLE * ({_BW} * {_BH}) + 0.25::DOUBLE * coalesce(n_rows, 0) + 0.15::DOUBLE * {_FITS}"),
    "uniq_largest": _dedup("greatest(x2 - x1, 0) * greatest(y2 - y1, 0)"),
    "dup_count": with_cte("p AS (SELECT clip_id, count(*) - 1 AS n FROM fr WHERE global_id > 0 GROUP BY clip_id, frame_idx, global_id) SELECT clip_id, CAST(sum(n) AS BIGINT) AS n_duplicates FROM p GROUP BY clip_id"),
    "tiny_ids": with_cte(_EXT + "SELECT * FROM ex WHERE n_rows < 8 OR (n_rows < 16 AND span < 24)"),
    "identity_summary": with_cte(_EXT + """, i AS (SELECT clip_id, count(*) AS n_ids, count(*) FILTER (n_rows >= 30 AND span >= 32) AS n_stable, max(global_id) AS max_id FROM ex GROUP BY clip_id), p AS (SELECT clip_id, count(*) - 1 AS n FROM fr WHERE global_id > 0 GROUP BY clip_id, frame_idx, global_id), q AS (SELECT clip_id, CAST(sum(n) AS BIGINT) AS n_duplicates FROM p GROUP BY clip_id),
        t AS (SELECT clip_id, count(*) AS n_rows, count(*) FILTER (global_id > 0) AS n_positive FROM fr GROUP BY clip_id) SELECT t.*, coalesce(n_ids, 0) AS n_ids, coalesce(n_stable, 0) AS n_stable, coalesce(max_id, 0) AS max_id, coalesce(n_duplicates, 0) AS n_duplicates FROM t LEFT JOIN i USING (clip_id) LEFT JOIN q USING (clip_id)"""),
    "identity_metrics": with_cte(_EXT + "SELECT *, round(n_rows / span, 6) AS density, round(n_rows / sum(n_rows) OVER (PARTITION BY clip_id), 6) AS share, n_rows >= 30 AND span >= 32 AS is_stable FROM ex"),
    "gid_distribution": with_cte("p AS (SELECT clip_id, global_id, count(*) AS n_rows, min(ms) AS first_ms, max(ms) AS last_ms FROM tk GROUP BY ALL) SELECT *, round(n_rows / sum(n_rows) OVER c, 6) AS share, last_ms - first_ms AS duration_ms, sum(CASE WHEN global_id <= 0 THEN n_rows ELSE 0 END) OVER c * 2 > sum(n_rows) OVER c AS mostly_unassigned FROM p WINDOW c AS (PARTITION BY clip_id)"),
    "ghost_boxes": with_cte(f"""f AS (SELECT *, (x1 + x2) / 2 / w AS ux, (y1 + y2) / 2 / h AS uy, {_BW} / {_BH} AS asp, (x1 + x2) / 2 / w >= 0.74 AND (y1 + y2) / 2 / h >= 0.32 AS rt FROM fr),
        o AS (SELECT *, asp < 0.18 OR asp > 1.08 OR {_BW} * {_BH} / (w * h) < 0.0032 OR {_BW} / w < 0.020 OR {_BH} / h < 0.060 OR (rt AND asp <= 0.35 AND {_BW} / w <= 0.095) AS odd FROM f),
        wh AS (SELECT clip_id, global_id FROM o WHERE global_id > 0 GROUP BY ALL HAVING count(*) >= 10 AND count(*) FILTER (odd) / count(*) >= 0.62 AND count(*) FILTER (rt) / count(*) >= 0.45 AND sqrt(stddev_pop(ux) ** 2 + stddev_pop(uy) ** 2) <= 0.060)
        SELECT row_idx, CASE WHEN o.global_id > 0 AND (odd OR wh.clip_id IS NOT NULL) THEN 0 ELSE o.global_id END AS global_id FROM o LEFT JOIN wh ON wh.clip_id = o.clip_id AND wh.global_id = o.global_id"""),
    "border_ghosts": with_cte(f"""m AS (SELECT row_idx, clip_id, global_id, frame_idx, {_BORDER('0.010')} AND ((x1 + x2) / 2 / w <= 0.030 OR (x1 + x2) / 2 / w >= 0.970 OR (y1 + y2) / 2 / h <= 0.020 OR (y1 + y2) / 2 / h >= 0.980) AND {_BW} * {_BH} / (w * h) <= 0.020::DOUBLE * 1.35::DOUBLE AND {_BW} / w <= 0.075 AND {_BW} / {_BH} <= 0.42 AS strip,
          {_BORDER('0.010')} AND {_BW} * {_BH} / (w * h) <= 0.020 AND ({_BW} / w <= 0.16 OR {_BH} / h <= 0.38) AS small FROM fr WHERE global_id > 0),
        c AS (SELECT *, CASE WHEN small = lag(small) OVER q AND frame_idx - lag(frame_idx) OVER q <= 2 THEN 0 ELSE 1 END AS cut FROM m WINDOW q AS (PARTITION BY clip_id, global_id ORDER BY frame_idx, row_idx)),
        r AS (SELECT *, sum(cut) OVER (PARTITION BY clip_id, global_id ORDER BY frame_idx, row_idx ROWS UNBOUNDED PRECEDING) AS run FROM c), n AS (SELECT *, count(*) OVER (PARTITION BY clip_id, global_id, run) AS len FROM r) SELECT row_idx FROM n WHERE strip OR (small AND len <= 10)"""),
    "edge_ghosts": with_cte(f"""b AS (SELECT clip_id, global_id, (x1 + x2) / 2 / w AS ux, (y1 + y2) / 2 / h AS uy, {_BW} / w AS uw, {_BH} / h AS uh, {_BORDER('0.012')} AS bo FROM fr WHERE global_id > 0)
        SELECT clip_id, global_id FROM b GROUP BY ALL HAVING count(*) >= 20 AND sqrt(stddev_pop(ux) ** 2 + stddev_pop(uy) ** 2) <= 0.010 AND count(*) FILTER (bo) / count(*) >= 0.85 AND (median(uw) <= 0.10 OR median(uh) <= 0.45)"""),
    "stationary_suppress": with_cte("""l AS (SELECT clip_id, global_id, count(*) AS n, list_sort(list((x1 + x2) / 2)) AS a, list_sort(list((y1 + y2) / 2)) AS b FROM fr WHERE global_id > 0 GROUP BY ALL HAVING count(*) >= 30),
        r AS (SELECT clip_id, global_id, n AS n_rows, round(a[least(n - 1, n * 95 // 100) + 1] - a[n * 5 // 100 + 1], 4) AS range_cx, round(b[least(n - 1, n * 95 // 100) + 1] - b[n * 5 // 100 + 1], 4) AS range_cy FROM l) SELECT *, range_cx < 60 AND range_cy < 60 AS is_still FROM r"""),
    "motion_of_ids": with_cte(_MOTION + "SELECT * FROM mo"),
    "static_drop": with_cte(_MOTION + "SELECT * FROM mo WHERE n_rows >= 20 AND way_norm <= 1.0 AND far_norm <= 0.20 AND spread_x <= 35 AND spread_y <= 35"),
    "compact_ids": with_cte(_EXT + ", f AS (SELECT clip_id, global_id, min(row_idx) AS fr1 FROM fr WHERE global_id > 0 GROUP BY ALL), k AS (SELECT ex.*, fr1, n_rows >= 25 OR span >= 26 AS keep FROM ex JOIN f ON f.clip_id = ex.clip_id AND f.global_id = ex.global_id) SELECT clip_id, global_id, CASE WHEN keep THEN row_number() OVER (PARTITION BY clip_id, keep ORDER BY fr1) ELSE 0 END AS new_id FROM k"),
    "canonicalize": with_cte(_EXT + ", s AS (SELECT *, n_rows >= 30 AND span >= 32 AS is_stable FROM ex) SELECT clip_id, global_id, is_stable, row_number() OVER (PARTITION BY clip_id ORDER BY is_stable DESC, first_frame, global_id) AS new_id FROM s"),
    "canonical_enforce": with_cte(_EXT + """, sl AS (SELECT DISTINCT clip_id, unnest([1, 2, 3, 4]) AS slot FROM fr), fe AS (SELECT clip_id, slot, row_number() OVER (PARTITION BY clip_id ORDER BY slot) AS k FROM sl WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.clip_id = sl.clip_id AND ex.global_id = sl.slot)),
        mv AS (SELECT clip_id, global_id, row_number() OVER (PARTITION BY clip_id ORDER BY n_rows DESC, span DESC, first_frame, global_id) AS k FROM ex WHERE global_id > 4 AND n_rows >= 30 AND span >= 32), md AS (SELECT mv.clip_id, mv.global_id, slot FROM mv JOIN fe ON fe.clip_id = mv.clip_id AND fe.k = mv.k)
        SELECT ex.clip_id, ex.global_id, CAST(coalesce(slot, CASE WHEN ex.global_id <= 4 THEN ex.global_id END, 0) AS BIGINT) AS new_id FROM ex LEFT JOIN md ON md.clip_id = ex.clip_id AND md.global_id = ex.global_id"""),
    "converge": with_cte(_EXT + "SELECT clip_id, count(*) AS n_before, count(*) FILTER (NOT (n_rows < 30 AND span < 32)) AS n_after, count(*) FILTER (n_rows < 30 AND span < 32) AS n_dropped, CAST(coalesce(sum(n_rows) FILTER (n_rows < 30 AND span < 32), 0) AS BIGINT) AS rows_dropped FROM ex GROUP BY clip_id"),
    "max_ids": with_cte(_EXT + "SELECT clip_id, global_id, CASE WHEN row_number() OVER (PARTITION BY clip_id ORDER BY n_rows DESC, global_id) <= 5 THEN global_id ELSE 0 END AS new_id FROM ex"),
    "gid_remap": with_cte(_EXT + """, f AS (SELECT clip_id, global_id, min(row_idx) AS fr1 FROM fr WHERE global_id > 0 GROUP BY ALL), k AS (SELECT ex.*, fr1, n_rows >= 25 OR span >= 26 AS keep FROM ex JOIN f ON f.clip_id = ex.clip_id AND f.global_id = ex.global_id), m AS (SELECT clip_id, global_id, CASE WHEN keep THEN row_number() OVER (PARTITION BY clip_id, keep ORDER BY fr1) ELSE 0 END AS new_id FROM k)
        SELECT row_idx, coalesce(new_id, fr.global_id) AS global_id FROM fr LEFT JOIN m ON m.clip_id = fr.clip_id AND m.global_id = fr.global_id"""),
    "tracklets": with_cte(_segs(10) + "SELECT * FROM sg"),
    "segments": with_cte(_segs(24) + "SELECT clip_id, global_id, count(*) AS n_segments, max(n_rows) AS longest FROM sg GROUP BY ALL"),
    "jump_split": with_cte(_EXT + f""", o AS (SELECT fr.clip_id, fr.global_id, frame_idx, row_idx, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, {_BH} AS hh FROM fr JOIN ex ON ex.clip_id = fr.clip_id AND ex.global_id = fr.global_id WHERE n_rows >= 36),
        c AS (SELECT *, CASE WHEN frame_idx - lag(frame_idx) OVER q <= 6 AND sqrt((cx - lag(cx) OVER q) ** 2 + (cy - lag(cy) OVER q) ** 2) / greatest(hh, lag(hh) OVER q) >= 0.6 THEN 1 WHEN lag(hh) OVER q IS NULL THEN 1 ELSE 0 END AS cut FROM o WINDOW q AS (PARTITION BY clip_id, global_id ORDER BY frame_idx, row_idx)),
        s AS (SELECT *, sum(cut) OVER (PARTITION BY clip_id, global_id ORDER BY frame_idx, row_idx ROWS UNBOUNDED PRECEDING) AS seg FROM c), z AS (SELECT clip_id, global_id, CAST(seg AS BIGINT) AS seg, count(*) AS n_rows FROM s GROUP BY ALL HAVING count(*) >= 18),
        k AS (SELECT *, row_number() OVER (PARTITION BY clip_id, global_id ORDER BY seg) AS k FROM z), t AS (SELECT clip_id, max(global_id) AS top FROM ex GROUP BY clip_id)
        SELECT clip_id, global_id, seg, n_rows, global_id AS new_id FROM k WHERE k = 1 UNION ALL SELECT k.clip_id, global_id, seg, n_rows, top + row_number() OVER (PARTITION BY k.clip_id ORDER BY global_id, seg) FROM k JOIN t ON t.clip_id = k.clip_id WHERE k > 1"""),
    "split_recycled": with_cte("s AS (SELECT clip_id, global_id, lag(frame_idx) OVER q AS p, frame_idx - lag(frame_idx) OVER q AS gap FROM fr WHERE global_id > 0 WINDOW q AS (PARTITION BY clip_id, global_id ORDER BY frame_idx, row_idx)), r AS (SELECT *, row_number() OVER (PARTITION BY clip_id, global_id ORDER BY gap DESC, p) AS r FROM s WHERE p IS NOT NULL) SELECT clip_id, global_id, gap, p AS after_frame FROM r WHERE r = 1"),
    "spatial_pred": with_cte(f"""o AS (SELECT row_idx, frame_idx AS f, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, {_BH} AS hh, lag((x1 + x2) / 2) OVER q AS ax, lag((y1 + y2) / 2) OVER q AS ay, lag(frame_idx) OVER q AS af, lag((x1 + x2) / 2, 2) OVER q AS bx, lag((y1 + y2) / 2, 2) OVER q AS by_, lag(frame_idx, 2) OVER q AS bf
          FROM fr WHERE global_id > 0 WINDOW q AS (PARTITION BY clip_id, global_id ORDER BY frame_idx, row_idx))
        SELECT row_idx, round(exp(-sqrt((cx - (ax + (ax - bx) / greatest(1, af - bf) * (f - af))) ** 2 + (cy - (ay + (ay - by_) / greatest(1, af - bf) * (f - af))) ** 2) / hh), 6) AS score FROM o WHERE bf IS NOT NULL"""),
    "sample_rows": with_cte("""r AS (SELECT clip_id, global_id, row_idx, row_number() OVER q - 1 AS i, count(*) OVER (PARTITION BY clip_id, global_id) AS n FROM fr WHERE global_id > 0 WINDOW q AS (PARTITION BY clip_id, global_id ORDER BY frame_idx, row_idx))
        SELECT clip_id, global_id, row_idx FROM r WHERE n <= 8 OR list_contains(list_transform(range(8), lambda j: (j * (n - 1)) // 7), i)"""),
}
