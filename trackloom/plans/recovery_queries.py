"""Queries on unassigned boxes, on the quality of samples and frames, on zone types, and on fused vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import geometry as g
from trackloom.functions.vectors import fused
from trackloom.operators import kpi, pairs, recovery
from trackloom.plans.base import framed_view, visits_view, with_cte, zones_view
from trackloom.plans.track_queries import _BLURQ, _IOU, _PAIRS, _UNIT, _blur
from trackloom.plans.visit_queries import _SUMMARY
from trackloom.sources.tables import Tables


def zero_trace(spark, d):
    return recovery.zero_trace(framed_view(Tables(spark, d)))


def audit_recover(spark, d):
    # Judged boxes tell the true persons; a third of the rows and all rows of every seventh person have lost their identity.
    fr = framed_view(Tables(spark, d))
    moved = {"x1": F.col("x1") + 5, "x2": F.col("x2") + 5, "y1": F.col("y1") + 7, "y2": F.col("y2") + 7}
    judged = fr.where("global_id > 0").withColumns(moved).select(F.col("row_idx").alias("ask_id"), "clip_id", "frame_idx", F.col("global_id").alias("person_id"), "x1", "y1", "x2", "y2")
    lost = (F.col("row_idx") % 3 == 0) | (F.col("global_id") % 7 == 0)
    return recovery.recovered(judged, fr.withColumn("global_id", F.when(lost, F.lit(0)).otherwise(F.col("global_id")).cast("bigint")))


def prototype_quality(spark, d):
    fr = framed_view(Tables(spark, d))
    both = fr.join(pairs.largest_overlap(fr), "row_idx")
    crop = F.when(F.col("row_idx") % 5 > 0, F.pmod(F.col("row_idx") * 13, F.lit(100)) / 100.0)
    q = g.prototype_quality(g.box(), _blur(), F.col("conf"), crop, F.col("overlap"), F.pmod(F.col("row_idx"), F.lit(3)).cast("double"), F.col("w"), F.col("h"))
    return both.select("row_idx", F.round(q, 6).alias("quality"))


def render_quality(spark, d):
    """Measures of pictures are stood in for by whole numbers from frame numbers, as the tables hold none."""
    k = F.col("frame_idx")
    share = lambda by: F.pmod(k * by, F.lit(100)) / 100.0
    frames = framed_view(Tables(spark, d)).select("clip_id", "frame_idx").distinct()
    bad = g.render_flag(F.pmod(k * 31, F.lit(256)).cast("double"), F.pmod(k * 17, F.lit(90)).cast("double"), share(13) / 4, share(29), share(37), share(41), F.pmod(k * 43, F.lit(80)).cast("double"))
    return frames.select("clip_id", "frame_idx", bad.alias("is_bad"))


def zone_type(spark, d):
    zn = zones_view(Tables(spark, d))
    return zn.select("camera", "zone_key", kpi.zone_type(F.col("zone_key"), F.col("zone_type")).alias("kind")).distinct()


def zone_metrics(spark, d):
    # Figures that a report left out: planted by the number of visits.
    t = Tables(spark, d)
    z = kpi.zone_summary(visits_view(t), zones_view(t))
    without = lambda c, by: F.when(F.col("visits") % by > 0, F.col(c)).alias(c)
    return kpi.zone_metrics(z.select("camera", "zone_key", "visits", "dwell_ms", without("qualified_visits", 3), without("transit_visits", 2), without("qualification_rate", 5)))


def fused_features(spark, d):
    e = Tables(spark, d).embeddings
    n = F.size("embedding")
    half = F.floor(n / 2).cast("int")
    shape = F.array(F.lit(0.4), F.lit(0.3), (F.col("vec_id") % 10 + 1) / 10.0)
    whole = fused([F.slice("embedding", 1, half), F.slice("embedding", half + 1, n - half), shape], [0.7, 0.2, 0.1])
    return e.select("vec_id", F.posexplode(whole).alias("dim", "value")).select("vec_id", F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value"))


_RECOVER = f"""jd AS (SELECT row_idx AS ask_id, clip_id, frame_idx, global_id AS person_id, x1 + 5 AS x1, y1 + 7 AS y1, x2 + 5 AS x2, y2 + 7 AS y2 FROM fr WHERE global_id > 0),
f2 AS (SELECT row_idx, clip_id, frame_idx, x1, y1, x2, y2, CASE WHEN row_idx % 3 = 0 OR global_id % 7 = 0 THEN 0 ELSE coalesce(global_id, 0) END AS gid FROM fr),
ed AS (SELECT a.ask_id, a.person_id, a.clip_id, a.frame_idx, b.row_idx, b.gid, {_IOU} AS v FROM jd a JOIN f2 b ON a.clip_id = b.clip_id AND a.frame_idx = b.frame_idx),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ask_id, gid > 0 ORDER BY v DESC, row_idx) AS r FROM ed WHERE v >= 0.34) WHERE r = 1),
c0 AS (SELECT clip_id, person_id, gid, count(*) AS n FROM bm WHERE gid > 0 GROUP BY ALL),
ct AS (SELECT *, sum(n) OVER (PARTITION BY clip_id, person_id) AS t FROM c0),
kn AS (SELECT clip_id, person_id, gid AS target FROM (SELECT *, row_number() OVER (PARTITION BY clip_id, person_id ORDER BY n DESC, gid) AS r FROM ct) WHERE r = 1 AND t >= 5 AND n >= 0.6 * t),
zr AS (SELECT * FROM bm WHERE gid <= 0),
nw AS (SELECT clip_id, person_id, row_number() OVER (PARTITION BY clip_id ORDER BY person_id) AS k FROM (SELECT clip_id, person_id FROM zr WHERE NOT EXISTS (SELECT 1 FROM kn WHERE kn.clip_id = zr.clip_id AND kn.person_id = zr.person_id) GROUP BY ALL HAVING count(*) >= 3)),
us AS (SELECT clip_id, count(DISTINCT gid) AS c FROM f2 WHERE gid >= 20 GROUP BY clip_id),
mx AS (SELECT nw.clip_id, max(k) + coalesce(max(c), 0) + 20 AS m FROM nw LEFT JOIN us ON us.clip_id = nw.clip_id GROUP BY nw.clip_id),
fn AS (SELECT clip_id, i AS id, row_number() OVER (PARTITION BY clip_id ORDER BY i) AS k FROM (SELECT clip_id, unnest(range(20, m + 1)) AS i FROM mx) x WHERE NOT EXISTS (SELECT 1 FROM f2 WHERE f2.clip_id = x.clip_id AND gid = i)),
tg AS (SELECT clip_id, person_id, target, false AS is_fresh FROM kn UNION ALL SELECT nw.clip_id, person_id, id, true FROM nw JOIN fn ON fn.clip_id = nw.clip_id AND fn.k = nw.k),
op AS (SELECT zr.row_idx, zr.clip_id, zr.frame_idx, zr.ask_id, tg.* EXCLUDE (clip_id) FROM zr JOIN tg ON tg.clip_id = zr.clip_id AND tg.person_id = zr.person_id WHERE NOT EXISTS (SELECT 1 FROM f2 WHERE f2.clip_id = zr.clip_id AND f2.frame_idx = zr.frame_idx AND f2.gid = tg.target)),
o1 AS (SELECT *, row_number() OVER (PARTITION BY clip_id, frame_idx, target ORDER BY is_fresh, person_id, ask_id) AS r FROM op),
o2 AS (SELECT *, row_number() OVER (PARTITION BY row_idx ORDER BY is_fresh DESC, person_id DESC, ask_id DESC) AS s FROM o1 WHERE r = 1)
SELECT row_idx, CAST(target AS BIGINT) AS global_id, is_fresh FROM o2 WHERE s = 1"""

QUERIES = {q.__name__: q for q in (zero_trace, audit_recover, prototype_quality, render_quality, zone_type, zone_metrics, fused_features)}

SQL = {
    "zero_trace": with_cte(f"""e AS (SELECT a.row_idx, b.row_idx AS nr, b.global_id AS ng, CASE WHEN b.row_idx IS NOT NULL THEN {_IOU.replace('1e-6', '1e-9')} END AS v FROM fr a LEFT JOIN fr b ON a.clip_id = b.clip_id AND a.frame_idx = b.frame_idx AND b.global_id > 0 WHERE coalesce(a.global_id, 0) <= 0),
        r AS (SELECT row_idx, count(nr) AS n, arg_min(struct_pack(nr := nr, ng := ng, v := v), (-v, nr)) FILTER (v > 0) AS x FROM e GROUP BY row_idx)
        SELECT row_idx, x.nr AS near_row, coalesce(x.ng, 0) AS near_gid, round(coalesce(x.v, 0), 6) AS iou, CASE WHEN n = 0 THEN 'no_box' WHEN x IS NULL THEN 'apart' WHEN x.v >= 0.5 THEN 'covered' ELSE 'beside' END AS reason FROM r"""),
    "audit_recover": with_cte(_RECOVER),
    "prototype_quality": with_cte(_PAIRS + f""", c AS (SELECT fr.row_idx, greatest(1.0, w) AS w, greatest(1.0, h) AS h, {_BLURQ.replace('row_idx', 'fr.row_idx')} AS bl, conf, overlap, x1, y1, x2, y2, CASE WHEN fr.row_idx % 5 > 0 THEN (fr.row_idx * 13) % 100 / 100.0::DOUBLE END AS cq, fr.row_idx % 3 AS hid FROM fr JOIN ov ON ov.row_idx = fr.row_idx)
        SELECT row_idx, round({_UNIT(f'''0.30::DOUBLE * {_UNIT('(bl - 24.0) / 180.0')} + 0.23::DOUBLE * {_UNIT('(greatest(1.0, x2 - x1) * greatest(1.0, y2 - y1) / (w * h) - 0.0022::DOUBLE) / 0.016::DOUBLE')}
          + 0.16::DOUBLE * ({_UNIT('least(greatest(0, x1), greatest(0, y1), greatest(0, w - least(w, x2)), greatest(0, h - least(h, y2))) / (0.06::DOUBLE * least(w, h) + 1e-6)')} + CASE WHEN conf IS NULL THEN 0.58::DOUBLE ELSE {_UNIT('(conf - 0.24::DOUBLE) / 0.56::DOUBLE')} END)
          + 0.15::DOUBLE * coalesce(cq, 0.58::DOUBLE) - least(0.55::DOUBLE, 0.24::DOUBLE * greatest(0, overlap)) - least(0.45::DOUBLE, 0.28::DOUBLE * hid)''')}, 6) AS quality FROM c"""),
    "render_quality": with_cte("""f AS (SELECT DISTINCT clip_id, frame_idx, frame_idx AS k FROM fr), m AS (SELECT *, (k * 31) % 256 AS mg, (k * 17) % 90 AS sg, (k * 13) % 100 / 400.0 AS wr, (k * 29) % 100 / 100.0 AS br, (k * 37) % 100 / 100.0 AS tw, (k * 41) % 100 / 100.0 AS bw, (k * 43) % 80 AS lv FROM f)
        SELECT clip_id, frame_idx, wr >= 0.16 OR (mg >= 205 AND sg <= 45) OR mg >= 225 OR sg <= 8 OR (greatest(tw, bw) >= 0.55 AND least(tw, bw) >= 0.12) OR (br >= 0.62 AND lv <= 28) AS is_bad FROM m"""),
    "zone_type": with_cte("""t AS (SELECT *, trim(regexp_replace(lower(coalesce(zone_type, '')), '[^a-z0-9]+', '_', 'g'), '_') AS zt, CASE zone_key WHEN 'check_zone' THEN 'decision_zone' WHEN 'counter_zone' THEN 'cashier_zone' ELSE zone_key END AS z FROM zn)
        SELECT DISTINCT camera, zone_key, CASE WHEN zt NOT IN ('', 'other') THEN zt WHEN z LIKE '%entrance%' THEN 'entrance' WHEN z LIKE '%walkway%' OR z LIKE '%aisle%' THEN 'walkway' WHEN z LIKE '%hot%' THEN 'hot' WHEN z LIKE '%promo%' THEN 'promo' WHEN z LIKE '%browse%' THEN 'browsing'
          WHEN z LIKE '%cashier%' OR z LIKE '%checkout%' OR z LIKE '%counter%' THEN 'checkout' ELSE 'other' END AS kind FROM t"""),
    "zone_metrics": with_cte(_SUMMARY + """, m AS (SELECT camera, zone_key, visits, dwell_ms, CASE WHEN visits % 3 > 0 THEN qualified_visits ELSE visits END AS qualified, CASE WHEN visits % 2 > 0 THEN transit_visits END AS tr, CASE WHEN visits % 5 > 0 THEN qualification_rate END AS qr FROM zs)
        SELECT camera, zone_key, visits, qualified, CAST(coalesce(tr, greatest(0, visits - qualified)) AS BIGINT) AS transit, round(CASE WHEN qr IS NULL THEN coalesce(100.0::DOUBLE * qualified / nullif(visits, 0), 0) WHEN qr <= 1 THEN 100 * qr ELSE qr END, 4) AS rate, round(coalesce(dwell_ms / nullif(visits, 0), 0), 4) AS mean_dwell_ms FROM m"""),
    "fused_features": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT vec_id, v[1 : len(v) // 2] AS a, v[len(v) // 2 + 1 :] AS b, [0.4::DOUBLE, 0.3::DOUBLE, (vec_id % 10 + 1) / 10.0::DOUBLE] AS c FROM e),
        f AS (SELECT vec_id, list_concat(list_concat(list_transform(a, lambda x: 0.7::DOUBLE * x / sqrt(list_dot_product(a, a))), list_transform(b, lambda x: 0.2::DOUBLE * x / sqrt(list_dot_product(b, b)))), list_transform(c, lambda x: 0.1::DOUBLE * x / sqrt(list_dot_product(c, c)))) AS u FROM p),
        z AS (SELECT vec_id, unnest(u) / sqrt(list_dot_product(u, u)) AS value, generate_subscripts(u, 1) - 1 AS dim FROM f) SELECT vec_id, CAST(dim AS BIGINT) AS dim, round(value, 6) AS value FROM z""",
}
