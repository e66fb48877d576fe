"""Queries that hold boxes against judged boxes.

The tables hold no judgements. Judged boxes are the boxes in entrance zones, moved by five and seven pixels; truth are all boxes with an
identity; predictions are the same boxes, moved the more the lower their confidence, under ids that change every 700 frames.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators import evaluate, hygiene, linking, matching, pairs
from trackloom.plans.base import framed_view, greedy_sql, union_sql, with_cte
from trackloom.plans.track_queries import _BH, _BW, _FITS
from trackloom.sources.tables import Tables


def _fr(spark, d):
    return framed_view(Tables(spark, d))


def _judged(fr):
    moved = {"x1": F.col("x1") + 5, "x2": F.col("x2") + 5, "y1": F.col("y1") + 7, "y2": F.col("y2") + 7}
    return fr.where("global_id > 0").withColumns(moved).select(F.col("row_idx").alias("ask_id"), "clip_id", "frame_idx", F.col("global_id").alias("person_id"), "x1", "y1", "x2", "y2")


def _truth(fr):
    return fr.where("global_id > 0").select(F.col("row_idx").alias("ask_id"), "clip_id", "frame_idx", F.col("global_id").alias("person_id"), "x1", "y1", "x2", "y2")


def _predicted(fr):
    dx = (1 - F.coalesce("conf", F.lit(0.5))) * (F.col("x2") - F.col("x1"))
    return fr.where("global_id > 0").select("row_idx", "clip_id", "frame_idx", (F.col("global_id") * 1000 + F.floor(F.col("frame_idx") / 700)).alias("global_id"), (F.col("x1") + dx).alias("x1"), "y1", (F.col("x2") + dx).alias("x2"), "y2")


def audit_best_match(spark, d):
    fr = _fr(spark, d)
    return pairs.best_match(_judged(fr), fr)


def audit_greedy_match(spark, d):
    fr = _fr(spark, d)
    return evaluate.frame_matches(_judged(fr), fr.where("global_id > 0"), 0.34, optimal=False).select("left", "right", F.round("score", 6).alias("iou"))


def mot_match(spark, d):
    fr = _fr(spark, d)
    # Boxes delivered twice can swap their partners, so frames are compared, not pairs.
    matches = evaluate.frame_matches(_truth(fr), _predicted(fr))
    return matches.groupBy("clip_id", "frame_idx").agg(F.count(F.lit(1)).alias("n_matched"), F.round(F.sum("score"), 6).alias("sum_iou"))


def mot_metrics(spark, d):
    fr = _fr(spark, d)
    return evaluate.mot_metrics(_truth(fr), _predicted(fr))


def mot_idf1(spark, d):
    fr = _fr(spark, d)
    return evaluate.idf1(_truth(fr), _predicted(fr))


def audit_purity(spark, d):
    fr = _fr(spark, d)
    return evaluate.purity(evaluate.judged_matches(_judged(fr), fr))


def ablation_score(spark, d):
    fr = _fr(spark, d)
    unique = fr.drop("global_id").join(hygiene.unique_per_frame(fr).select("row_idx", "global_id"), "row_idx")
    return evaluate.ablation({"as_is": fr, "unique": unique}, _judged(fr))


def purity_guard(spark, d):
    fr = _fr(spark, d)
    after = fr.drop("global_id").join(hygiene.unique_per_frame(fr).select("row_idx", "global_id"), "row_idx")
    return evaluate.guarded(fr, after, _judged(fr))


def audit_drop(spark, d):
    fr = _fr(spark, d)
    return evaluate.unsupported_ids(_judged(fr), fr)


def audit_lock(spark, d):
    fr = _fr(spark, d)
    return evaluate.dominant_persons(_judged(fr), fr, 8, 0.72)


def audit_template(spark, d):
    fr = _fr(spark, d)
    return evaluate.relabelled(_judged(fr), fr).select("row_idx", "global_id")


def audit_promote(spark, d):
    fr = _fr(spark, d)
    loose = fr.where("global_id <= 0").select(F.col("row_idx").alias("ask_id"), "clip_id", "frame_idx", (F.col("row_idx") % 5 + 1).alias("person_id"), *[(F.col(c) + 3).alias(c) for c in ("x1", "y1", "x2", "y2")])
    return evaluate.promoted(loose, fr)


def ignore_suppress(spark, d):
    fr = _fr(spark, d)
    return pairs.not_over_ignored(fr.where("global_id > 0"), fr.where("global_id <= 0")).select("row_idx")


def gt_validate(spark, d):
    fr = _fr(spark, d)
    return evaluate.validation(fr.withColumns({"person_id": F.col("global_id"), "ignore": F.lit(0), "visibility": F.col("conf")}))


def annotation_progress(spark, d):
    fr = _fr(spark, d)
    frames = fr.select("clip_id", "frame_idx").distinct()
    return evaluate.progress(frames, fr.where("zone_key IS NOT NULL").select("clip_id", "frame_idx").distinct())


def missing_frames(spark, d):
    fr = _fr(spark, d)
    return fr.select("clip_id", "frame_idx").distinct().subtract(fr.where("global_id > 0").select("clip_id", "frame_idx"))


def mot_export(spark, d):
    return evaluate.mot_lines(_fr(spark, d).withColumn("ignore", F.col("zone_key").isNull()))


def aba_smooth(spark, d):
    return evaluate.blips_smoothed(_fr(spark, d))


def fragment_merge(spark, d):
    fr = _fr(spark, d)
    ids = hygiene.id_extent(fr)
    small = (F.col("n_rows") < 30) | (F.col("span") < 32)
    tall = fr.where("global_id > 0").groupBy("clip_id", "global_id").agg(F.avg(F.col("y2") - F.col("y1")).alias("tall"))
    sized = ids.join(tall, ["clip_id", "global_id"])
    a = sized.where(small).select("clip_id", F.col("global_id").alias("a"), F.col("tall").alias("ta"))
    b = sized.where(~small).select("clip_id", F.col("global_id").alias("b"), F.col("tall").alias("tb"))
    apart = pairs.disjoint_pairs(fr).select("clip_id", F.explode(F.array(F.struct(F.col("gid_a").alias("a"), F.col("gid_b").alias("b")), F.struct(F.col("gid_b").alias("a"), F.col("gid_a").alias("b")))).alias("p")).select("clip_id", "p.a", "p.b")
    edges = a.join(b, "clip_id").join(apart, ["clip_id", "a", "b"], "left_semi").withColumn("score", F.round(F.least("ta", "tb") / F.greatest("ta", "tb", F.lit(1.0)), 6)).where("score >= 0.8")
    return matching.constrained_union(ids.select("clip_id", F.col("global_id").alias("node"), F.col("first_frame").alias("start_frame"), F.col("last_frame").alias("end_frame")), edges.select("clip_id", "a", "b", "score"))


def cross_cam_cascade(spark, d):
    return linking.cross_camera_cascade(Tables(spark, d).cross_camera_pair_scores)


QUERIES = {f.__name__: f for f in (
    audit_best_match, audit_greedy_match, mot_match, mot_metrics, mot_idf1, audit_purity, ablation_score, purity_guard, audit_drop, audit_lock, audit_template, audit_promote, ignore_suppress, gt_validate, annotation_progress,
    missing_frames, mot_export, aba_smooth, fragment_merge, cross_cam_cascade,
)}

_IOU = """(greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0))
  / (greatest(a.x2 - a.x1, 0) * greatest(a.y2 - a.y1, 0) + greatest(b.x2 - b.x1, 0) * greatest(b.y2 - b.y1, 0) - greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) + 1e-6)"""
_JUDGED = f"""jd AS (SELECT row_idx AS ask_id, clip_id, frame_idx, global_id AS person_id, x1 + 5 AS x1, y1 + 7 AS y1, x2 + 5 AS x2, y2 + 7 AS y2 FROM fr WHERE global_id > 0),
ed AS (SELECT ask_id, b.row_idx, b.global_id, {_IOU} AS v FROM jd a JOIN fr b ON a.clip_id = b.clip_id AND a.frame_idx = b.frame_idx WHERE b.global_id > 0),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ask_id ORDER BY v DESC, row_idx) AS r FROM ed WHERE v >= 0.34) WHERE r = 1),
jm AS (SELECT jd.ask_id, jd.clip_id, jd.person_id, bm.global_id FROM jd LEFT JOIN bm ON bm.ask_id = jd.ask_id),
ct AS (SELECT clip_id, person_id, global_id, count(*) AS n FROM jm WHERE global_id IS NOT NULL GROUP BY ALL)
"""
_DOMINANT = "dp AS (SELECT * FROM (SELECT clip_id, global_id, person_id, n, sum(n) OVER (PARTITION BY clip_id, global_id) AS t, row_number() OVER (PARTITION BY clip_id, global_id ORDER BY n DESC, person_id) AS r FROM ct) WHERE r = 1)"

_MOT = f"""tr AS (SELECT row_idx AS ask_id, clip_id, frame_idx, global_id AS person_id, x1, y1, x2, y2 FROM fr WHERE global_id > 0),
pr AS (SELECT row_idx, clip_id, frame_idx, CAST(global_id * 1000 + floor(frame_idx / 700) AS BIGINT) AS global_id, x1 + (1 - coalesce(conf, 0.5::DOUBLE)) * (x2 - x1) AS x1, y1, x2 + (1 - coalesce(conf, 0.5::DOUBLE)) * (x2 - x1) AS x2, y2 FROM fr WHERE global_id > 0),
me AS MATERIALIZED (SELECT a.clip_id, a.frame_idx, ask_id AS l, row_idx AS r, {_IOU.replace('1e-6', '1e-9')} AS s FROM tr a JOIN pr b ON a.clip_id = b.clip_id AND a.frame_idx = b.frame_idx WHERE {_IOU.replace('1e-6', '1e-9')} > 0),
ml AS MATERIALIZED (SELECT clip_id, frame_idx, l, row_number() OVER (PARTITION BY clip_id, frame_idx ORDER BY l) AS i FROM (SELECT DISTINCT clip_id, frame_idx, l FROM me)), mn AS MATERIALIZED (SELECT clip_id, frame_idx, max(i) AS n FROM ml GROUP BY ALL),
-- Every assignment of a frame's truth boxes, one box after the other; the best sum wins.
ms AS (SELECT clip_id, frame_idx, CAST(0 AS BIGINT) AS i, []::BIGINT[] AS used, []::STRUCT(l BIGINT, r BIGINT, s DOUBLE)[] AS pairs, 0::DOUBLE AS total FROM mn UNION ALL
  SELECT * FROM (SELECT ms.clip_id, ms.frame_idx, ms.i + 1, CASE WHEN o.r IS NULL THEN used ELSE list_append(used, o.r) END, CASE WHEN o.r IS NULL THEN pairs ELSE list_append(pairs, struct_pack(l := ml.l, r := o.r, s := o.s)) END, total + coalesce(o.s, 0)
    FROM ms JOIN ml ON ml.clip_id = ms.clip_id AND ml.frame_idx = ms.frame_idx AND ml.i = ms.i + 1 JOIN (SELECT clip_id, frame_idx, l, r, s FROM me UNION ALL SELECT clip_id, frame_idx, l, NULL, NULL FROM ml) o ON o.clip_id = ml.clip_id AND o.frame_idx = ml.frame_idx AND o.l = ml.l WHERE o.r IS NULL OR NOT list_contains(used, o.r))),
mb AS (SELECT * FROM (SELECT ms.*, row_number() OVER (PARTITION BY ms.clip_id, ms.frame_idx ORDER BY total DESC) AS k FROM ms JOIN mn ON mn.clip_id = ms.clip_id AND mn.frame_idx = ms.frame_idx AND mn.n = ms.i) WHERE k = 1),
mm AS (SELECT clip_id, frame_idx, p.l AS l, p.r AS r, p.s AS s FROM (SELECT clip_id, frame_idx, unnest(pairs) AS p FROM mb) WHERE p.s >= 0.5)
"""

SQL = {
    "mot_match": with_cte(_MOT + "SELECT clip_id, frame_idx, count(*) AS n_matched, round(sum(s), 6) AS sum_iou FROM mm GROUP BY ALL", recursive=True),
    "mot_metrics": with_cte(_MOT + """, na AS (SELECT mm.clip_id, mm.frame_idx, s, person_id, global_id, lag(global_id) OVER (PARTITION BY mm.clip_id, person_id ORDER BY mm.frame_idx, l) AS p FROM mm JOIN tr ON tr.ask_id = l JOIN pr ON pr.row_idx = r),
        sw AS (SELECT clip_id, count(*) AS n_matched, round(avg(s), 6) AS mean_iou, count(*) FILTER (p IS NOT NULL AND p <> global_id) AS n_switches FROM na GROUP BY clip_id), fo AS (SELECT clip_id, person_id, count(*) AS n FROM tr GROUP BY ALL), fm AS (SELECT clip_id, person_id, count(*) AS m FROM na GROUP BY ALL),
        tt AS (SELECT fo.clip_id, CAST(sum(n) AS BIGINT) AS n_truth, count(*) FILTER (coalesce(m, 0) / n >= 0.8) AS mostly_tracked, count(*) FILTER (coalesce(m, 0) / n <= 0.2) AS mostly_lost FROM fo LEFT JOIN fm ON fm.clip_id = fo.clip_id AND fm.person_id = fo.person_id GROUP BY fo.clip_id), pn AS (SELECT clip_id, count(*) AS n_predicted FROM pr GROUP BY clip_id),
        j AS (SELECT tt.*, coalesce(n_predicted, 0) AS n_predicted, coalesce(n_matched, 0) AS n_matched, mean_iou, coalesce(n_switches, 0) AS n_switches FROM tt LEFT JOIN pn ON pn.clip_id = tt.clip_id LEFT JOIN sw ON sw.clip_id = tt.clip_id)
        SELECT *, n_truth - n_matched AS misses, n_predicted - n_matched AS false_alarms, round(1 - (n_truth - n_matched + n_predicted - n_matched + n_switches) / n_truth, 6) AS mota, round(n_matched / n_predicted, 6) AS precision, round(n_matched / n_truth, 6) AS recall FROM j""", recursive=True),
    "audit_best_match": with_cte(_JUDGED + "SELECT ask_id, row_idx, global_id, round(v, 6) AS iou FROM bm"),
    "audit_purity": with_cte(_JUDGED + """, p AS (SELECT clip_id, round(avg(top), 6) AS person_purity, count(*) FILTER (k > 1) AS mixed_persons FROM (SELECT clip_id, person_id, max(n) / sum(n) AS top, count(*) AS k FROM ct GROUP BY ALL) GROUP BY clip_id),
        i AS (SELECT clip_id, round(avg(top), 6) AS id_purity, count(*) FILTER (k > 1) AS mixed_ids FROM (SELECT clip_id, global_id, max(n) / sum(n) AS top, count(*) AS k FROM ct GROUP BY ALL) GROUP BY clip_id),
        t AS (SELECT clip_id, count(*) AS n_judged, count(global_id) AS n_matched, round(count(global_id) / count(*), 6) AS coverage FROM jm GROUP BY clip_id) SELECT * FROM t LEFT JOIN p USING (clip_id) LEFT JOIN i USING (clip_id)"""),
    "audit_drop": with_cte(_JUDGED + ", ex AS (SELECT clip_id, global_id, count(*) AS n_rows, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame, max(frame_idx) - min(frame_idx) + 1 AS span FROM fr WHERE global_id > 0 GROUP BY ALL) SELECT * FROM ex WHERE clip_id IN (SELECT clip_id FROM jd) AND NOT EXISTS (SELECT 1 FROM ct WHERE ct.clip_id = ex.clip_id AND ct.global_id = ex.global_id)"),
    "audit_lock": with_cte(_JUDGED + f", {_DOMINANT} SELECT clip_id, global_id, person_id, n, round(n / t, 6) AS share FROM dp WHERE n >= 8 AND n >= 0.72::DOUBLE * t"),
    "audit_template": with_cte(_JUDGED + f""", {_DOMINANT}, g AS (SELECT fr.row_idx, fr.clip_id, frame_idx, greatest(x2 - x1, 0) * greatest(y2 - y1, 0) AS ar, CASE WHEN fr.clip_id IN (SELECT clip_id FROM jd) AND fr.global_id > 0 AND dp.clip_id IS NULL THEN 0 WHEN dp.n >= 6 AND dp.n >= 0.90::DOUBLE * dp.t THEN dp.person_id ELSE fr.global_id END AS gid
        FROM fr LEFT JOIN dp ON dp.clip_id = fr.clip_id AND dp.global_id = fr.global_id) SELECT row_idx, CASE WHEN gid > 0 AND row_number() OVER (PARTITION BY clip_id, frame_idx, gid ORDER BY ar DESC, row_idx) > 1 THEN 0 ELSE gid END AS global_id FROM g"""),
    "ignore_suppress": with_cte(f"SELECT row_idx FROM fr a WHERE global_id > 0 AND NOT EXISTS (SELECT 1 FROM fr b WHERE b.global_id <= 0 AND a.clip_id = b.clip_id AND a.frame_idx = b.frame_idx AND {_IOU.replace('1e-6', '1e-9')} >= 0.5)"),
    "gt_validate": with_cte("""v AS (SELECT *, count(*) OVER (PARTITION BY clip_id, frame_idx, global_id) AS k FROM fr) SELECT row_idx, unnest(list_filter([CASE WHEN x2 <= x1 OR y2 <= y1 THEN 'empty_box' END, CASE WHEN x1 < 0 OR y1 < 0 OR x2 > w OR y2 > h THEN 'outside_frame' END,
        CASE WHEN global_id IS NULL OR global_id <= 0 THEN 'bad_person' END, CASE WHEN conf IS NULL OR conf < 0 OR conf > 1 THEN 'bad_visibility' END, CASE WHEN global_id > 0 AND k > 1 THEN 'duplicate' END], lambda c: c IS NOT NULL)) AS code FROM v"""),
    "annotation_progress": with_cte("""f AS (SELECT clip_id, frame_idx, bool_or(zone_key IS NOT NULL) AS z FROM fr GROUP BY ALL), p AS (SELECT clip_id, CAST(floor(frame_idx / 300) AS BIGINT) AS window_id, count(*) AS n_frames, count(*) FILTER (z) AS n_annotated FROM f GROUP BY ALL)
        SELECT *, CASE WHEN n_annotated = n_frames THEN 'done' WHEN n_annotated > 0 THEN 'started' ELSE 'open' END AS status FROM p"""),
    "missing_frames": with_cte("SELECT clip_id, frame_idx FROM fr EXCEPT SELECT clip_id, frame_idx FROM fr WHERE global_id > 0"),
    "mot_export": with_cte("k AS (SELECT *, dense_rank() OVER (PARTITION BY clip_id ORDER BY frame_idx) AS k FROM fr) SELECT row_idx, clip_id, printf('%d,%d,%.3f,%.3f,%.3f,%.3f,%d,-1,-1,-1', k, global_id, x1, y1, x2 - x1, y2 - y1, CASE WHEN zone_key IS NULL THEN 0 ELSE 1 END) AS line FROM k"),
}


def _versions() -> str:
    """CTEs: un (fr after one box per identity and frame), and for s in 0 (fr), 1 (un): best matches, purity and duplicates."""
    score = f"0.58::DOUBLE * ({_BW} * {_BH}) + 0.20::DOUBLE * coalesce(n_rows, 0) + 0.14::DOUBLE * coalesce(span, 1) + 0.08::DOUBLE * {_FITS}"
    parts = [
        "jd AS (SELECT row_idx AS ask_id, clip_id, frame_idx, global_id AS person_id, x1 + 5 AS x1, y1 + 7 AS y1, x2 + 5 AS x2, y2 + 7 AS y2 FROM fr WHERE global_id > 0)",
        "ex AS (SELECT clip_id, global_id, count(*) AS n_rows, max(frame_idx) - min(frame_idx) + 1 AS span FROM fr WHERE global_id > 0 GROUP BY ALL)",
        f"sc AS (SELECT fr.*, {score} AS sc FROM fr LEFT JOIN ex ON ex.clip_id = fr.clip_id AND ex.global_id = fr.global_id)",
        "un AS (SELECT * REPLACE (CASE WHEN global_id > 0 AND row_number() OVER (PARTITION BY clip_id, frame_idx, global_id ORDER BY sc DESC, row_idx) > 1 THEN 0 ELSE global_id END AS global_id) FROM sc)",
    ]
    for k, t in enumerate(("fr", "un")):
        parts += [
            f"ed{k} AS (SELECT ask_id, b.row_idx, b.global_id, {_IOU} AS v FROM jd a JOIN {t} b ON a.clip_id = b.clip_id AND a.frame_idx = b.frame_idx WHERE b.global_id > 0)",
            f"bm{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ask_id ORDER BY v DESC, row_idx) AS r FROM ed{k} WHERE v >= 0.34) WHERE r = 1)",
            f"jm{k} AS (SELECT jd.ask_id, jd.clip_id, jd.person_id, b.global_id FROM jd LEFT JOIN bm{k} b ON b.ask_id = jd.ask_id)",
            f"ct{k} AS (SELECT clip_id, person_id, global_id, count(*) AS n FROM jm{k} WHERE global_id IS NOT NULL GROUP BY ALL)",
            f"pu{k} AS (SELECT clip_id, round(avg(top), 6) AS id_purity, count(*) FILTER (k > 1) AS mixed_ids FROM (SELECT clip_id, global_id, max(n) / sum(n) AS top, count(*) AS k FROM ct{k} GROUP BY ALL) GROUP BY clip_id)",
            f"dd{k} AS (SELECT clip_id, CAST(sum(n - 1) AS BIGINT) AS d FROM (SELECT clip_id, count(*) AS n FROM {t} WHERE global_id > 0 GROUP BY clip_id, frame_idx, global_id) GROUP BY clip_id)",
            f"xx{k} AS (SELECT clip_id, global_id, count(*) AS n, max(frame_idx) - min(frame_idx) + 1 AS span FROM {t} WHERE global_id > 0 GROUP BY ALL)",
        ]
    return ", ".join(parts)


def _guard_side(k: int, s: str) -> str:
    return f"g{k} AS (SELECT c.clip_id, coalesce(id_purity, 0) AS purity_{s}, coalesce(mixed_ids, 0) AS mixed_{s}, coalesce(d, 0) AS dups_{s} FROM (SELECT DISTINCT clip_id FROM jd) c LEFT JOIN pu{k} USING (clip_id) LEFT JOIN dd{k} USING (clip_id))"


def _ablation_row(k: int, name: str, t: str) -> str:
    return f"""SELECT '{name}' AS version, (SELECT count(*) FROM {t} WHERE global_id > 0) AS n_positive, (SELECT count(*) FROM xx{k}) AS n_ids, (SELECT count(*) FROM xx{k} WHERE n >= 30 AND span >= 32) AS n_stable, (SELECT CAST(coalesce(sum(d), 0) AS BIGINT) FROM dd{k}) AS n_duplicates,
      (SELECT count(global_id) FROM jm{k}) AS n_matched, (SELECT round(avg(id_purity), 6) FROM pu{k}) AS id_purity, (SELECT CAST(sum(mixed_ids) AS BIGINT) FROM pu{k}) AS mixed_ids"""


_FRAME_GROUP = ["clip_id", "frame_idx"]
_TRUTH = _MOT[: _MOT.index("ml AS MATERIALIZED")].rstrip().rstrip(",")
SQL |= {
    "purity_guard": with_cte(_versions() + f", {_guard_side(0, 'before')}, {_guard_side(1, 'after')} SELECT *, purity_after >= purity_before - 0.01::DOUBLE AND mixed_after <= mixed_before AND dups_after <= dups_before AS keep FROM g0 JOIN g1 USING (clip_id)"),
    "ablation_score": with_cte(_versions() + f", z AS ({_ablation_row(0, 'as_is', 'fr')} UNION ALL {_ablation_row(1, 'unique', 'un')}) SELECT * FROM z"),
    "audit_greedy_match": with_cte(_JUDGED + f", ge AS (SELECT clip_id, frame_idx, ask_id AS l, ed.row_idx AS r, {_IOU.replace('1e-6', '1e-9')} AS s FROM (SELECT ask_id, row_idx FROM ed) ed JOIN jd a USING (ask_id) JOIN (SELECT row_idx, x1, y1, x2, y2 FROM fr) b ON b.row_idx = ed.row_idx), gf AS (SELECT * FROM ge WHERE s >= 0.34), {greedy_sql('gf', _FRAME_GROUP, 'gm')} SELECT l AS \"left\", r AS \"right\", round(s, 6) AS iou FROM gm WHERE ok".replace('\\"', '"'), recursive=True),
    "mot_idf1": with_cte(_TRUTH + f""", sh AS (SELECT tr.clip_id, tr.person_id AS l, pr.global_id AS r, CAST(count(DISTINCT me.frame_idx) AS DOUBLE) AS s FROM me JOIN tr ON tr.ask_id = me.l JOIN pr ON pr.row_idx = me.r WHERE me.s >= 0.5 GROUP BY ALL), {greedy_sql('sh', ['clip_id'], 'gm')},
        tp AS (SELECT clip_id, sum(s) AS idtp FROM gm WHERE ok GROUP BY clip_id), tn AS (SELECT clip_id, count(*) AS n_truth FROM tr GROUP BY clip_id), pn AS (SELECT clip_id, count(*) AS n_predicted FROM pr GROUP BY clip_id), j AS (SELECT clip_id, n_truth, n_predicted, CAST(coalesce(idtp, 0) AS BIGINT) AS idtp FROM tn JOIN pn USING (clip_id) LEFT JOIN tp USING (clip_id))
        SELECT *, round(idtp / n_predicted, 6) AS id_precision, round(idtp / n_truth, 6) AS id_recall, round(2 * idtp / (n_truth + n_predicted), 6) AS id_f1 FROM j""", recursive=True),
    "audit_promote": with_cte(f"""lo AS (SELECT clip_id, frame_idx, row_idx % 5 + 1 AS person_id, x1 + 3 AS x1, y1 + 3 AS y1, x2 + 3 AS x2, y2 + 3 AS y2 FROM fr WHERE global_id <= 0),
        ge AS (SELECT a.clip_id, a.frame_idx, a.person_id AS l, b.row_idx AS r, max({_IOU}) AS s FROM lo a JOIN fr b ON a.clip_id = b.clip_id AND a.frame_idx = b.frame_idx WHERE b.global_id <= 0 AND {_IOU} >= 0.34 GROUP BY a.clip_id, a.frame_idx, a.person_id, b.row_idx),
        gf AS (SELECT * FROM ge WHERE NOT EXISTS (SELECT 1 FROM fr WHERE fr.clip_id = ge.clip_id AND fr.frame_idx = ge.frame_idx AND fr.global_id = ge.l)), {greedy_sql('gf', _FRAME_GROUP, 'gm')} SELECT r AS row_idx, l AS global_id FROM gm WHERE ok""", recursive=True),
    "aba_smooth": with_cte(f"""fs AS (SELECT clip_id, frame_idx, lag(frame_idx) OVER (PARTITION BY clip_id ORDER BY frame_idx) AS p FROM (SELECT DISTINCT clip_id, frame_idx FROM fr)),
        le AS (SELECT b.clip_id, b.frame_idx, a.row_idx AS l, b.row_idx AS r, {_IOU} AS v, sqrt(((a.x1 + a.x2 - b.x1 - b.x2) / 2) ** 2 + ((a.y1 + a.y2 - b.y1 - b.y2) / 2) ** 2) / greatest(a.y2 - a.y1, b.y2 - b.y1, 1) AS far FROM fs JOIN fr b ON b.clip_id = fs.clip_id AND b.frame_idx = fs.frame_idx JOIN fr a ON a.clip_id = fs.clip_id AND a.frame_idx = fs.p WHERE fs.frame_idx - p <= 6),
        lf AS (SELECT clip_id, frame_idx, l, r, 0.75::DOUBLE * v + 0.25::DOUBLE * exp(-far) AS s FROM le WHERE v > 0 AND 0.75::DOUBLE * v + 0.25::DOUBLE * exp(-far) >= 0.3), {greedy_sql('lf', _FRAME_GROUP, 'gm')}, lk AS (SELECT l, r FROM gm WHERE ok),
        bl AS (SELECT f.row_idx, f.clip_id, f.frame_idx, a.global_id AS g FROM lk x JOIN lk y ON y.l = x.r JOIN fr f ON f.row_idx = x.r JOIN fr a ON a.row_idx = x.l JOIN fr c ON c.row_idx = y.r WHERE a.global_id = c.global_id AND a.global_id > 0 AND a.global_id <> f.global_id),
        ok AS (SELECT *, row_number() OVER (PARTITION BY clip_id, frame_idx, g ORDER BY row_idx) AS k FROM bl WHERE NOT EXISTS (SELECT 1 FROM fr WHERE fr.clip_id = bl.clip_id AND fr.frame_idx = bl.frame_idx AND fr.global_id = bl.g)) SELECT row_idx, g AS global_id FROM ok WHERE k = 1""", recursive=True),
}
SQL["fragment_merge"] = with_cte(f"""ex AS (SELECT clip_id, global_id, count(*) AS n, min(frame_idx) AS f, max(frame_idx) AS l, avg(y2 - y1) AS ta FROM fr WHERE global_id > 0 GROUP BY ALL), nd AS (SELECT clip_id, global_id AS node, f AS start_frame, l AS end_frame FROM ex),
    sp AS (SELECT DISTINCT a.clip_id, a.global_id AS ga, b.global_id AS gb FROM fr a JOIN fr b ON a.clip_id = b.clip_id AND a.frame_idx = b.frame_idx AND a.global_id <> b.global_id WHERE a.global_id > 0 AND b.global_id > 0),
    e0 AS (SELECT a.clip_id, a.global_id AS a, b.global_id AS b, round(least(a.ta, b.ta) / greatest(a.ta, b.ta, 1), 6) AS score FROM ex a JOIN ex b ON a.clip_id = b.clip_id WHERE (a.n < 30 OR a.l - a.f + 1 < 32) AND NOT (b.n < 30 OR b.l - b.f + 1 < 32) AND NOT EXISTS (SELECT 1 FROM sp WHERE sp.clip_id = a.clip_id AND ga = a.global_id AND gb = b.global_id)),
    e1 AS (SELECT * FROM e0 WHERE score >= 0.8), {union_sql('nd', 'e1', 0, 'cu')} SELECT clip_id, node, root FROM cu_r""", recursive=True)
