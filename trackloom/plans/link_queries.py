"""Queries over stretches, decisions, pair scores and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import vectors as v
from trackloom.operators import embeddings, linking, matching, pairs, reference
from trackloom.plans.base import framed_view, greedy_sql, union_sql, with_cte
from trackloom.sources.tables import Tables


def reentry_candidates(spark, d):
    c = linking.reentry_candidates(Tables(spark, d).tracklets)
    return c.select("clip_id", "c_tracklet_id", "p_tracklet_id", "gap", F.round("prefilter", 6).alias("prefilter"))


def reentry_scores(spark, d):
    s = linking.reentry_scores(linking.reentry_candidates(Tables(spark, d).tracklets))
    return s.select("clip_id", "c_tracklet_id", "p_tracklet_id", "reason", F.round("score", 6).alias("score"))


def _ranked(spark, d):
    return linking.reranked(linking.reentry_scores(linking.reentry_candidates(Tables(spark, d).tracklets)))


def rerank(spark, d):
    return _ranked(spark, d).where("rank <= 2").select("clip_id", "c_tracklet_id", "p_tracklet_id", F.col("rank").cast("bigint").alias("rank"), F.round("final", 6).alias("final"), F.round("margin", 6).alias("margin"))


def reentry_decide(spark, d):
    return linking.decided(Tables(spark, d).tracklets, _ranked(spark, d))


def stitch_candidates(spark, d):
    return linking.stitch_edges(Tables(spark, d).tracklets).select("clip_id", "a", "b", "gap", F.round("score", 6).alias("score"))


def stitch(spark, d):
    t = Tables(spark, d).tracklets
    nodes = t.select("clip_id", F.col("tracklet_id").alias("node"), "start_frame", "end_frame")
    return matching.constrained_union(nodes, linking.stitch_edges(t).select("clip_id", "a", "b", F.round("score", 9).alias("score")), 3)


def group_merge(spark, d):
    t = Tables(spark, d).tracklets
    nodes = t.select("clip_id", F.col("tracklet_id").alias("node"), "start_frame", "end_frame")
    return matching.constrained_union(nodes, linking.merge_edges(t).select("clip_id", "a", "b", F.round("score", 9).alias("score")))


def local_consistency(spark, d):
    return linking.local_consistency(Tables(spark, d).tracklets)


def majority_vote(spark, d):
    return linking.majority(framed_view(Tables(spark, d)).where("global_id > 0"), ["clip_id", "global_id"], "zone_key", 3, 0.3)


def tracklets_in_windows(spark, d):
    t = Tables(spark, d)
    return linking.overlapping_windows(t.tracklets, pairs.crowd_windows(framed_view(t), 2, 0.05))


def top2_margin(spark, d):
    s = Tables(spark, d).cross_camera_pair_scores.where("score BETWEEN 0 AND 1 AND NOT isnan(score)").groupBy("cam1_gid", "cam2_gid").agg(F.max("score").alias("score"))
    return linking.first_and_second(s, "cam1_gid", "cam2_gid", "score")


def cross_cam_pairs(spark, d):
    return linking.cross_camera_primary(Tables(spark, d).cross_camera_pair_scores).select("cam1_gid", "cam2_gid", F.round("score", 6).alias("score"))


def cross_cam_assign(spark, d):
    sure = linking.cross_camera_primary(Tables(spark, d).cross_camera_pair_scores)
    return matching.greedy_match(sure, ["cam1_gid"], ["cam2_gid"], "score").select("cam1_gid", "cam2_gid", F.round("score", 6).alias("score"))


def pair_score(spark, d):
    s = Tables(spark, d).cross_camera_pair_scores
    again = 0.52 * F.col("sim_topk") + 0.32 * F.col("sim_mean") + 0.10 * F.greatest("sim_edge", F.lit(0.0)) + 0.06 * F.col("shape")
    return s.where("sim_topk IS NOT NULL AND sim_mean IS NOT NULL AND sim_edge IS NOT NULL AND shape IS NOT NULL").groupBy("cam1_gid").agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.max(again), 6).alias("best"), F.round(F.min(again), 6).alias("worst"))


def match_type_hist(spark, d):
    kind = F.when(F.col("score").isNull() | F.isnan("score") | ~F.col("score").between(0, 1), "invalid").when(F.col("score") >= 0.67, "primary").when(F.col("score") >= 0.63, "fallback").otherwise("none")
    return Tables(spark, d).cross_camera_pair_scores.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cam1_gid").alias("n_cam1"))


def reason_histogram(spark, d):
    reasons = Tables(spark, d).reentry_decisions.select("id", F.explode(F.split("decision_reason", r"\|")).alias("reason"))
    return reasons.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_decisions"))


def deployment_summary(spark, d):
    first = F.split_part("decision_reason", F.lit("|"), F.lit(1))
    taken, refused = first.startswith("reuse"), first.startswith("rejected") | first.startswith("new_id")
    return Tables(spark, d).reentry_decisions.groupBy("clip_id").agg(
        F.count(F.lit(1)).alias("n_decisions"), F.count_if(taken).alias("n_accepted"), F.count_if(refused).alias("n_rejected"), F.round(F.avg(F.when(F.col("best_score") >= 0, F.col("best_score"))), 6).alias("mean_score")
    )


def trace_join(spark, d):
    t = Tables(spark, d)
    last = t.reentry_decisions.groupBy("clip_id", "tracklet_id").agg(F.max_by(F.struct("assigned_final_gid", "best_prev_tracklet_id", "decision_reason"), "id").alias("x"))
    return t.tracklets.join(last, ["clip_id", "tracklet_id"], "left").select("clip_id", "tracklet_id", "final_gid", F.col("x.assigned_final_gid").alias("decided_gid"), F.col("x.best_prev_tracklet_id").alias("prev"), F.col("x.decision_reason").alias("reason"), (F.col("final_gid") == F.col("x.assigned_final_gid")).alias("agrees"))


def version_diff(spark, d):
    t = Tables(spark, d)
    last = t.reentry_decisions.groupBy("clip_id", "tracklet_id").agg(F.max_by("assigned_final_gid", "id").alias("new_gid"))
    both = t.tracklets.select("clip_id", "tracklet_id", F.col("source_gid").alias("old_gid")).join(last.withColumn("there", F.lit(True)), ["clip_id", "tracklet_id"], "left")
    kind = F.when(F.col("there").isNull(), "missing").when(F.col("old_gid") == F.col("new_gid"), "same").when((F.col("old_gid") > 0) & (F.coalesce("new_gid", F.lit(0)) <= 0), "zeroed").otherwise("changed")
    return both.groupBy("clip_id", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def topk_matches(spark, d):
    e = Tables(spark, d).embeddings
    return embeddings.nearest(e.where("vec_id % 50 = 0"), e, 5)


def centroids(spark, d):
    return embeddings.centroids(Tables(spark, d).embeddings).select("label", "n", F.posexplode("centroid").alias("dim", "value")).select("label", "n", F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value"))


def topk_set_similarity(spark, d):
    return embeddings.set_similarity(Tables(spark, d).embeddings, 6)


def anchor_votes(spark, d):
    e = Tables(spark, d).embeddings
    return embeddings.centroid_votes(e)


def anchor_mean(spark, d):
    sims = embeddings.centroid_similarity(Tables(spark, d).embeddings)
    return matching.greedy_match(sims.where("similarity >= 0.0").select(F.col("a").alias("l"), F.col("b").alias("r"), F.col("similarity")), ["l"], ["r"], "similarity").select("l", "r", "similarity")


def prototype_clean(spark, d):
    return embeddings.cleaned_prototypes(Tables(spark, d).embeddings)


def color_sim(spark, d):
    return embeddings.part_similarity(Tables(spark, d).embeddings)


def gallery_ema(spark, d):
    return embeddings.gallery(Tables(spark, d).embeddings).withColumn("similarity", F.round("similarity", 6))


def id_bank(spark, d):
    return embeddings.banked(Tables(spark, d).embeddings)


def drift_split(spark, d):
    return embeddings.drift_segments(Tables(spark, d).embeddings, 0.0, 8)


def sim_merge(spark, d):
    # A fragment is a label's vectors of one stretch of 250; fragments of one stretch overlap in time and stay apart.
    e = Tables(spark, d).embeddings.withColumn("label", F.col("label") * 1000 + F.floor(F.col("vec_id") / 250))
    sims = embeddings.centroid_similarity(e)
    nodes = e.groupBy("label").agg(F.min("vec_id").alias("start_frame"), F.max("vec_id").alias("end_frame")).select(F.lit("all").alias("clip_id"), F.col("label").cast("bigint").alias("node"), "start_frame", "end_frame")
    return matching.constrained_union(nodes, sims.where("similarity >= 0.3").select(F.lit("all").alias("clip_id"), F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"), F.col("similarity").alias("score")), 3)


def trust_decay(spark, d):
    t = Tables(spark, d).tracklets
    return t.select("clip_id", "tracklet_id", F.round(v.trust(F.col("end_frame") - F.col("start_frame")), 8).alias("trust"))


def ref_align(spark, d):
    t = Tables(spark, d).tracklets.where("start_frame IS NOT NULL AND end_frame IS NOT NULL")
    refs = t.where("final_gid > 0").groupBy("clip_id", F.col("final_gid").alias("ref")).agg(F.avg("median_h_ratio").alias("rh"), F.avg("median_aspect").alias("ra"))
    score = 0.65 * v.ratio(F.col("median_h_ratio"), F.col("rh")) + 0.35 * v.ratio(F.col("median_aspect"), F.col("ra"))
    scores = t.join(refs, "clip_id").select("clip_id", F.col("tracklet_id").alias("target"), "ref", F.round(score, 6).alias("score")).where("score >= 0.5")
    targets = t.select("clip_id", F.col("tracklet_id").alias("target"), F.col("source_gid").alias("source"), F.col("num_rows").alias("n_rows"), "start_frame", "end_frame")
    return reference.claimed(targets, scores)


def _anchors(spark, d):
    e = Tables(spark, d).embeddings
    return reference.anchor_evidence(e, e)


def anchor_evidence(spark, d):
    return _anchors(spark, d).select("target", "ref", "mean", "best", "vote", "n", F.col("rank").cast("bigint").alias("rank"), "margin")


def anchor_strong(spark, d):
    return reference.anchored(_anchors(spark, d), 0.05, 0.2, 0.15, 0.01)


def pair_separate(spark, d):
    return reference.separated(Tables(spark, d).embeddings, 0, 1)


def identity_layer(spark, d):
    e = Tables(spark, d).embeddings.where("embedding IS NOT NULL")
    rows = e.select(F.lit("all").alias("clip_id"), F.floor(F.col("vec_id") / 10).alias("frame_idx"), F.col("vec_id").alias("row_idx"), F.col("label").alias("local_id"), F.lit(0.8).alias("quality"), v.unit_vector(F.col("embedding")).alias("v"))
    return reference.identified(rows, reference.LayerRules(reuse=0.25))


QUERIES = {f.__name__: f for f in (
    ref_align, anchor_evidence, anchor_strong, pair_separate, identity_layer,
    reentry_candidates, reentry_scores, rerank, reentry_decide, stitch_candidates, stitch, group_merge, local_consistency, majority_vote, tracklets_in_windows, top2_margin, cross_cam_pairs, cross_cam_assign, pair_score, match_type_hist,
    reason_histogram, deployment_summary, trace_join, version_diff, topk_matches, centroids, topk_set_similarity, anchor_votes, anchor_mean, prototype_clean, color_sim, gallery_ema, id_bank, drift_split, sim_merge, trust_decay,
)}

_RATIO = lambda c: f"CASE WHEN p.{c} > 0 AND c.{c} > 0 THEN least(p.{c}, c.{c}) / greatest(p.{c}, c.{c}) ELSE 0 END"
_SIDE = "CASE WHEN p.exit_side = c.entry_side THEN 1.0 WHEN p.exit_side = 'center' OR c.entry_side = 'center' THEN 0.62 WHEN (p.exit_side, c.entry_side) IN (('left','right'),('right','left'),('top','bottom'),('bottom','top')) THEN 0.28 ELSE 0.40 END::DOUBLE"
_TURN = "CASE WHEN sqrt(p.motion_dx ** 2 + p.motion_dy ** 2) > 1 AND sqrt(c.motion_dx ** 2 + c.motion_dy ** 2) > 1 THEN 0.5::DOUBLE * ((p.motion_dx * c.motion_dx + p.motion_dy * c.motion_dy) / (sqrt(p.motion_dx ** 2 + p.motion_dy ** 2) * sqrt(c.motion_dx ** 2 + c.motion_dy ** 2)) + 1) ELSE 0.5 END"
_REENTRY = f"""WITH cp AS (SELECT p.clip_id, c.tracklet_id AS c_tracklet_id, p.tracklet_id AS p_tracklet_id, c.start_frame - p.end_frame AS gap, {_SIDE} AS side, sqrt(greatest(coalesce(p.quality, 0), 0) * greatest(coalesce(c.quality, 0), 0)) AS q,
  least(p.quality, c.quality) AS ql, {_RATIO('median_h_ratio')} AS hr, {_RATIO('median_aspect')} AS ar, {_TURN} AS turn FROM tracklets p JOIN tracklets c ON p.clip_id = c.clip_id AND c.start_frame - p.end_frame BETWEEN 4 AND 1600),
pf AS (SELECT *, 0.50::DOUBLE * side + 0.30::DOUBLE * exp(-gap / 1600) + 0.20::DOUBLE * q AS prefilter FROM cp),
rc AS (SELECT *, row_number() OVER (PARTITION BY clip_id, c_tracklet_id ORDER BY prefilter DESC, p_tracklet_id) AS r FROM pf WHERE prefilter >= 0.30),
sc AS (SELECT * EXCLUDE (r), CASE WHEN side < 0.22 THEN 'entry_exit_side_incompatible' WHEN hr < 0.32 THEN 'size_ratio_implausible' WHEN ar < 0.30 THEN 'aspect_ratio_implausible' WHEN ql < 0.10 THEN 'pair_low_quality' END AS reason,
  (0.10::DOUBLE * (0.6::DOUBLE * hr + 0.4::DOUBLE * ar) + 0.06::DOUBLE * exp(-gap / 1600) + 0.04::DOUBLE * side + 0.02::DOUBLE * turn) / 0.22::DOUBLE * (0.82::DOUBLE + 0.18::DOUBLE * q) AS score FROM rc WHERE r <= 72),
ra AS (SELECT *, row_number() OVER (PARTITION BY clip_id, c_tracklet_id ORDER BY score DESC, p_tracklet_id) AS r FROM sc WHERE reason IS NULL),
rb AS (SELECT *, CASE WHEN r <= 6 THEN score - CASE WHEN side < 0.62 THEN 0.04::DOUBLE ELSE 0 END ELSE score END AS final FROM ra),
rr AS (SELECT *, row_number() OVER w AS rank, final - coalesce(lead(final) OVER w, -1) AS margin FROM rb WINDOW w AS (PARTITION BY clip_id, c_tracklet_id ORDER BY final DESC, p_tracklet_id))
"""
_BEST = "b AS (SELECT cam1_gid, cam2_gid, max(score) AS score FROM cross_camera_pair_scores WHERE score BETWEEN 0 AND 1 AND NOT isnan(score) GROUP BY ALL)"
_VEC = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e)"
_CENT = _VEC + ", x AS (SELECT label, unnest(v) AS val, generate_subscripts(v, 1) AS i FROM u), c0 AS (SELECT label, i, avg(val) AS m FROM x GROUP BY ALL), c1 AS (SELECT label, list(m ORDER BY i) AS m FROM c0 GROUP BY label), cn AS (SELECT label, list_transform(m, lambda z: z / sqrt(list_dot_product(m, m))) AS c FROM c1)"

SQL = {
    "reentry_candidates": _REENTRY + "SELECT clip_id, c_tracklet_id, p_tracklet_id, gap, round(prefilter, 6) AS prefilter FROM rc WHERE r <= 72",
    "reentry_scores": _REENTRY + "SELECT clip_id, c_tracklet_id, p_tracklet_id, reason, round(score, 6) AS score FROM sc",
    "rerank": _REENTRY + "SELECT clip_id, c_tracklet_id, p_tracklet_id, rank, round(final, 6) AS final, round(margin, 6) AS margin FROM rr WHERE rank <= 2",
    "stitch_candidates": f"""WITH s AS (SELECT p.clip_id, p.tracklet_id AS a, c.tracklet_id AS b, c.start_frame - p.end_frame AS gap, 0.65::DOUBLE * {_RATIO('median_h_ratio')} + 0.35::DOUBLE * {_RATIO('median_aspect')} AS sh, p.exit_side = 'center' OR c.entry_side = 'center' AS ins, {_SIDE} AS side, {_TURN} AS turn
        FROM tracklets p JOIN tracklets c ON p.clip_id = c.clip_id AND c.start_frame - p.end_frame BETWEEN 1 AND 360), t AS (SELECT *, 0.7::DOUBLE * sh + 0.2::DOUBLE * side + 0.1::DOUBLE * turn - 0.07::DOUBLE * gap / 360 AS score FROM s)
        SELECT clip_id, a, b, gap, round(score, 6) AS score FROM t WHERE sh >= 0.58 AND (gap < 180 OR NOT ins) AND score >= 0.66""",
    "local_consistency": """WITH v AS (SELECT clip_id, local_track_id, final_gid, sum(num_rows) AS votes FROM tracklets WHERE local_track_id IS NOT NULL AND final_gid IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY clip_id, local_track_id ORDER BY votes DESC, final_gid) AS r, sum(votes) OVER (PARTITION BY clip_id, local_track_id) AS t FROM v)
        SELECT clip_id, local_track_id, final_gid AS identity, CAST(votes AS BIGINT) AS votes, round(votes / t, 6) AS share FROM r WHERE r = 1""",
    "majority_vote": with_cte("""v AS (SELECT clip_id, global_id, zone_key, count(*) AS n FROM fr WHERE global_id > 0 AND zone_key IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY clip_id, global_id ORDER BY n DESC, zone_key) AS r, sum(n) OVER (PARTITION BY clip_id, global_id) AS t FROM v)
        SELECT clip_id, global_id, zone_key, n, round(n / t, 6) AS share FROM r WHERE r = 1 AND n >= 3 AND n >= 0.3::DOUBLE * t"""),
    "top2_margin": f"WITH {_BEST}, r AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS second FROM b WINDOW w AS (PARTITION BY cam1_gid ORDER BY score DESC, cam2_gid)) SELECT cam1_gid, cam2_gid, round(score, 6) AS best, round(score - coalesce(second, -1), 6) AS margin FROM r WHERE r = 1",
    "cross_cam_pairs": """WITH o AS (SELECT *, row_number() OVER (PARTITION BY cam1_gid, cam2_gid ORDER BY score DESC, sim_topk DESC NULLS LAST, sim_mean DESC NULLS LAST) AS r FROM cross_camera_pair_scores WHERE score BETWEEN 0 AND 1 AND NOT isnan(score)), p AS (SELECT * EXCLUDE (r) FROM o WHERE r = 1),
        l AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS second FROM p WINDOW w AS (PARTITION BY cam1_gid ORDER BY score DESC, cam2_gid)) SELECT cam1_gid, cam2_gid, round(score, 6) AS score FROM l WHERE r = 1 AND score >= 0.67 AND sim_topk >= 0.62 AND sim_mean >= 0.60 AND (score >= 0.75 OR score - coalesce(second, -1) >= 0.02::DOUBLE)""",
    "cross_cam_assign": None,
    "gallery_ema": f"""WITH RECURSIVE {_VEC}, o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM u),
        g AS (SELECT label, vec_id, k, v AS c, NULL::DOUBLE AS s FROM o WHERE k = 1 UNION ALL
          SELECT label, vec_id, k, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))), s FROM (SELECT o.label, o.vec_id, o.k, list_dot_product(g.c, o.v) AS s, list_transform(range(1, 65), lambda i: 0.9::DOUBLE * g.c[i] + 0.1::DOUBLE * o.v[i]) AS m FROM g JOIN o ON o.label = g.label AND o.k = g.k + 1))
        SELECT CAST(label AS BIGINT) AS label, vec_id, k AS n, round(s, 6) AS similarity FROM g""",
    "drift_split": f"""WITH RECURSIVE {_VEC}, o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM u),
        g AS (SELECT label, vec_id, k, v AS c, CAST(1 AS BIGINT) AS n, CAST(1 AS BIGINT) AS segment FROM o WHERE k = 1 UNION ALL
          SELECT label, vec_id, k, CASE WHEN cut THEN v ELSE list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) END, CASE WHEN cut THEN 1 ELSE n + 1 END, CASE WHEN cut THEN segment + 1 ELSE segment END
          FROM (SELECT o.label, o.vec_id, o.k, o.v, g.n, g.segment, g.n >= 8 AND list_dot_product(g.c, o.v) < 0 AS cut, list_transform(range(1, 65), lambda i: 0.78::DOUBLE * g.c[i] + 0.22::DOUBLE * o.v[i]) AS m FROM g JOIN o ON o.label = g.label AND o.k = g.k + 1))
        SELECT CAST(label AS BIGINT) AS label, vec_id, segment FROM g""",
    "pair_score": """WITH s AS (SELECT cam1_gid, 0.52::DOUBLE * sim_topk + 0.32::DOUBLE * sim_mean + 0.10::DOUBLE * greatest(sim_edge, 0) + 0.06::DOUBLE * shape AS z FROM cross_camera_pair_scores WHERE sim_topk IS NOT NULL AND sim_mean IS NOT NULL AND sim_edge IS NOT NULL AND shape IS NOT NULL)
        SELECT cam1_gid, count(*) AS n_pairs, round(max(z), 6) AS best, round(min(z), 6) AS worst FROM s GROUP BY cam1_gid""",
    "match_type_hist": "SELECT CASE WHEN score IS NULL OR isnan(score) OR NOT score BETWEEN 0 AND 1 THEN 'invalid' WHEN score >= 0.67 THEN 'primary' WHEN score >= 0.63 THEN 'fallback' ELSE 'none' END AS kind, count(*) AS n, count(DISTINCT cam1_gid) AS n_cam1 FROM cross_camera_pair_scores GROUP BY 1",
    "reason_histogram": "WITH r AS (SELECT id, unnest(string_split(decision_reason, '|')) AS reason FROM reentry_decisions) SELECT reason, count(*) AS n, count(DISTINCT id) AS n_decisions FROM r GROUP BY reason",
    "deployment_summary": "WITH r AS (SELECT *, string_split(decision_reason, '|')[1] AS f FROM reentry_decisions) SELECT clip_id, count(*) AS n_decisions, count(*) FILTER (f LIKE 'reuse%') AS n_accepted, count(*) FILTER (f LIKE 'rejected%' OR f LIKE 'new_id%') AS n_rejected, round(avg(best_score) FILTER (best_score >= 0), 6) AS mean_score FROM r GROUP BY clip_id",
    "trace_join": """WITH x AS (SELECT clip_id, tracklet_id, arg_max(struct_pack(g := assigned_final_gid, p := best_prev_tracklet_id, r := decision_reason), id) AS x FROM reentry_decisions GROUP BY ALL)
        SELECT t.clip_id, t.tracklet_id, final_gid, x.g AS decided_gid, x.p AS prev, x.r AS reason, final_gid = x.g AS agrees FROM tracklets t LEFT JOIN x ON x.clip_id = t.clip_id AND x.tracklet_id = t.tracklet_id""",
    "version_diff": """WITH l AS (SELECT clip_id, tracklet_id, id, assigned_final_gid, row_number() OVER (PARTITION BY clip_id, tracklet_id ORDER BY id DESC) AS r FROM reentry_decisions), x AS (SELECT * FROM l WHERE r = 1)
        SELECT t.clip_id, CASE WHEN x.clip_id IS NULL THEN 'missing' WHEN source_gid = assigned_final_gid THEN 'same' WHEN source_gid > 0 AND coalesce(assigned_final_gid, 0) <= 0 THEN 'zeroed' ELSE 'changed' END AS kind, count(*) AS n FROM tracklets t LEFT JOIN x ON x.clip_id = t.clip_id AND x.tracklet_id = t.tracklet_id GROUP BY ALL""",
    "topk_matches": f"WITH {_VEC}, p AS (SELECT q.vec_id AS query_id, u.vec_id, round(list_dot_product(q.v, u.v), 6) AS similarity FROM u q JOIN u ON q.vec_id <> u.vec_id WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM p) SELECT * FROM r WHERE rank <= 5",
    "centroids": f"WITH {_CENT}, n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), z AS (SELECT label, unnest(c) AS value, generate_subscripts(c, 1) - 1 AS dim FROM cn) SELECT z.label, n, CAST(dim AS BIGINT) AS dim, round(value, 6) AS value FROM z JOIN n ON n.label = z.label",
    "topk_set_similarity": f"""WITH {_VEC}, p AS (SELECT a.label AS a, b.label AS b, a.vec_id AS va, list_dot_product(a.v, b.v) AS d FROM u a JOIN u b ON a.label < b.label),
        t AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY d DESC) AS r FROM p), m AS (SELECT a, b, va, max(d) AS d FROM p GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY d DESC) AS r FROM m),
        x AS (SELECT a, b, round(avg(d), 6) AS topk FROM t WHERE r <= 6 GROUP BY ALL), y AS (SELECT a, b, round(avg(d), 6) AS best_topk FROM o WHERE r <= 6 GROUP BY ALL) SELECT x.a, x.b, topk, best_topk FROM x JOIN y ON x.a = y.a AND x.b = y.b""",
    "anchor_votes": f"""WITH {_CENT}, s AS (SELECT vec_id, u.label, cn.label AS ref, list_dot_product(v, c) AS d FROM u CROSS JOIN cn), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d DESC, ref) AS r FROM s), v AS (SELECT label, ref, count(*) AS votes FROM r WHERE r = 1 GROUP BY ALL)
        SELECT label, ref, votes, round(votes / sum(votes) OVER (PARTITION BY label), 6) AS share FROM v""",
    "color_sim": f"""WITH {_CENT}, q AS (SELECT label, list_transform([0, 1, 2, 3], lambda i: c[CAST(floor(i * len(c) / 4) AS BIGINT) + 1 : CAST(floor((i + 1) * len(c) / 4) AS BIGINT)]) AS p FROM cn),
        h AS (SELECT a.label AS a, b.label AS b, list_transform([1, 2, 3, 4], lambda i: list_dot_product(a.p[i], b.p[i]) / nullif(sqrt(list_dot_product(a.p[i], a.p[i])) * sqrt(list_dot_product(b.p[i], b.p[i])), 0)) AS s FROM q a JOIN q b ON a.label < b.label),
        z AS (SELECT a, b, unnest(s) AS s, unnest([0.4::DOUBLE, 0.3::DOUBLE, 0.2::DOUBLE, 0.1::DOUBLE]) AS w FROM h)
        SELECT a, b, round(sum(w * s) / sum(w) - 0.2::DOUBLE * greatest(max(s) - min(s) - 0.5::DOUBLE, 0), 6) AS similarity, count(*) AS n_parts FROM z WHERE s IS NOT NULL GROUP BY a, b""",
    "prototype_clean": f"""WITH {_CENT}, d AS (SELECT vec_id, u.label, list_dot_product(v, c) AS coherence FROM u JOIN cn ON cn.label = u.label), m AS (SELECT label, median(coherence) AS med FROM d GROUP BY label)
        SELECT d.label, count(*) AS n, count(*) FILTER (coherence >= med - 0.05::DOUBLE) AS n_kept, round(avg(coherence) FILTER (coherence >= med - 0.05::DOUBLE), 6) AS coherence FROM d JOIN m ON m.label = d.label GROUP BY d.label""",
    "anchor_evidence": None,
    "anchor_strong": None,
    "pair_separate": f"""WITH {_VEC}, x AS (SELECT label, unnest(v) AS val, generate_subscripts(v, 1) AS i FROM u WHERE label IN (0, 1)), c0 AS (SELECT label, i, avg(val) AS m FROM x GROUP BY ALL), c1 AS (SELECT label, list(m ORDER BY i) AS m FROM c0 GROUP BY label), cn AS (SELECT label, list_transform(m, lambda z: z / sqrt(list_dot_product(m, m))) AS c FROM c1),
        s AS (SELECT vec_id, label, round(list_dot_product(v, (SELECT c FROM cn WHERE label = 0)) - list_dot_product(v, (SELECT c FROM cn WHERE label = 1)), 9) AS lead FROM u WHERE label IN (0, 1)) SELECT vec_id, label, CAST(CASE WHEN lead >= 0.08 THEN 0 WHEN lead <= -0.08 THEN 1 ELSE label END AS BIGINT) AS new_label FROM s""",
    "trust_decay": "SELECT clip_id, tracklet_id, round(greatest(0.02::DOUBLE, 0.06::DOUBLE * exp(-0.004::DOUBLE * (end_frame - start_frame) - 0.002::DOUBLE * greatest(end_frame - start_frame - 240, 0))), 8) AS trust FROM tracklets",
    "tracklets_in_windows": None,
}


def _windows_sql() -> str:
    from trackloom.plans import track_queries

    crowd = track_queries.SQL["crowd_windows"]
    return f"WITH cw AS ({crowd}) SELECT DISTINCT t.clip_id, t.tracklet_id FROM tracklets t JOIN cw ON cw.clip_id = t.clip_id AND t.start_frame <= cw.end_frame AND t.end_frame >= cw.start_frame AND t.end_frame >= t.start_frame"


SQL["tracklets_in_windows"] = _windows_sql()
SQL["anchor_mean"] = f"""WITH RECURSIVE {_CENT}, e0 AS (SELECT 'x' AS g, a.label AS l, b.label AS r, round(list_dot_product(a.c, b.c), 6) AS s FROM cn a JOIN cn b ON a.label < b.label), e1 AS (SELECT * FROM e0 WHERE s >= 0),
{greedy_sql('e1', ['g'], 'gm')} SELECT CAST(l AS INTEGER) AS l, CAST(r AS INTEGER) AS r, s AS similarity FROM gm WHERE ok"""
_EVIDENCE = f"""WITH {_CENT}, n0 AS (SELECT vec_id, u.label AS target, cn.label AS ref, round(list_dot_product(v, c), 9) AS d FROM u CROSS JOIN cn), v0 AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d DESC, ref) AS k FROM n0),
s0 AS (SELECT target, ref, round(avg(d), 6) AS mean, round(max(d), 6) AS best, round(count(*) FILTER (k = 1) / count(*), 6) AS vote, count(*) AS n FROM v0 GROUP BY ALL),
ev AS (SELECT *, row_number() OVER w AS rank, round(mean - coalesce(lead(mean) OVER w, -1), 6) AS margin FROM s0 WINDOW w AS (PARTITION BY target ORDER BY mean DESC, ref))"""
SQL["anchor_evidence"] = _EVIDENCE + " SELECT * FROM ev"
SQL["anchor_strong"] = _EVIDENCE + """, t AS (SELECT *, CASE WHEN n < 5 THEN 'low_prototype_quality' WHEN mean < 0.05 THEN 'below_min_mean' WHEN best < 0.2 THEN 'below_min_best' WHEN vote < 0.15 THEN 'votes_disagree' WHEN margin < 0.01 THEN 'below_min_margin' ELSE 'accepted' END AS reason FROM ev WHERE rank = 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY ref, reason = 'accepted' ORDER BY mean DESC, target) AS k FROM t) SELECT target, ref, mean, CASE WHEN reason = 'accepted' AND k > 1 THEN 'reserved' ELSE reason END AS reason FROM r"""
# A sure pair is its cam1_gid's only one, so the greedy matching is each cam2_gid's best.
SQL["cross_cam_assign"] = f"SELECT cam1_gid, cam2_gid, score FROM (SELECT *, row_number() OVER (PARTITION BY cam2_gid ORDER BY score DESC, cam1_gid) AS k FROM ({SQL['cross_cam_pairs']})) WHERE k = 1"
_NODES = "nd AS (SELECT clip_id, tracklet_id AS node, start_frame, end_frame FROM tracklets)"
SQL["stitch"] = "WITH RECURSIVE" + SQL["stitch_candidates"].strip().removeprefix("WITH").rsplit("SELECT clip_id, a, b, gap", 1)[0].rstrip() + f""",
se AS (SELECT clip_id, a, b, round(score, 9) AS score FROM t WHERE sh >= 0.58 AND (gap < 180 OR NOT ins) AND score >= 0.66), {_NODES}, {union_sql('nd', 'se', 3, 'cu')} SELECT clip_id, node, root FROM cu_r"""
_MERGE = "(0.10::DOUBLE * (0.6::DOUBLE * hr + 0.4::DOUBLE * ar) + 0.06::DOUBLE * exp(-gap / 1600) + 0.04::DOUBLE * side + 0.02::DOUBLE * turn) / 0.22::DOUBLE * (0.82::DOUBLE + 0.18::DOUBLE * q)"
SQL["group_merge"] = _REENTRY.split("),\npf AS", 1)[0].replace("WITH cp", "WITH RECURSIVE cp", 1).replace("BETWEEN 4 AND 1600", "BETWEEN 0 AND 2200 AND p.tracklet_id <> c.tracklet_id") + f"""),
se AS (SELECT clip_id, p_tracklet_id AS a, c_tracklet_id AS b, round(score, 9) AS score FROM (SELECT *, {_MERGE} AS score FROM cp) WHERE score >= 0.78), {_NODES}, {union_sql('nd', 'se', 0, 'cu')} SELECT clip_id, node, root FROM cu_r"""
# A fragment is a label's vectors of one stretch of 250; fragments of one stretch overlap in time and stay apart.
_FRAGMENTS = _CENT.replace("SELECT vec_id, label, CAST(embedding", "SELECT vec_id, label * 1000 + vec_id // 250 AS label, CAST(embedding", 1)
SQL["sim_merge"] = f"""WITH RECURSIVE {_FRAGMENTS}, nd AS (SELECT 'all' AS clip_id, label AS node, min(vec_id) AS start_frame, max(vec_id) AS end_frame FROM u GROUP BY label),
e0 AS (SELECT 'all' AS clip_id, a.label AS a, b.label AS b, round(list_dot_product(a.c, b.c), 6) AS score FROM cn a JOIN cn b ON a.label < b.label), e1 AS (SELECT * FROM e0 WHERE score >= 0.3), {union_sql('nd', 'e1', 3, 'cu')} SELECT clip_id, node, root FROM cu_r"""
_GID = lambda x: f"list_filter(ids, lambda z: z.t = {x})[1].g"
SQL["reentry_decide"] = _REENTRY.replace("WITH cp", "WITH RECURSIVE cp", 1).rstrip() + f""",
op AS (SELECT clip_id, c_tracklet_id, max(final) FILTER (rank = 1) AS f1, max(p_tracklet_id) FILTER (rank = 1) AS p1, max(final) FILTER (rank = 2) AS f2, max(p_tracklet_id) FILTER (rank = 2) AS p2 FROM rr WHERE rank <= 2 GROUP BY ALL),
tl AS MATERIALIZED (SELECT t.clip_id, t.tracklet_id AS tid, t.start_frame AS s, t.end_frame AS e, f1, p1, f2, p2, row_number() OVER (PARTITION BY t.clip_id ORDER BY t.start_frame, t.tracklet_id) AS k FROM tracklets t LEFT JOIN op ON op.clip_id = t.clip_id AND op.c_tracklet_id = t.tracklet_id),
tg AS (SELECT clip_id, max(source_gid) + 1 AS fresh FROM tracklets GROUP BY clip_id),
dc AS (SELECT clip_id, CAST(0 AS BIGINT) AS k, NULL::BIGINT AS tid, NULL::BIGINT AS gid, NULL::VARCHAR AS reason, []::STRUCT(t BIGINT, g BIGINT)[] AS ids, []::STRUCT(g BIGINT, u BIGINT)[] AS busy, fresh FROM tg UNION ALL
  SELECT clip_id, k, tid, CASE WHEN ok THEN known ELSE fresh END, reason, list_append(ids, struct_pack(t := tid, g := CASE WHEN ok THEN known ELSE fresh END)), list_append(busy, struct_pack(g := CASE WHEN ok THEN known ELSE fresh END, u := e)), CASE WHEN ok THEN fresh ELSE fresh + 1 END
  FROM (SELECT *, reason IN ('strong_reentry_reuse', 'same_candidate_safe_accept') AS ok FROM (SELECT *, CASE WHEN f1 IS NULL OR known IS NULL THEN 'new_id_no_candidate' WHEN f1 < 0.70 THEN 'rejected_weak_score' WHEN lead < 0.03 AND NOT agree THEN 'rejected_ambiguous_margin'
      WHEN coalesce(list_max(list_transform(list_filter(busy, lambda z: z.g = known), lambda z: z.u)), -1) >= s THEN 'rejected_overlap_conflict' WHEN lead >= 0.03 THEN 'strong_reentry_reuse' ELSE 'same_candidate_safe_accept' END AS reason
    FROM (SELECT dc.clip_id, tl.k, tl.tid, tl.s, tl.e, f1, f1 - coalesce(f2, -1) AS lead, {_GID('tl.p1')} AS known, f2 IS NOT NULL AND coalesce({_GID('tl.p2')} = {_GID('tl.p1')}, false) AS agree, ids, busy, fresh FROM dc JOIN tl ON tl.clip_id = dc.clip_id AND tl.k = dc.k + 1))))
SELECT clip_id, tid AS tracklet_id, gid AS identity, reason FROM dc WHERE k > 0"""
