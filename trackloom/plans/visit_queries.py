"""Queries over visits: from boxes to visits, and what is counted of visits."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators import kpi, visits
from trackloom.plans.base import cameras_view, tracks_view, visits_view, with_cte, zones_view
from trackloom.sources.tables import Tables


def sessionize(spark, d):
    return visits.zone_sessions(tracks_view(Tables(spark, d)), 1000)


def visits_capped(spark, d):
    return visits.capped_visits(tracks_view(Tables(spark, d)))


def visits_runs(spark, d):
    return visits.change_visits(tracks_view(Tables(spark, d)).where("global_id > 0"))


def visits_hysteresis(spark, d):
    return visits.held_visits(tracks_view(Tables(spark, d)).where("global_id > 0"))


def zone_engine_visits(spark, d):
    return visits.online_visits(tracks_view(Tables(spark, d)).where("global_id > 0"))


def zone_summary_sql(spark, d):
    return kpi.zone_totals(visits_view(Tables(spark, d)))


def export_zone_summary(spark, d):
    return kpi.zone_export(visits_view(Tables(spark, d)))


def zone_summary(spark, d):
    t = Tables(spark, d)
    return kpi.zone_summary(visits_view(t), zones_view(t))


def zone_kind(spark, d):
    t = Tables(spark, d)
    keys = visits_view(t).select("zone_key").unionByName(zones_view(t).select("zone_key")).where("zone_key IS NOT NULL").distinct()
    z = kpi.zone_alias(F.col("zone_key"))
    return keys.select("zone_key", z.alias("alias"), kpi.zone_kind(z).alias("kind"), kpi.engagement_threshold(z).alias("threshold_s"))


def n_persons(spark, d):
    return tracks_view(Tables(spark, d)).groupBy("camera").agg(F.countDistinct("global_id").alias("n_persons"))


def bounce_progression(spark, d):
    return kpi.bounce_by_progression(visits_view(Tables(spark, d)))


def bounce_qualified(spark, d):
    t = Tables(spark, d)
    return kpi.bounce_by_qualified(kpi.zone_summary(visits_view(t), zones_view(t)))


def kpi_bounce_best(spark, d):
    return kpi.bounce_by_best(visits_view(Tables(spark, d)))


def kpi_bounce_total(spark, d):
    t = Tables(spark, d)
    return kpi.bounce_by_total(visits_view(t), tracks_view(t))


def camera_cards(spark, d):
    t = Tables(spark, d)
    return kpi.camera_cards(kpi.zone_summary(visits_view(t), zones_view(t)))


def person_summary(spark, d):
    t = Tables(spark, d)
    return kpi.person_summary(visits_view(t), tracks_view(t))


def person_fallback(spark, d):
    t = Tables(spark, d)
    return kpi.person_fallback(visits_view(t), tracks_view(t))


def export_person_summary(spark, d):
    return kpi.person_export(visits_view(Tables(spark, d)))


def freshness(spark, d):
    t = Tables(spark, d)
    return kpi.freshness(tracks_view(t), visits_view(t), zones_view(t), cameras_view(t))


def ab_zone_delta(spark, d):
    t = Tables(spark, d)
    v = visits_view(t)
    return kpi.zone_delta(v.where("camera = 'cam_01'"), v.where("camera = 'cam_02'"))


def insights(spark, d):
    t = Tables(spark, d)
    return kpi.insights(kpi.zone_summary(visits_view(t), zones_view(t)))


def scope_filter(spark, d):
    return visits_view(Tables(spark, d)).where(kpi.in_scope("cam_01", group="FULL_shop")).groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"))


def events_overlap(spark, d):
    return visits_view(Tables(spark, d)).where(kpi.overlaps(60_000, 120_000)).select("id", "enter_ms", "exit_ms")


def fetch_events(spark, d):
    return visits_view(Tables(spark, d)).where("camera = 'cam_02' AND enter_ms >= 60000 AND exit_ms <= 120000").select("id", "clip_id", "global_id", "enter_ms", "exit_ms")


def fetch_tracks(spark, d):
    return tracks_view(Tables(spark, d)).where("camera = 'cam_01' AND clip_id = 'full_shop04' AND ms BETWEEN 60000 AND 120000").select("row_idx", "frame_idx", "global_id", "ms", "zone_key")


def all_cameras(spark, d):
    t = Tables(spark, d)
    return tracks_view(t).select("camera").union(visits_view(t).select("camera")).distinct()


def union_cameras(spark, d):
    t = Tables(spark, d)
    known = visits_view(t).join(cameras_view(t).select("camera"), "camera", "left_semi")
    return known.select(F.col("camera").alias("source"), "id", "global_id")


def meta_groups(spark, d):
    return kpi.clip_groups(tracks_view(Tables(spark, d)))


def rollup_visits(spark, d):
    return visits_view(Tables(spark, d)).rollup("camera", "clip_id", "zone_key").agg(F.count(F.lit(1)).alias("visits"), F.sum("dwell_ms").alias("dwell_ms"), F.grouping_id().alias("level"))


def engagement_sales_gap(spark, d):
    t = Tables(spark, d)
    return kpi.share_gap(
        t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_type").alias("item")).agg(F.sum("l_quantity").alias("a"), F.count(F.lit(1)).cast("double").alias("b"))
    )


QUERIES = {f.__name__: f for f in (
    sessionize, visits_capped, visits_runs, visits_hysteresis, zone_engine_visits, zone_summary_sql, export_zone_summary, zone_summary, zone_kind, n_persons, bounce_progression, bounce_qualified,
    kpi_bounce_best, kpi_bounce_total, camera_cards, person_summary, person_fallback, export_person_summary, freshness, ab_zone_delta, insights, scope_filter, events_overlap, fetch_events, fetch_tracks,
    all_cameras, union_cameras, meta_groups, rollup_visits, engagement_sales_gap,
)}

_PARTS = """
a AS (SELECT *, CASE WHEN ms - lag(ms) OVER w > 1000 THEN 1 ELSE 0 END AS cut FROM tk WHERE zone_key IS NOT NULL AND ms IS NOT NULL WINDOW w AS (PARTITION BY clip_id, global_id, zone_key ORDER BY ms, row_idx)),
b AS (SELECT *, 1 + sum(cut) OVER (PARTITION BY clip_id, global_id, zone_key ORDER BY ms, row_idx ROWS UNBOUNDED PRECEDING) AS visit FROM a),
c0 AS (SELECT *, ms - lag(ms) OVER (PARTITION BY clip_id, global_id, zone_key, visit ORDER BY ms, row_idx) AS gap FROM b),
c AS (SELECT *, CASE WHEN gap > 200 THEN 200 ELSE gap END AS pause FROM c0)
"""
_RUNS = """
a AS (SELECT *, CASE WHEN zone_key IS NOT DISTINCT FROM lag(zone_key) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS cut FROM tk WHERE ms IS NOT NULL AND global_id > 0 WINDOW w AS (PARTITION BY clip_id, global_id ORDER BY ms, row_idx)),
b AS (SELECT *, sum(cut) OVER (PARTITION BY clip_id, global_id ORDER BY ms, row_idx ROWS UNBOUNDED PRECEDING) AS run FROM a),
r AS (SELECT clip_id, global_id, run, zone_key, min(ms) AS first_ms, max(ms) AS last_ms FROM b GROUP BY ALL),
s AS (SELECT *, coalesce(lead(first_ms) OVER (PARTITION BY clip_id, global_id ORDER BY run), last_ms) AS exit_ms FROM r)
"""
_ALIAS = "CASE zone_key WHEN 'check_zone' THEN 'decision_zone' WHEN 'counter_zone' THEN 'cashier_zone' ELSE zone_key END"
_THRESHOLD = """CASE z WHEN 'entrance_zone' THEN 2.0 WHEN 'walkway_zone' THEN 1.5 WHEN 'decision_zone' THEN 999.0 WHEN 'hot_zone' THEN 3.0 WHEN 'promo_zone' THEN 3.0 WHEN 'browsing_zone' THEN 2.0 WHEN 'cashier_zone' THEN 2.0
  ELSE CASE WHEN z LIKE '%walkway%' OR z LIKE '%decision%' THEN 999.0 WHEN z LIKE '%entrance%' THEN 2.0 WHEN z LIKE '%hot%' OR z LIKE '%promo%' THEN 3.0 WHEN z LIKE '%browse%' THEN 2.0 WHEN z LIKE '%cashier%' OR z LIKE '%checkout%' THEN 2.0 ELSE 2.5 END END"""
_KIND = """CASE WHEN z LIKE '%walkway%' OR z LIKE '%decision%' THEN 'flow' WHEN z LIKE '%entrance%' THEN 'entrance' WHEN z LIKE '%hot%' OR z LIKE '%promo%' OR z LIKE '%browse%' THEN 'engagement' WHEN z LIKE '%cashier%' OR z LIKE '%checkout%' THEN 'checkout' ELSE 'other' END"""
_SUMMARY = f"""
ev AS (SELECT camera, {_ALIAS} AS z, coalesce(dwell_ms, 0) AS dwell FROM vv WHERE zone_key IS NOT NULL),
de AS (SELECT DISTINCT camera, {_ALIAS} AS z FROM zn WHERE camera IS NOT NULL),
q AS (SELECT camera, z, count(*) AS visits, sum(dwell) AS dwell_ms, count(*) FILTER (dwell >= 1000 * ({_THRESHOLD})) AS qualified_visits, sum(dwell) FILTER (dwell >= 1000 * ({_THRESHOLD})) AS qualified_dwell_ms FROM ev GROUP BY ALL),
defined AS (SELECT DISTINCT camera FROM de),
keys AS (SELECT camera, z FROM de UNION SELECT camera, z FROM q WHERE camera NOT IN (SELECT camera FROM defined)),
zs AS (SELECT k.camera, k.z AS zone_key, {_KIND.replace('z LIKE', 'k.z LIKE')} AS zone_kind, coalesce(visits, 0) AS visits, CAST(coalesce(dwell_ms, 0) AS BIGINT) AS dwell_ms, coalesce(qualified_visits, 0) AS qualified_visits,
       coalesce(visits, 0) - coalesce(qualified_visits, 0) AS transit_visits, CAST(coalesce(qualified_dwell_ms, 0) AS BIGINT) AS qualified_dwell_ms, CAST(coalesce(dwell_ms, 0) - coalesce(qualified_dwell_ms, 0) AS BIGINT) AS transit_dwell_ms,
       round(coalesce(qualified_visits, 0) / greatest(coalesce(visits, 0), 1), 6) AS qualification_rate
       FROM keys k LEFT JOIN q ON q.camera = k.camera AND q.z = k.z)
"""

SQL = {
    "sessionize": with_cte(_PARTS + "SELECT clip_id, global_id, zone_key, CAST(visit AS BIGINT) AS visit, min(ms) AS enter_ms, max(ms) AS exit_ms, count(*) AS n_rows FROM b GROUP BY ALL"),
    "visits_capped": with_cte(_PARTS + "SELECT clip_id, global_id, zone_key, CAST(visit AS BIGINT) AS visit, min(ms) AS enter_ms, max(ms) AS exit_ms, CAST(coalesce(sum(pause), 0) AS BIGINT) AS dwell_ms, count(*) AS n_rows FROM c GROUP BY clip_id, global_id, zone_key, visit HAVING count(*) >= 2 AND coalesce(sum(pause), 0) >= 500"),
    "visits_runs": with_cte(_RUNS + "SELECT clip_id, global_id, zone_key, first_ms AS enter_ms, exit_ms FROM s WHERE zone_key IS NOT NULL AND exit_ms > first_ms"),
    "visits_hysteresis": with_cte(_RUNS.rstrip() + """, q AS (SELECT r.*, cn.n FROM r JOIN (SELECT clip_id, global_id, run, count(*) AS n FROM b GROUP BY ALL) cn USING (clip_id, global_id, run)),
        st AS (SELECT DISTINCT clip_id, global_id, CAST(0 AS HUGEINT) AS run, NULL::VARCHAR AS zone, NULL::BIGINT AS since, false AS has, NULL::VARCHAR AS cz, NULL::BIGINT AS cs, NULL::VARCHAR AS za, NULL::BIGINT AS a1, NULL::BIGINT AS a2, NULL::VARCHAR AS zb, NULL::BIGINT AS b1, NULL::BIGINT AS b2 FROM q
          UNION ALL
          SELECT clip_id, global_id, run, CASE WHEN same THEN zone WHEN c2 THEN z ELSE zone1 END, CASE WHEN same THEN since WHEN c2 THEN CASE WHEN z IS NOT NULL THEN f END ELSE since1 END, NOT same AND NOT c2, z, f,
            CASE WHEN c1 AND zone IS NOT NULL AND cs > since THEN zone END, since, cs, CASE WHEN NOT same AND c2 AND zone1 IS NOT NULL AND f > since1 THEN zone1 END, since1, f
          FROM (SELECT *, CASE WHEN c1 THEN cz ELSE zone END AS zone1, CASE WHEN c1 THEN CASE WHEN cz IS NOT NULL THEN cs END ELSE since END AS since1 FROM (
            SELECT q.clip_id, q.global_id, q.run, q.zone_key AS z, q.first_ms AS f, st.zone, st.since, st.cz, st.cs, coalesce(q.zone_key = st.zone, false) AS same, NOT coalesce(q.zone_key = st.zone, false) AND st.has AND q.first_ms - st.cs >= 500 AS c1, q.last_ms - q.first_ms >= 500 AND q.n > 1 AS c2
            FROM st JOIN q ON q.clip_id = st.clip_id AND q.global_id = st.global_id AND q.run = st.run + 1))),
        en AS (SELECT clip_id, global_id, max(run) AS run, max(last_ms) AS last_ms FROM q GROUP BY ALL)
        SELECT clip_id, global_id, za AS zone_key, a1 AS enter_ms, a2 AS exit_ms FROM st WHERE za IS NOT NULL UNION ALL SELECT clip_id, global_id, zb, b1, b2 FROM st WHERE zb IS NOT NULL
        UNION ALL SELECT st.clip_id, st.global_id, zone, since, en.last_ms FROM st JOIN en ON en.clip_id = st.clip_id AND en.global_id = st.global_id AND en.run = st.run WHERE zone IS NOT NULL AND en.last_ms > since""", recursive=True),
    "zone_engine_visits": with_cte(_RUNS.rstrip() + """, fi AS (SELECT clip_id, global_id, run, zone_key, first_ms FROM r), co AS (SELECT fi.*, min(b.ms) FILTER (b.ms - first_ms >= 1000) AS commit_ms FROM fi JOIN b ON b.clip_id = fi.clip_id AND b.global_id = fi.global_id AND b.run = fi.run GROUP BY ALL),
        he AS (SELECT *, CASE WHEN run = 1 THEN first_ms ELSE commit_ms END AS since FROM co WHERE run = 1 OR commit_ms IS NOT NULL), ch AS (SELECT *, lag(zone_key) OVER w AS zp, row_number() OVER w AS rn FROM he WINDOW w AS (PARTITION BY clip_id, global_id ORDER BY run)),
        ca AS (SELECT *, lead(since) OVER (PARTITION BY clip_id, global_id ORDER BY run) AS left_ms FROM ch WHERE rn = 1 OR zp IS DISTINCT FROM zone_key), la AS (SELECT clip_id, max(ms) AS clip_end FROM b GROUP BY clip_id)
        SELECT ca.clip_id, global_id, zone_key, since AS enter_ms, coalesce(left_ms, clip_end) AS exit_ms FROM ca JOIN la ON la.clip_id = ca.clip_id WHERE zone_key IS NOT NULL AND coalesce(left_ms, clip_end) > since"""),
    "zone_summary_sql": with_cte("SELECT camera, zone_key, count(*) AS visits, CAST(sum(dwell_ms) AS BIGINT) AS dwell_ms, round(avg(dwell_ms), 4) AS avg_dwell_ms FROM vv GROUP BY ALL"),
    "export_zone_summary": with_cte("SELECT zone_key, count(*) AS visits, floor((sum(dwell_ms) + 5) / 10) / 100 AS total_dwell_s, round(avg(dwell_ms) / 1000.0, 2) AS avg_dwell_s FROM vv GROUP BY ALL"),
    "zone_summary": with_cte(_SUMMARY + "SELECT * FROM zs"),
    "zone_kind": with_cte(f"k AS (SELECT zone_key FROM vv UNION SELECT zone_key FROM zn), n AS (SELECT zone_key, {_ALIAS} AS z FROM k WHERE zone_key IS NOT NULL) SELECT zone_key, z AS alias, {_KIND} AS kind, CAST({_THRESHOLD} AS DOUBLE) AS threshold_s FROM n"),
    "n_persons": with_cte("SELECT camera, count(DISTINCT global_id) AS n_persons FROM tk GROUP BY camera"),
    "bounce_progression": with_cte("""p AS (SELECT camera, clip_id, global_id, bool_or(zone_key = 'entrance_zone') AS e, bool_or(zone_key = 'walkway_zone') AS k FROM vv WHERE zone_key IS NOT NULL AND global_id IS NOT NULL GROUP BY ALL)
        SELECT camera, count(*) FILTER (e) AS entered, count(*) FILTER (e AND NOT k) AS bounced, round(coalesce(count(*) FILTER (e AND NOT k) / nullif(count(*) FILTER (e), 0), 0), 6) AS bounce_rate FROM p GROUP BY camera"""),
    "bounce_qualified": with_cte(_SUMMARY + "SELECT camera, CAST(sum(visits) AS BIGINT) AS visits, CAST(sum(qualified_visits) AS BIGINT) AS qualified_visits, CASE WHEN sum(visits) > 0 THEN round(greatest(0, 1 - sum(qualified_visits) / sum(visits)), 6) ELSE 0 END AS bounce_rate FROM zs GROUP BY camera"),
    "kpi_bounce_best": with_cte("p AS (SELECT camera, clip_id, global_id, max(coalesce(dwell_ms, 0)) AS best FROM vv GROUP BY ALL) SELECT camera, count(*) AS n_persons, count(*) FILTER (best < 3000) AS n_bounced, round(count(*) FILTER (best < 3000) / count(*), 6) AS bounce_rate FROM p GROUP BY camera"),
    "kpi_bounce_total": with_cte("""s AS (SELECT DISTINCT camera, clip_id, global_id FROM tk WHERE global_id > 0), v AS (SELECT camera, clip_id, global_id, sum(dwell_ms) AS d FROM vv GROUP BY ALL),
        p AS (SELECT s.camera, coalesce(d, 0) AS total FROM s LEFT JOIN v ON v.camera = s.camera AND v.clip_id = s.clip_id AND v.global_id = s.global_id), f AS (SELECT *, max(total) OVER (PARTITION BY camera) AS most FROM p)
        SELECT camera, count(*) AS n_persons, count(*) FILTER (total < 3000) AS n_bounced, round(count(*) FILTER (total < 3000) / count(*), 6) AS bounce_rate FROM f WHERE total >= 1000 OR most < 1000 GROUP BY camera"""),
    "camera_cards": with_cte(_SUMMARY + """SELECT camera, CAST(sum(visits) AS BIGINT) AS visits, CAST(sum(CASE WHEN zone_kind = 'engagement' THEN qualified_visits ELSE 0 END) AS BIGINT) AS engaged, CAST(sum(CASE WHEN zone_kind = 'checkout' THEN qualified_visits ELSE 0 END) AS BIGINT) AS checkouts,
        CASE WHEN sum(CASE WHEN zone_key LIKE '%entrance%' THEN visits ELSE 0 END) > 0 THEN round(least(1, sum(CASE WHEN regexp_matches(zone_key, 'walkway|hot|promo|browse|cashier|checkout') THEN qualified_visits ELSE 0 END) / sum(CASE WHEN zone_key LIKE '%entrance%' THEN visits ELSE 0 END)), 6) ELSE 0 END AS progression_rate,
        round(coalesce(sum(dwell_ms) / nullif(sum(visits), 0), 0), 4) AS avg_dwell_ms, count(*) FILTER (visits > 0) AS active_zones, min_by(zone_key, struct_pack(d := -dwell_ms, k := zone_key)) AS top_zone FROM zs GROUP BY camera"""),
    "person_summary": with_cte("e AS (SELECT camera, clip_id, global_id, count(*) AS visits, CAST(coalesce(sum(dwell_ms), 0) AS BIGINT) AS dwell_ms FROM vv GROUP BY ALL), f AS (SELECT camera, clip_id, global_id, count(*) AS n FROM tk GROUP BY ALL) SELECT e.*, coalesce(n, 0) AS n_frames FROM e LEFT JOIN f ON f.camera = e.camera AND f.clip_id = e.clip_id AND f.global_id = e.global_id"),
    "person_fallback": with_cte("""h AS (SELECT DISTINCT camera, clip_id FROM vv)
        SELECT camera, clip_id, global_id, count(*) AS n_frames, min(ms) AS first_ms, max(ms) AS last_ms, floor((greatest(0, max(ms) - min(ms)) + 5) / 10) / 100 AS duration_s FROM tk
        WHERE global_id > 0 AND NOT EXISTS (SELECT 1 FROM h WHERE h.camera = tk.camera AND h.clip_id = tk.clip_id) GROUP BY camera, clip_id, global_id"""),
    "export_person_summary": with_cte("SELECT camera, clip_id, global_id, count(*) AS visits, count(DISTINCT zone_key) AS n_zones, floor((coalesce(sum(dwell_ms), 0) + 5) / 10) / 100 AS total_dwell_s FROM vv GROUP BY ALL"),
    "freshness": with_cte("""a AS (SELECT camera, count(*) AS track_rows, count(DISTINCT global_id) AS track_ids, count(DISTINCT clip_id) AS clips, min(ms) AS min_ms, max(ms) AS max_ms, count(*) FILTER (zone_key IS NOT NULL) AS zoned_rows FROM tk GROUP BY camera),
        b AS (SELECT camera, count(*) AS event_rows, count(DISTINCT global_id) AS event_ids, max(exit_ms) AS max_exit_ms FROM vv GROUP BY camera), z AS (SELECT camera, count(*) AS zone_defs FROM zn GROUP BY camera),
        j AS (SELECT camera, coalesce(track_rows, 0) AS track_rows, coalesce(track_ids, 0) AS track_ids, coalesce(clips, 0) AS clips, min_ms, max_ms, coalesce(zoned_rows, 0) AS zoned_rows, coalesce(event_rows, 0) AS event_rows, coalesce(event_ids, 0) AS event_ids, max_exit_ms, coalesce(zone_defs, 0) AS zone_defs FROM cam LEFT JOIN a USING (camera) LEFT JOIN b USING (camera) LEFT JOIN z USING (camera))
        SELECT *, round(coalesce(zoned_rows / nullif(track_rows, 0), 0), 6) AS zoned_ratio, round(coalesce(event_ids / nullif(track_ids, 0), 0), 6) AS event_id_ratio,
        CASE WHEN track_rows = 0 THEN 'error' WHEN zoned_rows = 0 OR event_rows = 0 OR (event_ids > 0 AND event_ids / track_ids < 0.25) THEN 'warn' ELSE 'ok' END AS status FROM j"""),
    "ab_zone_delta": with_cte("""a AS (SELECT zone_key, count(*) AS n, sum(dwell_ms) AS dw FROM vv WHERE camera = 'cam_01' AND zone_key IS NOT NULL GROUP BY ALL), b AS (SELECT zone_key, count(*) AS n, sum(dwell_ms) AS dw FROM vv WHERE camera = 'cam_02' AND zone_key IS NOT NULL GROUP BY ALL),
        j AS (SELECT coalesce(a.zone_key, b.zone_key) AS zone_key, coalesce(a.n, 0) AS visits_a, coalesce(b.n, 0) AS visits_b, CAST(coalesce(a.dw, 0) AS BIGINT) AS dwell_a, CAST(coalesce(b.dw, 0) AS BIGINT) AS dwell_b FROM a FULL JOIN b ON a.zone_key = b.zone_key)
        SELECT *, visits_b - visits_a AS visits_delta, CASE WHEN visits_a <> 0 THEN round(100.0 * (visits_b - visits_a) / visits_a, 4) END AS visits_pct, CASE WHEN dwell_a <> 0 THEN round(100.0 * (dwell_b - dwell_a) / dwell_a, 4) END AS dwell_pct FROM j"""),
    "insights": with_cte(_SUMMARY + """, i AS (SELECT camera, zone_key, CASE WHEN visits > 0 THEN dwell_ms / visits ELSE 0 END AS a, visits, qualified_visits AS q, transit_visits AS tr, qualification_rate AS r, zone_kind AS k FROM zs)
        SELECT camera, zone_key, unnest(list_filter([
          CASE WHEN k = 'entrance' AND a >= 8000 THEN 'slow_entrance' END, CASE WHEN k = 'entrance' AND a <= 3000 AND visits > 5 THEN 'smooth_entrance' END,
          CASE WHEN k = 'engagement' AND q = 0 AND visits > 0 THEN 'no_engagement' END, CASE WHEN k = 'engagement' AND r >= 0.6 AND q >= 3 THEN 'strong_engagement' END,
          CASE WHEN k = 'engagement' AND tr > q AND visits > 3 THEN 'mostly_transit' END, CASE WHEN k = 'checkout' AND visits > 0 AND a >= 3000 THEN 'checkout_dwell' END], lambda x: x IS NOT NULL)) AS insight FROM i"""),
    "scope_filter": with_cte("SELECT clip_id, count(*) AS n FROM vv WHERE camera = 'cam_01' AND clip_id ILIKE 'FULL_shop%' GROUP BY clip_id"),
    "events_overlap": with_cte("SELECT id, enter_ms, exit_ms FROM vv WHERE NOT (exit_ms < 60000 OR enter_ms > 120000)"),
    "fetch_events": with_cte("SELECT id, clip_id, global_id, enter_ms, exit_ms FROM vv WHERE camera = 'cam_02' AND enter_ms >= 60000 AND exit_ms <= 120000"),
    "fetch_tracks": with_cte("SELECT row_idx, frame_idx, global_id, ms, zone_key FROM tk WHERE camera = 'cam_01' AND clip_id = 'full_shop04' AND ms BETWEEN 60000 AND 120000"),
    "all_cameras": with_cte("SELECT camera FROM tk UNION SELECT camera FROM vv"),
    "union_cameras": with_cte("SELECT camera AS source, id, global_id FROM vv WHERE camera IN (SELECT camera FROM cam)"),
    "meta_groups": with_cte("c AS (SELECT DISTINCT camera, clip_id FROM tk WHERE clip_id IS NOT NULL) SELECT camera, array_to_string(string_split(clip_id, '_')[1:2], '_') AS clip_group, count(*) AS n_clips FROM c GROUP BY ALL"),
    "rollup_visits": with_cte("SELECT camera, clip_id, zone_key, count(*) AS visits, CAST(sum(dwell_ms) AS BIGINT) AS dwell_ms, grouping(camera, clip_id, zone_key) AS level FROM vv GROUP BY ROLLUP (camera, clip_id, zone_key)"),
    "engagement_sales_gap": """WITH s AS (SELECT p_type AS item, sum(l_quantity) AS a, count(*) AS b FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
        SELECT item, round(a / sum(a) OVER (), 6) AS share_a, round(b / sum(b) OVER (), 6) AS share_b, round(abs(a / sum(a) OVER () - b / sum(b) OVER ()), 6) AS gap, abs(a / sum(a) OVER () - b / sum(b) OVER ()) > 0.10 AS is_wide FROM s""",
}
