"""Views over the test tables that queries and their SQL share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions.keys import finite, slug, whole_ms, zone_key
from trackloom.session import broadcast_if_small
from trackloom.sources.tables import Tables

_SLUG = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '_')"
_OUT = r"({0} IS NULL OR regexp_full_match({0}, '[\s\p{{Z}}]*'))"
_ZK = f"CASE WHEN NOT {_OUT.format('zone_id')} THEN {_SLUG.format('zone_id')} END"

#: CTEs: tk (tracks with keys), vv (visit events with keys), cam (cameras), fr (tracks with their frame).
CTE = f"""
tk AS (SELECT id AS row_idx, {_SLUG.format('camera_id')} AS camera, clip_id, frame_idx, ts, CAST(round(1000 * ts) AS BIGINT) AS ms, global_id, x1, y1, x2, y2, {_ZK} AS zone_key, conf, captured_at FROM tracks),
vv AS (SELECT id, {_SLUG.format('camera_id')} AS camera, clip_id, global_id, {_ZK} AS zone_key, CAST(round(1000 * t_enter) AS BIGINT) AS enter_ms, CAST(round(1000 * t_exit) AS BIGINT) AS exit_ms, CAST(round(1000 * dwell_s) AS BIGINT) AS dwell_ms, captured_at FROM visit_events),
cam AS (SELECT {_SLUG.format('camera_id')} AS camera, CAST(max(frame_w) AS DOUBLE) AS w, CAST(max(frame_h) AS DOUBLE) AS h, max(fps) AS fps FROM cameras GROUP BY 1),
fr AS (SELECT tk.*, w, h, fps FROM tk JOIN cam USING (camera) WHERE x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL),
zn AS (SELECT {_SLUG.format('camera_id')} AS camera, {_ZK} AS zone_key, zone_name, zone_type, polygon, added_at, removed_at FROM zones WHERE NOT {_OUT.format('zone_id')})
"""


def with_cte(body: str, recursive: bool = False) -> str:
    """SQL that may use the shared CTEs. ``body`` is more CTEs and a select, or a select alone."""
    body = body.strip()
    return f"WITH {'RECURSIVE ' * recursive}{CTE.strip()}{' ' if body.upper().startswith('SELECT') else ', '}{body}"


def tracks_view(t: Tables) -> DataFrame:
    """tk: row_idx, camera, clip_id, frame_idx, ts, ms, global_id, box, zone_key, conf, captured_at."""
    return t.tracks.select(
        F.col("id").alias("row_idx"),
        slug(F.col("camera_id")).alias("camera"),
        "clip_id",
        "frame_idx",
        "ts",
        whole_ms(F.col("ts")).alias("ms"),
        "global_id",
        *[finite(F.col(c)).alias(c) for c in ("x1", "y1", "x2", "y2")],
        zone_key(F.col("zone_id")).alias("zone_key"),
        "conf",
        "captured_at",
    )


def visits_view(t: Tables) -> DataFrame:
    """vv: id, camera, clip_id, global_id, zone_key, enter_ms, exit_ms, dwell_ms, captured_at."""
    return t.visit_events.select(
        "id",
        slug(F.col("camera_id")).alias("camera"),
        "clip_id",
        "global_id",
        zone_key(F.col("zone_id")).alias("zone_key"),
        whole_ms(F.col("t_enter")).alias("enter_ms"),
        whole_ms(F.col("t_exit")).alias("exit_ms"),
        whole_ms(F.col("dwell_s")).alias("dwell_ms"),
        "captured_at",
    )


def cameras_view(t: Tables) -> DataFrame:
    """cam: camera, w, h, fps; broadcast if it is measured to be small."""
    return broadcast_if_small(
        t.cameras.groupBy(slug(F.col("camera_id")).alias("camera")).agg(
            F.max("frame_w").cast("double").alias("w"), F.max("frame_h").cast("double").alias("h"), F.max("fps").alias("fps")
        )
    )


def framed_view(t: Tables) -> DataFrame:
    """fr: tk of known cameras with whole boxes, and w, h, fps of the camera."""
    whole = "x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL"
    return tracks_view(t).where(whole).join(cameras_view(t), "camera")


def zones_view(t: Tables) -> DataFrame:
    """zn: camera, zone_key, zone_name, zone_type, polygon (JSON), added_at, removed_at."""
    return t.zones.select(slug(F.col("camera_id")).alias("camera"), zone_key(F.col("zone_id")).alias("zone_key"), "zone_name", "zone_type", "polygon", "added_at", "removed_at").where("zone_key IS NOT NULL")


def greedy_sql(edges: str, group: list[str], name: str) -> str:
    """Recursive CTEs ``<name>_o`` and ``<name>``: edges (group columns, l, r, s) taken from the best down, each l and r of a group once.

    Rows of ``<name>`` with ``ok`` are the matching.
    """
    g, o = ", ".join(group), f"{name}_o"
    on = " AND ".join(f"{name}.{c} = {o}.{c}" for c in group)
    mine = ", ".join(f"{o}.{c}" for c in group)
    free = f"NOT list_contains({name}.ul, {o}.l) AND NOT list_contains({name}.ur, {o}.r)"
    return f"""{o} AS MATERIALIZED (SELECT {g}, l, r, s, row_number() OVER (PARTITION BY {g} ORDER BY s DESC, l, r) AS i FROM {edges}),
{name} AS (SELECT DISTINCT {g}, CAST(0 AS BIGINT) AS i, []::BIGINT[] AS ul, []::BIGINT[] AS ur, NULL::BIGINT AS l, NULL::BIGINT AS r, NULL::DOUBLE AS s, false AS ok FROM {o} UNION ALL
  SELECT {mine}, {o}.i, CASE WHEN {free} THEN list_append(ul, {o}.l) ELSE ul END, CASE WHEN {free} THEN list_append(ur, {o}.r) ELSE ur END, {o}.l, {o}.r, {o}.s, {free} FROM {name} JOIN {o} ON {on} AND {o}.i = {name}.i + 1)
"""


def union_sql(nodes: str, edges: str, tolerance: int, name: str) -> str:
    """Recursive CTEs that merge ``nodes`` (clip_id, node, start_frame, end_frame) along ``edges`` (clip_id, a, b, score) from the best score
    down unless spans of the two groups overlap by more than ``tolerance``. ``<name>_r`` has clip_id, node, root."""
    of = lambda x: f"list_filter(gs, lambda g: list_contains(g.m, {x}))[1]"
    clash = f"list_bool_or(flatten(list_transform(ga.sp, lambda x: list_transform(gb.sp, lambda y: least(x.e, y.e) - greatest(x.s, y.s) + 1 > {tolerance}))))"
    first = "(list_sort(ga.sp)[1].s, list_sort(ga.sp)[1].e, ga.root) < (list_sort(gb.sp)[1].s, list_sort(gb.sp)[1].e, gb.root)"
    kept = "list_filter(gs, lambda g: g.root <> ga.root AND g.root <> gb.root)"
    both = f"struct_pack(root := CASE WHEN {first} THEN ga.root ELSE gb.root END, m := list_concat(ga.m, gb.m), sp := list_concat(ga.sp, gb.sp))"
    return f"""{name}_e AS MATERIALIZED (SELECT clip_id, a, b, row_number() OVER (PARTITION BY clip_id ORDER BY score DESC, a, b) AS i FROM {edges}),
{name} AS (SELECT clip_id, CAST(0 AS BIGINT) AS i, list(struct_pack(root := node, m := [node], sp := [struct_pack(s := start_frame, e := end_frame)]) ORDER BY node) AS gs FROM (SELECT clip_id, CAST(node AS BIGINT) AS node, start_frame, end_frame FROM {nodes}) GROUP BY clip_id UNION ALL
  SELECT clip_id, i, CASE WHEN ga IS NULL OR gb IS NULL OR ga.root = gb.root OR {clash} THEN gs ELSE list_append({kept}, {both}) END
  FROM (SELECT {name}.clip_id, {name}_e.i, gs, {of(f'{name}_e.a')} AS ga, {of(f'{name}_e.b')} AS gb FROM {name} JOIN {name}_e ON {name}_e.clip_id = {name}.clip_id AND {name}_e.i = {name}.i + 1)),
{name}_l AS (SELECT clip_id, arg_max(gs, i) AS gs FROM {name} GROUP BY clip_id),
{name}_r AS (SELECT clip_id, unnest(g.m) AS node, g.root AS root FROM (SELECT clip_id, unnest(gs) AS g FROM {name}_l))
"""
