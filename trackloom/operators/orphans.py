"""Problem 2: references to records that do not exist, or not at that time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.keys import is_outside, slug, zone_key
from trackloom.session import broadcast_if_small

_OPEN = (1 << 63) - 1
_EMPTY_SPANS = "array<struct<since:bigint,until:bigint>>"


def _micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def _children(df: DataFrame, table: str, parent: str, raw1: Column, raw2: Column, at: Column, at_day: Column) -> DataFrame:
    return df.select(
        F.lit(table).alias("table_name"),
        F.lit(parent).alias("parent_table"),
        F.col("id").cast("bigint").alias("id"),
        raw1.cast("string").alias("raw1"),
        raw2.cast("string").alias("raw2"),
        at.alias("at"),
        at_day.alias("day"),
    )


def _zone_parents(zones: DataFrame) -> DataFrame:
    since = F.coalesce(_micros(F.col("added_at")), F.lit(-_OPEN))
    until = F.coalesce(_micros(F.col("removed_at")), F.lit(_OPEN))
    return (
        zones.select(
            F.lit("zones").alias("parent_table"),
            slug(F.col("camera_id")).alias("key1"),
            zone_key(F.col("zone_id")).alias("key2"),
            since.alias("since"),
            until.alias("until"),
        )
        .where("key1 IS NOT NULL AND key2 IS NOT NULL AND since < until")
        .distinct()
    )


def _tracklet_parents(tracklets: DataFrame) -> DataFrame:
    return (
        tracklets.where("tracklet_id IS NOT NULL AND start_frame IS NOT NULL AND clip_id IS NOT NULL")
        .groupBy("clip_id", "tracklet_id")
        .agg(F.min("start_frame").alias("first"))
        .select(
            F.lit("tracklets").alias("parent_table"),
            F.col("clip_id").alias("key1"),
            F.col("tracklet_id").cast("string").alias("key2"),
            (F.col("first") + 1).alias("since"),
            F.lit(_OPEN).alias("until"),
        )
    )


def orphan_references(tracks: DataFrame, visits: DataFrame, decisions: DataFrame, zones: DataFrame, tracklets: DataFrame) -> DataFrame:
    """Rows whose reference has no parent in force: ``table_name, id, day`` (the day of the row, null where it has no time).

    Method. Child keys are first counted per spelling with their earliest and latest position, then united with the parent
    keys in long form (parent table, key, flag and span of the parent) and grouped by parent table and key. Groups whose
    parent does not cover all of their children are kept, with the parent's spans: none for keys that do not exist at all.
    Only rows with such a key are looked at singly. Child rows are never shuffled unless the kept keys are too many to be
    broadcast (measured); then it is a shuffled join.

    Positions are microseconds for zones (in force from ``added_at``, null: always, up to but not including ``removed_at``) and
    start frames for tracklets (a parent must start strictly earlier). Defined cases: a row outside any zone, or with a
    best_prev_tracklet_id of null or 0, refers to nothing and is no orphan; a reference from a row with a null time, frame,
    camera or clip can be met by no parent and is one; each delivery of a row counts; zones that are never in force
    (``removed_at`` not after ``added_at``) are no parents; an empty child table gives no rows, an empty parent table makes
    every reference an orphan. The spans of one zone key are held together: they are periods of one entry of a dimension.
    """
    refers = lambda df: df.where(~is_outside(F.col("zone_id")))
    zoned = lambda df, name: _children(
        refers(df), name, "zones", F.col("camera_id"), F.col("zone_id"), _micros(F.col("captured_at")), F.to_date("captured_at")
    )
    linked = _children(
        decisions.where("best_prev_tracklet_id <> 0"),
        "reentry_decisions",
        "tracklets",
        F.col("clip_id"),
        F.col("best_prev_tracklet_id"),
        F.col("start_frame").cast("bigint"),
        F.lit(None).cast("date"),
    )
    children = zoned(tracks, "tracks").unionByName(zoned(visits, "visit_events")).unionByName(linked)

    spelled = children.groupBy("parent_table", "raw1", "raw2").agg(
        F.min("at").alias("lo"), F.max("at").alias("hi"), F.count_if(F.col("at").isNull()).alias("untimed")
    )
    is_zone = F.col("parent_table") == "zones"
    span = "struct<since:bigint,until:bigint>"
    child_keys = spelled.select(
        "parent_table",
        F.when(is_zone, slug(F.col("raw1"))).otherwise(F.col("raw1")).alias("key1"),
        F.when(is_zone, zone_key(F.col("raw2"))).otherwise(F.col("raw2")).alias("key2"),
        F.struct("raw1", "raw2").alias("spelling"),
        "lo",
        "hi",
        "untimed",
        F.lit(None).cast(span).alias("span"),
    )
    parents = _zone_parents(zones).unionByName(_tracklet_parents(tracklets))
    parent_keys = parents.select(
        "parent_table",
        "key1",
        "key2",
        F.lit(None).cast("struct<raw1:string,raw2:string>").alias("spelling"),
        F.lit(None).cast("bigint").alias("lo"),
        F.lit(None).cast("bigint").alias("hi"),
        F.lit(0).cast("bigint").alias("untimed"),
        F.struct("since", "until").cast(span).alias("span"),
    )
    grouped = (
        child_keys.unionByName(parent_keys)
        .groupBy("parent_table", "key1", "key2")
        .agg(
            F.collect_set("spelling").alias("spellings"),
            F.collect_set("span").alias("spans"),
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
            F.sum("untimed").alias("untimed"),
        )
    )
    covered = F.exists("spans", lambda s: (s["since"] <= F.col("lo")) & (F.col("hi") < s["until"])) & (F.col("untimed") == 0)
    lacking = (
        grouped.where(F.size("spellings") > 0)
        .where(~F.coalesce(covered, F.lit(False)))
        .select("parent_table", F.explode("spellings").alias("spelling"), F.col("spans").cast(_EMPTY_SPANS).alias("spans"))
        .select(F.col("parent_table").alias("of"), F.col("spelling.raw1").alias("r1"), F.col("spelling.raw2").alias("r2"), "spans")
    )
    lacking = broadcast_if_small(lacking)
    on = (F.col("parent_table") == F.col("of")) & (F.col("raw2") == F.col("r2")) & F.col("raw1").eqNullSafe(F.col("r1"))
    in_force = F.exists("spans", lambda s: (s["since"] <= F.col("at")) & (F.col("at") < s["until"]))
    return children.join(lacking, on).where(~F.coalesce(in_force, F.lit(False))).select("table_name", "id", "day")


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphans per table and day: ``table_name, day, n_orphans``."""
    return orphans.groupBy("table_name", "day").agg(F.count(F.lit(1)).alias("n_orphans"))
