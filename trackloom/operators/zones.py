"""Zones as a dimension, and the zone of a point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.geometry import anchor_point, box, in_polygon
from trackloom.session import broadcast_if_small

_POLYGON = "array<array<double>>"


def zone_lists(zones: DataFrame) -> DataFrame:
    """One row per camera: its zones as an array of structs in the order in which they are tried (by zone_key, then age).

    A camera's zones are a dimension entry of bounded size; the table is broadcast if it is measured to be small.
    """
    micros = lambda c, default: F.coalesce(F.unix_micros(F.col(c).cast("timestamp")), F.lit(default))
    far = (1 << 63) - 1
    shapes = zones.where("camera IS NOT NULL").withColumn("polygon", F.from_json("polygon", _POLYGON))
    xs, ys = F.transform("polygon", lambda p: p[0]), F.transform("polygon", lambda p: p[1])
    reach = F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)).alias("reach")
    entry = F.struct("zone_key", micros("added_at", -far).alias("since"), micros("removed_at", far).alias("until"), reach, "polygon")
    lists = shapes.groupBy(F.col("camera").alias("z_camera")).agg(F.array_sort(F.collect_list(entry)).alias("zones"))
    return broadcast_if_small(lists)


def assign_zone(rows: DataFrame, zones: DataFrame, point: str = "ankle") -> DataFrame:
    """Adds ``found_zone``: the first zone of the row's camera, in force at ``captured_at``, whose polygon holds the box's point.

    The zones of a camera come with the row by a broadcast join, so rows are not shuffled. No zone gives null.
    """
    x, y = anchor_point(box(), point)
    at = F.unix_micros(F.col("captured_at").cast("timestamp"))
    joined = rows.join(zone_lists(zones), F.col("camera") == F.col("z_camera"), "left")

    def hit(z: Column) -> Column:
        r, slack = z["reach"], 1e-6
        near = (x >= r[0] - slack) & (x <= r[2] + slack) & (y >= r[1] - slack) & (y <= r[3] + slack)
        return near & (z["since"] <= at) & (at < z["until"]) & in_polygon(x, y, z["polygon"])

    return joined.withColumn("found_zone", F.get(F.filter("zones", hit), F.lit(0))["zone_key"]).drop("z_camera", "zones")


def backfilled(rows: DataFrame, zones: DataFrame, overwrite: bool = False) -> DataFrame:
    """Rows with ``zone_key`` filled in where it is missing, or replaced everywhere."""
    assigned = assign_zone(rows, zones)
    new = F.col("found_zone") if overwrite else F.coalesce("zone_key", "found_zone")
    return assigned.withColumn("zone_key", new).drop("found_zone")


def upserted(existing: DataFrame, incoming: DataFrame, keep_polygon: bool = False) -> DataFrame:
    """Zones (camera, zone_key, zone_name, zone_type, polygon) after inserting or updating by key; polygons drawn by hand may stay."""
    keys = ["camera", "zone_key"]
    old = existing.select(*keys, *[F.col(c).alias(f"o_{c}") for c in ("zone_name", "zone_type", "polygon")], F.lit(True).alias("was"))
    both = old.join(incoming.select(*keys, "zone_name", "zone_type", "polygon", F.lit(True).alias("is")), keys, "full")
    pick = lambda c: F.when(F.col("is"), F.col(c)).otherwise(F.col(f"o_{c}"))
    polygon = F.coalesce("o_polygon", "polygon") if keep_polygon else pick("polygon")
    return both.select(*keys, pick("zone_name").alias("zone_name"), pick("zone_type").alias("zone_type"), polygon.alias("polygon"))


def synchronised(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """Existing zones without those that ``wanted`` no longer names, for the cameras it names at all."""
    stale = existing.join(wanted.select("camera").distinct(), "camera", "left_semi").join(wanted.select("camera", "zone_key"), ["camera", "zone_key"], "left_anti")
    return existing.join(stale.select("camera", "zone_key").distinct(), ["camera", "zone_key"], "left_anti")


def overlapping_zones(zones: DataFrame) -> DataFrame:
    """Pairs of a camera's zones whose bounding boxes overlap, with the overlapping area."""
    polygon = F.from_json("polygon", _POLYGON)
    xs, ys = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    boxes = zones.select("camera", "zone_key", F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2")).distinct()
    other = boxes.select("camera", F.col("zone_key").alias("zone_b"), *[F.col(c).alias(f"{c}_b") for c in ("x1", "y1", "x2", "y2")])
    w = F.least("x2", "x2_b") - F.greatest("x1", "x1_b")
    h = F.least("y2", "y2_b") - F.greatest("y1", "y1_b")
    return boxes.join(other, "camera").where("zone_key < zone_b").where((w > 0) & (h > 0)).select("camera", F.col("zone_key").alias("zone_a"), "zone_b", (w * h).alias("overlap_area"))


def first_by_rank(candidates: DataFrame, key: str, rank: str) -> DataFrame:
    """The candidate of lowest ``rank`` for each ``key``."""
    return candidates.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(rank))).where("__r = 1").drop("__r")
