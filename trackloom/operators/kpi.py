"""Counts and rates of visits per zone, person and camera. Dwell times are whole milliseconds, so sums do not depend on order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.keys import slug

# Zone names that mean the same, and the dwell in seconds from which a visit counts as engagement.
ZONE_ALIASES = {"check_zone": "decision_zone", "counter_zone": "cashier_zone"}
ENGAGEMENT_SECONDS = {
    "entrance_zone": 2.0,
    "walkway_zone": 1.5,
    "decision_zone": 999.0,
    "hot_zone": 3.0,
    "promo_zone": 3.0,
    "browsing_zone": 2.0,
    "cashier_zone": 2.0,
}
DOWNSTREAM = "walkway|hot|promo|browse|cashier|checkout"


def _has(zone: Column, *tokens: str) -> Column:
    return reduce(Column.__or__, [zone.contains(t) for t in tokens])


def zone_alias(zone: Column) -> Column:
    return F.coalesce(_lookup(ZONE_ALIASES, zone), zone)


def _lookup(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def engagement_threshold(zone: Column) -> Column:
    """Seconds: by exact name first, then by what the name contains (a walkway by name has 1.5, any other walkway none in practice)."""
    by_part = (
        F.when(_has(zone, "walkway", "decision"), 999.0)
        .when(_has(zone, "entrance"), 2.0)
        .when(_has(zone, "hot", "promo"), 3.0)
        .when(_has(zone, "browse"), 2.0)
        .when(_has(zone, "cashier", "checkout"), 2.0)
        .otherwise(2.5)
    )
    return F.coalesce(_lookup(ENGAGEMENT_SECONDS, zone), by_part)


def zone_kind(zone: Column) -> Column:
    """flow, entrance, engagement, checkout or other. ``browsing_zone`` is other: only names with ``browse`` are engagement."""
    return (
        F.when(_has(zone, "walkway", "decision"), "flow")
        .when(_has(zone, "entrance"), "entrance")
        .when(_has(zone, "hot", "promo", "browse"), "engagement")
        .when(_has(zone, "cashier", "checkout"), "checkout")
        .otherwise("other")
    )


def in_scope(camera: str, clip: str | None = None, group: str | None = None) -> Column:
    """Rows of a camera, and of one clip or of clips whose name begins with ``group`` (any letter case, ``_`` as any letter)."""
    scope = F.col("camera") == camera
    if clip:
        return scope & (F.col("clip_id") == clip)
    return scope & F.col("clip_id").ilike(f"{group}%") if group else scope


def overlaps(since_ms: int, until_ms: int) -> Column:
    """Visits that share a moment with the closed interval; open ends count only if null."""
    return ~((F.col("exit_ms") < since_ms) | (F.col("enter_ms") > until_ms))


def zone_totals(visits: DataFrame) -> DataFrame:
    return visits.groupBy("camera", "zone_key").agg(F.count(F.lit(1)).alias("visits"), F.sum("dwell_ms").alias("dwell_ms"), F.round(F.avg("dwell_ms"), 4).alias("avg_dwell_ms"))


def zone_export(visits: DataFrame) -> DataFrame:
    return visits.groupBy("zone_key").agg(
        F.count(F.lit(1)).alias("visits"), F.round(F.sum("dwell_ms") / 1000.0, 2).alias("total_dwell_s"), F.round(F.avg("dwell_ms") / 1000.0, 2).alias("avg_dwell_s")
    )


def zone_summary(visits: DataFrame, zones: DataFrame) -> DataFrame:
    """Per camera and zone: visits and dwell, and how much of them reached the zone's engagement threshold.

    Zones that a camera defines have a row even without visits; a camera that defines any shows no others. Names that mean
    the same are one zone.
    """
    z = zone_alias(F.col("zone_key"))
    dwell = F.coalesce("dwell_ms", F.lit(0))
    events = visits.where("zone_key IS NOT NULL").select("camera", z.alias("zone_key"), dwell.alias("dwell"))
    enough = F.col("dwell") >= 1000 * engagement_threshold(F.col("zone_key"))
    facts = events.groupBy("camera", "zone_key").agg(
        F.count(F.lit(1)).alias("visits"), F.sum("dwell").alias("dwell_ms"), F.count_if(enough).alias("qualified_visits"), F.sum(F.when(enough, F.col("dwell"))).alias("qualified_dwell_ms")
    )
    defined = zones.where("camera IS NOT NULL").select("camera", z.alias("zone_key")).distinct()
    rest = facts.join(defined.select("camera").distinct(), "camera", "left_anti").select("camera", "zone_key")
    keys = defined.unionByName(rest)
    none = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    return (
        keys.join(facts, ["camera", "zone_key"], "left")
        .select("camera", "zone_key", zone_kind(F.col("zone_key")).alias("zone_kind"), *[none(c).alias(c) for c in ("visits", "dwell_ms", "qualified_visits", "qualified_dwell_ms")])
        .withColumns(
            {
                "transit_visits": F.col("visits") - F.col("qualified_visits"),
                "transit_dwell_ms": F.col("dwell_ms") - F.col("qualified_dwell_ms"),
                "qualification_rate": F.round(F.col("qualified_visits") / F.greatest("visits", F.lit(1)), 6),
            }
        )
    )


def zone_type(zone: Column, given: Column) -> Column:
    """The type a zone was given, or, where that is missing or ``other``, the one its name (or the name it stands for) tells."""
    name, own = zone_alias(zone), slug(given, "other")
    told = (
        F.when(_has(name, "entrance"), "entrance")
        .when(_has(name, "walkway", "aisle"), "walkway")
        .when(_has(name, "hot"), "hot")
        .when(_has(name, "promo"), "promo")
        .when(_has(name, "browse"), "browsing")
        .when(_has(name, "cashier", "checkout", "counter"), "checkout")
        .otherwise("other")
    )
    return F.when(own != "other", own).otherwise(told)


def zone_metrics(summary: DataFrame) -> DataFrame:
    """Figures of zones as shown, whatever of them is given: missing qualified visits are all visits, missing transit visits the rest, a
    missing rate their share; ``rate`` is in percent, and a given one up to 1 is a share. Rows have camera and zone_key."""
    visits = F.coalesce("visits", F.lit(0))
    qualified = F.coalesce("qualified_visits", visits)
    share = F.coalesce(F.try_divide(100 * qualified, visits), F.lit(0.0))
    rate = F.when(F.col("qualification_rate").isNull(), share).when(F.col("qualification_rate") <= 1, 100 * F.col("qualification_rate")).otherwise(F.col("qualification_rate"))
    dwell = F.coalesce("dwell_ms", F.lit(0))
    return summary.select(
        "camera",
        "zone_key",
        visits.alias("visits"),
        qualified.alias("qualified"),
        F.coalesce("transit_visits", F.greatest(F.lit(0), visits - qualified)).cast("bigint").alias("transit"),
        F.round(rate, 4).alias("rate"),
        F.round(F.coalesce(F.try_divide(dwell, visits), F.lit(0.0)), 4).alias("mean_dwell_ms"),
    )


def bounce_by_progression(visits: DataFrame, entrance: str = "entrance_zone", onward: str = "walkway_zone") -> DataFrame:
    """Persons seen in the entrance but never onward, per camera."""
    seen = visits.where("zone_key IS NOT NULL AND global_id IS NOT NULL").groupBy("camera", "clip_id", "global_id").agg(
        F.bool_or(F.col("zone_key") == entrance).alias("entered"), F.bool_or(F.col("zone_key") == onward).alias("went_on")
    )
    return seen.groupBy("camera").agg(
        F.count_if("entered").alias("entered"),
        F.count_if(F.col("entered") & ~F.col("went_on")).alias("bounced"),
        F.round(F.coalesce(F.try_divide(F.count_if(F.col("entered") & ~F.col("went_on")), F.count_if("entered")), F.lit(0.0)), 6).alias("bounce_rate"),
    )


def bounce_by_qualified(summary: DataFrame) -> DataFrame:
    rate = F.round(F.greatest(F.lit(0.0), 1 - F.sum("qualified_visits") / F.sum("visits")), 6)
    return summary.groupBy("camera").agg(F.sum("visits").alias("visits"), F.sum("qualified_visits").alias("qualified_visits"), F.when(F.sum("visits") > 0, rate).otherwise(0.0).alias("bounce_rate"))


def _bounced(persons: DataFrame, dwell: str, limit_ms: int) -> DataFrame:
    short = F.col(dwell) < limit_ms
    return persons.groupBy("camera").agg(F.count(F.lit(1)).alias("n_persons"), F.count_if(short).alias("n_bounced"), F.round(F.count_if(short) / F.count(F.lit(1)), 6).alias("bounce_rate"))


def bounce_by_best(visits: DataFrame, limit_ms: int = 3000) -> DataFrame:
    """Persons whose longest single visit is shorter than ``limit_ms``."""
    return _bounced(visits.groupBy("camera", "clip_id", "global_id").agg(F.max(F.coalesce("dwell_ms", F.lit(0))).alias("best")), "best", limit_ms)


def bounce_by_total(visits: DataFrame, tracks: DataFrame, limit_ms: int = 3000, least_ms: int = 1000) -> DataFrame:
    """Persons (with or without visits) whose total dwell is shorter than ``limit_ms``; those below ``least_ms`` are left out
    unless the camera has no others."""
    keys = ["camera", "clip_id", "global_id"]
    persons = tracks.where("global_id > 0").select(*keys).distinct()
    totals = persons.join(visits.groupBy(*keys).agg(F.sum("dwell_ms").alias("d")), keys, "left").select("camera", F.coalesce("d", F.lit(0)).alias("total"))
    most = totals.groupBy("camera").agg(F.max("total").alias("most"))
    return _bounced(totals.join(most, "camera").where((F.col("total") >= least_ms) | (F.col("most") < least_ms)), "total", limit_ms)


def camera_cards(summary: DataFrame) -> DataFrame:
    """The figures of a camera's overview from its zone summary."""
    kind = lambda k: F.sum(F.when(F.col("zone_kind") == k, F.col("qualified_visits")).otherwise(0))
    entered = F.sum(F.when(F.col("zone_key").contains("entrance"), F.col("visits")).otherwise(0))
    onward = F.sum(F.when(F.col("zone_key").rlike(DOWNSTREAM), F.col("qualified_visits")).otherwise(0))
    return summary.groupBy("camera").agg(
        F.sum("visits").alias("visits"),
        kind("engagement").alias("engaged"),
        kind("checkout").alias("checkouts"),
        F.when(entered > 0, F.round(F.least(F.lit(1.0), onward / entered), 6)).otherwise(0.0).alias("progression_rate"),
        F.round(F.coalesce(F.try_divide(F.sum("dwell_ms"), F.sum("visits")), F.lit(0.0)), 4).alias("avg_dwell_ms"),
        F.count_if(F.col("visits") > 0).alias("active_zones"),
        F.min_by("zone_key", F.struct(-F.col("dwell_ms"), "zone_key")).alias("top_zone"),
    )


def person_summary(visits: DataFrame, tracks: DataFrame) -> DataFrame:
    keys = ["camera", "clip_id", "global_id"]
    events = visits.groupBy(*keys).agg(F.count(F.lit(1)).alias("visits"), F.coalesce(F.sum("dwell_ms"), F.lit(0)).alias("dwell_ms"))
    frames = tracks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_frames"))
    return events.join(frames, keys, "left").select(*keys, "visits", "dwell_ms", F.coalesce("n_frames", F.lit(0)).alias("n_frames"))


def person_fallback(visits: DataFrame, tracks: DataFrame) -> DataFrame:
    """What the boxes alone tell of persons, for clips that have no visits at all."""
    without = tracks.where("global_id > 0").join(visits.select("camera", "clip_id").distinct(), ["camera", "clip_id"], "left_anti")
    return without.groupBy("camera", "clip_id", "global_id").agg(
        F.count(F.lit(1)).alias("n_frames"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"), F.round(F.greatest(F.lit(0), F.max("ms") - F.min("ms")) / 1000.0, 2).alias("duration_s")
    )


def person_export(visits: DataFrame) -> DataFrame:
    return visits.groupBy("camera", "clip_id", "global_id").agg(
        F.count(F.lit(1)).alias("visits"), F.countDistinct("zone_key").alias("n_zones"), F.round(F.coalesce(F.sum("dwell_ms"), F.lit(0)) / 1000.0, 2).alias("total_dwell_s")
    )


def freshness(tracks: DataFrame, visits: DataFrame, zones: DataFrame, cameras: DataFrame, least_ratio: float = 0.25) -> DataFrame:
    """Per camera: what there is of rows, ids and times, and ``ok``, ``warn`` or ``error``."""
    seen = tracks.groupBy("camera").agg(
        F.count(F.lit(1)).alias("track_rows"), F.countDistinct("global_id").alias("track_ids"), F.countDistinct("clip_id").alias("clips"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"), F.count("zone_key").alias("zoned_rows")
    )
    events = visits.groupBy("camera").agg(F.count(F.lit(1)).alias("event_rows"), F.countDistinct("global_id").alias("event_ids"), F.max("exit_ms").alias("max_exit_ms"))
    known = zones.groupBy("camera").agg(F.count(F.lit(1)).alias("zone_defs"))
    joined = cameras.select("camera").join(seen, "camera", "left").join(events, "camera", "left").join(known, "camera", "left")
    joined = joined.fillna(0, ["track_rows", "track_ids", "clips", "zoned_rows", "event_rows", "event_ids", "zone_defs"])
    low = (F.col("event_ids") > 0) & (F.col("event_ids") / F.col("track_ids") < least_ratio)
    return joined.withColumns(
        {
            "zoned_ratio": F.round(F.coalesce(F.try_divide("zoned_rows", "track_rows"), F.lit(0.0)), 6),
            "event_id_ratio": F.round(F.coalesce(F.try_divide("event_ids", "track_ids"), F.lit(0.0)), 6),
            "status": F.when(F.col("track_rows") == 0, "error").when((F.col("zoned_rows") == 0) | (F.col("event_rows") == 0) | low, "warn").otherwise("ok"),
        }
    )


def percent_change(new: Column, old: Column) -> Column:
    """Null where the old value is 0; a negative base turns the sign, as the plain quotient does."""
    return F.when(old != 0, 100.0 * (new - old) / old)


def zone_delta(first: DataFrame, second: DataFrame) -> DataFrame:
    """Zones of two sides, a missing side counted as 0."""
    side = lambda df, s: df.where("zone_key IS NOT NULL").groupBy("zone_key").agg(F.count(F.lit(1)).alias(f"visits_{s}"), F.sum("dwell_ms").alias(f"dwell_{s}"))
    both = side(first, "a").join(side(second, "b"), "zone_key", "full").fillna(0)
    return both.withColumns(
        {
            "visits_delta": F.col("visits_b") - F.col("visits_a"),
            "visits_pct": F.round(percent_change(F.col("visits_b"), F.col("visits_a")), 4),
            "dwell_pct": F.round(percent_change(F.col("dwell_b"), F.col("dwell_a")), 4),
        }
    )


def insights(summary: DataFrame) -> DataFrame:
    """Named findings per zone, from its kind, its average dwell and its share of qualified visits."""
    average = F.coalesce(F.try_divide("dwell_ms", "visits"), F.lit(0.0))
    kind, visits, good, passing = F.col("zone_kind"), F.col("visits"), F.col("qualified_visits"), F.col("transit_visits")
    rules = [
        ((kind == "entrance") & (average >= 8000), "slow_entrance"),
        ((kind == "entrance") & (average <= 3000) & (visits > 5), "smooth_entrance"),
        ((kind == "engagement") & (good == 0) & (visits > 0), "no_engagement"),
        ((kind == "engagement") & (F.col("qualification_rate") >= 0.6) & (good >= 3), "strong_engagement"),
        ((kind == "engagement") & (passing > good) & (visits > 3), "mostly_transit"),
        ((kind == "checkout") & (visits > 0) & (average >= 3000), "checkout_dwell"),
    ]
    return summary.select("camera", "zone_key", F.explode(F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in rules]))).alias("insight"))


def clip_groups(tracks: DataFrame) -> DataFrame:
    """Clips by the first two parts of their names."""
    clips = tracks.where("clip_id IS NOT NULL").select("camera", "clip_id").distinct()
    return clips.groupBy("camera", F.substring_index("clip_id", "_", 2).alias("clip_group")).agg(F.count(F.lit(1)).alias("n_clips"))


def share_gap(items: DataFrame, wide: float = 0.10) -> DataFrame:
    """Shares of two measures ``a`` and ``b`` per ``item`` and how far apart they are."""
    totals = items.agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))
    shares = items.join(F.broadcast(totals)).withColumns({"sa": F.col("a") / F.col("all_a"), "sb": F.col("b") / F.col("all_b")})
    gap = F.abs(F.col("sa") - F.col("sb"))
    return shares.select("item", F.round("sa", 6).alias("share_a"), F.round("sb", 6).alias("share_b"), F.round(gap, 6).alias("gap"), (gap > wide).alias("is_wide"))
