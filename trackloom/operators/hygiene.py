"""Passes that clean identities: rows keep their place, an identity that does not hold becomes 0.

Rows: row_idx, clip_id, frame_idx, global_id, x1, y1, x2, y2 and where frames matter w, h (their size). An identity is
(clip_id, global_id) with a positive global_id; others are left as they are. Ties go to the lower row_idx.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.geometry import area, box, centre, height, width
from trackloom.operators.islands import islands, with_previous
from trackloom.operators.ranking import at_index

_ID = ["clip_id", "global_id"]
#: Frames of a block of a track.
BLOCK = 4096


def _w(b=None) -> Column:
    return F.greatest(width(b or box()), F.lit(1.0))


def _h(b=None) -> Column:
    return F.greatest(height(b or box()), F.lit(1.0))


def positive(rows: DataFrame) -> DataFrame:
    return rows.where("global_id > 0")


def id_extent(rows: DataFrame) -> DataFrame:
    """Per identity: n_rows, first_frame, last_frame, span (frames from first to last)."""
    return positive(rows).groupBy(*_ID).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"), (F.max("frame_idx") - F.min("frame_idx") + 1).alias("span")
    )


def zeroed(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``row_idx, clip_id, frame_idx, global_id`` with the identities in ``gone`` set to 0."""
    marks = gone.select(*_ID).distinct().withColumn("gone", F.lit(True))
    return rows.join(marks, _ID, "left").select("row_idx", "clip_id", "frame_idx", F.when(F.col("gone"), 0).otherwise(F.col("global_id")).cast("bigint").alias("global_id"))


def _one_per_frame(rows: DataFrame, score: Column) -> DataFrame:
    """Of the boxes of an identity in one frame keeps the best; the others become 0."""
    best = Window.partitionBy("clip_id", "frame_idx", "global_id").orderBy(F.desc("score"), "row_idx")
    ranked = rows.withColumn("score", score).withColumn("r", F.row_number().over(best))
    return ranked.select("row_idx", "clip_id", "frame_idx", F.when((F.col("global_id") > 0) & (F.col("r") > 1), 0).otherwise(F.col("global_id")).cast("bigint").alias("global_id"))


def unique_per_frame(rows: DataFrame) -> DataFrame:
    """Keeps the box of the highest .58 area + .20 rows + .14 span + .08 (1 if its aspect is a person's)."""
    fits = F.when((_w() / _h()).between(0.18, 1.10), 1.0).otherwise(0.0)
    score = 0.58 * (_w() * _h()) + 0.20 * F.coalesce("n_rows", F.lit(0)) + 0.14 * F.coalesce("span", F.lit(1)) + 0.08 * fits
    return _one_per_frame(rows.join(id_extent(rows), _ID, "left"), score)


def suppress_duplicates(rows: DataFrame) -> DataFrame:
    """The same with .60 area + .25 rows + .15 aspect."""
    fits = F.when((_w() / _h()).between(0.18, 1.10), 1.0).otherwise(0.0)
    return _one_per_frame(rows.join(id_extent(rows), _ID, "left"), 0.60 * (_w() * _h()) + 0.25 * F.coalesce("n_rows", F.lit(0)) + 0.15 * fits)


def largest_per_frame(rows: DataFrame) -> DataFrame:
    return _one_per_frame(rows, area(box()))


def duplicate_count(rows: DataFrame) -> DataFrame:
    """Per clip, the boxes beyond the first of an identity in a frame."""
    per = positive(rows).groupBy("clip_id", "frame_idx", "global_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("clip_id").agg(F.sum(F.col("n") - 1).alias("n_duplicates"))


def tiny_ids(rows: DataFrame, least_rows: int = 8, least_span: int = 24) -> DataFrame:
    """Identities of fewer than ``least_rows`` boxes, or of fewer than twice as many within a short span."""
    n = F.col("n_rows")
    return id_extent(rows).where((n < least_rows) | ((n < 2 * least_rows) & (F.col("span") < least_span)))


def summary(rows: DataFrame, stable_rows: int = 30, stable_span: int = 32) -> DataFrame:
    """Per clip: boxes, boxes with an identity, identities, stable ones (enough boxes and span), the highest, duplicates."""
    stable = (F.col("n_rows") >= stable_rows) & (F.col("span") >= stable_span)
    ids = id_extent(rows).groupBy("clip_id").agg(F.count(F.lit(1)).alias("n_ids"), F.count_if(stable).alias("n_stable"), F.max("global_id").alias("max_id"))
    totals = rows.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("global_id") > 0).alias("n_positive"))
    return totals.join(ids, "clip_id", "left").join(duplicate_count(rows), "clip_id", "left").fillna(0, ["n_ids", "n_stable", "max_id", "n_duplicates"])


def id_metrics(rows: DataFrame, frames_of: str = "clip_id") -> DataFrame:
    """Per identity: boxes, extent, the share of its span and of its clip's boxes with an identity."""
    total = Window.partitionBy(frames_of)
    return id_extent(rows).withColumns(
        {"density": F.round(F.col("n_rows") / F.col("span"), 6), "share": F.round(F.col("n_rows") / F.sum("n_rows").over(total), 6), "is_stable": (F.col("n_rows") >= 30) & (F.col("span") >= 32)}
    )


def id_distribution(rows: DataFrame) -> DataFrame:
    """Per clip and id, 0 and below included: boxes, share, first and last time, whether unassigned boxes are more than half."""
    per = rows.groupBy(*_ID).agg(F.count(F.lit(1)).alias("n_rows"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))
    clip = Window.partitionBy("clip_id")
    return per.withColumns(
        {
            "share": F.round(F.col("n_rows") / F.sum("n_rows").over(clip), 6),
            "duration_ms": F.col("last_ms") - F.col("first_ms"),
            "mostly_unassigned": F.sum(F.when(F.col("global_id") <= 0, F.col("n_rows")).otherwise(0)).over(clip) * 2 > F.sum("n_rows").over(clip),
        }
    )


def ghost_boxes(rows: DataFrame) -> DataFrame:
    """Sets boxes no person has (aspect, size, narrow strips low on the right) and whole identities made of them to 0."""
    aspect, share_w, share_h = _w() / _h(), _w() / F.col("w"), _h() / F.col("h")
    cx, cy = centre(box())
    right = (cx / F.col("w") >= 0.74) & (cy / F.col("h") >= 0.32)
    odd = (aspect < 0.18) | (aspect > 1.08) | (_w() * _h() / (F.col("w") * F.col("h")) < 0.0032) | (share_w < 0.020) | (share_h < 0.060) | (right & (aspect <= 0.35) & (share_w <= 0.095))
    flagged = rows.withColumns({"odd": (F.col("global_id") > 0) & odd, "right": right, "ux": cx / F.col("w"), "uy": cy / F.col("h")})
    whole = (
        positive(flagged)
        .groupBy(*_ID)
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("odd").alias("n_odd"), F.count_if("right").alias("n_right"), F.stddev_pop("ux").alias("sx"), F.stddev_pop("uy").alias("sy"))
        .where((F.col("n") >= 10) & (F.col("n_odd") / F.col("n") >= 0.62) & (F.col("n_right") / F.col("n") >= 0.45) & (F.hypot("sx", "sy") <= 0.060))
    )
    kept = zeroed(flagged, whole)
    return kept.join(flagged.select("row_idx", "odd"), "row_idx").select("row_idx", "clip_id", "frame_idx", F.when(F.col("odd"), 0).otherwise(F.col("global_id")).cast("bigint").alias("global_id"))


def _at_border(margin: float) -> Column:
    mx, my = F.greatest(F.lit(2), F.floor(margin * F.col("w"))), F.greatest(F.lit(2), F.floor(margin * F.col("h")))
    return (F.col("x1") <= mx) | (F.col("y1") <= my) | (F.col("x2") >= F.col("w") - mx) | (F.col("y2") >= F.col("h") - my)


def border_ghosts(rows: DataFrame, longest: int = 10) -> DataFrame:
    """``row_idx`` of small boxes at the border: narrow strips, and runs of at most ``longest`` such boxes of an identity.

    A run ends at another box of the identity and where two frames or more are missing.
    """
    share_w, share_h = _w() / F.col("w"), _h() / F.col("h")
    share = _w() * _h() / (F.col("w") * F.col("h"))
    cx, cy = centre(box())
    edge = (cx / F.col("w") <= 0.030) | (cx / F.col("w") >= 0.970) | (cy / F.col("h") <= 0.020) | (cy / F.col("h") >= 0.980)
    border = _at_border(0.010)
    marked = positive(rows).withColumns(
        {
            "strip": border & edge & (share <= 0.020 * 1.35) & (share_w <= 0.075) & (_w() / _h() <= 0.42),
            "small": border & (share <= 0.020) & ((share_w <= 0.16) | (share_h <= 0.38)),
        }
    )
    slim = marked.select("row_idx", *_ID, "frame_idx", "strip", "small")
    runs = islands(slim, _ID, ["frame_idx", "row_idx"], F.floor(F.col("frame_idx") / BLOCK), ["frame_idx", "small"], lambda prev: (F.col("small") != prev["small"]) | (F.col("frame_idx") - prev["frame_idx"] > 2), "run")
    sizes = runs.where("small").groupBy(*_ID, "run").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= longest)
    short = runs.where("small").join(sizes, [*_ID, "run"], "left_semi").select("row_idx")
    return short.unionByName(slim.where("strip").select("row_idx")).distinct()


def edge_ghosts(rows: DataFrame, least_rows: int = 120) -> DataFrame:
    """Identities that stay still at a frame's edge and are narrow or low."""
    cx, cy = centre(box())
    base = positive(rows).select(*_ID, (cx / F.col("w")).alias("ux"), (cy / F.col("h")).alias("uy"), (_w() / F.col("w")).alias("uw"), (_h() / F.col("h")).alias("uh"), _at_border(0.012).alias("b"))
    still = base.groupBy(*_ID).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("ux").alias("sx"), F.stddev_pop("uy").alias("sy"), F.count_if("b").alias("nb")).where(
        (F.col("n") >= least_rows) & (F.hypot("sx", "sy") <= 0.010) & (F.col("nb") / F.col("n") >= 0.85)
    )
    left = base.join(still.select(*_ID), _ID, "left_semi")
    half = {"a": lambda n: F.floor((n - 1) / 2), "b": lambda n: F.floor(n / 2)}
    mid = lambda c: at_index(left, _ID, c, F.floor(F.col(c) * 64), half).select(*_ID, ((F.col("a") + F.col("b")) / 2).alias(f"m{c}"))
    return mid("uw").join(mid("uh"), _ID).where((F.col("muw") <= 0.10) | (F.col("muh") <= 0.45)).select(*_ID)


def stationary_ids(rows: DataFrame, least_rows: int = 30, reach: float = 60.0) -> DataFrame:
    """Identities whose centres range over less than ``reach`` pixels from the 5 % to the 95 % position, in x and in y."""
    cx, cy = centre(box())
    base = positive(rows).select(*_ID, cx.alias("cx"), cy.alias("cy"))
    ends = {"lo": lambda n: F.floor(n * 5 / 100), "hi": lambda n: F.least(n - 1, F.floor(n * 95 / 100))}
    reach_of = lambda c: at_index(base, _ID, c, F.floor(F.col(c) / 32), ends).select(*_ID, (F.col("hi") - F.col("lo")).alias(f"range_{c}"))
    enough = base.groupBy(*_ID).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") >= least_rows)
    return (
        enough.join(reach_of("cx"), _ID).join(reach_of("cy"), _ID).select(*_ID, "n_rows", F.round("range_cx", 4).alias("range_cx"), F.round("range_cy", 4).alias("range_cy"))
        .withColumn("is_still", (F.col("range_cx") < reach) & (F.col("range_cy") < reach))
    )


def motion_of_ids(rows: DataFrame) -> DataFrame:
    """Per identity: way and distance from first to last box in units of its median height, spread of its centres."""
    cx, cy = centre(box())
    base = positive(rows).select("row_idx", *_ID, "frame_idx", cx.alias("cx"), cy.alias("cy"), _h().alias("hh"))
    steps = with_previous(base, _ID, ["frame_idx", "row_idx"], F.floor(F.col("frame_idx") / BLOCK), ["cx", "cy"])
    order = F.struct("frame_idx", "row_idx")
    moved = steps.groupBy(*_ID).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.hypot(F.col("cx") - F.col("prev.cx"), F.col("cy") - F.col("prev.cy"))).alias("way"),
        F.max_by(F.struct("cx", "cy"), order).alias("last"),
        F.min_by(F.struct("cx", "cy"), order).alias("first"),
        F.stddev_pop("cx").alias("sx"),
        F.stddev_pop("cy").alias("sy"),
    )
    half = {"a": lambda n: F.floor((n - 1) / 2), "b": lambda n: F.floor(n / 2)}
    tall = at_index(base, _ID, "hh", F.floor(F.col("hh") / 8), half).select(*_ID, ((F.col("a") + F.col("b")) / 2).alias("med_h"))
    far = F.hypot(F.col("last.cx") - F.col("first.cx"), F.col("last.cy") - F.col("first.cy"))
    return moved.join(tall, _ID).select(
        *_ID,
        "n_rows",
        F.round(F.coalesce("way", F.lit(0.0)) / F.col("med_h"), 4).alias("way_norm"),
        F.round(far / F.col("med_h"), 4).alias("far_norm"),
        F.round("sx", 4).alias("spread_x"),
        F.round("sy", 4).alias("spread_y"),
    )


def static_ids(rows: DataFrame, least_rows: int = 220) -> DataFrame:
    """Identities that hardly move: short way, end near their start, little spread."""
    return motion_of_ids(rows).where((F.col("n_rows") >= least_rows) & (F.col("way_norm") <= 1.0) & (F.col("far_norm") <= 0.20) & (F.col("spread_x") <= 35) & (F.col("spread_y") <= 35))


def compact_ids(rows: DataFrame, least_rows: int = 25, least_span: int = 26) -> DataFrame:
    """Old and new ids: numbered from 1 within a clip by first row; identities with few boxes in a short span become 0."""
    ids = id_extent(rows).join(positive(rows).groupBy(*_ID).agg(F.min("row_idx").alias("first_row")), _ID)
    keep = (F.col("n_rows") >= least_rows) | (F.col("span") >= least_span)
    numbers = ids.where(keep).withColumn("new_id", F.row_number().over(Window.partitionBy("clip_id").orderBy("first_row")).cast("bigint"))
    return ids.select(*_ID).join(numbers.select(*_ID, "new_id"), _ID, "left").fillna(0, ["new_id"])


def canonical_numbers(rows: DataFrame, stable_rows: int = 30, stable_span: int = 32) -> DataFrame:
    """Old and new ids: stable identities 1..S by first frame, then the others."""
    stable = (F.col("n_rows") >= stable_rows) & (F.col("span") >= stable_span)
    order = Window.partitionBy("clip_id").orderBy(F.desc("is_stable"), "first_frame", "global_id")
    return id_extent(rows).withColumn("is_stable", stable).withColumn("new_id", F.row_number().over(order).cast("bigint")).select(*_ID, "is_stable", "new_id")


def enforce_canonical(rows: DataFrame, n: int, stable_rows: int = 30, stable_span: int = 32) -> DataFrame:
    """Old and new ids so that only 1..n remain: the strongest stable other ids take the free places, the rest become 0."""
    ids = id_extent(rows)
    stable = (F.col("n_rows") >= stable_rows) & (F.col("span") >= stable_span)
    slots = rows.select("clip_id").distinct().select("clip_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(n).cast("bigint"))).alias("slot"))
    taken = ids.where(F.col("global_id") <= n).select("clip_id", F.col("global_id").alias("slot"))
    free = slots.join(taken, ["clip_id", "slot"], "left_anti").withColumn("k", F.row_number().over(Window.partitionBy("clip_id").orderBy("slot")))
    strength = Window.partitionBy("clip_id").orderBy(F.desc("n_rows"), F.desc("span"), "first_frame", "global_id")
    movers = ids.where((F.col("global_id") > n) & stable).withColumn("k", F.row_number().over(strength))
    moved = movers.join(free, ["clip_id", "k"]).select(*_ID, F.col("slot").alias("new_id"))
    return ids.select(*_ID).join(moved, _ID, "left").select(*_ID, F.coalesce("new_id", F.when(F.col("global_id") <= n, F.col("global_id")), F.lit(0)).alias("new_id"))


def keep_largest(rows: DataFrame, n: int) -> DataFrame:
    """Old and new ids: per clip the ``n`` identities of most boxes stay, the rest become 0."""
    order = Window.partitionBy("clip_id").orderBy(F.desc("n_rows"), "global_id")
    ranked = id_extent(rows).withColumn("k", F.row_number().over(order))
    return ranked.select(*_ID, F.when(F.col("k") <= n, F.col("global_id")).otherwise(0).cast("bigint").alias("new_id"))


def remapped(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """Rows under the new ids of ``numbers`` (clip_id, global_id, new_id); ids without an entry stay."""
    return rows.join(numbers.select(*_ID, "new_id"), _ID, "left").select("row_idx", "clip_id", "frame_idx", F.coalesce("new_id", "global_id").alias("global_id"))


def converge(rows: DataFrame, least_rows: int = 30, least_span: int = 32) -> DataFrame:
    """Per clip, identities before and after fragments (few boxes and a short span) are dropped."""
    fragment = (F.col("n_rows") < least_rows) & (F.col("span") < least_span)
    return id_extent(rows).groupBy("clip_id").agg(
        F.count(F.lit(1)).alias("n_before"), F.count_if(~fragment).alias("n_after"), F.count_if(fragment).alias("n_dropped"), F.coalesce(F.sum(F.when(fragment, F.col("n_rows"))), F.lit(0)).alias("rows_dropped")
    )


def segments(rows: DataFrame, gap: int = 2, keys: tuple[str, ...] = ("clip_id", "global_id")) -> DataFrame:
    """Stretches of an identity without more than ``gap`` frames between boxes: seg, start_frame, end_frame, n_rows, first and last centre."""
    cx, cy = centre(box())
    base = positive(rows).select("row_idx", *keys, "frame_idx", cx.alias("cx"), cy.alias("cy"), _h().alias("hh"))
    cut = islands(base, list(keys), ["frame_idx", "row_idx"], F.floor(F.col("frame_idx") / BLOCK), ["frame_idx"], lambda prev: F.col("frame_idx") - prev["frame_idx"] > gap, "seg")
    order = F.struct("frame_idx", "row_idx")
    point = F.struct("cx", "cy")
    grouped = cut.groupBy(*keys, "seg").agg(
        F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("end_frame"), F.count(F.lit(1)).alias("n_rows"), F.min_by(point, order).alias("p"), F.max_by(point, order).alias("q")
    )
    return grouped.select(*keys, F.col("seg").cast("bigint").alias("seg"), "start_frame", "end_frame", "n_rows", *[F.round(F.col(f"{e}.{c}"), 4).alias(f"{n}_{c}") for e, n in (("p", "start"), ("q", "end")) for c in ("cx", "cy")])


def jump_splits(rows: DataFrame, gap: int = 6, far: float = 0.6, least: int = 18) -> DataFrame:
    """Identities cut where the centre jumps by ``far`` heights or more within ``gap`` frames. Segments of ``least`` boxes count: the
    first keeps the id, later ones get ids above the clip's highest, by id and segment; others stay. Identities with fewer than
    twice that many boxes (24 at least) stay whole. Result: clip_id, global_id, seg, n_rows, new_id."""
    cx, cy = centre(box())
    big = id_extent(rows).where(F.col("n_rows") >= max(2 * least, 24)).select(*_ID)
    base = positive(rows).join(big, _ID, "left_semi").select("row_idx", *_ID, "frame_idx", cx.alias("cx"), cy.alias("cy"), _h().alias("hh"))

    def jump(prev: Column) -> Column:
        apart = F.hypot(F.col("cx") - prev["cx"], F.col("cy") - prev["cy"]) / F.greatest("hh", prev["hh"])
        return (F.col("frame_idx") - prev["frame_idx"] <= gap) & (apart >= far)

    cut = islands(base, _ID, ["frame_idx", "row_idx"], F.floor(F.col("frame_idx") / BLOCK), ["frame_idx", "cx", "cy", "hh"], jump, "seg")
    sizes = cut.groupBy(*_ID, "seg").agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") >= least)
    nth = sizes.withColumn("k", F.row_number().over(Window.partitionBy(*_ID).orderBy("seg")))
    top = positive(rows).groupBy("clip_id").agg(F.max("global_id").alias("top"))
    later = nth.where("k > 1").withColumn("j", F.row_number().over(Window.partitionBy("clip_id").orderBy("global_id", "seg"))).join(top, "clip_id")
    return nth.where("k = 1").select(*_ID, "seg", "n_rows", F.col("global_id").alias("new_id")).unionByName(later.select(*_ID, "seg", "n_rows", (F.col("top") + F.col("j")).alias("new_id")))


def largest_gaps(rows: DataFrame) -> DataFrame:
    """Per identity its longest absence: after which frame, and for how many frames (the first of equal ones)."""
    base = positive(rows).select("row_idx", *_ID, "frame_idx")
    steps = with_previous(base, _ID, ["frame_idx", "row_idx"], F.floor(F.col("frame_idx") / BLOCK), ["frame_idx"]).where("prev IS NOT NULL")
    gap = F.col("frame_idx") - F.col("prev.frame_idx")
    return steps.groupBy(*_ID).agg(F.max(F.struct(gap.alias("gap"), (-F.col("prev.frame_idx")).alias("at"))).alias("g")).select(*_ID, F.col("g.gap").alias("gap"), (-F.col("g.at")).alias("after_frame"))


def predicted(rows: DataFrame) -> DataFrame:
    """How near a box lies to where the two boxes before it lead at constant speed: exp(-distance / height)."""
    cx, cy = centre(box())
    base = positive(rows).select("row_idx", *_ID, "frame_idx", cx.alias("cx"), cy.alias("cy"), _h().alias("hh"))
    block, order = F.floor(F.col("frame_idx") / BLOCK), ["frame_idx", "row_idx"]
    one = with_previous(base, _ID, order, block, ["frame_idx", "cx", "cy"], "p")
    two = with_previous(one, _ID, order, block, ["p"], "q")
    last, before = F.col("p"), F.col("q.p")
    dt, lead = F.greatest(F.lit(1), last["frame_idx"] - before["frame_idx"]), F.col("frame_idx") - last["frame_idx"]
    px = last["cx"] + (last["cx"] - before["cx"]) / dt * lead
    py = last["cy"] + (last["cy"] - before["cy"]) / dt * lead
    return two.where(before.isNotNull()).select("row_idx", F.round(F.exp(-F.hypot(F.col("cx") - px, F.col("cy") - py) / F.col("hh")), 6).alias("score"))


def sampled(rows: DataFrame, k: int = 8) -> DataFrame:
    """``k`` boxes of each identity at even steps from its first to its last (all of them if it has no more)."""
    from trackloom.operators.ranking import blocked_rank

    base = positive(rows).select("row_idx", *_ID, "frame_idx")
    ranked = blocked_rank(base, _ID, ["frame_idx", "row_idx"], F.floor(F.col("frame_idx") / BLOCK), "r")
    sizes = base.groupBy(*_ID).agg(F.count(F.lit(1)).alias("n"))
    both = ranked.join(sizes, _ID).withColumn("i", F.col("r") - 1)
    # Position i is taken if it is floor(j (n - 1) / (k - 1)) for some j.
    j = F.ceil(F.col("i") * (k - 1) / F.greatest(F.col("n") - 1, F.lit(1)))
    taken = (F.col("n") <= k) | ((j <= k - 1) & (F.floor(j * (F.col("n") - 1) / (k - 1)) == F.col("i")))
    return both.where(taken).select(*_ID, "row_idx")
