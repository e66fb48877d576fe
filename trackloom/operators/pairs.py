"""Pairs of boxes in one frame, and pairs of identities by the frames they share.

A frame is (clip_id, frame_idx); it holds as many boxes as persons fit into a picture, which bounds what pairs of its boxes cost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.geometry import area, box, centre_distance, containment, intersection, iou
from trackloom.operators.islands import fold_sorted
from trackloom.operators.ranking import block_offsets

_FRAME = ["clip_id", "frame_idx"]
_BOX = ("x1", "y1", "x2", "y2")


def _side(rows: DataFrame, s: str) -> DataFrame:
    return rows.select(*_FRAME, F.col("row_idx").alias(f"row_{s}"), F.col("global_id").alias(f"gid_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in _BOX])


def frame_pairs(rows: DataFrame) -> DataFrame:
    """Every two boxes of a frame once (row_a < row_b), with both identities and boxes."""
    return _side(rows, "a").join(_side(rows, "b"), _FRAME).where("row_a < row_b")


def overlapping_pairs(rows: DataFrame, least: float = 0.1, eps: float = 1e-6) -> DataFrame:
    """Pairs of a frame's boxes with an IoU of at least ``least``: row_a, row_b, iou."""
    value = iou(box(suffix="_a"), box(suffix="_b"), eps)
    return frame_pairs(rows).withColumn("iou", value).where(F.col("iou") >= least).select("row_a", "row_b", F.round("iou", 6).alias("iou"))


def largest_overlap(rows: DataFrame) -> DataFrame:
    """For every box its largest IoU with another of the frame, 0 for a box alone."""
    both = frame_pairs(rows).select("row_a", "row_b", iou(box(suffix="_a"), box(suffix="_b")).alias("v"))
    each = both.select(F.explode(F.array("row_a", "row_b")).alias("row_idx"), "v").groupBy("row_idx").agg(F.max("v").alias("v"))
    return rows.select("row_idx").join(each, "row_idx", "left").select("row_idx", F.round(F.coalesce("v", F.lit(0.0)), 6).alias("overlap"))


def shared_frames(rows: DataFrame) -> DataFrame:
    """Pairs of identities of a clip and the number of frames that hold both: gid_a < gid_b."""
    seen = rows.where("global_id > 0").select(*_FRAME, "global_id").distinct()
    other = seen.select(*_FRAME, F.col("global_id").alias("gid_b"))
    return seen.withColumnRenamed("global_id", "gid_a").join(other, _FRAME).where("gid_a < gid_b").groupBy("clip_id", "gid_a", "gid_b").agg(F.count(F.lit(1)).alias("n_frames"))


def overlap_statistics(rows: DataFrame) -> DataFrame:
    """Pairs of identities that share frames: frames, their share of the shorter one's, mean and largest IoU of their largest boxes."""
    size = Window.partitionBy(*_FRAME, "global_id").orderBy(F.desc(area(box())), "row_idx")
    one = rows.where("global_id > 0").withColumn("r", F.row_number().over(size)).where("r = 1")
    frames = one.groupBy("clip_id", "global_id").agg(F.count(F.lit(1)).alias("n"))
    both = frame_pairs(one)
    low = both.select(
        "clip_id", F.least("gid_a", "gid_b").alias("gid_a"), F.greatest("gid_a", "gid_b").alias("gid_b"), iou(box(suffix="_a"), box(suffix="_b")).alias("v")
    ).where("gid_a < gid_b")
    stats = low.groupBy("clip_id", "gid_a", "gid_b").agg(F.count(F.lit(1)).alias("n_frames"), F.avg("v").alias("mean"), F.max("v").alias("most"))
    a = frames.select("clip_id", F.col("global_id").alias("gid_a"), F.col("n").alias("na"))
    b = frames.select("clip_id", F.col("global_id").alias("gid_b"), F.col("n").alias("nb"))
    joined = stats.join(a, ["clip_id", "gid_a"]).join(b, ["clip_id", "gid_b"])
    return joined.select("clip_id", "gid_a", "gid_b", "n_frames", F.round(F.col("n_frames") / F.least("na", "nb"), 6).alias("share"), F.round("mean", 6).alias("mean_iou"), F.round("most", 6).alias("max_iou"))


def disjoint_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of identities of a clip that never share a frame, so that they may be one person."""
    ids = rows.where("global_id > 0").select("clip_id", "global_id").distinct()
    pairs = ids.withColumnRenamed("global_id", "gid_a").join(ids.select("clip_id", F.col("global_id").alias("gid_b")), "clip_id").where("gid_a < gid_b")
    return pairs.join(shared_frames(rows), ["clip_id", "gid_a", "gid_b"], "left_anti")


def contained_pairs(rows: DataFrame, least_hits: int = 2, least_iou: float = 0.48, contained: float = 0.84, near: float = 0.42) -> DataFrame:
    """Boxes of two identities that lie in each other, for pairs of identities where it happens ``least_hits`` times."""
    a, b = box(suffix="_a"), box(suffix="_b")
    same = (F.greatest(iou(a, b) - least_iou, containment(a, b) - contained) >= 0) & (centre_distance(a, b) <= near)
    real = (intersection(a, b) > 0) & (area(a) > 1) & (area(b) > 1)
    hits = frame_pairs(rows.where("global_id > 0")).where("gid_a <> gid_b").where(real & same)
    events = hits.select(*_FRAME, "row_a", "row_b", "gid_a", "gid_b", area(a).alias("area_a"), area(b).alias("area_b"), F.least("gid_a", "gid_b").alias("g"), F.greatest("gid_a", "gid_b").alias("h"))
    often = events.groupBy("clip_id", "g", "h").agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= least_hits)
    return events.join(often, ["clip_id", "g", "h"])


class _Drops:
    """Of two boxes the weaker becomes 0; a box that is 0 already does not count against another."""

    def __init__(self, key: tuple) -> None:
        self.gone: set[int] = set()

    def step(self, row):
        a, b = int(row.row_a), int(row.row_b)
        if a in self.gone or b in self.gone:
            return
        weak = a if (row.n_a, row.area_a) < (row.n_b, row.area_b) else b
        self.gone.add(weak)
        yield (weak,)

    def end(self):
        return ()


def contained_duplicates(rows: DataFrame) -> DataFrame:
    """``row_idx`` of boxes to set to 0: of each contained pair the identity with fewer boxes (then the smaller box) goes.

    Pairs of a frame are taken in the order of their identities and rows, as an earlier decision can spare a later one.
    """
    counts = rows.where("global_id > 0").groupBy("clip_id", "global_id").agg(F.count(F.lit(1)).alias("n"))
    events = contained_pairs(rows)
    for s in ("a", "b"):
        events = events.join(counts.select("clip_id", F.col("global_id").alias(f"gid_{s}"), F.col("n").alias(f"n_{s}")), ["clip_id", f"gid_{s}"])
    slim = events.select(*_FRAME, "g", "h", "row_a", "row_b", "n_a", "n_b", "area_a", "area_b")
    return fold_sorted(slim, _FRAME, ["g", "h", "row_a", "row_b"], _Drops, "row_idx bigint")


def last_positions(rows: DataFrame, asked: DataFrame, block_frames: int = 4096) -> DataFrame:
    """As-of join, backward and strict: for each ``asked`` (ask_id, clip_id, global_id, frame_idx) the identity's last box before.

    Positions and questions are united and ordered within blocks of frames; the last box of the blocks before is handed on by a
    window over one row per block. Questions without an earlier box have nulls.
    """
    keys = ["clip_id", "global_id"]
    have = rows.where("global_id > 0").groupBy(*keys, "frame_idx").agg(F.min(F.struct("row_idx", *_BOX)).alias("b"))
    have = have.select(*keys, "frame_idx", F.lit(None).cast("bigint").alias("ask_id"), F.lit(1).alias("kind"), F.struct("frame_idx", "b.*").alias("pos"))
    want = asked.select(*keys, "frame_idx", "ask_id", F.lit(0).alias("kind"), F.lit(None).cast(have.schema["pos"].dataType).alias("pos"))
    parts = [*keys, "block"]
    both = have.unionByName(want).withColumn("block", F.floor(F.col("frame_idx") / block_frames)).repartition(*parts)
    order = Window.partitionBy(*parts).orderBy("frame_idx", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("near", F.last("pos", ignorenulls=True).over(order))
    edges = both.groupBy(*parts).agg(F.max_by("pos", F.when(F.col("kind") == 1, F.col("frame_idx"))).alias("own"))
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(*[F.col(p).alias(f"e_{p}") for p in parts], F.last("own", ignorenulls=True).over(before).alias("far"))
    on = F.lit(True)
    for p in parts:
        on = on & F.col(p).eqNullSafe(F.col(f"e_{p}"))
    answered = seen.where("kind = 0").join(edges, on).withColumn("at", F.coalesce("near", "far"))
    return answered.select("ask_id", F.col("at.frame_idx").alias("last_frame"), F.col("at.row_idx").alias("last_row"), *[F.col(f"at.{c}").alias(c) for c in _BOX])


def best_match(asked: DataFrame, rows: DataFrame, least: float = 0.34) -> DataFrame:
    """For each asked box (ask_id, clip_id, frame_idx, box) the box of the frame with the highest IoU of at least ``least``."""
    a = asked.select("ask_id", *_FRAME, *[F.col(c).alias(f"{c}_a") for c in _BOX])
    b = _side(rows.where("global_id > 0"), "b")
    value = iou(box(suffix="_a"), box(suffix="_b"))
    best = Window.partitionBy("ask_id").orderBy(F.desc("iou"), "row_b")
    edges = a.join(b, _FRAME).withColumn("iou", value).where(F.col("iou") >= least)
    return edges.withColumn("r", F.row_number().over(best)).where("r = 1").select("ask_id", F.col("row_b").alias("row_idx"), F.col("gid_b").alias("global_id"), F.round("iou", 6).alias("iou"))


def not_over_ignored(rows: DataFrame, regions: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows that no ignore region of their frame overlaps with an IoU of ``least`` or more."""
    region = regions.select(*[F.col(c).alias(f"r_{c}") for c in _FRAME], *[F.col(c).alias(f"{c}_r") for c in _BOX])
    same = (F.col("clip_id") == F.col("r_clip_id")) & (F.col("frame_idx") == F.col("r_frame_idx"))
    return rows.join(region, same & (iou(box(), box(suffix="_r"), 1e-9) >= least), "left_anti")


def crowd_windows(rows: DataFrame, least_boxes: int = 4, least_overlap: float = 0.13) -> DataFrame:
    """Stretches of successive frames in which at least ``least_boxes`` boxes overlap by ``least_overlap`` on average."""
    per = rows.select("clip_id", "frame_idx", "row_idx").join(largest_overlap(rows), "row_idx").groupBy(*_FRAME).agg(F.count(F.lit(1)).alias("n"), F.avg("overlap").alias("v"))
    crowded = per.where((F.col("n") >= least_boxes) & (F.col("v") >= least_overlap))
    # Successive frames keep the difference of frame and rank.
    parts = ["clip_id", "block"]
    blocked = crowded.withColumn("block", F.floor(F.col("frame_idx") / 100_000)).withColumn("k", F.row_number().over(Window.partitionBy(*parts).orderBy("frame_idx")))
    sizes = block_offsets(blocked.groupBy(*parts).agg(F.count(F.lit(1)).alias("m")), ["clip_id"], "block", ["m"])
    ranked = blocked.join(sizes.select(*parts, "m_before"), parts).withColumn("island", F.col("frame_idx") - F.col("k") - F.col("m_before"))
    return ranked.groupBy("clip_id", "island").agg(F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("end_frame"), F.round(F.sum(F.col("n") * F.col("v")), 4).alias("pressure")).drop("island")



def clean_boxes(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` boxes of each identity that others cover least, the larger ones first: row_idx, clip_id, global_id."""
    base = rows.where("global_id > 0").join(largest_overlap(rows), "row_idx")
    order = [F.col("overlap"), F.desc("size"), F.col("row_idx")]
    sized = base.select("row_idx", "clip_id", "global_id", "overlap", area(box()).alias("size"), F.pmod(F.xxhash64("row_idx"), F.lit(16)).alias("salt"))
    # A large identity is ranked in parts first.
    part = Window.partitionBy("clip_id", "global_id", "salt").orderBy(*order)
    few = sized.withColumn("r", F.row_number().over(part)).where(F.col("r") <= k)
    whole = Window.partitionBy("clip_id", "global_id").orderBy(*order)
    return few.withColumn("r", F.row_number().over(whole)).where(F.col("r") <= k).select("row_idx", "clip_id", "global_id")
