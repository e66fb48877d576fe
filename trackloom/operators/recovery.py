"""Unassigned boxes: what lies near them, and identities won back from judged boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.geometry import box, iou
from trackloom.operators.linking import majority

_FRAME, _BOX = ["clip_id", "frame_idx"], ["x1", "y1", "x2", "y2"]


def zero_trace(rows: DataFrame) -> DataFrame:
    """Every unassigned box with the assigned box of its frame that overlaps it most: row_idx, near_row, near_gid, iou, reason.

    ``reason``: ``no_box`` (nobody assigned in the frame), ``apart`` (none overlaps), ``covered`` (IoU of a half or more), else ``beside``.
    Ties go to the lower row. Without an overlap near_row is null and near_gid 0.
    """
    free = rows.where("coalesce(global_id, 0) <= 0").select("row_idx", *_FRAME, *[F.col(c).alias(f"{c}_a") for c in _BOX])
    named = rows.where("global_id > 0").select(F.col("row_idx").alias("near_row"), *_FRAME, F.col("global_id").alias("near_gid"), *[F.col(c).alias(f"{c}_b") for c in _BOX])
    met = free.join(named, _FRAME, "left").withColumn("iou", F.when(F.col("near_row").isNotNull(), iou(box(suffix="_a"), box(suffix="_b"), 1e-9)).otherwise(0.0))
    near = F.when(F.col("iou") > 0, F.struct((-F.col("iou")).alias("off"), "near_row", "near_gid"))
    best = met.groupBy("row_idx").agg(F.count("near_row").alias("n"), F.min(near).alias("e"))
    value = F.coalesce(-F.col("e.off"), F.lit(0.0))
    reason = F.when(F.col("n") == 0, "no_box").when(value == 0, "apart").when(value >= 0.5, "covered").otherwise("beside")
    return best.select("row_idx", F.col("e.near_row").alias("near_row"), F.coalesce("e.near_gid", F.lit(0)).cast("bigint").alias("near_gid"), F.round(value, 6).alias("iou"), reason.alias("reason"))


def recovered(judged: DataFrame, rows: DataFrame, least: float = 0.34, support: int = 5, purity: float = 0.60, hits: int = 3, fresh_from: int = 20) -> DataFrame:
    """Unassigned boxes that judged ones tell: row_idx, global_id, is_fresh.

    A person's identity is the one that most of its judged boxes match, with enough ``support`` and ``purity``; a person without one
    who matches at least ``hits`` unassigned boxes gets a free id from ``fresh_from`` on, in the order of the persons. Each judged box
    tells its best unassigned box (ties: the lower row) if that IoU is at least ``least``. An identity stands once in a frame: where a row of
    the frame has it already nothing changes; of several judged boxes that tell it in one frame the first person's lowest one counts, and of
    several identities for one row the last person's (those with known identities come first).
    """
    a = judged.select("ask_id", "person_id", *_FRAME, *[F.col(c).alias(f"{c}_a") for c in _BOX])
    b = rows.select("row_idx", F.coalesce("global_id", F.lit(0)).alias("gid"), *_FRAME, *[F.col(c).alias(f"{c}_b") for c in _BOX])
    met = a.join(b, _FRAME).withColumn("iou", iou(box(suffix="_a"), box(suffix="_b"))).where(F.col("iou") >= least)
    best = met.groupBy("ask_id", "person_id", *_FRAME, (F.col("gid") > 0).alias("named")).agg(F.min(F.struct((-F.col("iou")).alias("off"), "row_idx", "gid")).alias("e"))
    told = best.select("ask_id", "person_id", *_FRAME, "named", "e.row_idx", "e.gid")
    known = majority(told.where("named"), ["clip_id", "person_id"], "gid", support, purity).select("clip_id", "person_id", F.col("gid").alias("target"))
    zero = told.where("NOT named").drop("named", "gid")

    new = zero.groupBy("clip_id", "person_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= hits).join(known, ["clip_id", "person_id"], "left_anti")
    numbered = new.withColumn("k", F.row_number().over(Window.partitionBy("clip_id").orderBy("person_id")))
    # The k-th id from fresh_from on that the clip does not use: an id used moves all later ones up by one.
    used = rows.where(F.col("global_id") >= fresh_from).select("clip_id", F.col("global_id").alias("u")).distinct()
    in_order = F.row_number().over(Window.partitionBy("clip_id").orderBy("u"))
    shifts = used.select("clip_id", F.lit(None).cast("bigint").alias("person_id"), (F.col("u") - fresh_from - in_order + 2).alias("k"), F.lit(0).alias("is_person"))
    merged = shifts.unionByName(numbered.select("clip_id", "person_id", F.col("k").cast("bigint").alias("k"), F.lit(1).alias("is_person")))
    up = F.count_if(F.col("is_person") == 0).over(Window.partitionBy("clip_id").orderBy("k", "is_person").rowsBetween(Window.unboundedPreceding, 0))
    fresh = merged.withColumn("up", up).where("is_person = 1").select("clip_id", "person_id", (F.col("k") + F.col("up") + (fresh_from - 1)).alias("target"))

    targets = known.withColumn("is_fresh", F.lit(False)).unionByName(fresh.withColumn("is_fresh", F.lit(True)))
    options = zero.join(targets, ["clip_id", "person_id"]).join(rows.where("global_id > 0").select(*_FRAME, F.col("global_id").alias("target")).distinct(), [*_FRAME, "target"], "left_anti")
    first = Window.partitionBy(*_FRAME, "target").orderBy("is_fresh", "person_id", "ask_id")
    last = Window.partitionBy("row_idx").orderBy(F.desc("is_fresh"), F.desc("person_id"), F.desc("ask_id"))
    single = options.withColumn("r", F.row_number().over(first)).where("r = 1").withColumn("r", F.row_number().over(last)).where("r = 1")
    return single.select("row_idx", F.col("target").cast("bigint").alias("global_id"), "is_fresh")
