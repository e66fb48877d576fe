"""Problem 1: activity grouped into sessions by start-end pairing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.keys import whole_ms
from trackloom.operators.ranking import block_offsets

#: A pause of more than this many milliseconds ends a session.
GAP_MS = 30_000
#: Length of the time blocks into which a track is cut. A block holds at most BLOCK_MS / GAP_MS + 1 sessions.
BLOCK_MS = 3_600_000


def presence_sessions(tracks: DataFrame, gap_ms: int = GAP_MS, block_ms: int = BLOCK_MS) -> DataFrame:
    """Every session of every track (clip_id, global_id): ``start_ms, end_ms, duration_ms, n_boxes``.

    Method, start-end pairing. Boxes are cut into (track, time block); a box within ``gap_ms`` of a block's edge also goes to
    the neighbour as a halo row. RANGE frames over whole milliseconds find the boxes without a box in the ``gap_ms`` before
    them (starts) and after them (ends). Starts and ends are numbered separately, within the block and then by the block's
    offset within its track, and equal ranks are brought together. The number of boxes is the difference of the two boxes' own ranks.
    No task holds more of a track than one block; the window over a whole track sees one row per block.

    Defined cases: rows with a null, NaN or infinite ``ts`` and rows with ``global_id`` null or not positive form no session;
    a null ``clip_id`` is a clip of its own; equal times are one point that counts each row (a box delivered twice counts
    twice in ``n_boxes``); a pause of exactly ``gap_ms`` does not split; an empty table gives no rows. Other columns, also
    clashing ones, are ignored.
    """
    if not 0 < gap_ms < block_ms:
        raise ValueError("0 < gap_ms < block_ms")
    track, part = ["clip_id", "global_id"], ["clip_id", "global_id", "block"]
    at = tracks.select("clip_id", "global_id", whole_ms(F.col("ts")).alias("ms")).where("global_id > 0 AND ms IS NOT NULL")
    own = F.floor(F.col("ms") / block_ms).cast("bigint")
    into = F.pmod(F.col("ms"), F.lit(block_ms))
    homes = F.array_compact(
        F.array(own, F.when(into < gap_ms, own - 1), F.when(into >= block_ms - gap_ms, own + 1))
    )
    placed = (
        at.select(*track, "ms", own.alias("own"), F.explode(homes).alias("block"))
        .repartition(*part)
        .groupBy(*part, "ms")
        .agg(F.sum((F.col("own") == F.col("block")).cast("bigint")).alias("n"))
    )
    by_time = Window.partitionBy(*part).orderBy("ms")
    earlier = by_time.rangeBetween(-gap_ms, -1)
    later = by_time.rangeBetween(1, gap_ms)
    seen = by_time.rowsBetween(Window.unboundedPreceding, 0)
    marked = placed.select(
        *part,
        "ms",
        "n",
        (F.count("ms").over(earlier) == 0).alias("is_start"),
        (F.count("ms").over(later) == 0).alias("is_end"),
        F.sum("n").over(seen).alias("rank_in"),
    ).where("n > 0")
    point = F.struct("ms", "rank_in", "n")
    blocks = marked.groupBy(*part).agg(
        F.sum("n").alias("boxes"),
        F.array_sort(F.collect_list(F.when(F.col("is_start"), point))).alias("starts"),
        F.array_sort(F.collect_list(F.when(F.col("is_end"), point))).alias("ends"),
    )
    sized = blocks.withColumns({"n_starts": F.size("starts").cast("bigint"), "n_ends": F.size("ends").cast("bigint")})
    placed_blocks = block_offsets(sized, track, "block", ["boxes", "n_starts", "n_ends"])

    # Starts and ends of equal rank meet in one aggregation, most of them before it shuffles.
    none = F.lit(None).cast("bigint")
    start = lambda p, i: F.struct((F.col("n_starts_before") + i).alias("rank"), p["ms"].alias("start_ms"), (F.col("boxes_before") + p["rank_in"] - p["n"]).alias("start_box"), none.alias("end_ms"), none.alias("end_box"))
    end = lambda p, i: F.struct((F.col("n_ends_before") + i).alias("rank"), none.alias("start_ms"), none.alias("start_box"), p["ms"].alias("end_ms"), (F.col("boxes_before") + p["rank_in"]).alias("end_box"))
    ranked = placed_blocks.select(*track, F.explode(F.concat(F.transform("starts", start), F.transform("ends", end))).alias("p"))
    pairs = ranked.groupBy(*track, "p.rank").agg(*[F.max(f"p.{c}").alias(c) for c in ("start_ms", "start_box", "end_ms", "end_box")])
    return pairs.select(*track, "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), (F.col("end_box") - F.col("start_box")).alias("n_boxes"))
