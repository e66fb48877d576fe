"""Problem 4: overlapping intervals merged into periods, and the gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.keys import whole_ms, zone_key
from trackloom.session import durable

#: Gaps longer than this are not reported.
LONGEST_GAP_MS = 3_600_000
#: Width of the blocks by which a large entity's boundaries are ranked.
BLOCK_MS = 3_600_000

_ENTITY = ["clip_id", "global_id", "zone_key"]


def visit_intervals(visits: DataFrame) -> DataFrame:
    """The intervals that count: assigned persons, a zone key, an end after the start; whole milliseconds.

    Visits outside any zone have no zone key and are left out; a null ``clip_id`` is a clip of its own.
    """
    return visits.select(
        "clip_id", "global_id", zone_key(F.col("zone_id")).alias("zone_key"), whole_ms(F.col("t_enter")).alias("enter"), whole_ms(F.col("t_exit")).alias("leave")
    ).where("global_id > 0 AND zone_key IS NOT NULL AND leave > enter")


def merge_intervals(intervals: DataFrame, longest_gap_ms: int = LONGEST_GAP_MS, block_ms: int = BLOCK_MS) -> DataFrame:
    """Continuous periods and gaps of each entity (clip_id, global_id, zone_key) from ``enter``, ``leave`` in milliseconds.

    Method. The starts and the ends of an entity are ranked independently of each other. Between rank k and k + 1 lies a gap
    exactly where start k + 1 exceeds end k. The first start and the start after every gap, and the end before every gap and
    the last end, are numbered once more; equal numbers are the two boundaries of a period, and the end of one number and the
    start of the next those of a gap.

    An entity is cut into blocks of time, so that one with a third of all rows is spread over many tasks. A block holds its
    starts and its ends in order; the ranks of both differ from those within the entity by what lies before the block, and of that
    only the difference matters here: the intervals that are open where the block begins. A start whose rank's end lies in an
    earlier block exceeds it, one whose end lies in a later block does not, and likewise for ends; the others are compared
    within the block. Windows over an entity see one row of counts per block.

    Repeated intervals change nothing; touching ones merge; nulls in the keys form an entity of their own; an empty table gives
    no rows. Result: clip_id, global_id, zone_key, kind (``period`` or ``gap``), start_ms, end_ms, with gaps of at most
    ``longest_gap_ms``.
    """
    at = lambda name: F.floor(F.col(name) / block_ms).cast("bigint").alias("block")
    none = F.lit(None).cast("bigint")
    once = intervals.select(F.struct(*_ENTITY).alias("of"), "enter", "leave").distinct()
    ends_of = F.array(F.struct(at("enter"), F.col("enter"), none.alias("leave")), F.struct(at("leave"), none.alias("enter"), F.col("leave")))
    points = once.select("of", F.explode(ends_of).alias("p"))
    # One struct names a block: joins on it keep the partitioning, and its null fields are equal.
    blocks = durable(
        points.groupBy(F.struct("of", F.col("p.block").alias("block")).alias("part")).agg(
            F.array_sort(F.collect_list("p.enter")).alias("starts"), F.array_sort(F.collect_list("p.leave")).alias("ends")
        )
    )
    earlier = Window.partitionBy("part.of").orderBy("part.block").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda count: F.coalesce(F.sum(count).over(earlier), F.lit(0).cast("bigint"))
    sizes = blocks.select("part", (F.size("starts") - F.size("ends")).cast("bigint").alias("more"))
    opened = sizes.select("part", before("more").cast("int").alias("open"))
    open_, starts, ends = F.col("open"), F.col("starts"), F.col("ends")
    # Start i (from 0) meets end i - 1 + open of the block, end j start j + 1 - open; outside the block the blocks' order decides.
    opens = lambda s, i: (open_ + i <= 0) | F.coalesce(s > F.get(ends, open_ + i - 1), F.lit(False))
    closes = lambda e, j: (j + 1 - open_ >= F.size(starts)) | ((j + 1 - open_ >= 0) & F.coalesce(F.get(starts, j + 1 - open_) > e, F.lit(False)))
    cuts = blocks.join(opened, "part").select("part", F.filter(starts, opens).alias("first"), F.filter(ends, closes).alias("last"))
    cuts = durable(cuts.where((F.size("first") > 0) | (F.size("last") > 0)))
    numbers = cuts.select("part", F.size("first").cast("bigint").alias("n_first"), F.size("last").cast("bigint").alias("n_last"))
    numbers = numbers.select("part", before("n_first").alias("first_before"), before("n_last").alias("last_before"))

    def side(points: str, number, start=False, end=False, following=False):
        value = lambda on, v: (v if on else none)
        return F.transform(points, lambda v, i: F.struct(number(i).alias("j"), value(start, v).alias("start"), value(end, v).alias("end"), value(following, v).alias("next")))

    numbered = F.concat(
        side("first", lambda i: F.col("first_before") + i + 1, start=True),
        side("first", lambda i: F.col("first_before") + i, following=True),
        side("last", lambda i: F.col("last_before") + i + 1, end=True),
    )
    pairs = cuts.join(numbers, "part").select("part.of", F.explode(numbered).alias("b")).where("b.j > 0")
    pairs = pairs.groupBy("of", "b.j").agg(F.max("b.start").alias("start"), F.max("b.end").alias("end"), F.max("b.next").alias("next"))
    period = F.struct(F.lit("period").alias("kind"), F.col("start").alias("start_ms"), F.col("end").alias("end_ms"))
    gap = F.when(F.col("next") - F.col("end") <= longest_gap_ms, F.struct(F.lit("gap").alias("kind"), F.col("end").alias("start_ms"), F.col("next").alias("end_ms")))
    return pairs.select("of.*", F.explode(F.array_compact(F.array(period, gap))).alias("r")).select(*_ENTITY, "r.*")
