"""Problem 6: runs of repeated consecutive events collapsed into one record each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.keys import whole_ms, zone_key
from trackloom.session import durable

#: Frames that one block of a track spans.
BLOCK_FRAMES = 2048


def _resolved(matches: Column) -> Column:
    """Pointer doubling inside a block. ``matches[i]``: event i equals its predecessor. Gives for every event its run's start.

    Matching events point to their predecessor, others to themselves; then every pointer is replaced by its pointer's pointer
    as often as the number of events can be halved.
    """
    first = F.transform(matches, lambda m, i: F.when(m, i - 1).otherwise(i))
    rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(F.size(matches))).cast("int")))
    return F.aggregate(rounds, first, lambda pointers, _: F.transform(pointers, lambda p: F.get(pointers, p)))


def _chase(links: DataFrame, track: list[str]) -> DataFrame:
    """Pointer doubling across blocks by self-joins. ``links``: node, to, to_run of the nodes that are no run starts.

    In every round a pointer to another node of ``links`` is replaced by that node's pointer, so pointers grow by powers of two;
    rounds end when no pointer leads to a node that points on. Each round is checkpointed.
    """
    on = (F.col("a.clip_id").eqNullSafe(F.col("b.clip_id"))) & (F.col("a.global_id") == F.col("b.global_id")) & (F.col("a.to") == F.col("b.node"))
    links = durable(links)
    while True:
        joined = links.alias("a").join(links.alias("b"), on, "left")
        links = durable(
            joined.select(
                *[F.col(f"a.{c}").alias(c) for c in track],
                F.col("a.node").alias("node"),
                F.coalesce("b.to", "a.to").alias("to"),
                F.coalesce("b.to_run", "a.to_run").alias("to_run"),
                F.col("b.node").isNotNull().alias("moved"),
            )
        )
        moving = links.agg(F.count_if("moved")).first()[0]
        links = links.drop("moved")
        if not moving:
            return links


def zone_stays(tracks: DataFrame, least: int = 2, block_frames: int = BLOCK_FRAMES) -> DataFrame:
    """Unbroken stays of every track: ``clip_id, global_id, zone_key, start_frame, end_frame, n_events, start_ms, end_ms, duration_ms``.

    Method, pointer doubling. An event whose zone equals that of its predecessor (by frame) in the track points to it; pointers
    are replaced by their pointers' pointers until all reach the start of their run. A track is cut into blocks of frames, so
    that no task holds a whole track: inside a block the pointers are doubled in an array (at most ``block_frames`` events),
    which also collapses the events before they are shuffled again; runs that fill whole blocks are linked from block to block,
    and these pointers are doubled by logarithmically many self-joins. With ``block_frames=1`` every event is linked by joins.

    Defined cases: rows without a positive ``global_id``, with a null (NaN, infinite) ``ts`` or a null ``frame_idx`` are no events;
    rows of one frame are one event (the lowest id's); events outside any zone end a run and form none; pauses do not; a
    null ``clip_id`` is a clip of its own; runs of fewer than ``least`` events are left out; an empty table gives no rows.
    """
    track, part = ["clip_id", "global_id"], ["clip_id", "global_id", "block"]
    events = (
        tracks.select("id", *track, "frame_idx", whole_ms(F.col("ts")).alias("ms"), "zone_id")
        .where("global_id > 0 AND ms IS NOT NULL AND frame_idx IS NOT NULL")
        .select(*track, F.floor(F.col("frame_idx") / block_frames).cast("bigint").alias("block"), "frame_idx", "id", "ms", "zone_id")
        .repartition(*part)
        .groupBy(*part, "frame_idx")
        .agg(F.min(F.struct("id", "ms", "zone_id")).alias("e"))
        .select(*part, F.struct(F.col("frame_idx").alias("frame"), F.col("e.ms").alias("ms"), zone_key(F.col("e.zone_id")).alias("zone")).alias("e"))
    )
    blocks = events.groupBy(*part).agg(F.array_sort(F.collect_list("e")).alias("es"))
    matching = F.transform("es", lambda e, i: (i > 0) & F.coalesce(e["zone"] == F.get(F.col("es"), i - 1)["zone"], F.lit(False)))
    pointed = blocks.select(*part, "es", _resolved(matching).alias("start"))
    runs = (
        pointed.select(*part, F.explode(F.arrays_zip("es", "start")).alias("p"))
        .groupBy(*part, F.col("p.start").alias("run"))
        .agg(
            F.first("p.es.zone").alias("zone_key"),
            F.min("p.es.frame").alias("start_frame"),
            F.max("p.es.frame").alias("end_frame"),
            F.count(F.lit(1)).alias("n_events"),
            F.min_by("p.es.ms", "p.es.frame").alias("start_ms"),
            F.max_by("p.es.ms", "p.es.frame").alias("end_ms"),
        )
    )
    runs = durable(runs)

    # One row per block: its first and last run. The first run of a block may continue the last one of the block before it.
    ends = runs.groupBy(*part).agg(
        F.min_by("zone_key", "run").alias("first_zone"), F.max_by("zone_key", "run").alias("last_zone"), F.max("run").alias("last_run")
    )
    in_order = Window.partitionBy(*track).orderBy("block")
    linked = ends.select(
        *track,
        F.col("block").alias("node"),
        "first_zone",
        "last_run",
        F.lag("last_zone").over(in_order).alias("zone_before"),
        F.lag("block").over(in_order).alias("to"),
        F.lag("last_run").over(in_order).alias("to_run"),
    ).where("first_zone = zone_before")
    linked = durable(linked)
    # A block that is one run hands its pointer on; others only receive.
    chains = _chase(linked.where("last_run = 0").select(*track, "node", "to", "to_run"), track)
    heads = linked.where("last_run > 0").select(*track, "node", "to", "to_run")
    on = F.col("h.clip_id").eqNullSafe(F.col("c.clip_id")) & (F.col("h.global_id") == F.col("c.global_id")) & (F.col("h.to") == F.col("c.node"))
    heads = heads.alias("h").join(chains.alias("c"), on, "left").select(
        *[F.col(f"h.{c}").alias(c) for c in track], F.col("h.node").alias("node"), F.coalesce("c.to", "h.to").alias("to"), F.coalesce("c.to_run", "h.to_run").alias("to_run")
    )
    roots = chains.unionByName(heads)
    on = F.col("r.clip_id").eqNullSafe(F.col("o.clip_id")) & (F.col("r.global_id") == F.col("o.global_id")) & (F.col("r.block") == F.col("o.node")) & (F.col("r.run") == 0)
    rooted = runs.alias("r").join(roots.alias("o"), on, "left")
    return (
        rooted.where("r.zone_key IS NOT NULL")
        .groupBy(
            F.col("r.clip_id").alias("clip_id"),
            F.col("r.global_id").alias("global_id"),
            F.coalesce("o.to", "r.block").alias("root_block"),
            F.coalesce("o.to_run", "r.run").alias("root_run"),
        )
        .agg(
            F.first("r.zone_key").alias("zone_key"),
            F.min("r.start_frame").alias("start_frame"),
            F.max("r.end_frame").alias("end_frame"),
            F.sum("r.n_events").alias("n_events"),
            F.min_by("r.start_ms", "r.start_frame").alias("start_ms"),
            F.max_by("r.end_ms", "r.end_frame").alias("end_ms"),
        )
        .where(F.col("n_events") >= least)
        .select(*track, "zone_key", "start_frame", "end_frame", "n_events", "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"))
    )
