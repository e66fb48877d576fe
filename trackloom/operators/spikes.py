"""Problem 3: implausible spikes, stuck values and impossible boxes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.keys import finite, slug
from trackloom.session import broadcast_if_small, durable, measured, ship_package

_BOX = ("x1", "y1", "x2", "y2")


@dataclass(frozen=True)
class SpikeRules:
    """Parameters of the control charts and of the rules that follow them.

    ``far``: a spike departs by more than so many median changes of its camera. ``longest``: boxes in a spike. ``stuck``: equal
    boxes in a row. ``outside``: share of the frame by which a side may leave it. ``pause_s``: a longer pause starts a track's
    chart anew. ``level``, ``scale``, ``trend``: weights of a new value in the mean, in the scale and, while something moves fast, in the slope. ``limit``: suspected beyond so many
    scales, and beyond ``least`` to ``most`` median changes at any scale. ``clip``: share of the limit that a suspected value may
    move the mean by. ``block``: frames a block of a track spans.
    """

    far: float = 20.0
    longest: int = 3
    stuck: int = 8
    outside: float = 0.25
    pause_s: float = 2.0
    level: float = 0.7
    scale: float = 0.1
    trend: float = 0.2
    limit: float = 4.0
    least: float = 2.0
    most: float = 8.0
    clip: float = 0.25
    block: int = 8192


#: Rows of a track that a block sees before its own (to warm the charts) and after them.
BEFORE, AFTER = 24, 8
#: Rows of a chart that run in step with others in the numpy fold, and rows ahead of them that warm it up: of what a chart knew before,
#: a thousandth is left after these.
_STRIDE, _WARM = 1024, 64

_ROW = "struct<frame:bigint,n:bigint,id:bigint,id2:bigint,x1:double,y1:double,x2:double,y2:double>"


def impossible(frame_w: Column, frame_h: Column, outside: float) -> Column:
    """A box without a positive width and height, or with a side too far outside its frame; null coordinates are neither."""
    x1, y1, x2, y2 = (finite(F.col(c)) for c in _BOX)
    w, h = frame_w * outside, frame_h * outside
    tests = [x2 - x1 <= 0, y2 - y1 <= 0]
    for side in (x1, x2):
        tests += [side < -w, side > frame_w + w]
    for side in (y1, y2):
        tests += [side < -h, side > frame_h + h]
    some = F.lit(False)
    for test in tests:
        some = some | F.coalesce(test, F.lit(False))
    return some


def _charts(x: np.ndarray, fresh: np.ndarray, unit: np.ndarray, r: SpikeRules) -> np.ndarray:
    """Suspected values of many series in step. x: steps x series x 4; fresh: where a chart starts anew; unit: by series.

    The chart expects its mean, moved on by its slope. More than ``longest`` suspected values in a row are a lasting move if they
    lie together (a leap starts their count again, so that a spike after a small move is none), or if they go on steadily: the
    chart then follows them, and takes on the slope of the steady ones.
    """
    steps, series, _ = x.shape
    suspected = np.zeros(x.shape, bool)
    if not steps:
        return suspected
    u = unit[:, None]
    mean, slope, scale = x[0].copy(), np.zeros((series, 4)), np.broadcast_to(u, (series, 4)).copy()
    together, outs = np.zeros((series, 4), np.int32), np.zeros((series, 4), np.int32)
    before, went = x[0], np.zeros((series, 4))
    for t in range(steps):
        now, new = x[t], fresh[t][:, None]
        mean += slope
        off = now - mean
        bound = np.clip(r.limit * scale, r.least * u, r.most * u)
        out = (np.abs(off) > bound) & ~new
        goes = np.where(new, 0.0, now - before)
        leap = np.abs(goes) > bound
        together = np.where(out, np.where(leap, 1, together + 1), 0)
        outs = np.where(out, outs + 1, 0)
        steady = (outs > r.longest) & leap & (np.abs(goes - went) <= bound)
        moved = (together > r.longest) | steady
        step = np.where(out, np.clip(off, -r.clip * bound, r.clip * bound), r.level * off)
        mean = np.where(new | moved, now, mean + step)
        slope = np.where(new | moved, np.where(steady, goes, 0.0), slope + np.where(out | (slope == 0), 0.0, r.trend * off))
        scale = np.where(new, u, (1 - r.scale) * scale + r.scale * np.minimum(np.abs(off), bound))
        together[moved] = 0
        outs[moved] = 0
        before, went = now, goes
        suspected[t] = out
    return suspected


def _suspects(x: np.ndarray, starts: np.ndarray, unit: np.ndarray, r: SpikeRules) -> np.ndarray:
    """Runs the charts over consecutive rows: each stretch of _STRIDE rows with _WARM rows ahead of it to warm up."""
    n = len(x)
    stride = min(_STRIDE, n)
    stretches = -(-n // stride)
    at = np.arange(stretches)[:, None] * stride + np.arange(-_WARM, stride)[None, :]
    valid = (at >= 0) & (at < n)
    at = np.clip(at, 0, n - 1)
    fresh = starts[at] | ~valid
    fresh[:, 0] = True
    # A stretch may hold several sources; values are charted in units of their source's median change.
    scaled = x[at] / unit[at][:, :, None]
    got = _charts(np.ascontiguousarray(scaled.transpose(1, 0, 2)), np.ascontiguousarray(fresh.T), np.ones(stretches), r).transpose(1, 0, 2)
    return got[:, _WARM:].reshape(-1, 4)[:n]


def _judge(block: np.ndarray, frame: np.ndarray, x: np.ndarray, bad: np.ndarray, unit: np.ndarray, pause: np.ndarray, r: SpikeRules) -> tuple[np.ndarray, np.ndarray]:
    """(stuck, spike) of rows sorted by block and frame; bad: impossible boxes; pause: in frames."""
    n = len(x)
    first = np.ones(n, bool)
    first[1:] = block[1:] != block[:-1]
    equal = np.zeros(n, bool)
    equal[1:] = (x[1:] == x[:-1]).all(axis=1) & ~first[1:]
    run = np.cumsum(~equal) - 1
    stuck = np.bincount(run)[run] >= r.stuck

    spike = np.zeros(n, bool)
    use = np.flatnonzero(~np.isnan(x).any(axis=1) & ~bad & (unit > 0))
    if len(use) > 2:
        y, b, f, u, p = x[use], block[use], frame[use], unit[use], pause[use]
        cut = np.ones(len(use), bool)
        cut[1:] = (b[1:] != b[:-1]) | (f[1:] - f[:-1] > p[1:])
        suspect = _suspects(y, cut, u, r)
        found = np.zeros(len(use), bool)
        cuts = np.cumsum(cut)
        for length in range(1, r.longest + 1):
            i = np.arange(1, len(use) - length)
            i = i[(cuts[i - 1] == cuts[i + length]) & suspect[i].any(axis=1)]
            least = np.full((len(i), 4), np.inf)
            for j in range(length):
                away = np.minimum(np.abs(y[i + j] - y[i - 1]), np.abs(y[i + j] - y[i + length]))
                least = np.minimum(least, np.where(suspect[i + j], away, 0))
            hit = i[(least > r.far * u[i][:, None]).any(axis=1)]
            for j in range(length):
                found[hit + j] = True
        spike[use[found]] = True
    return stuck, spike


_FOUND = pa.schema([("clip_id", pa.string()), ("global_id", pa.int64()), ("frame", pa.int64()), ("n", pa.int64()), ("id", pa.int64()), ("id2", pa.int64()), ("is_stuck", pa.bool_()), ("is_spike", pa.bool_())])


def _detector(r: SpikeRules, rows_at_once: int = 60_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judge(table: pa.Table) -> pa.RecordBatch:
            col = lambda name: table[name].combine_chunks().to_numpy(zero_copy_only=False)
            x = np.stack([col(c).astype(float) for c in _BOX], axis=1)
            stuck, spike = _judge(col("part"), col("frame"), x, col("is_bad").astype(bool), col("unit").astype(float), col("pause").astype(float), r)
            keep = np.flatnonzero((stuck | spike) & col("is_own").astype(bool))
            out = table.select(["clip_id", "global_id", "frame", "n", "id", "id2"]).take(pa.array(keep)).combine_chunks()
            columns = [out[c].combine_chunks() if out[c].num_chunks != 1 else out[c].chunk(0) for c in out.column_names]
            return pa.RecordBatch.from_arrays([*columns, pa.array(stuck[keep]), pa.array(spike[keep])], schema=_FOUND)

        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < rows_at_once:
                continue
            table = pa.Table.from_batches(held)
            part = table["part"].combine_chunks().to_numpy()
            whole = int(np.flatnonzero(part != part[-1])[-1]) + 1 if (part != part[-1]).any() else 0
            if whole:  # the last block may go on in the next batch
                yield judge(table.slice(0, whole))
                table = table.slice(whole)
            held, rows = table.to_batches(), table.num_rows
        if rows:
            yield judge(pa.Table.from_batches(held))

    return run


def box_faults(tracks: DataFrame, cameras: DataFrame, rules: SpikeRules = SpikeRules()) -> DataFrame:
    """``id, fault`` of every box that is ``impossible``, ``stuck`` or a ``spike``; a box may have several faults.

    Method. Each track is a source. Robust exponentially weighted control charts, one per coordinate, run along it: a value
    beyond the limit is suspected, and clipped before it updates mean and scale; four suspected values in a row that lie together or
    go on steadily are a lasting move, which the chart follows; a pause starts it anew. A run-length counter finds stuck boxes and physical limits the
    impossible ones. Suspected runs of at most three boxes are then checked exactly: some coordinate of each of them must lie
    more than ``far`` median changes (of the camera) from the box before the run and from the one after it.

    A track is cut into blocks of frames; each block also sees the last rows before it and the first after it, which one
    window over the track's blocks (not rows) hands on. The charts forget within those rows.

    Defined cases: nulls, NaN and infinite values are no coordinates, such a box is neither stuck nor a spike and is passed over;
    impossible boxes are passed over by the charts; rows of an unknown camera have no frame or median and can only be
    stuck or without a positive side; rows without a positive global_id or without frame_idx can only be impossible. Deliveries of
    one frame are one box (the lowest id's) and all of them are reported. An empty table gives no rows.
    """
    r = rules
    ship_package(tracks.sparkSession)
    frames, few = measured(
        cameras.where("camera_id IS NOT NULL")
        .groupBy(slug(F.col("camera_id")).alias("of_camera"))
        .agg(F.max(finite(F.col("frame_w").cast("double"))).alias("frame_w"), F.max(finite(F.col("frame_h").cast("double"))).alias("frame_h"), F.max(finite(F.col("fps").cast("double"))).alias("fps"))
    )
    boxes = tracks.select("id", "clip_id", "global_id", "frame_idx", slug(F.col("camera_id")).alias("camera"), *[finite(F.col(c).cast("double")).alias(c) for c in _BOX])
    known = boxes.join(frames, F.col("camera") == F.col("of_camera"), "left")
    limits = known.where(impossible(F.col("frame_w"), F.col("frame_h"), r.outside)).select("id", F.lit("impossible").alias("fault"))

    # A track's block is one struct, so that joins on it keep the partitioning and a null clip is a value like others.
    part = F.struct("clip_id", "global_id", F.floor(F.col("frame_idx") / r.block).cast("bigint").alias("block")).alias("part")
    by_frame = (
        boxes.where("global_id > 0 AND frame_idx IS NOT NULL")
        .select(part, "frame_idx", "camera", "id", *_BOX)
        .repartition("part")
        .groupBy("part", "frame_idx")
        .agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("id2"), F.min(F.struct("id", "camera", *_BOX)).alias("one"))
    )
    row = F.struct(F.col("frame_idx").alias("frame"), "n", F.col("one.id").alias("id"), "id2", *[F.col(f"one.{c}").alias(c) for c in _BOX]).cast(_ROW)
    # Read three times below: for the edges of blocks, for the cameras' medians and for the charts.
    blocks = durable(by_frame.groupBy("part").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.max("one.camera").alias("camera")))

    edges = blocks.select("part", F.slice(F.col("rows"), F.greatest(F.size("rows") - BEFORE + 1, F.lit(1)), BEFORE).alias("tail"), F.slice("rows", 1, AFTER).alias("head"))
    in_order = Window.partitionBy("part.clip_id", "part.global_id").orderBy("part.block")
    near = edges.select(
        "part",
        F.flatten(F.collect_list("tail").over(in_order.rowsBetween(-BEFORE, -1))).alias("before"),
        F.flatten(F.collect_list("head").over(in_order.rowsBetween(1, AFTER))).alias("after"),
    )
    near = near.select("part", F.slice(F.col("before"), F.greatest(F.size("before") - BEFORE + 1, F.lit(1)), BEFORE).alias("before"), F.slice("after", 1, AFTER).alias("after"))
    spread = blocks.join(near, "part")

    # The usual change of a camera: the median over all successive boxes of all of its tracks, within blocks and from one to the next.
    change = lambda p, q: F.array(*[F.abs(q[c] - p[c]) for c in _BOX])
    inner = F.zip_with(F.slice(F.col("rows"), 1, F.size("rows") - 1), F.slice(F.col("rows"), 2, F.size("rows") - 1), change)
    borders = blocks.select("part", "camera", F.element_at("rows", 1).alias("first"), F.element_at("rows", -1).alias("last"))
    across = borders.select("camera", change(F.lag("last").over(in_order), F.col("first")).alias("changes"))
    changes = blocks.where(F.size("rows") > 1).select("camera", F.flatten(inner).alias("changes")).unionByName(across)
    changes = changes.select("camera", F.explode("changes").alias("change")).where("change IS NOT NULL")
    units = changes.groupBy("camera").agg(F.percentile_approx("change", 0.5, 10_000).alias("unit"))
    units = units.join(frames, F.col("camera") == F.col("of_camera")).select(F.col("of_camera").alias("u_camera"), "unit")
    units = F.broadcast(units) if few else units  # no more rows than cameras

    sized = spread.join(frames, F.col("camera") == F.col("of_camera"), "left").join(units, F.col("camera") == F.col("u_camera"), "left")
    tag = lambda rows, own: F.transform(rows, lambda b: F.struct(F.lit(own).alias("is_own"), b.alias("b")))
    flat = sized.select(
        F.xxhash64("part").alias("part"),
        F.col("part.clip_id").alias("clip_id"),
        F.col("part.global_id").alias("global_id"),
        F.coalesce("unit", F.lit(0.0)).alias("unit"),
        F.coalesce(F.col("fps") * r.pause_s, F.lit(float("inf"))).alias("pause"),
        "frame_w",
        "frame_h",
        F.explode(F.concat(tag(F.col("before"), False), tag(F.col("rows"), True), tag(F.col("after"), False))).alias("r"),
    ).select("part", "clip_id", "global_id", "unit", "pause", "frame_w", "frame_h", "r.is_own", "r.b.*")
    fed = flat.withColumn("is_bad", impossible(F.col("frame_w"), F.col("frame_h"), r.outside)).drop("frame_w", "frame_h")
    found = durable(fed.mapInArrow(_detector(r), "clip_id string, global_id bigint, frame bigint, n bigint, id bigint, id2 bigint, is_stuck boolean, is_spike boolean"))

    faults = F.array_compact(F.array(F.when(F.col("is_stuck"), F.lit("stuck")), F.when(F.col("is_spike"), F.lit("spike"))))
    named = found.withColumn("fault", F.explode(faults))
    # One or two deliveries of a frame are named by its lowest and highest id; frames delivered more often are looked up.
    direct = named.select(F.explode(F.array_distinct(F.array("id", "id2"))).alias("id"), "fault")
    often = broadcast_if_small(named.where("n > 2").select(F.col("clip_id").alias("o_clip"), F.col("global_id").alias("o_gid"), F.col("frame").alias("o_frame"), F.col("id").alias("o_id"), F.col("id2").alias("o_id2"), "fault"))
    again = boxes.join(often, F.col("clip_id").eqNullSafe(F.col("o_clip")) & (F.col("global_id") == F.col("o_gid")) & (F.col("frame_idx") == F.col("o_frame"))).where("id <> o_id AND id <> o_id2")
    return limits.unionByName(direct).unionByName(again.select("id", "fault"))
