"""Evaluation against judged boxes, and passes that follow such judgements.

Judged boxes: ask_id, clip_id, frame_idx, person_id, x1, y1, x2, y2. Predicted boxes: row_idx, clip_id, frame_idx, global_id, box.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.geometry import box, iou
from trackloom.operators import hygiene
from trackloom.operators.islands import with_previous
from trackloom.operators.linking import majority
from trackloom.operators.matching import greedy_match, optimal_match
from trackloom.operators.pairs import best_match
from trackloom.session import durable

_BOX = ("x1", "y1", "x2", "y2")
_FRAME = ["clip_id", "frame_idx"]


def judged_matches(judged: DataFrame, rows: DataFrame, least: float = 0.34) -> DataFrame:
    """Each judged box with the best predicted box of its frame: ask_id, clip_id, person_id, global_id (null without a match)."""
    return judged.select("ask_id", "clip_id", "person_id").join(best_match(judged, rows, least), "ask_id", "left")


def purity(matches: DataFrame) -> DataFrame:
    """Per clip: judged boxes, coverage, purity of persons and of ids (means of the largest shares), persons with several ids, ids with several persons."""
    found = matches.where("global_id IS NOT NULL AND person_id IS NOT NULL").groupBy("clip_id", "person_id", "global_id").agg(F.count(F.lit(1)).alias("n"))

    def by(side: str, name: str) -> DataFrame:
        each = found.groupBy("clip_id", side).agg((F.max("n") / F.sum("n")).alias("top"), F.count(F.lit(1)).alias("k"))
        return each.groupBy("clip_id").agg(F.round(F.avg("top"), 6).alias(f"{name}_purity"), F.count_if(F.col("k") > 1).alias(f"mixed_{name}s"))

    totals = matches.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n_judged"), F.count("global_id").alias("n_matched"), F.round(F.count("global_id") / F.count(F.lit(1)), 6).alias("coverage"))
    return totals.join(by("person_id", "person"), "clip_id", "left").join(by("global_id", "id"), "clip_id", "left")


def ablation(versions: dict[str, DataFrame], judged: DataFrame) -> DataFrame:
    """Identity figures and purity of several versions of the same rows, summed over clips."""
    out = None
    for name, rows in versions.items():
        figures = hygiene.summary(rows).agg(F.sum("n_positive").alias("n_positive"), F.sum("n_ids").alias("n_ids"), F.sum("n_stable").alias("n_stable"), F.sum("n_duplicates").alias("n_duplicates"))
        quality = purity(judged_matches(judged, rows)).agg(F.sum("n_matched").alias("n_matched"), F.round(F.avg("id_purity"), 6).alias("id_purity"), F.sum("mixed_ids").alias("mixed_ids"))
        row = figures.join(quality).select(F.lit(name).alias("version"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def guarded(before: DataFrame, after: DataFrame, judged: DataFrame, slack: float = 0.01) -> DataFrame:
    """Per clip whether a pass may stay: purity does not fall by more than ``slack``, duplicates and mixed ids do not grow."""
    side = lambda rows, s: purity(judged_matches(judged, rows)).join(hygiene.summary(rows).select("clip_id", "n_duplicates"), "clip_id").select(
        "clip_id", F.coalesce("id_purity", F.lit(0.0)).alias(f"purity_{s}"), F.coalesce("mixed_ids", F.lit(0)).alias(f"mixed_{s}"), F.col("n_duplicates").alias(f"dups_{s}")
    )
    both = side(before, "before").join(side(after, "after"), "clip_id")
    ok = (F.col("purity_after") >= F.col("purity_before") - slack) & (F.col("mixed_after") <= F.col("mixed_before")) & (F.col("dups_after") <= F.col("dups_before"))
    return both.withColumn("keep", ok)


def unsupported_ids(judged: DataFrame, rows: DataFrame) -> DataFrame:
    """Identities of judged clips that no judged box matches."""
    supported = judged_matches(judged, rows).where("global_id IS NOT NULL").select("clip_id", "global_id").distinct()
    return hygiene.id_extent(rows).join(judged.select("clip_id").distinct(), "clip_id", "left_semi").join(supported, ["clip_id", "global_id"], "left_anti")


def dominant_persons(judged: DataFrame, rows: DataFrame, support: int, share: float) -> DataFrame:
    """The person most of an identity's judged boxes show, with enough support and share."""
    return majority(judged_matches(judged, rows).where("global_id IS NOT NULL"), ["clip_id", "global_id"], "person_id", support, share)


def relabelled(judged: DataFrame, rows: DataFrame, support: int = 6, share: float = 0.90) -> DataFrame:
    """Rows under the person of their identity if it is pure; of a frame's boxes that would share a person the largest keeps it.
    Identities of judged clips without votes become 0, impure ones stay."""
    voted = judged_matches(judged, rows).where("global_id IS NOT NULL").select("clip_id", "global_id").distinct().withColumn("voted", F.lit(True))
    pure = dominant_persons(judged, rows, support, share).select("clip_id", "global_id", F.col("person_id").alias("target"))
    clips = judged.select("clip_id").distinct().withColumn("is_judged", F.lit(True))
    marked = rows.join(pure, ["clip_id", "global_id"], "left").join(voted, ["clip_id", "global_id"], "left").join(clips, "clip_id", "left")
    lost = F.col("is_judged") & F.col("voted").isNull() & (F.col("global_id") > 0)
    new = F.when(F.coalesce(lost, F.lit(False)), 0).otherwise(F.coalesce("target", "global_id"))
    return hygiene.largest_per_frame(marked.withColumn("global_id", new.cast("bigint")))


def promoted(judged: DataFrame, rows: DataFrame, least: float = 0.34) -> DataFrame:
    """Unassigned boxes that a judged box matches take its person if no box of the frame has that identity: row_idx, global_id.

    Among several judged boxes the higher IoU wins, and each box and each person of a frame is used once.
    """
    free = rows.where("global_id <= 0").select(F.col("row_idx").alias("row_b"), *_FRAME, *[F.col(c).alias(f"{c}_b") for c in _BOX])
    a = judged.where("person_id > 0").select("person_id", *_FRAME, *[F.col(c).alias(f"{c}_a") for c in _BOX])
    edges = a.join(free, _FRAME).withColumn("iou", iou(box(suffix="_a"), box(suffix="_b"))).where(F.col("iou") >= least)
    taken = rows.where("global_id > 0").select(*_FRAME, F.col("global_id").alias("person_id")).distinct()
    best = edges.join(taken, [*_FRAME, "person_id"], "left_anti").groupBy(*_FRAME, "person_id", "row_b").agg(F.max("iou").alias("iou"))
    return greedy_match(best, [*_FRAME, "person_id"], ["row_b"], "iou").select(F.col("row_b").alias("row_idx"), F.col("person_id").alias("global_id"))


def match_edges(truth: DataFrame, rows: DataFrame) -> DataFrame:
    """Every truth and predicted box of a frame that overlap: left (ask_id), right (row_idx), score (IoU)."""
    a = truth.select(F.col("ask_id").alias("left"), *_FRAME, *[F.col(c).alias(f"{c}_a") for c in _BOX])
    b = rows.select(F.col("row_idx").alias("right"), *_FRAME, *[F.col(c).alias(f"{c}_b") for c in _BOX])
    return a.join(b, _FRAME).withColumn("score", iou(box(suffix="_a"), box(suffix="_b"), 1e-9)).where("score > 0").select(*_FRAME, "left", "right", "score")


def frame_matches(truth: DataFrame, rows: DataFrame, least: float = 0.5, optimal: bool = True) -> DataFrame:
    """One-to-one matches of each frame: clip_id, frame_idx, left, right, score. Optimal: highest sum first, threshold after;
    otherwise edges above the threshold from the best down."""
    edges = match_edges(truth, rows)
    return optimal_match(edges, least) if optimal else greedy_match(edges.where(F.col("score") >= least), [*_FRAME, "left"], [*_FRAME, "right"], "score")


def mot_metrics(truth: DataFrame, rows: DataFrame, least: float = 0.5) -> DataFrame:
    """Per clip: truth and predicted boxes, matches, misses, false alarms, switches of identity, MOTA, precision, recall, mean IoU, and
    truth tracks found in at least 80 % or at most 20 % of their frames."""
    named = (
        frame_matches(truth, rows, least)
        .join(truth.select(F.col("ask_id").alias("left"), "person_id"), "left")
        .join(rows.select(F.col("row_idx").alias("right"), "global_id"), "right")
    )
    matched = durable(named)
    steps = with_previous(matched, ["clip_id", "person_id"], ["frame_idx", "left"], F.floor(F.col("frame_idx") / hygiene.BLOCK), ["global_id"])
    switches = steps.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n_matched"), F.round(F.avg("score"), 6).alias("mean_iou"), F.count_if(F.col("prev").isNotNull() & (F.col("prev.global_id") != F.col("global_id"))).alias("n_switches"))
    found = truth.groupBy("clip_id", "person_id").agg(F.count(F.lit(1)).alias("n")).join(matched.groupBy("clip_id", "person_id").agg(F.count(F.lit(1)).alias("m")), ["clip_id", "person_id"], "left")
    share = F.coalesce("m", F.lit(0)) / F.col("n")
    tracks = found.groupBy("clip_id").agg(F.sum("n").alias("n_truth"), F.count_if(share >= 0.8).alias("mostly_tracked"), F.count_if(share <= 0.2).alias("mostly_lost"))
    predicted = rows.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n_predicted"))
    joined = tracks.join(predicted, "clip_id", "left").join(switches, "clip_id", "left").fillna(0, ["n_predicted", "n_matched", "n_switches"])
    misses, alarms = F.col("n_truth") - F.col("n_matched"), F.col("n_predicted") - F.col("n_matched")
    return joined.withColumns(
        {
            "misses": misses,
            "false_alarms": alarms,
            "mota": F.round(1 - (misses + alarms + F.col("n_switches")) / F.col("n_truth"), 6),
            "precision": F.round(F.try_divide("n_matched", "n_predicted"), 6),
            "recall": F.round(F.try_divide("n_matched", "n_truth"), 6),
        }
    )


def idf1(truth: DataFrame, rows: DataFrame, least: float = 0.5) -> DataFrame:
    """Identity precision, recall and F1 per clip: truth tracks and ids matched one to one so that they agree in most frames in all."""
    edges = match_edges(truth, rows).where(F.col("score") >= least)
    named = edges.join(truth.select(F.col("ask_id").alias("left"), "person_id"), "left").join(rows.select(F.col("row_idx").alias("right"), "global_id"), "right")
    shared = named.groupBy("clip_id", "person_id", "global_id").agg(F.countDistinct("frame_idx").alias("n"))
    whole = shared.select("clip_id", F.lit(0).cast("bigint").alias("frame_idx"), F.col("person_id").alias("left"), F.col("global_id").alias("right"), F.col("n").cast("double").alias("score"))
    pairs = optimal_match(whole, 1).groupBy("clip_id").agg(F.sum("score").cast("bigint").alias("idtp"))
    totals = truth.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n_truth")).join(rows.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n_predicted")), "clip_id", "left").join(pairs, "clip_id", "left").fillna(0)
    return totals.withColumns(
        {
            "id_precision": F.round(F.try_divide("idtp", "n_predicted"), 6),
            "id_recall": F.round(F.try_divide("idtp", "n_truth"), 6),
            "id_f1": F.round(2 * F.col("idtp") / (F.col("n_truth") + F.col("n_predicted")), 6),
        }
    )


def validation(rows: DataFrame) -> DataFrame:
    """Faults of judged rows (row_idx, box, person_id, ignore, visibility, w, h): one row per row_idx and code."""
    x1, y1, x2, y2 = box()
    gone = lambda *cs: F.coalesce(sum((c.isNull().cast("int") for c in cs[1:]), cs[0].isNull().cast("int")) > 0, F.lit(False))
    counted = rows.withColumn("__many", F.count(F.lit(1)).over(Window.partitionBy("clip_id", "frame_idx", "person_id")))
    rules: list[tuple[str, Column]] = [
        ("missing_box", gone(x1, y1, x2, y2)),
        ("empty_box", (x2 <= x1) | (y2 <= y1)),
        ("outside_frame", (x1 < 0) | (y1 < 0) | (x2 > F.col("w")) | (y2 > F.col("h"))),
        ("bad_ignore", ~F.col("ignore").isin(0, 1) | F.col("ignore").isNull()),
        ("bad_person", F.col("person_id").isNull() | (F.col("person_id") <= 0)),
        ("bad_visibility", F.col("visibility").isNull() | ~F.col("visibility").between(0, 1)),
        ("duplicate", (F.col("person_id") > 0) & (F.col("__many") > 1)),
    ]
    codes = F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in rules]))
    return counted.withColumn("code", F.explode(codes)).select("row_idx", "code")


def progress(frames: DataFrame, annotated: DataFrame, window: int = 300) -> DataFrame:
    """Per clip and window of frames: frames, how many are annotated, and ``done``, ``started`` or ``open``."""
    marked = frames.join(annotated.withColumn("is", F.lit(True)), _FRAME, "left")
    per = marked.groupBy("clip_id", F.floor(F.col("frame_idx") / window).alias("window_id")).agg(F.count(F.lit(1)).alias("n_frames"), F.count("is").alias("n_annotated"))
    return per.withColumn("status", F.when(F.col("n_annotated") == F.col("n_frames"), "done").when(F.col("n_annotated") > 0, "started").otherwise("open"))


def mot_lines(rows: DataFrame) -> DataFrame:
    """Lines of the MOT challenge's text format: frames numbered from 1 within the clip, corner and size, confidence 0 for rows to ignore."""
    frames = rows.select("clip_id", "frame_idx").distinct()
    numbered = frames.withColumn("k", F.row_number().over(Window.partitionBy("clip_id").orderBy("frame_idx")))
    x1, y1, x2, y2 = box()
    line = F.format_string("%d,%d,%.3f,%.3f,%.3f,%.3f,%d,-1,-1,-1", "k", "global_id", x1, y1, x2 - x1, y2 - y1, F.when(F.col("ignore"), 0).otherwise(1))
    return rows.join(numbered, _FRAME).select("row_idx", "clip_id", line.alias("line"))


def linked_boxes(rows: DataFrame, most_gap: int = 6, least: float = 0.3) -> DataFrame:
    """Boxes of successive frames of a clip that continue each other: one-to-one by .75 IoU + .25 exp(-distance in heights)."""
    frames = rows.select(*_FRAME).distinct()
    steps = with_previous(frames, ["clip_id"], ["frame_idx"], F.floor(F.col("frame_idx") / hygiene.BLOCK), ["frame_idx"]).where("prev IS NOT NULL")
    near = steps.select("clip_id", "frame_idx", F.col("prev.frame_idx").alias("before")).where(F.col("frame_idx") - F.col("before") <= most_gap)
    b = rows.join(near, _FRAME).select("clip_id", "before", F.col("row_idx").alias("row_b"), *[F.col(c).alias(f"{c}_b") for c in _BOX])
    a = rows.select("clip_id", F.col("frame_idx").alias("before"), F.col("row_idx").alias("row_a"), *[F.col(c).alias(f"{c}_a") for c in _BOX])
    pa, pb = box(suffix="_a"), box(suffix="_b")
    far = F.hypot((pa[0] + pa[2] - pb[0] - pb[2]) / 2, (pa[1] + pa[3] - pb[1] - pb[3]) / 2) / F.greatest(pa[3] - pa[1], pb[3] - pb[1], F.lit(1.0))
    edges = a.join(b, ["clip_id", "before"]).withColumns({"v": iou(pa, pb), "score": 0.75 * iou(pa, pb) + 0.25 * F.exp(-far)}).where((F.col("v") > 0) & (F.col("score") >= least))
    return greedy_match(edges.select("row_a", "row_b", "score"), ["row_a"], ["row_b"], "score")


def blips_smoothed(rows: DataFrame) -> DataFrame:
    """Boxes whose id differs from the same id on both linked neighbours take that id, unless the frame has it already: row_idx, global_id."""
    links = linked_boxes(rows).select("row_a", "row_b")
    ids = rows.select("row_idx", *_FRAME, "global_id")
    before = links.select(F.col("row_b").alias("row_idx"), F.col("row_a").alias("a"))
    after = links.select(F.col("row_a").alias("row_idx"), F.col("row_b").alias("c"))
    around = before.join(after, "row_idx").join(ids, "row_idx").join(ids.select(F.col("row_idx").alias("a"), F.col("global_id").alias("ga")), "a").join(ids.select(F.col("row_idx").alias("c"), F.col("global_id").alias("gc")), "c")
    blips = around.where("ga = gc AND ga > 0 AND ga <> global_id").select("row_idx", *_FRAME, F.col("ga").alias("new_id"))
    taken = rows.select(*_FRAME, F.col("global_id").alias("new_id")).distinct()
    one = Window.partitionBy(*_FRAME, "new_id").orderBy("row_idx")
    return blips.join(taken, [*_FRAME, "new_id"], "left_anti").withColumn("r", F.row_number().over(one)).where("r = 1").select("row_idx", F.col("new_id").alias("global_id"))
