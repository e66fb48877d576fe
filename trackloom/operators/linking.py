"""Links between stretches of one person: candidates, scores, decisions and merges.

Stretches: clip_id, tracklet_id, local_track_id, source_gid, final_gid, start_frame, end_frame, entry_side, exit_side, motion_dx,
motion_dy, median_h_ratio, median_aspect, quality, num_rows. A tracklet_id is unique within its clip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.geometry import side_score
from trackloom.functions.vectors import ratio
from trackloom.operators.islands import fold_sorted

_COLUMNS = ("tracklet_id", "source_gid", "start_frame", "end_frame", "entry_side", "exit_side", "motion_dx", "motion_dy", "median_h_ratio", "median_aspect", "quality")


def candidate_pairs(tracklets: DataFrame, least_gap: int = 4, most_gap: int = 1600) -> DataFrame:
    """Earlier and later stretches of a clip (columns with ``p_`` and ``c_``) between which ``least_gap`` to ``most_gap`` frames lie.

    A range join: ends and starts fall into buckets of ``most_gap`` frames, and a start looks only into its own bucket and the one
    before it.
    """
    base = tracklets.where("start_frame IS NOT NULL AND end_frame IS NOT NULL")
    earlier = base.select("clip_id", F.floor(F.col("end_frame") / most_gap).alias("bucket"), *[F.col(c).alias(f"p_{c}") for c in _COLUMNS])
    own = F.floor(F.col("start_frame") / most_gap)
    later = base.select("clip_id", F.explode(F.array(own, own - 1)).alias("bucket"), *[F.col(c).alias(f"c_{c}") for c in _COLUMNS])
    gap = F.col("c_start_frame") - F.col("p_end_frame")
    return earlier.join(later, ["clip_id", "bucket"]).withColumn("gap", gap).where(F.col("gap").between(least_gap, most_gap)).drop("bucket")


def _quality() -> Column:
    return F.sqrt(F.greatest(F.coalesce("p_quality", F.lit(0.0)), F.lit(0.0)) * F.greatest(F.coalesce("c_quality", F.lit(0.0)), F.lit(0.0)))


def _turn() -> Column:
    """How far two movements agree in direction, .5 where one stands still."""
    a = F.hypot("p_motion_dx", "p_motion_dy")
    b = F.hypot("c_motion_dx", "c_motion_dy")
    cos = (F.col("p_motion_dx") * F.col("c_motion_dx") + F.col("p_motion_dy") * F.col("c_motion_dy")) / (a * b)
    return F.when((a > 1) & (b > 1), 0.5 * (cos + 1)).otherwise(0.5)


def reentry_candidates(tracklets: DataFrame, keep: int = 72, least: float = 0.30, most_gap: int = 1600) -> DataFrame:
    """For every stretch its best ``keep`` predecessors by .50 side + .30 time + .20 quality, if that is at least ``least``."""
    side = side_score(F.col("p_exit_side"), F.col("c_entry_side"))
    first = 0.50 * side + 0.30 * F.exp(-F.col("gap") / most_gap) + 0.20 * _quality()
    scored = candidate_pairs(tracklets, 4, most_gap).withColumns({"side": side, "prefilter": first}).where(F.col("prefilter") >= least)
    best = Window.partitionBy("clip_id", "c_tracklet_id").orderBy(F.desc("prefilter"), "p_tracklet_id")
    return scored.withColumn("r", F.row_number().over(best)).where(F.col("r") <= keep).drop("r")


def reentry_scores(candidates: DataFrame, most_gap: int = 1600) -> DataFrame:
    """Adds ``reason`` (the first gate that a pair fails, or null) and ``score``: shape, time, side and motion weighted as their
    shares of the full score, times .82 + .18 quality. Appearance terms join as columns where vectors exist."""
    shape = 0.6 * ratio(F.col("p_median_h_ratio"), F.col("c_median_h_ratio")) + 0.4 * ratio(F.col("p_median_aspect"), F.col("c_median_aspect"))
    reason = (
        F.when(F.col("side") < 0.22, "entry_exit_side_incompatible")
        .when(ratio(F.col("p_median_h_ratio"), F.col("c_median_h_ratio")) < 0.32, "size_ratio_implausible")
        .when(ratio(F.col("p_median_aspect"), F.col("c_median_aspect")) < 0.30, "aspect_ratio_implausible")
        .when(F.least("p_quality", "c_quality") < 0.10, "pair_low_quality")
    )
    raw = (0.10 * shape + 0.06 * F.exp(-F.col("gap") / most_gap) + 0.04 * F.col("side") + 0.02 * _turn()) / 0.22
    return candidates.withColumns({"reason": reason, "score": raw * (0.82 + 0.18 * _quality())})


def reranked(scored: DataFrame, top: int = 6, penalty: float = 0.04) -> DataFrame:
    """Passing pairs, the best ``top`` of each stretch scored anew (a penalty for an odd pair of sides) and ranked again, with the
    lead over the second."""
    ok = scored.where("reason IS NULL")
    by_score = Window.partitionBy("clip_id", "c_tracklet_id").orderBy(F.desc("score"), "p_tracklet_id")
    new = F.when(F.col("r") <= top, F.col("score") - F.when(F.col("side") < 0.62, penalty).otherwise(0.0)).otherwise(F.col("score"))
    again = ok.withColumn("r", F.row_number().over(by_score)).withColumn("final", new)
    by_final = Window.partitionBy("clip_id", "c_tracklet_id").orderBy(F.desc("final"), "p_tracklet_id")
    ranked = again.withColumns({"rank": F.row_number().over(by_final), "second": F.lead("final").over(by_final)})
    return ranked.withColumn("margin", F.col("final") - F.coalesce("second", F.lit(-1.0))).drop("r", "second")


class _Decide:
    """One stretch after the other: it takes the identity of its best predecessor if score and lead suffice and that identity is
    not seen at the same time, else a new one."""

    def __init__(self, key: tuple, score: float, margin: float) -> None:
        self.key, self.score, self.margin = key, score, margin
        self.identity: dict[int, int] = {}
        self.busy_until: dict[int, int] = {}
        self.fresh = None

    def step(self, row):
        if self.fresh is None:
            self.fresh = int(row.top_gid) + 1
        tid, start, end = int(row.tracklet_id), int(row.start_frame), int(row.end_frame)
        options = [(float(o["final"]), int(o["prev"])) for o in (row.options if row.options is not None else [])]
        reason, target = "new_id_no_candidate", None
        if options:
            best, prev = options[0]
            known = self.identity.get(prev)
            second = options[1] if len(options) > 1 else None
            lead = best - (second[0] if second else -1.0)
            agree = second is not None and self.identity.get(second[1]) == known
            if known is None:
                reason = "new_id_no_candidate"
            elif best < self.score:
                reason = "rejected_weak_score"
            elif lead < self.margin and not agree:
                reason = "rejected_ambiguous_margin"
            elif self.busy_until.get(known, -1) >= start:
                reason = "rejected_overlap_conflict"
            else:
                reason, target = "strong_reentry_reuse" if lead >= self.margin else "same_candidate_safe_accept", known
        if target is None:
            target, self.fresh = self.fresh, self.fresh + 1
        self.identity[tid] = target
        self.busy_until[target] = max(end, self.busy_until.get(target, -1))
        yield (*self.key, tid, target, reason)

    def end(self):
        return ()


def decided(tracklets: DataFrame, ranked: DataFrame, score: float = 0.70, margin: float = 0.03) -> DataFrame:
    """Decisions in order of time within each clip: clip_id, tracklet_id, identity, reason. New identities count on from the
    clip's highest source id."""
    options = ranked.where("rank <= 2").groupBy("clip_id", F.col("c_tracklet_id").alias("tracklet_id")).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("final")).alias("minus"), F.col("p_tracklet_id").alias("prev"), F.col("final").alias("final")))).alias("options")
    )
    top = tracklets.groupBy("clip_id").agg(F.max("source_gid").alias("top_gid"))
    rows = tracklets.select("clip_id", "tracklet_id", "start_frame", "end_frame").join(top, "clip_id").join(options, ["clip_id", "tracklet_id"], "left")
    schema = "clip_id string, tracklet_id bigint, identity bigint, reason string"
    return fold_sorted(rows, ["clip_id"], ["start_frame", "tracklet_id"], lambda key: _Decide(key, score, margin), schema)


def stitch_edges(tracklets: DataFrame, least: float = 0.66, most_gap: int = 360) -> DataFrame:
    """Pairs of stretches that may be one: shape .58 at least and, after a long gap, both ends at a side of the frame."""
    shape = 0.65 * ratio(F.col("p_median_h_ratio"), F.col("c_median_h_ratio")) + 0.35 * ratio(F.col("p_median_aspect"), F.col("c_median_aspect"))
    inside = (F.col("p_exit_side") == "center") | (F.col("c_entry_side") == "center")
    score = 0.7 * shape + 0.2 * side_score(F.col("p_exit_side"), F.col("c_entry_side")) + 0.1 * _turn() - 0.07 * F.col("gap") / most_gap
    ok = (shape >= 0.58) & ((F.col("gap") < 180) | ~inside)
    pairs = candidate_pairs(tracklets, 1, most_gap).withColumn("score", score).where(ok & (F.col("score") >= least))
    return pairs.select("clip_id", F.col("p_tracklet_id").alias("a"), F.col("c_tracklet_id").alias("b"), "gap", "score")


def merge_edges(tracklets: DataFrame, least: float = 0.78, most_gap: int = 2200) -> DataFrame:
    """Every pair of stretches 0 to ``most_gap`` frames apart whose score is at least ``least``; neither a number of predecessors nor
    the gates and penalties of re-entry hold here. The score is that of ``reentry_scores``."""
    other = F.col("p_tracklet_id") != F.col("c_tracklet_id")  # a stretch of one frame ends where it starts
    pairs = candidate_pairs(tracklets, 0, most_gap).where(other).withColumn("side", side_score(F.col("p_exit_side"), F.col("c_entry_side")))
    return reentry_scores(pairs).where(F.col("score") >= least).select("clip_id", F.col("p_tracklet_id").alias("a"), F.col("c_tracklet_id").alias("b"), "gap", "score")


def local_consistency(tracklets: DataFrame) -> DataFrame:
    """Every local track takes the identity that most of its boxes have (the lower one of equals)."""
    votes = tracklets.where("local_track_id IS NOT NULL AND final_gid IS NOT NULL").groupBy("clip_id", "local_track_id", "final_gid").agg(F.sum("num_rows").alias("votes"))
    best = Window.partitionBy("clip_id", "local_track_id").orderBy(F.desc("votes"), "final_gid")
    return votes.withColumns({"r": F.row_number().over(best), "all": F.sum("votes").over(Window.partitionBy("clip_id", "local_track_id"))}).where("r = 1").select(
        "clip_id", "local_track_id", F.col("final_gid").alias("identity"), "votes", F.round(F.col("votes") / F.col("all"), 6).alias("share")
    )


def majority(votes: DataFrame, key: list[str], value: str, support: int = 1, share: float = 0.0) -> DataFrame:
    """The most frequent value of each key with its support, if it has enough of both support and share; ties: the lower value."""
    counts = votes.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy(*key).orderBy(F.desc("n"), value)
    ranked = counts.withColumns({"r": F.row_number().over(best), "total": F.sum("n").over(Window.partitionBy(*key))}).where("r = 1")
    return ranked.where((F.col("n") >= support) & (F.col("n") >= share * F.col("total"))).select(*key, value, "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def overlapping_windows(tracklets: DataFrame, windows: DataFrame, bucket: int = 1024) -> DataFrame:
    """Stretches that share a frame with a window (clip_id, start_frame, end_frame), by buckets of frames."""
    spread = lambda df: F.explode(F.sequence(F.floor(F.col("start_frame") / bucket), F.floor(F.col("end_frame") / bucket)))
    t = tracklets.where("end_frame >= start_frame").select("clip_id", "tracklet_id", "start_frame", "end_frame", spread(tracklets).alias("b"))
    w = windows.select("clip_id", F.col("start_frame").alias("ws"), F.col("end_frame").alias("we"), F.explode(F.sequence(F.floor(F.col("start_frame") / bucket), F.floor(F.col("end_frame") / bucket))).alias("b"))
    hit = t.join(w, ["clip_id", "b"]).where("start_frame <= we AND end_frame >= ws")
    return hit.select("clip_id", "tracklet_id").distinct()


def first_and_second(scores: DataFrame, key: str, other: str, score: str) -> DataFrame:
    """Best and second partner of each key, and the lead (the best alone leads by its score and 1)."""
    best = Window.partitionBy(key).orderBy(F.desc(score), other)
    two = scores.withColumns({"r": F.row_number().over(best), "second": F.lead(score).over(best)}).where("r = 1")
    return two.select(key, other, F.round(score, 6).alias("best"), F.round(F.col(score) - F.coalesce("second", F.lit(-1.0)), 6).alias("margin"))


def cross_camera_primary(scores: DataFrame) -> DataFrame:
    """Pairs sure enough to be matched first: all similarities high and a lead over the second unless the score is very high."""
    valid = scores.where("score BETWEEN 0 AND 1 AND NOT isnan(score)")
    one = Window.partitionBy("cam1_gid", "cam2_gid").orderBy(F.desc("score"), F.desc("sim_topk"), F.desc("sim_mean"))
    pairs = valid.withColumn("r", F.row_number().over(one)).where("r = 1").drop("r")
    best = Window.partitionBy("cam1_gid").orderBy(F.desc("score"), "cam2_gid")
    led = pairs.withColumns({"r": F.row_number().over(best), "second": F.lead("score").over(best)})
    sure = (F.col("score") >= 0.75) | (F.col("score") - F.coalesce("second", F.lit(-1.0)) >= 0.02)
    return led.where((F.col("r") == 1) & (F.col("score") >= 0.67) & (F.col("sim_topk") >= 0.62) & (F.col("sim_mean") >= 0.60) & sure).select("cam1_gid", "cam2_gid", "score")


def cross_camera_cascade(scores: DataFrame) -> DataFrame:
    """Identities of the second camera assigned to those of the first in stages: cam2_gid, cam1_gid, match_type, score.

    ``primary`` and ``unclaimed`` use each side once; ``fragment_reuse`` and ``fallback_reuse`` may give an identity again. What no
    stage takes is ``new``.
    """
    from trackloom.operators.matching import greedy_match
    from trackloom.session import durable

    valid = scores.where("score BETWEEN 0 AND 1 AND NOT isnan(score)")
    one = Window.partitionBy("cam1_gid", "cam2_gid").orderBy(F.desc("score"), F.desc("sim_topk"), F.desc("sim_mean"))
    pairs = valid.withColumn("r", F.row_number().over(one)).where("r = 1").select("cam1_gid", "cam2_gid", "score", "sim_topk", "sim_mean")
    best = Window.partitionBy("cam2_gid").orderBy(F.desc("score"), "cam1_gid")
    lead = F.col("score") - F.coalesce("second", F.lit(-1.0))
    rest = durable(pairs.withColumn("second", F.lead("score").over(best)).where((F.col("score") >= 0.63) & (F.col("sim_topk") >= 0.59) & (F.col("sim_mean") >= 0.60)))

    def open_pairs(least: float, topk: float, mean: float, margin: float, sure: float) -> DataFrame:
        passing = (F.col("score") >= least) & (F.col("sim_topk") >= topk) & (F.col("sim_mean") >= mean)
        return rest.where(passing & ((lead >= margin) | (F.col("score") >= sure)))

    done = greedy_match(cross_camera_primary(scores), ["cam1_gid"], ["cam2_gid"], "score").select("cam2_gid", "cam1_gid", F.lit("primary").alias("match_type"), "score")
    rest = rest.join(done.select("cam2_gid"), "cam2_gid", "left_anti")
    unclaimed = open_pairs(0.66, 0.61, 0.60, 0.02, 0.75).join(done.select("cam1_gid"), "cam1_gid", "left_anti").select("cam1_gid", "cam2_gid", "score")
    second = greedy_match(unclaimed, ["cam1_gid"], ["cam2_gid"], "score").select("cam2_gid", "cam1_gid", F.lit("unclaimed").alias("match_type"), "score")
    done = done.unionByName(second)
    rest = rest.join(second.select("cam2_gid"), "cam2_gid", "left_anti")
    stages = F.when((F.col("score") >= 0.67) & (F.col("sim_topk") >= 0.63) & (F.col("sim_mean") >= 0.63), "fragment_reuse").when((lead >= 0.01) | (F.col("score") >= 0.74), "fallback_reuse")
    top = rest.withColumn("r", F.row_number().over(best)).where("r = 1").withColumn("match_type", stages).where("match_type IS NOT NULL")
    done = done.unionByName(top.select("cam2_gid", "cam1_gid", "match_type", "score"))
    new = valid.select("cam2_gid").distinct().join(done.select("cam2_gid"), "cam2_gid", "left_anti")
    return done.unionByName(new.select("cam2_gid", F.lit(None).cast("bigint").alias("cam1_gid"), F.lit("new").alias("match_type"), F.lit(None).cast("double").alias("score")))


def ambiguity(tracklets: DataFrame) -> DataFrame:
    """Why a stretch has or has not a clear predecessor: candidates, those that pass, the gates that stop others, lead and verdict."""
    scored = reentry_scores(reentry_candidates(tracklets))
    stopped = lambda r: F.count_if(F.col("reason") == r)
    counts = scored.groupBy("clip_id", F.col("c_tracklet_id").alias("tracklet_id")).agg(
        F.count(F.lit(1)).alias("n_candidates"), F.count_if(F.col("reason").isNull()).alias("n_passing"), stopped("entry_exit_side_incompatible").alias("n_side"), stopped("size_ratio_implausible").alias("n_size")
    )
    leads = reranked(scored).where("rank = 1").select("clip_id", F.col("c_tracklet_id").alias("tracklet_id"), "margin")
    joined = tracklets.select("clip_id", "tracklet_id").join(counts, ["clip_id", "tracklet_id"], "left").join(leads, ["clip_id", "tracklet_id"], "left")
    verdict = F.when(F.col("n_candidates").isNull(), "no_candidate").when(F.col("n_passing") == 0, "all_gated").when(F.col("margin") < 0.045, "ambiguous").otherwise("clear")
    return joined.withColumns({"verdict": verdict, "margin": F.round("margin", 6)}).fillna(0, ["n_candidates", "n_passing", "n_side", "n_size"])
