"""Identities carried over from references: claims under caps, anchors with reasons, and an online identity layer."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.vectors import dot, unit_vector
from trackloom.operators.embeddings import centroids
from trackloom.operators.islands import fold_sorted
from trackloom.session import broadcast_if_small


@dataclass(frozen=True)
class ClaimRules:
    """``least``: score that a claim needs. ``margin``: lead over the second, half of it from ``strong`` on, none from ``sure`` on.
    ``overlap``: frames that claims of one reference may share. ``sources``: different sources that one reference may have."""

    least: float = 0.69
    margin: float = 0.04
    strong: float = 0.83
    sure: float = 0.88
    overlap: int = 6
    sources: int = 3


class _Claims:
    """The largest targets claim first; those that get nothing inherit their source's main reference if time allows, else a new id."""

    def __init__(self, key: tuple, rules: ClaimRules) -> None:
        self.key, self.rules = key, rules
        self.spans: dict[int, list[tuple[int, int]]] = {}
        self.of_reference: dict[int, set[int]] = {}
        self.votes: dict[int, dict[int, int]] = {}
        self.open: list[tuple[int, int, int, int]] = []
        self.highest = 0
        self.target, self.told = None, []

    def _fits(self, reference: int, start: int, end: int) -> bool:
        return all(min(end, e) - max(start, s) + 1 <= self.rules.overlap for s, e in self.spans.get(reference, ()))

    def _take(self, reference: int, start: int, end: int) -> None:
        self.spans.setdefault(reference, []).append((start, end))

    def step(self, row):
        """A target with one reference (null if none); a target's references come from the best score down."""
        if self.target != row.target:
            self._settle()
            self.target, self.sure, self.held, self.given = int(row.target), None, None, None
            self.source, self.start, self.stop, self.n_rows = int(row.source or 0), int(row.start_frame), int(row.end_frame), int(row.n_rows or 0)
            self.highest = max(self.highest, int(row.top_reference or 0))
        if row.ref is not None and self.given is None and self.sure is not False:
            score, reference = float(row.score), int(row.ref)
            if self.held is None:
                self.held = (score, reference)
            else:
                if self.sure is None:
                    self._judge(score)
                self._try(score, reference)
        return self._told()

    def _judge(self, second: float) -> None:
        """Whether the best reference leads enough for this target to claim one; if so, the best is tried."""
        r, best = self.rules, self.held[0]
        need = r.margin if best < r.strong else r.margin / 2
        self.sure = best >= r.least and (best - second >= need or best >= r.sure)
        self._try(*self.held)

    def _try(self, score: float, reference: int) -> None:
        if not self.sure or self.given is not None or score < self.rules.least:
            return
        known = self.of_reference.setdefault(reference, set())
        if not self._fits(reference, self.start, self.stop) or (self.source > 0 and self.source not in known and len(known) >= self.rules.sources):
            return
        self._take(reference, self.start, self.stop)
        if self.source > 0:
            known.add(self.source)
            votes = self.votes.setdefault(self.source, {})
            votes[reference] = votes.get(reference, 0) + max(1, self.n_rows)
        self.given = reference

    def _settle(self) -> None:
        """The target before is complete: a lone reference is judged, and a target that claimed none waits for ``end``."""
        if self.target is None:
            return
        if self.held is not None and self.sure is None:
            self._judge(-1.0)
        if self.given is None:
            self.open.append((self.start, self.target, self.source, self.stop))
        else:
            self.told.append((*self.key, self.target, self.given, "claimed"))

    def _told(self) -> list[tuple]:
        told, self.told = self.told, []
        return told

    def end(self):
        self._settle()
        yield from self._told()
        for start, target, source, end in sorted(self.open):
            votes = self.votes.get(source) if source > 0 else None
            reference = min(votes, key=lambda v: (-votes[v], v)) if votes else None
            if reference is not None and self._fits(reference, start, end):
                self._take(reference, start, end)
                yield (*self.key, target, reference, "inherited")
            else:
                self.highest += 1
                yield (*self.key, target, self.highest, "new")


def claimed(targets: DataFrame, scores: DataFrame, rules: ClaimRules = ClaimRules()) -> DataFrame:
    """References for targets (clip_id, target, source, n_rows, start_frame, end_frame) by scores (clip_id, target, ref, score):
    clip_id, target, identity, how. Several targets may have one reference if they do not overlap in time. Every reference of score
    ``least`` or more is tried, from the best down."""
    top = scores.groupBy("clip_id").agg(F.max("ref").alias("top_reference"))
    rows = targets.join(scores.select("clip_id", "target", "ref", "score"), ["clip_id", "target"], "left").join(top, "clip_id", "left")
    ordered = rows.withColumns({"less": -F.col("n_rows"), "minus": -F.col("score")})
    return fold_sorted(ordered, ["clip_id"], ["less", "target", "minus", "ref"], lambda key: _Claims(key, rules), "clip_id string, target bigint, identity bigint, how string")


def anchor_evidence(targets: DataFrame, references: DataFrame) -> DataFrame:
    """Every target with every reference (both: vec_id, embedding, label): mean and best cosine of the target's vectors with the
    reference's centroid, the share of its vectors that are nearest to it, and the leads over the next reference."""
    refs = broadcast_if_small(centroids(references).select(F.col("label").alias("ref"), F.col("centroid").alias("c")))
    near = targets.where("embedding IS NOT NULL").select("vec_id", "label", unit_vector(F.col("embedding")).alias("v")).join(refs).select("vec_id", F.col("label").alias("target"), "ref", F.round(dot(F.col("v"), F.col("c")), 9).alias("d"))
    first = near.groupBy("vec_id", "target").agg(F.min_by("ref", F.struct(-F.col("d"), "ref")).alias("ref"))
    votes = first.groupBy("target", "ref").agg(F.count(F.lit(1)).alias("votes"))
    sums = near.groupBy("target", "ref").agg(F.round(F.avg("d"), 6).alias("mean"), F.round(F.max("d"), 6).alias("best"), F.count(F.lit(1)).alias("n"))
    both = sums.join(votes, ["target", "ref"], "left").withColumn("vote", F.round(F.coalesce("votes", F.lit(0)) / F.col("n"), 6))
    order = Window.partitionBy("target").orderBy(F.desc("mean"), "ref")
    return both.withColumns({"rank": F.row_number().over(order), "margin": F.round(F.col("mean") - F.coalesce(F.lead("mean").over(order), F.lit(-1.0)), 6)}).drop("votes")


def anchored(evidence: DataFrame, least_mean: float = 0.82, least_best: float = 0.88, least_vote: float = 0.55, margin: float = 0.04, least_rows: int = 5) -> DataFrame:
    """The best reference of each target, and whether it is accepted or the first reason against it: target, ref, reason."""
    reason = (
        F.when(F.col("n") < least_rows, "low_prototype_quality")
        .when(F.col("mean") < least_mean, "below_min_mean")
        .when(F.col("best") < least_best, "below_min_best")
        .when(F.col("vote") < least_vote, "votes_disagree")
        .when(F.col("margin") < margin, "below_min_margin")
        .otherwise("accepted")
    )
    top = evidence.where("rank = 1").withColumn("reason", reason)
    # A reference goes to one target: the one of the highest mean, then the lower label.
    one = Window.partitionBy("ref", F.col("reason") == "accepted").orderBy(F.desc("mean"), "target")
    ranked = top.withColumn("r", F.row_number().over(one))
    return ranked.select("target", "ref", "mean", F.when((F.col("reason") == "accepted") & (F.col("r") > 1), "reserved").otherwise(F.col("reason")).alias("reason"))


def separated(vectors: DataFrame, a: int, b: int, margin: float = 0.08) -> DataFrame:
    """Vectors of two labels, those moved to the other label that resemble its centroid more by ``margin``: vec_id, label, new_label."""
    pair = vectors.where(F.col("label").isin(a, b))
    c = centroids(pair)
    ca = broadcast_if_small(c.where(F.col("label") == a).select(F.col("centroid").alias("ca")))
    cb = broadcast_if_small(c.where(F.col("label") == b).select(F.col("centroid").alias("cb")))
    scored = pair.where("embedding IS NOT NULL").select("vec_id", "label", unit_vector(F.col("embedding")).alias("v")).join(ca).join(cb)
    lead = F.round(dot(F.col("v"), F.col("ca")) - dot(F.col("v"), F.col("cb")), 9)
    return scored.select("vec_id", "label", F.when(lead >= margin, a).when(lead <= -margin, b).otherwise(F.col("label")).cast("bigint").alias("new_label"))


@dataclass(frozen=True)
class LayerRules:
    """``memory``: frames for which a lost local track's identity stays reserved for likeness alone at ``reuse``. ``reuse``, ``margin``: score
    and lead for an identity of the bank. ``confirm``, ``confirm_new``: successive proposals that lock one. ``least_quality``: below it a
    row decides nothing. ``drift``, ``release``: likeness that counts as drift, and net drifts that release a lock."""

    memory: int = 48
    reuse: float = 0.70
    margin: float = 0.04
    confirm: int = 2
    confirm_new: int = 3
    least_quality: float = 0.34
    drift: float = 0.34
    release: int = 6
    prototypes: int = 8


@dataclass
class _Local:
    gid: int = 0
    pending: int = 0
    hits: int = 0
    drifts: int = 0
    seen: int = -1


@dataclass
class _Known:
    first: np.ndarray
    main: np.ndarray
    kept: list = field(default_factory=list)
    last: int = -1
    owner: int = -1

    def likeness(self, v: np.ndarray) -> float:
        top = sorted((float(p @ v) for p in self.kept), reverse=True)[:4]
        main, mean_top = float(self.main @ v), float(np.mean(top))
        recent = max(0.65 * main + 0.35 * mean_top, 0.96 * mean_top, 0.92 * top[0])
        return 0.68 * recent + 0.32 * float(self.first @ v)


class IdentityLayer:
    """Gives local tracks identities that outlive them. State of one clip; ``update`` takes a frame's rows (local_id, quality, unit
    feature) and gives (identity, reason) of each; identity 0 is undecided."""

    def __init__(self, rules: LayerRules = LayerRules()) -> None:
        self.rules, self.locals, self.bank, self.next = rules, {}, {}, 1

    def _propose(self, frame: int, local: int, v: np.ndarray, busy: set[int]) -> tuple[int, str]:
        scored = sorted(((k.likeness(v), -g) for g, k in self.bank.items() if g not in busy), reverse=True)
        if scored:
            best, lead = scored[0][0], scored[0][0] - (scored[1][0] if len(scored) > 1 else -1.0)
            recent = self.bank[-scored[0][1]].last >= frame - self.rules.memory
            if best >= self.rules.reuse and (lead >= self.rules.margin or recent):
                return -scored[0][1], "short_memory" if recent else "bank"
            if best >= self.rules.reuse:
                return 0, "ambiguous"
        return -1, "new"

    def update(self, frame: int, rows: list[tuple[int, float, np.ndarray]]) -> list[tuple[int, str]]:
        r, out = self.rules, []
        busy = {l.gid for n, l in self.locals.items() if l.gid and any(n == row[0] for row in rows)}
        used: set[int] = set()
        for local, quality, v in rows:
            state = self.locals.setdefault(local, _Local())
            state.seen = frame
            if state.gid:
                known = self.bank[state.gid]
                like = known.likeness(v)
                if quality >= r.least_quality:
                    state.drifts = state.drifts + 1 if like < r.drift else max(0, state.drifts - 1)
                if state.drifts >= r.release:
                    busy.discard(state.gid)
                    known.owner, state.gid, state.drifts, state.hits = -1, 0, 0, 0
                    out.append((0, "drift_release"))
                    continue
                if state.gid in used:
                    out.append((0, "conflict"))
                    continue
                used.add(state.gid)
                known.last, known.owner = frame, local
                if quality >= r.least_quality and like >= r.drift:
                    mixed = 0.9 * known.main + 0.1 * v
                    known.main = mixed / (np.linalg.norm(mixed) or 1.0)
                    if max(float(p @ v) for p in known.kept) < 0.97:
                        known.kept = [*known.kept, v][-r.prototypes :]
                out.append((state.gid, "locked"))
                continue
            if quality < r.least_quality:
                out.append((0, "low_quality"))
                continue
            proposal, why = self._propose(frame, local, v, busy | used)
            if proposal == 0:
                state.hits = max(0, state.hits - 1)
                out.append((0, why))
                continue
            state.hits = state.hits + 1 if proposal == state.pending else 1
            state.pending = proposal
            if state.hits < (r.confirm_new if proposal < 0 else r.confirm):
                out.append((0, "pending"))
                continue
            if proposal < 0:
                proposal, self.next = self.next, self.next + 1
                self.bank[proposal] = _Known(v, v, [v])
            state.gid, state.hits, state.drifts = proposal, 0, 0
            self.bank[proposal].last, self.bank[proposal].owner = frame, local
            used.add(proposal)
            out.append((proposal, why))
        self.locals = {n: s for n, s in self.locals.items() if s.gid or frame - s.seen <= r.memory}
        return out


class _Layer:
    def __init__(self, key: tuple, rules: LayerRules) -> None:
        self.key, self.layer, self.frame, self.rows = key, IdentityLayer(rules), None, []

    def _flush(self):
        if self.rows:
            for row, (gid, why) in zip(self.rows, self.layer.update(self.frame, [r[1:] for r in self.rows])):
                yield (*self.key, row[0], gid, why)
        self.rows = []

    def step(self, row):
        if row.frame_idx != self.frame:
            yield from self._flush()
            self.frame = int(row.frame_idx)
        self.rows.append((int(row.row_idx), int(row.local_id), float(row.quality), np.asarray(row.v, float)))

    def end(self):
        yield from self._flush()


def identified(rows: DataFrame, rules: LayerRules = LayerRules()) -> DataFrame:
    """Identities of local tracks' rows (clip_id, frame_idx, row_idx, local_id, quality, v): clip_id, row_idx, identity, reason."""
    slim = rows.select("clip_id", "frame_idx", "row_idx", "local_id", "quality", "v")
    return fold_sorted(slim, ["clip_id"], ["frame_idx", "row_idx"], lambda key: _Layer(key, rules), "clip_id string, row_idx bigint, identity bigint, reason string")
