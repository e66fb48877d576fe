"""A tracker by detection: boxes of successive frames become local tracks. The same state serves batches and streams."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from trackloom.operators.islands import fold_sorted
from trackloom.operators.matching import best_assignment


@dataclass(frozen=True)
class TrackerRules:
    """``active``, ``recent``, ``long``: greatest age in frames of the three stages of association. ``least_*``: scores that a pair needs.
    ``birth``: confidence from which an unmatched box starts a track. ``confirm``: boxes that confirm one. ``hold``: frames that
    tracks outlive a bad frame."""

    active: int = 2
    recent: int = 12
    long: int = 140
    least_active: float = 0.10
    least_recent: float = 0.12
    least_long: float = 0.45
    birth: float = 0.5
    confirm: int = 4
    hold: int = 12


@dataclass
class Track:
    number: int
    box: np.ndarray
    frame: int
    speed: np.ndarray = field(default_factory=lambda: np.zeros(4))
    hits: int = 1
    feature: np.ndarray | None = None


def _iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of every box of ``a`` with every box of ``b``."""
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    inter = np.prod(np.clip(high - low, 0, None), axis=2)
    size = lambda x: np.prod(np.clip(x[:, 2:] - x[:, :2], 0, None), axis=1)
    return inter / (size(a)[:, None] + size(b)[None, :] - inter + 1e-6)


class FrameTracker:
    """State of one clip: tracks and the next number. ``update`` takes a frame's boxes and gives their track numbers (0: none)."""

    def __init__(self, rules: TrackerRules = TrackerRules()) -> None:
        self.rules, self.tracks, self.next = rules, [], 1
        self.held = 0

    def _stage(self, frame: int, boxes: np.ndarray, features, open_: list[int], tracks: list[Track], least: float, by_motion: float) -> dict[int, Track]:
        if not open_ or not tracks:
            return {}
        there = np.array([t.box + t.speed * (frame - t.frame) for t in tracks])
        mine = boxes[open_]
        overlap = _iou(there, mine)
        tall = np.maximum(there[:, 3] - there[:, 1], 1.0)
        gap = (there[:, None, :2] + there[:, None, 2:] - mine[None, :, :2] - mine[None, :, 2:]) / 2
        away = np.hypot(gap[..., 0], gap[..., 1]) / tall[:, None]
        score = (1 - by_motion) * overlap + by_motion * np.exp(-away) + 0.03 * (away < 0.35) - 0.04 * np.minimum(away, 2)
        if features is not None:
            known = [t.feature if t.feature is not None else np.zeros(features.shape[1]) for t in tracks]
            alike = np.array(known) @ features[open_].T
            score = 0.65 * score + 0.35 * alike
        score = np.where(score >= least, score, 0.0)
        return {open_[j]: tracks[i] for i, j in best_assignment(score) if score[i, j] > 0}

    def update(self, frame: int, boxes: np.ndarray, conf: np.ndarray, features: np.ndarray | None = None, is_bad: bool = False) -> list[int]:
        r = self.rules
        if is_bad:  # no births and no updates; tracks wait
            self.held += 1
            if self.held > r.hold:
                self.tracks = []
            return [0] * len(boxes)
        self.held = 0
        self.tracks = [t for t in self.tracks if frame - t.frame <= r.long]
        numbers, open_ = [0] * len(boxes), list(range(len(boxes)))
        left = list(self.tracks)
        for oldest, least, by_motion in ((r.active, r.least_active, 0.30), (r.recent, r.least_recent, 0.60), (r.long, r.least_long, 1.0)):
            found = self._stage(frame, boxes, features, open_, [t for t in left if frame - t.frame <= oldest], least, by_motion)
            for j, t in found.items():
                dt = max(1, frame - t.frame)
                t.speed = 0.7 * t.speed + 0.3 * (boxes[j] - t.box) / dt
                t.box, t.frame, t.hits = boxes[j], frame, t.hits + 1
                if features is not None:
                    mixed = features[j] if t.feature is None else 0.92 * t.feature + 0.08 * features[j]
                    t.feature = mixed / (np.linalg.norm(mixed) or 1.0)
                numbers[j] = t.number
            taken = {id(t) for t in found.values()}
            left = [t for t in left if id(t) not in taken]
            open_ = [j for j in open_ if j not in found]
        for j in open_:
            if conf[j] >= r.birth:
                self.tracks.append(Track(self.next, boxes[j], frame, feature=None if features is None else features[j]))
                numbers[j], self.next = self.next, self.next + 1
        return numbers


class _Clip:
    def __init__(self, key: tuple, rules: TrackerRules) -> None:
        self.key, self.tracker, self.frame, self.rows = key, FrameTracker(rules), None, []

    def _flush(self):
        if self.rows:
            boxes = np.array([r[1] for r in self.rows])
            numbers = self.tracker.update(self.frame, boxes, np.array([r[2] for r in self.rows]), None, all(r[3] for r in self.rows))
            yield from ((*self.key, r[0], n) for r, n in zip(self.rows, numbers))
        self.rows = []

    def step(self, row):
        if row.frame_idx != self.frame:
            yield from self._flush()
            self.frame = int(row.frame_idx)
        conf = 0.0 if row.conf is None or row.conf != row.conf else float(row.conf)
        self.rows.append((int(row.row_idx), (row.x1, row.y1, row.x2, row.y2), conf, bool(row.frame_is_bad)))

    def end(self):
        yield from self._flush()


def tracked(detections: DataFrame, rules: TrackerRules = TrackerRules()) -> DataFrame:
    """``clip_id, row_idx, local_id`` of detections (row_idx, clip_id, frame_idx, box, conf, frame_is_bad) in order of frames.

    Frames of a clip depend on each other, so a clip is one stream; clips run side by side.
    """
    rows = detections.select("clip_id", "frame_idx", "row_idx", "x1", "y1", "x2", "y2", "conf", "frame_is_bad")
    return fold_sorted(rows, ["clip_id"], ["frame_idx", "row_idx"], lambda key: _Clip(key, rules), "clip_id string, row_idx bigint, local_id bigint")
