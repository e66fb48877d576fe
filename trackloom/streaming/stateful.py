"""Streams of boxes: sessions, visits with hysteresis, tracking and ingest. Each keeps only state that its watermark bounds."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackloom.operators.tracker import FrameTracker, TrackerRules
from trackloom.session import ship_package


def stream_sessions(boxes: DataFrame, gap: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """Presence sessions of a stream with a ``captured_at`` timestamp. A session ends where the pause is longer than ``gap``; rows later
    than ``late`` are dropped. (A session window of ``gap`` merges up to and including it, as the batch operator does, if the gap is
    given one microsecond more; whole-second gaps of clock times do not meet that edge.)"""
    return (
        boxes.where("global_id > 0")
        .withWatermark("captured_at", late)
        .groupBy(F.session_window("captured_at", gap).alias("w"), "clip_id", "global_id")
        .agg(F.min("captured_at").alias("start_at"), F.max("captured_at").alias("end_at"), F.count(F.lit(1)).alias("n_boxes"))
        .drop("w")
    )


_VISIT = "clip_id string, global_id bigint, zone_key string, enter_ms bigint, exit_ms bigint"


def stream_visits(boxes: DataFrame, hold_ms: int = 1000, idle_ms: int = 60_000, late: str = "10 minutes") -> DataFrame:
    """Visits of a stream (clip_id, global_id, zone_key, ms, captured_at) by the online rule: a change of zone commits once its candidate
    has held for ``hold_ms``. A person not seen for ``idle_ms`` of event time leaves."""
    ship_package(boxes.sparkSession)

    def handle(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        if state.hasTimedOut:
            zone, since, _, _, last, _ = pickle.loads(state.get[0])
            if zone is not None and last > since:
                out.append((*key, zone, since, last))
            state.remove()
        else:
            zone, since, candidate, started, last, seen = pickle.loads(state.get[0]) if state.exists else (None, 0, None, None, -1, False)
            rows = pd.concat(list(frames)).sort_values("ms", kind="stable")
            for at, now in zip(rows["ms"].astype(int), rows["zone_key"]):
                now = None if now is None or now != now else now
                if at < last:  # behind what has been decided
                    continue
                last = at
                if not seen:
                    zone, since, seen = now, at, True
                elif now == zone:
                    started = None
                elif started is None or candidate != now:
                    candidate, started = now, at
                elif at - started >= hold_ms:
                    if zone is not None:
                        out.append((*key, zone, since, at))
                    zone, since, started = now, at, None
            state.update((pickle.dumps((zone, since, candidate, started, last, seen)),))
            newest = int(rows["captured_at"].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + idle_ms)
        if out:
            yield pd.DataFrame(out, columns=["clip_id", "global_id", "zone_key", "enter_ms", "exit_ms"])

    rows = boxes.where("global_id > 0 AND ms IS NOT NULL").withWatermark("captured_at", late)
    return rows.groupBy("clip_id", "global_id").applyInPandasWithState(handle, _VISIT, "state binary", "append", GroupStateTimeout.EventTimeTimeout)


def stream_tracks(detections: DataFrame, rules: TrackerRules = TrackerRules()) -> DataFrame:
    """Local track numbers of a stream of detections, keyed by clip. Rows of a batch are put in frame order; frames at or before
    the last one handled come too late and get number 0."""
    ship_package(detections.sparkSession)

    def handle(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker, last = pickle.loads(state.get[0]) if state.exists else (FrameTracker(rules), -1)
        rows = pd.concat(list(frames)).sort_values(["frame_idx", "row_idx"])
        out = []
        for frame, part in rows.groupby("frame_idx", sort=True):
            boxes = part[["x1", "y1", "x2", "y2"]].to_numpy(float)
            if frame <= last:
                numbers = [0] * len(part)
            else:
                numbers, last = tracker.update(int(frame), boxes, np.nan_to_num(part["conf"].to_numpy(float)), None, False), int(frame)
            out.append(pd.DataFrame({"clip_id": key[0], "row_idx": part["row_idx"].to_numpy(), "local_id": numbers}))
        state.update((pickle.dumps((tracker, last)),))
        yield pd.concat(out)

    rows = detections.select("clip_id", "frame_idx", "row_idx", "x1", "y1", "x2", "y2", "conf")
    return rows.groupBy("clip_id").applyInPandasWithState(handle, "clip_id string, row_idx bigint, local_id bigint", "state binary", "append", GroupStateTimeout.NoTimeout)


def ingest(stream: DataFrame, folder: str, checkpoint: str):
    """Appends a stream of boxes to Parquet partitioned by camera and clip; a replayed batch overwrites what it wrote before.

    Each batch goes to its own folder ``batch=<number>``, so a retry after a lost executor or driver leaves no duplicates.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("camera", "clip_id").parquet(str(PurePosixPath(folder) / f"batch={number}"))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
