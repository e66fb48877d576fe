import random

import numpy as np
import pytest

from trackloom.operators.spikes import SpikeRules, _judge, box_faults

SCHEMA = "id bigint, clip_id string, global_id bigint, frame_idx bigint, camera_id string, x1 double, y1 double, x2 double, y2 double, frame string, part bigint"


def run(spark, rows, rules=SpikeRules(), cams=(("cam_01", 1000, 500, 10.0),)):
    tracks = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    cameras = spark.createDataFrame(list(cams), "camera_id string, frame_w bigint, frame_h bigint, fps double")
    out = {}
    for r in box_faults(tracks, cameras, rules).collect():
        out.setdefault(r.fault, []).append(r.id)
    return {k: sorted(v) for k, v in out.items()}


def walk(n, clip="a", gid=1, first_id=0, seed=0, camera="Cam 01", step=2):
    """A person who moves by one to `step` pixels a frame."""
    rng, x, rows = random.Random(seed), 300.0, []
    for i in range(n):
        x += rng.uniform(1, step) * (1 if i % 100 < 50 else -1)
        rows.append([first_id + i, clip, gid, i * 2, camera, x, 100.0 + rng.uniform(0, 2), x + 50, 220.0 + rng.uniform(0, 2)])
    return rows


def test_spikes_of_one_to_three(spark):
    rows = walk(300)
    spikes = [20, 60, 61, 120, 121, 122]
    for i in spikes:
        rows[i][5] += 200
        rows[i][7] += 200
    for i in (200, 201, 202, 203):  # four are a lasting move
        rows[i][6] -= 90
    rows[250][8] += 15  # below twenty times the usual change
    rows[280][6] = None  # no coordinate, no case
    assert run(spark, rows) == {"spike": spikes}


def test_box_between_two_spikes_is_none(spark):
    rows = walk(100)
    for i in (40, 42):
        rows[i][6] -= 90
    assert run(spark, rows) == {"spike": [40, 42]}


def test_a_lasting_move_and_a_move_after_a_pause(spark):
    rows = walk(200)
    for r in rows[100:]:
        r[5] += 300
        r[7] += 300
    for r in rows[150:]:
        r[3] += 1000
        r[6] -= 80
    rows[150][6] -= 85  # right after the pause: no box just before it
    rows[180][6] -= 85
    assert run(spark, rows) == {"spike": [180]}


def test_impossible_boxes(spark):
    ok, w, h = (0.0, 0.0, 10.0, 10.0), 1000, 500
    boxes = [ok, (10.0, 0.0, 10.0, 10.0), (0.0, 10.0, 10.0, 5.0), (-250.0, 0.0, 10.0, 10.0), (-250.1, 0.0, 10.0, 10.0), (0.0, 0.0, 1.25 * w + 0.1, 10.0), (0.0, 0.0, 1.25 * w, 10.0), (0.0, -0.25 * h - 1, 1.0, 1.0), (0.0, 0.0, 1.0, 1.25 * h + 1), (None, 0.0, None, 10.0), (float("nan"), 1.0, float("inf"), 9.0), (None, 5.0, None, 4.0)]
    rows = [(i, "a", gid, i, "CAM-01", *b) for i, b in enumerate(boxes) for gid in (0,)]
    assert run(spark, rows) == {"impossible": [1, 2, 4, 5, 7, 8, 11]}
    other = [(i, None, None, None, "unknown", *b) for i, b in enumerate(boxes)]
    assert run(spark, other) == {"impossible": [1, 2, 11]}


def test_stuck_runs(spark):
    rows = walk(120)
    for i in range(30, 38):
        rows[i][5:] = rows[30][5:]
    for i in range(60, 67):  # seven are too few
        rows[i][5:] = rows[60][5:]
    for i in range(80, 95):  # a null breaks a run
        rows[i][5:] = rows[80][5:]
    rows[86] = rows[86][:5] + [None] + rows[86][6:]
    found = run(spark, rows)
    assert found["stuck"] == [*range(30, 38), *range(87, 95)]


def test_deliveries_repeats_and_nulls(spark):
    rows = walk(60, clip=None)
    rows[30][6] -= 90
    again = [[1000 + k, *rows[30][1:]] for k in range(4)]
    again += [[2000, *rows[5][1:]]]
    assert run(spark, rows + again) == {"spike": [30, 1000, 1001, 1002, 1003]}
    assert run(spark, []) == {}
    assert run(spark, rows, cams=()) == {}


@pytest.mark.parametrize("block", [8, 64, 8192])
def test_blocks_do_not_change_the_result(spark, block):
    rows = walk(500, seed=3)
    for i in (7, 8, 100, 101, 102, 255, 256, 499 - 40):
        rows[i][6] -= 100
    for i in range(300, 340):
        rows[i][5:] = rows[300][5:]
    rows += walk(50, gid=2, first_id=5000)
    want = {"spike": [7, 8, 100, 101, 102, 255, 256, 459], "stuck": list(range(300, 340))}
    assert run(spark, rows, SpikeRules(block=block)) == want


@pytest.mark.parametrize("speed", [0, 2, 5, 8, 12, 20, 30])
def test_no_spike_is_lost_at_any_speed(speed):
    """Steady movers by so many median changes a box: the planted spikes are found, and nothing else once the chart has settled.

    (From ``far`` changes a box on, the boxes of the mover themselves are far from both neighbours.)"""
    r = SpikeRules()
    rng = np.random.default_rng(speed)
    n = 900
    x = np.cumsum(np.full((n, 4), float(speed)), axis=0) + rng.normal(0, 0.6, (n, 4))
    planted = np.zeros(n, bool)
    for at in range(20, n - 20, 11):
        length, side = int(rng.integers(1, 4)), rng.choice([-1, 1])
        # Far from the box before and from the one after, wherever the mover has got to by then.
        x[at : at + length, rng.integers(4)] += side * (r.far + 3 + speed * (length + 1) + rng.uniform(0, 60))
        planted[at : at + length] = True
    _, spike = _judge(np.zeros(n, np.int64), np.arange(n), x, np.zeros(n, bool), np.ones(n), np.full(n, 20.0), r)
    assert not (planted & ~spike).any()
    assert speed >= r.far or not (spike & ~planted)[20:].any()


def test_spike_right_after_a_small_lasting_move(spark):
    rows = walk(60)
    for r in rows[30:]:
        r[6] -= 12
    for i in (33, 34, 35):
        rows[i][6] -= 60
    assert run(spark, rows) == {"spike": [33, 34, 35]}
