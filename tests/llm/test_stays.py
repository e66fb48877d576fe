import random
from itertools import groupby

import pytest

from trackloom.llm.stays import zone_stays

SCHEMA = "id bigint, clip_id string, global_id bigint, frame_idx bigint, ts double, zone_id string, block string, run int, e int"


def run(spark, rows, **how):
    df = zone_stays(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA), **how)
    return sorted((r.clip_id or "", r.global_id, r.zone_key, r.start_frame, r.end_frame, r.n_events, r.start_ms, r.end_ms, r.duration_ms) for r in df.collect())


def brute(rows, least=2):
    first = {}
    for i, c, g, f, t, z in sorted(rows, key=lambda r: r[0]):
        if g is not None and g > 0 and t is not None and f is not None:
            first.setdefault((c or "", g, f), (round(1000 * t), z.strip().lower() if z and z.strip() else None))
    out = []
    for key, part in groupby(sorted(first.items()), key=lambda r: r[0][:2]):
        stay = []
        for (_, _, f), (ms, z) in [*part, ((0, 0, 0), (0, None))]:
            if stay and z != stay[0][2]:
                if len(stay) >= least:
                    out.append((*key, stay[0][2], stay[0][0], stay[-1][0], len(stay), stay[0][1], stay[-1][1], stay[-1][1] - stay[0][1]))
                stay = []
            if z is not None:
                stay.append((f, ms, z))
    return sorted(out)


def test_small_cases(spark):
    rows = [(1, "a", 1, 1, 0.1, "Door"), (2, "a", 1, 2, 0.2, "door "), (3, "a", 1, 2, 9.0, "other"), (4, "a", 1, 900, 99.0, "door"), (5, "a", 1, 901, 99.1, None), (6, "a", 1, 902, 99.2, "door"), (7, "a", 1, 903, 99.3, " "), (8, "a", 1, 904, None, "door"), (9, "a", 0, 1, 1.0, "door"), (10, "a", 0, 2, 1.0, "door"), (11, None, 1, 5, 1.0, "x"), (12, None, 1, 6, 1.5, "x"), (13, "a", 1, None, 1.0, "door")]
    assert run(spark, rows) == [("", 1, "x", 5, 6, 2, 1000, 1500, 500), ("a", 1, "door", 1, 900, 3, 100, 99000, 98900)]
    assert run(spark, []) == []


@pytest.mark.parametrize("block", [1, 4, 50, 2048])
def test_any_block_equals_brute_force(spark, block):
    rng = random.Random(block)
    rows, i = [], 0
    for clip, gid, n in [("a", 1, 260), ("a", 2, 40), (None, 1, 30)]:
        f, z = 0, "z"
        for _ in range(n):
            f += rng.choice([1, 1, 2, 3, 40])
            if rng.random() < 0.06:
                z = rng.choice(["z", "y", None, ""])
            rows.append((i := i + 1, clip, gid, f, f / 10, z))
            if rng.random() < 0.1:
                rows.append((i := i + 1, clip, gid, f, f / 10, z))
    rng.shuffle(rows)
    assert run(spark, rows, block_frames=block) == brute(rows)


def test_one_long_run_over_many_blocks(spark):
    rows = [(i, "a", 1, i * 3, i / 4, "z") for i in range(200)]
    assert run(spark, rows, block_frames=5) == [("a", 1, "z", 0, 597, 200, 0, 49750, 49750)]
