import random
from itertools import groupby

import pytest

from trackloom.operators.intervals import merge_intervals, visit_intervals

SCHEMA = "clip_id string, global_id bigint, zone_id string, t_enter double, t_exit double, kind string, k bigint"


def run(spark, rows, **how):
    df = merge_intervals(visit_intervals(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)), **how)
    return sorted((r.clip_id or "", r.global_id, r.zone_key, r.kind, r.start_ms, r.end_ms) for r in df.collect())


def brute(rows, longest=3_600_000):
    kept = sorted((c or "", g, z, round(a * 1000), round(b * 1000)) for c, g, z, a, b in rows if g and g > 0 and z and a is not None and b is not None and round(b * 1000) > round(a * 1000))
    out = []
    for key, part in groupby(kept, key=lambda r: r[:3]):
        periods = []
        for *_, a, b in part:
            if periods and a <= periods[-1][1]:
                periods[-1][1] = max(periods[-1][1], b)
            else:
                periods.append([a, b])
        out += [(*key, "period", a, b) for a, b in periods]
        out += [(*key, "gap", p[1], q[0]) for p, q in zip(periods, periods[1:]) if q[0] - p[1] <= longest]
    return sorted(out)


def test_overlap_nest_touch_repeat(spark):
    rows = [("a", 1, "z", 0.0, 5.0), ("a", 1, "Z ", 4.0, 6.0), ("a", 1, "z", 1.0, 2.0), ("a", 1, "z", 6.0, 7.0), ("a", 1, "z", 9.0, 9.5), ("a", 1, "z", 9.0, 9.5)]
    assert run(spark, rows) == [("a", 1, "z", "gap", 7000, 9000), ("a", 1, "z", "period", 0, 7000), ("a", 1, "z", "period", 9000, 9500)]


def test_what_does_not_count(spark):
    rows = [("a", 0, "z", 0.0, 5.0), ("a", None, "z", 0.0, 5.0), ("a", 1, None, 0.0, 5.0), ("a", 1, " ", 0.0, 5.0), ("a", 1, "z", 0.0, None), ("a", 1, "z", None, 1.0), ("a", 1, "z", 5.0, 5.0), ("a", 1, "z", 6.0, 5.0), ("a", 1, "z", float("nan"), 5.0)]
    assert run(spark, rows) == [] and run(spark, []) == []
    assert run(spark, [(None, 1, "z", 0.0, 1.0)]) == [("", 1, "z", "period", 0, 1000)]


def test_longest_gap(spark):
    rows = [("a", 1, "z", 0.0, 1.0), ("a", 1, "z", 3601.0, 3602.0), ("a", 1, "z", 7202.001, 7203.0)]
    assert [r for r in run(spark, rows) if r[3] == "gap"] == [("a", 1, "z", "gap", 1000, 3601000)]


@pytest.mark.parametrize("seed", range(3))
def test_many_blocks_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(700):
        a = round(rng.uniform(0, 20_000), rng.choice([0, 3]))
        rows.append((rng.choice(["hot"] * 4 + [None, "b"]), rng.choice([1, 1, 1, 2]), rng.choice(["z", "z", "y"]), a, round(a + rng.choice([1, 10, 60, 900]), 3)))
    assert run(spark, rows, block_ms=500_000, longest_gap_ms=100_000) == brute(rows, 100_000)
