import random
from itertools import groupby

import pytest

from trackloom.operators.sessions import presence_sessions

SCHEMA = "clip_id string, global_id bigint, ts double, block string, n bigint"


def table(spark, rows):
    return spark.createDataFrame([(c, g, t, "x", 9) for c, g, t in rows], SCHEMA)


def got(df):
    return sorted((r.clip_id or "", r.global_id, r.start_ms, r.end_ms, r.duration_ms, r.n_boxes) for r in df.collect())


def brute(rows, gap):
    out = []
    kept = sorted((c or "", g, round(1000 * t)) for c, g, t in rows if g is not None and g > 0 and t is not None and t == t and abs(t) != float("inf"))
    for key, part in groupby(kept, key=lambda r: r[:2]):
        run = []
        for _, _, ms in part:
            if run and ms - run[-1] > gap:
                out.append((*key, run[0], run[-1], run[-1] - run[0], len(run)))
                run = []
            run.append(ms)
        out.append((*key, run[0], run[-1], run[-1] - run[0], len(run)))
    return sorted(out)


def test_exact_gap_merges_and_one_more_splits(spark):
    rows = [("a", 1, 0.0), ("a", 1, 30.0), ("a", 1, 60.001), ("a", 2, 5.0)]
    assert got(presence_sessions(table(spark, rows))) == [("a", 1, 0, 30000, 30000, 2), ("a", 1, 60001, 60001, 0, 1), ("a", 2, 5000, 5000, 0, 1)]


def test_nulls_unassigned_ties_and_repeats(spark):
    rows = [(None, 1, 1.0), (None, 1, 1.0), ("a", 0, 1.0), ("a", -1, 1.0), ("a", None, 1.0), ("a", 1, None), ("a", 1, float("nan")), ("a", 1, float("inf")), ("a", 1, -3.0)]
    assert got(presence_sessions(table(spark, rows))) == [("", 1, 1000, 1000, 0, 2), ("a", 1, -3000, -3000, 0, 1)]


def test_empty(spark):
    assert got(presence_sessions(table(spark, []))) == []


@pytest.mark.parametrize("seed", range(3))
def test_many_blocks_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows, t = [], 0.0
    for _ in range(900):  # one track holds most rows and spans many blocks of 100 s
        t += rng.choice([0, 0.5, 1, 5, 29.9, 30, 30.1, 80, 300])
        rows.append(("hot", 7, round(t, 3)))
    rows += [(rng.choice(["a", None]), rng.randint(-1, 2), rng.choice([None, round(rng.uniform(-200, 400), 3)])) for _ in range(200)]
    rng.shuffle(rows)
    assert got(presence_sessions(table(spark, rows), block_ms=100_000)) == brute(rows, 30_000)


def test_parameters(spark):
    with pytest.raises(ValueError):
        presence_sessions(table(spark, []), gap_ms=10, block_ms=10)
