import random
from collections import defaultdict

import pytest

from trackloom.llm.topn import top_pairs

SCHEMA = "cam1_gid bigint, cam2_gid bigint, score double, rank int, salt string"


def run(spark, rows, n=3, subgroups=4):
    df = top_pairs(spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA), n, subgroups)
    return sorted(((r.cam1_gid, r.rank, r.cam2_gid, r.score) for r in df.collect()), key=str)


def brute(rows, n):
    best = defaultdict(dict)
    for a, b, s in rows:
        if s is not None and 0 <= s <= 1:
            best[a][b] = max(s, best[a].get(b, -1))
    return sorted(((a, i + 1, b, s) for a, g in best.items() for i, (b, s) in enumerate(sorted(g.items(), key=lambda x: (-x[1], x[0] is not None, x[0] or 0))[:n])), key=str)


def test_ties_invalid_and_repeated(spark):
    rows = [(1, 9, 0.5), (1, 8, 0.5), (1, 7, 0.5), (1, 6, 0.5), (1, 5, None), (1, 4, float("nan")), (1, 3, 1.1), (1, 2, -0.1), (1, 9, 0.6), (2, 1, 0.0), (2, 1, 0.0), (3, 1, None), (None, 1, 1.0), (None, None, 1.0)]
    assert run(spark, rows) == brute(rows, 3)
    assert (1, 1, 9, 0.6) in run(spark, rows) and run(spark, []) == []


@pytest.mark.parametrize("subgroups", [1, 32])
def test_equals_brute_force_with_a_hot_group(spark, subgroups):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, 3]), rng.randint(1, 400), round(rng.random(), 1)) for _ in range(3000)]
    assert run(spark, rows, 5, subgroups) == brute(rows, 5)


def test_parameters(spark):
    with pytest.raises(ValueError):
        top_pairs(spark.createDataFrame([], SCHEMA), 0)
