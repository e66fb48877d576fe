import random
from itertools import permutations

import numpy as np
import pytest

from trackloom.operators.matching import best_assignment, constrained_union, greedy_match, optimal_match
from trackloom.operators.tracker import FrameTracker, tracked


def greedy(edges):
    left, right, out = set(), set(), []
    for a, b, s in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            out.append((a, b, s))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_greedy_rounds_equal_the_sorted_loop(spark, seed):
    rng = random.Random(seed)
    edges = list({(rng.randint(0, 40), rng.randint(0, 40)): round(rng.random(), 1) for _ in range(400)}.items())
    edges = [(a, b, s) for (a, b), s in edges]
    df = spark.createDataFrame(edges, "a bigint, b bigint, s double")
    assert sorted((r.a, r.b, r.s) for r in greedy_match(df, ["a"], ["b"], "s").collect()) == greedy(edges)
    assert greedy_match(df.limit(0), ["a"], ["b"], "s").collect() == []


@pytest.mark.parametrize("shape", [(1, 1), (2, 5), (5, 2), (4, 4), (5, 5)])
def test_best_assignment_is_optimal(shape):
    rng = np.random.default_rng(sum(shape))
    for _ in range(40):
        value = np.round(rng.random(shape), 2) * (rng.random(shape) < 0.7)
        got = best_assignment(value)
        n, m = shape
        small, big = (value, m) if n <= m else (value.T, n)
        best = max(sum(small[i, p[i]] for i in range(len(small))) for p in permutations(range(big), len(small)))
        assert sum(value[i, j] for i, j in got) == pytest.approx(best)
        assert len({i for i, _ in got}) == len(got) == len({j for _, j in got}) == min(shape)


def test_optimal_differs_from_greedy_and_threshold_comes_after(spark):
    edges = [("c", 1, 1, 11, 0.9), ("c", 1, 1, 12, 0.8), ("c", 1, 2, 11, 0.8), ("c", 1, 2, 12, 0.1), ("c", 2, 1, 11, 0.6), ("c", 3, 5, 15, 0.4)]
    df = spark.createDataFrame(edges, "clip_id string, frame_idx bigint, left bigint, right bigint, score double")
    assert sorted((r.frame_idx, r.left, r.right) for r in optimal_match(df, 0.5).collect()) == [(1, 1, 12), (1, 2, 11), (2, 1, 11)]
    # The best sum takes a pair below the threshold, which is then lost.
    lossy = [("c", 1, 1, 11, 0.6), ("c", 1, 1, 12, 0.45), ("c", 1, 2, 11, 0.45)]
    df = spark.createDataFrame(lossy, "clip_id string, frame_idx bigint, left bigint, right bigint, score double")
    assert optimal_match(df, 0.5).collect() == []


def test_constrained_union(spark):
    nodes = spark.createDataFrame([("c", 1, 0, 10), ("c", 2, 20, 30), ("c", 3, 25, 40), ("c", 4, 29, 50), (None, 1, 0, 1)], "clip_id string, node bigint, start_frame bigint, end_frame bigint")
    edges = spark.createDataFrame([("c", 1, 2, 0.9), ("c", 1, 3, 0.8), ("c", 2, 4, 0.7), ("c", 3, 9, 1.0)], "clip_id string, a bigint, b bigint, score double")
    roots = lambda t: {(r.clip_id, r.node): r.root for r in constrained_union(nodes, edges, t).collect()}
    # 3 overlaps 2, which is already with 1; 4 overlaps 2 by two frames.
    assert roots(0) == {("c", 1): 1, ("c", 2): 1, ("c", 3): 3, ("c", 4): 4, (None, 1): 1}
    assert roots(2) == {("c", 1): 1, ("c", 2): 1, ("c", 3): 3, ("c", 4): 1, (None, 1): 1}


def person(frame, x, y=100.0):
    return [x + 2.0 * frame, y, x + 2.0 * frame + 40, y + 120.0]


def test_tracker_keeps_crossing_persons_and_bridges_gaps():
    t = FrameTracker()
    seen = []
    for f in range(60):
        boxes = [person(f, 0), person(f, 400, 300)]
        if 20 <= f < 28:
            boxes = boxes[1:]
        numbers = t.update(f, np.array(boxes), np.full(len(boxes), 0.9))
        seen.append(numbers)
    assert all(n == [1, 2] for n in seen[:20]) and all(n == [2] for n in seen[20:28]) and all(n == [1, 2] for n in seen[28:])


def test_tracker_births_bad_frames_and_expiry():
    t = FrameTracker()
    assert t.update(0, np.array([person(0, 0)]), np.array([0.2])) == [0]
    assert t.update(1, np.array([person(1, 0)]), np.array([0.9])) == [1]
    for f in range(2, 6):
        assert t.update(f, np.array([person(f, 0)]), np.array([0.9]), is_bad=True) == [0]
    assert t.update(6, np.array([person(6, 0)]), np.array([0.9])) == [1]
    for f in range(7, 25):
        t.update(f, np.array([person(f, 0)]), np.array([0.9]), is_bad=True)
    assert t.update(25, np.array([person(25, 0)]), np.array([0.9])) == [2]
    assert t.update(500, np.array([person(25, 0)]), np.array([0.9])) == [3]


def test_tracked_orders_rows_itself(spark):
    rows = [(i, clip, f, *person(f, x), 0.9, False) for i, (clip, f, x) in enumerate((c, f, x) for c in ("a", "b") for f in range(30) for x in (0, 300))]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "row_idx bigint, clip_id string, frame_idx bigint, x1 double, y1 double, x2 double, y2 double, conf double, frame_is_bad boolean")
    got = {r.row_idx: r.local_id for r in tracked(df).collect()}
    assert all(got[r[0]] == r[0] % 2 + 1 for r in rows)


def test_identities_are_matched_for_the_most_frames_in_all(spark):
    """Greedily, p1-a (100) would leave p1-b and p2-a (99 each) without a partner."""
    from trackloom.operators.evaluate import idf1

    rows, n = [], 0
    for person, identity, count in ((1, 11, 100), (1, 12, 99), (2, 11, 99)):
        for _ in range(count):
            rows.append((n, "c", n, person, identity, 0.0, 0.0, 9.0, 9.0))
            n += 1
    all_rows = spark.createDataFrame(rows, "row_idx bigint, clip_id string, frame_idx bigint, person_id bigint, global_id bigint, x1 double, y1 double, x2 double, y2 double")
    truth = all_rows.withColumnRenamed("row_idx", "ask_id").drop("global_id")
    got = idf1(truth, all_rows.drop("person_id")).first()
    assert (got.idtp, got.id_f1) == (198, round(2 * 198 / (2 * n), 6))


def test_optimal_match_of_a_group_of_several_parts(spark):
    rng = random.Random(5)
    for _ in range(3):
        edges = {(a, b): round(rng.uniform(0.1, 1), 3) for part in (0, 10, 20) for a in range(part, part + 4) for b in range(part, part + 4) if rng.random() < 0.6}
        frame = spark.createDataFrame([("c", 1, a, b, s) for (a, b), s in edges.items()], "clip_id string, frame_idx bigint, left bigint, right bigint, score double")
        best = sum(max(sum(edges.get((part + i, part + p), 0) for i, p in enumerate(perm)) for perm in permutations(range(4))) for part in (0, 10, 20))
        assert sum(r.score for r in optimal_match(frame, 0.0).collect()) == pytest.approx(best)
