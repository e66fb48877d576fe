import itertools

import numpy as np
import pytest

from trackloom.operators.embeddings import part_similarity, set_similarity
from trackloom.plans import link_queries


def labelled(n, labels, seed=0):
    rng = np.random.default_rng(seed)
    return [(k, [float(x) for x in rng.normal(size=8)], k % labels) for k in range(n)]


def whole_sets(rows, k):
    sets = {}
    for _, v, label in rows:
        sets.setdefault(label, []).append(np.asarray(v) / np.linalg.norm(v))
    out = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        products = np.array(sets[a]) @ np.array(sets[b]).T
        out[a, b] = (np.sort(products.ravel())[-k:].mean(), np.sort(products.max(axis=1))[-k:].mean())
    return out


@pytest.mark.parametrize("block", [4096, 16])
def test_sets_are_compared_whole(spark, block):
    rows = labelled(120, 3)
    got = set_similarity(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), 6, block).collect()
    expected = whole_sets(rows, 6)
    assert {(r.a, r.b) for r in got} == set(expected)
    for r in got:
        assert (r.topk, r.best_topk) == pytest.approx(expected[r.a, r.b], abs=2e-6)


def test_topk_set_similarity_sees_late_vectors(spark, tmp_path):
    """The one pair that is alike comes after the first 24 vectors of each label."""
    rows = [(k, [1.0, 0.0, 0.0] if k % 2 else [0.0, 1.0, 0.0], k % 2) for k in range(80)] + [(80, [0.0, 0.0, 1.0], 0), (81, [0.0, 0.0, 1.0], 1)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    (row,) = link_queries.topk_set_similarity(spark, str(tmp_path)).collect()
    assert (row.topk, row.best_topk) == (round(1 / 6, 6), round(1 / 6, 6))


def parts_by_hand(rows, weights=(0.4, 0.3, 0.2, 0.1)):
    sets = {}
    for _, v, label in rows:
        sets.setdefault(label, []).append(np.asarray(v) / np.linalg.norm(v))
    profiles = {label: np.mean(vs, axis=0) for label, vs in sets.items()}
    out = {}
    for a, b in itertools.combinations(sorted(profiles), 2):
        n, known = len(profiles[a]), []
        for i, w in enumerate(weights):
            p, q = (profiles[x][i * n // 4 : (i + 1) * n // 4] for x in (a, b))
            if np.linalg.norm(p) and np.linalg.norm(q):
                known.append((w, p @ q / np.linalg.norm(p) / np.linalg.norm(q)))
        cosines = [c for _, c in known]
        score = sum(w * c for w, c in known) / sum(w for w, _ in known) - 0.2 * max(max(cosines) - min(cosines) - 0.5, 0) if known else 0.0
        out[a, b] = (score, len(known))
    return out


def test_parts_of_every_two_labels(spark):
    """Gaps in vec_id, a length that is not 64, a missing part, and labels with no part in common."""
    rng = np.random.default_rng(1)
    rows = [(7 * k, [float(x) for x in rng.normal(size=82)], k % 4) for k in range(20)]
    rows = [(i, [0.0] * 20 + v[20:] if label == 2 else v, label) for i, v, label in rows]
    rows += [(500, [1.0] * 20 + [0.0] * 62, 8), (600, [0.0] * 41 + [1.0] * 41, 9)]
    got = {(r.a, r.b): (r.similarity, r.n_parts) for r in part_similarity(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()}
    expected = parts_by_hand(rows)
    assert set(got) == set(expected) and len(got) == 15
    for pair, (similarity, n) in expected.items():
        assert got[pair] == (pytest.approx(similarity, abs=2e-6), n)
    assert got[1, 2][1] == 3 and got[8, 9] == (0.0, 0) and got[2, 8] == (0.0, 0)
