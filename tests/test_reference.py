import numpy as np

from trackloom.operators.reference import ClaimRules, IdentityLayer, LayerRules, anchor_evidence, anchored, claimed, separated

TARGETS = "clip_id string, target bigint, source bigint, n_rows bigint, start_frame bigint, end_frame bigint"
SCORES = "clip_id string, target bigint, ref bigint, score double"


def test_claims_margin_overlap_sources_and_fallback(spark):
    targets = [("c", 1, 50, 100, 0, 100), ("c", 2, 51, 90, 50, 150), ("c", 3, 50, 20, 200, 220), ("c", 4, 52, 10, 300, 310), ("c", 5, 51, 5, 400, 410), ("d", 1, 0, 5, 0, 9)]
    scores = [("c", 1, 7, 0.9), ("c", 1, 8, 0.5), ("c", 2, 7, 0.9), ("c", 2, 8, 0.8), ("c", 3, 7, 0.75), ("c", 3, 8, 0.74), ("c", 4, 8, 0.6)]
    got = {(r.clip_id, r.target): (r.identity, r.how) for r in claimed(spark.createDataFrame(targets, TARGETS), spark.createDataFrame(scores, SCORES)).collect()}
    assert got == {
        ("c", 1): (7, "claimed"),
        ("c", 2): (8, "claimed"),  # 7 is taken at that time
        ("c", 3): (7, "inherited"),  # too close to call, but its source is 7's
        ("c", 4): (9, "new"),
        ("c", 5): (8, "inherited"),
        ("d", 1): (1, "new"),
    }
    few = claimed(spark.createDataFrame(targets[:1] + [("c", 9, 60, 50, 500, 510)], TARGETS), spark.createDataFrame(scores[:1] + [("c", 9, 7, 0.95)], SCORES), ClaimRules(sources=1))
    assert {r.target: r.how for r in few.collect()} == {1: "claimed", 9: "new"}


def vector(i, noise=0.0, rng=np.random.default_rng(0)):
    v = np.zeros(8)
    v[i] = 1
    v = v + noise * rng.normal(size=8)
    return v / np.linalg.norm(v)


def test_anchors_and_separation(spark):
    rows = [(k, [float(x) for x in vector(k % 3, 0.05)], k % 3) for k in range(30)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label bigint")
    assert {(r.target, r.ref, r.reason) for r in anchored(anchor_evidence(df, df)).collect()} == {(0, 0, "accepted"), (1, 1, "accepted"), (2, 2, "accepted")}
    wrong = df.collect()[:2]
    mixed = spark.createDataFrame([(r.vec_id, r.embedding, 1 - r.label if r in wrong else r.label) for r in df.collect()], df.schema)
    moved = {r.vec_id for r in separated(mixed, 0, 1).where("label <> new_label").collect()}
    assert moved == {0, 1}
    assert anchored(anchor_evidence(df.limit(0), df)).collect() == []


def test_identity_layer_locks_reuses_and_releases():
    layer = IdentityLayer(LayerRules())
    a, b = vector(0), vector(1)
    said = [layer.update(f, [(1, 0.9, a), (2, 0.9, b)]) for f in range(5)]
    assert said[0] == [(0, "pending"), (0, "pending")] and said[4] == [(1, "locked"), (2, "locked")]
    # the first person comes back under another local track
    back = [layer.update(f, [(9, 0.9, a), (2, 0.9, b)]) for f in range(20, 24)]
    assert back[-1] == [(1, "locked"), (2, "locked")] and back[1][0] == (1, "short_memory")
    assert layer.update(30, [(10, 0.1, vector(3))]) == [(0, "low_quality")]
    # a local track that turns into someone else is released, then found again
    later = [layer.update(f, [(2, 0.9, vector(5))]) for f in range(40, 52)]
    assert (0, "drift_release") in [x[0] for x in later] and later[-1][0][0] == 3
