from trackloom.operators.reference import claimed

TARGETS = "clip_id string, target bigint, source bigint, n_rows bigint, start_frame bigint, end_frame bigint"
SCORES = "clip_id string, target bigint, ref bigint, score double"


def test_a_ninth_reference_is_tried(spark):
    """Nine targets at one time, nine references: the last target finds its eight best taken."""
    targets = [("c", t, 100 + t, 100 - t, 0, 50) for t in range(1, 10)]
    scores = [("c", t, ref, 0.99 - ref / 100) for t in range(1, 10) for ref in range(1, 13)]
    got = {r.target: (r.identity, r.how) for r in claimed(spark.createDataFrame(targets, TARGETS), spark.createDataFrame(scores, SCORES)).collect()}
    assert got == {t: (t, "claimed") for t in range(1, 10)}


def test_a_claim_needs_lead_and_least(spark):
    targets = [("c", t, 0, 100 - t, 60 * t, 60 * t + 50) for t in range(5)]
    scores = [("c", 0, 1, 0.70), ("c", 1, 1, 0.70), ("c", 1, 2, 0.69), ("c", 2, 1, 0.70), ("c", 2, 2, 0.60), ("c", 3, 1, 0.68), ("c", 4, 1, 0.70), ("c", 4, 2, 0.62), ("c", 4, 3, 0.61)]
    got = {r.target: r.how for r in claimed(spark.createDataFrame(targets, TARGETS), spark.createDataFrame(scores, SCORES)).collect()}
    assert got == {0: "claimed", 1: "new", 2: "claimed", 3: "new", 4: "claimed"}
