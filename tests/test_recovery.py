from trackloom.operators.recovery import recovered, zero_trace

ROWS = "row_idx bigint, clip_id string, frame_idx bigint, global_id bigint, x1 double, y1 double, x2 double, y2 double, person_id string"
JUDGED = "ask_id bigint, person_id bigint, clip_id string, frame_idx bigint, x1 double, y1 double, x2 double, y2 double"
HERE, THERE = (0.0, 0.0, 10.0, 20.0), (100.0, 0.0, 110.0, 20.0)


def run(spark, rows, judged, **rules):
    r = spark.createDataFrame([(*x[:4], *x[4], "x") for x in rows], ROWS)
    j = spark.createDataFrame([(*x[:4], *x[4]) for x in judged], JUDGED)
    return sorted((x.row_idx, x.global_id, x.is_fresh) for x in recovered(j, r, **rules).collect())


def test_known_and_fresh_identities(spark):
    rows, judged = [], []
    for f in range(6):  # person 1 is 7 in six frames, and lost in frame 6
        rows.append((f, "c", f, 7, HERE))
        judged.append((f, 1, "c", f, HERE))
    rows += [(6, "c", 6, 0, HERE), (7, "c", 7, 0, HERE), (8, "c", 7, 7, THERE)]
    judged += [(6, 1, "c", 6, HERE), (7, 1, "c", 7, HERE)]  # in frame 7 identity 7 stands elsewhere
    for f in range(10, 14):  # persons 2 and 3 were never named; 20 and 22 are in use
        rows += [(100 + f, "c", f, None, HERE), (200 + f, "c", f, -1, THERE)]
        judged += [(100 + f, 2, "c", f, HERE), (200 + f, 3, "c", f, THERE)]
    rows += [(900, "c", 90, 20, HERE), (901, "c", 91, 22, HERE)]
    got = run(spark, rows, judged)
    assert got == [(6, 7, False), *((100 + f, 21, True) for f in range(10, 14)), *((200 + f, 23, True) for f in range(10, 14))]


def test_too_few_hits_and_empty_tables(spark):
    rows = [(f, "c", f, 0, HERE) for f in range(2)]
    judged = [(f, 1, "c", f, HERE) for f in range(2)]
    assert run(spark, rows, judged) == [] and run(spark, [], judged) == [] and run(spark, rows, []) == []
    assert run(spark, rows, judged, hits=2) == [(0, 20, True), (1, 20, True)]


def test_an_identity_once_in_a_frame(spark):
    rows = [(1, "c", 0, 0, HERE), (2, "c", 0, 0, THERE), *((10 + f, "c", 1 + f, 5, HERE) for f in range(5))]
    judged = [(1, 1, "c", 0, HERE), (2, 1, "c", 0, THERE), *((10 + f, 1, "c", 1 + f, HERE) for f in range(5))]
    assert run(spark, rows, judged) == [(1, 5, False)]


def test_zero_trace(spark):
    boxes = [(1, "c", 0, 0, HERE), (2, "c", 0, 9, (0.0, 0.0, 10.0, 16.0)), (3, "c", 0, 4, (0.0, 0.0, 10.0, 16.0)), (4, "c", 1, None, HERE), (5, "c", 2, -1, HERE), (6, "c", 2, 3, THERE), (7, None, 0, 0, HERE)]
    rows = spark.createDataFrame([(*x[:4], *x[4], "x") for x in boxes], ROWS)
    got = {r.row_idx: (r.near_row, r.near_gid, r.iou, r.reason) for r in zero_trace(rows).collect()}
    assert got == {1: (2, 9, 0.8, "covered"), 4: (None, 0, 0.0, "no_box"), 5: (None, 0, 0.0, "apart"), 7: (None, 0, 0.0, "no_box")}
    assert zero_trace(rows.limit(0)).collect() == []
