import random

import pytest
from pyspark.sql import functions as F

from trackloom.functions import vectors
from trackloom.functions.keys import is_outside, slug, whole_ms, zone_key
from trackloom.operators import evaluate, hygiene, kpi, pairs

SCHEMA = "row_idx bigint, clip_id string, frame_idx bigint, global_id bigint, x1 double, y1 double, x2 double, y2 double, w double, h double"


def boxes(rng, n=300):
    out = []
    for i in range(n):
        x, y = rng.uniform(0, 900), rng.uniform(0, 400)
        out.append((i, rng.choice(["a", "b"]), rng.randint(0, 40), rng.randint(-1, 5), x, y, x + rng.choice([1, 30, 60]), y + rng.choice([1, 80, 140]), 1000.0, 600.0))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def as_rows(df, result):
    return df.drop("global_id").join(result.select("row_idx", "global_id"), "row_idx").select(*[c.split()[0] for c in SCHEMA.split(", ")])


@pytest.mark.parametrize("clean", [hygiene.unique_per_frame, hygiene.suppress_duplicates, hygiene.largest_per_frame])
def test_one_box_per_identity_and_frame(spark, clean):
    rows = boxes(random.Random(1))
    df = table(spark, rows)
    once = as_rows(df, clean(df))
    assert once.count() == len(rows)  # nothing is deleted
    assert once.where("global_id > 0").groupBy("clip_id", "frame_idx", "global_id").count().where("count > 1").count() == 0
    assert sorted(clean(once).collect()) == sorted(clean(df).collect())  # again changes nothing
    mixed = rows[:]
    random.Random(2).shuffle(mixed)
    assert sorted(clean(table(spark, mixed)).collect()) == sorted(clean(df).collect())
    assert sum(r.n_duplicates for r in hygiene.duplicate_count(once).collect()) == 0


def test_exact_tie_keeps_the_lower_row(spark):
    rows = [(i, "a", 1, 7, 0.0, 0.0, 30.0, 80.0, 100.0, 100.0) for i in (3, 1, 2)]
    assert {r.row_idx: r.global_id for r in hygiene.unique_per_frame(table(spark, rows)).collect()} == {1: 7, 2: 0, 3: 0}


def test_tiny_ids_at_the_edges(spark):
    make = lambda gid, frames: [(gid * 100 + i, "a", f, gid, 0.0, 0.0, 30.0, 80.0, 100.0, 100.0) for i, f in enumerate(frames)]
    rows = make(1, range(7)) + make(2, range(8)) + make(3, [*range(14), 23]) + make(4, range(0, 70, 10)) + make(5, [*range(14), 22])
    assert sorted(r.global_id for r in hygiene.tiny_ids(table(spark, rows)).collect()) == [1, 2, 4, 5]


def test_renumbering(spark):
    rows = [(i, "a", i, g, 0.0, 0.0, 30.0, 80.0, 100.0, 100.0) for i, g in enumerate([9] * 30 + [4] * 40 + [6] * 3 + [0])]
    df = table(spark, rows)
    assert {r.global_id: r.new_id for r in hygiene.compact_ids(df).collect()} == {9: 1, 4: 2, 6: 0}
    numbers = {r.global_id: (r.is_stable, r.new_id) for r in hygiene.canonical_numbers(df, 30, 32).collect()}
    assert numbers == {4: (True, 1), 9: (False, 2), 6: (False, 3)}
    assert {r.global_id: r.new_id for r in hygiene.enforce_canonical(df, 2, 30, 30).collect()} == {4: 1, 9: 2, 6: 0}
    assert hygiene.remapped(df, hygiene.compact_ids(df)).where("row_idx = 73").first().global_id == 0


def test_segments_and_jumps(spark):
    frames = [0, 1, 3, 6, 7]
    rows = [(i, "a", f, 1, 10.0 * i, 0.0, 10.0 * i + 30, 80.0, 100.0, 100.0) for i, f in enumerate(frames)]
    got = [(r.seg, r.start_frame, r.end_frame, r.n_rows) for r in hygiene.segments(table(spark, rows), 2).orderBy("seg").collect()]
    assert got == [(1, 0, 3, 3), (2, 6, 7, 2)]
    walk = [(i, "a", i, 1, 1.0 * i + 500 * (i >= 20), 0.0, 1.0 * i + 500 * (i >= 20) + 30, 80.0, 1000.0, 100.0) for i in range(40)]
    assert {(r.seg, r.n_rows, r.new_id) for r in hygiene.jump_splits(table(spark, walk)).collect()} == {(1, 20, 1), (2, 20, 2)}


def test_contained_duplicates_spare_what_is_gone(spark):
    rows = []
    for f in range(3):
        for k, (gid, size) in enumerate([(1, 100.0), (2, 96.0), (3, 92.0)]):
            rows.append((10 * f + k, "a", f, gid, 0.0, 0.0, size, 2 * size, 1000.0, 600.0))
    rows.append((99, "a", 50, 1, 0.0, 0.0, 9.0, 9.0, 1000.0, 600.0))
    gone = {r.row_idx for r in pairs.contained_duplicates(table(spark, rows)).collect()}
    # 1 beats 2; 1 beats 3; 2 is gone and cannot meet 3 again.
    assert gone == {1, 2, 11, 12, 21, 22}


def test_empty_tables(spark):
    empty = table(spark, [])
    for f in (hygiene.unique_per_frame, hygiene.summary, hygiene.ghost_boxes, hygiene.border_ghosts, hygiene.edge_ghosts, hygiene.stationary_ids, hygiene.motion_of_ids, hygiene.compact_ids, hygiene.segments, hygiene.jump_splits, hygiene.largest_gaps, hygiene.predicted, hygiene.sampled, pairs.largest_overlap, pairs.contained_duplicates, pairs.crowd_windows, evaluate.blips_smoothed):
        assert f(empty).collect() == [], f.__name__


def test_keys(spark):
    texts = ["Cam 01", " CAM-01 ", "__a__b__", "a_1", "--", "", None, " \t", "Ä b", "x.-y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r) for r in df.select(slug(F.col("t")), zone_key(F.col("t")), is_outside(F.col("t")), slug(F.col("t"), "id")).collect()]
    assert [g[0] for g in got] == ["cam_01", "cam_01", "a_b", "a_1", "", "", None, "", "b", "x_y"]
    assert [g[1] for g in got] == ["cam_01", "cam_01", "a_b", "a_1", "", None, None, None, "b", "x_y"]
    assert got[4][3] == "id" and got[6][3] == "id"
    times = spark.createDataFrame([(1.2345,), (2.0005,), (-0.001,), (float("nan"),), (None,)], "t double")
    assert [r[0] for r in times.select(whole_ms(F.col("t"))).collect()] == [1235, 2001, -1, None, None]


def test_zone_kinds_and_thresholds(spark):
    names = ["walkway_zone", "north_walkway", "browsing_zone", "browse_corner", "hot_zone", "counter_zone", "checkout_zone", "shelf", "my_entrance"]
    df = spark.createDataFrame([(n,) for n in names], "z string").withColumn("z", kpi.zone_alias(F.col("z")))
    got = [tuple(r) for r in df.select(kpi.zone_kind(F.col("z")), kpi.engagement_threshold(F.col("z"))).collect()]
    assert got == [("flow", 1.5), ("flow", 999.0), ("other", 2.0), ("engagement", 2.0), ("engagement", 3.0), ("checkout", 2.0), ("checkout", 2.0), ("other", 2.5), ("entrance", 2.0)]


def test_percent_change(spark):
    df = spark.createDataFrame([(5.0, 0.0), (6.0, 4.0), (1.0, -2.0)], "new double, old double")
    assert [r[0] for r in df.select(kpi.percent_change(F.col("new"), F.col("old"))).collect()] == [None, 50.0, -150.0]


def test_vectors(spark):
    rows = [([1.0, 0.0], [0.0, 2.0]), ([3.0, 4.0], [3.0, 4.0]), (None, [1.0]), ([1.0], [1.0, 2.0]), ([0.0], [1.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    assert [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, pytest.approx(1.0), -1.0, -1.0, -1.0]
    assert df.select(vectors.cosine(F.col("a"), F.col("b"), 0.0)).collect()[2][0] == 0.0
    sets = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0]], [[1.0, 0.0], [0.6, 0.8]])], "l array<array<double>>, r array<array<double>>")
    top, best = sets.select(vectors.top_similarity(F.col("l"), F.col("r"), 2), vectors.top_of_best(F.col("l"), F.col("r"), 2)).first()
    assert top == pytest.approx(0.9) and best == pytest.approx(0.9)
