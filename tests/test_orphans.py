from datetime import datetime, timezone

from trackloom.operators.orphans import orphan_counts, orphan_references

AT = lambda day, hour=0: datetime(2025, 3, day, hour, tzinfo=timezone.utc)
TRACKS = "id bigint, camera_id string, zone_id string, captured_at timestamp, table_name string"
DECISIONS = "id bigint, clip_id string, best_prev_tracklet_id bigint, start_frame bigint"
ZONES = "camera_id string, zone_id string, added_at timestamp, removed_at timestamp, id string"
TRACKLETS = "clip_id string, tracklet_id bigint, start_frame bigint, id bigint"


def run(spark, tracks=(), visits=(), decisions=(), zones=(), tracklets=()):
    found = orphan_references(
        spark.createDataFrame([(*r, "x") for r in tracks], TRACKS),
        spark.createDataFrame([(*r, "x") for r in visits], TRACKS),
        spark.createDataFrame(list(decisions), DECISIONS),
        spark.createDataFrame([(*r, "x") for r in zones], ZONES),
        spark.createDataFrame([(*r, 1) for r in tracklets], TRACKLETS),
    )
    return found


def ids(df):
    return sorted((r.table_name, r.id) for r in df.collect())


ZONE = [("Cam 01", "Hot-Zone", AT(2), AT(5)), ("cam_01", "hot_zone", AT(8), None), ("cam_02", "door", None, None), ("cam_02", "never", AT(5), AT(5)), (None, "hot_zone", AT(1), None), ("cam_01", " ", AT(1), None)]


def test_zone_in_force(spark):
    tracks = [
        (1, "cam_01", "hot_zone", AT(2)),  # from added_at on
        (2, "CAM_01", "HOT ZONE ", AT(5)),  # removed_at is no longer in force
        (3, "cam-01", "hot_zone", AT(4, 23)),
        (4, "cam_01", "hot_zone", AT(20)),  # it came back
        (5, "cam_01", "hot_zone", AT(1)),  # too early
        (6, "cam_02", "hot_zone", AT(3)),  # another camera's
        (7, "cam_01", "  \t", AT(3)),  # outside
        (8, "cam_01", None, AT(3)),
        (9, "cam_01", "hot_zone", None),  # no time: nothing in force
        (10, None, "hot_zone", AT(3)),  # no camera: no zone of it
        (11, "cam_02", "door", AT(1)),  # added_at null: always
        (12, "cam_02", "never", AT(5)),
        (13, "cam_01", "--", AT(3)),  # a key, though an empty one
        (13, "cam_01", "--", AT(3)),  # delivered twice
    ]
    want = [2, 5, 6, 9, 10, 12, 13, 13]
    assert ids(run(spark, tracks=tracks, zones=ZONE)) == [("tracks", i) for i in want]
    assert ids(run(spark, visits=tracks, zones=ZONE)) == [("visit_events", i) for i in want]


def test_tracklets_must_start_earlier(spark):
    tracklets = [("a", 1, 10), ("a", 1, 50), ("b", 2, 0), (None, 3, 0), ("a", 4, None)]
    decisions = [(1, "a", 1, 11), (2, "a", 1, 10), (3, "a", 2, 99), (4, "b", 2, 1), (5, "a", 0, 5), (6, "a", None, 5), (7, "a", 1, None), (8, None, 3, 9), (9, "a", 4, 9), (10, "a", -51, 9)]
    assert ids(run(spark, decisions=decisions, tracklets=tracklets)) == sorted(("reentry_decisions", i) for i in (2, 3, 7, 8, 9, 10))


def test_counts_and_empty_tables(spark):
    assert ids(run(spark)) == []
    tracks = [(1, "c", "z", AT(3)), (2, "c", "z", AT(3, 5)), (3, "c", "z", AT(4)), (4, "c", "z", None)]
    counts = {(r.table_name, str(r.day)): r.n_orphans for r in orphan_counts(run(spark, tracks=tracks)).collect()}
    assert counts == {("tracks", "2025-03-03"): 2, ("tracks", "2025-03-04"): 1, ("tracks", "None"): 1}


def test_too_many_keys_for_a_broadcast(spark, monkeypatch):
    from trackloom import session

    monkeypatch.setattr(session.broadcast_if_small, "__defaults__", (0,))
    tracks = [(i, "cam_01", f"ghost {i % 7}", AT(3)) for i in range(50)] + [(99, "cam_01", "hot_zone", AT(3))]
    assert ids(run(spark, tracks=tracks, zones=ZONE)) == [("tracks", i) for i in range(50)]
