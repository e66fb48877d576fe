import pytest

from trackloom.plans import visit_queries

VISITS = "id bigint, camera_id string, clip_id string, global_id bigint, zone_id string, t_enter double, t_exit double, dwell_s double, captured_at timestamp"
TRACKS = "id bigint, camera_id string, clip_id string, frame_idx bigint, ts double, global_id bigint, x1 double, y1 double, x2 double, y2 double, zone_id string, conf double, captured_at timestamp"


@pytest.fixture
def folder(spark, tmp_path):
    cameras = [(f"cam_{k:02d}", 640, 480, 25.0) for k in range(1, 8)]
    visits = [(k, f"cam_{k:02d}", f"s{k:02d}_a", 1, "zone", 0.0, 1.0, 1.0, None) for k in range(1, 8)]
    # s08_a has boxes and no visits; a box without an identity is no person.
    tracks = [(k, f"cam_{min(k, 7):02d}", f"s{k:02d}_a", k, float(k), 1, 0.0, 0.0, 9.0, 9.0, None, 0.9, None) for k in range(1, 9)]
    tracks += [(9, "cam_07", "s08_a", 9, 9.5, 1, 0.0, 0.0, 9.0, 9.0, None, 0.9, None), (10, "cam_07", "s08_a", 9, 9.5, 0, 0.0, 0.0, 9.0, 9.0, None, 0.9, None)]
    for name, rows, schema in (("cameras", cameras, "camera_id string, frame_w int, frame_h int, fps double"), ("visit_events", visits, VISITS), ("tracks", tracks, TRACKS)):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_union_holds_every_camera_of_the_table(spark, folder):
    assert sorted((r.source, r.id, r.global_id) for r in visit_queries.union_cameras(spark, folder).collect()) == [(f"cam_{k:02d}", k, 1) for k in range(1, 8)]


def test_fallback_only_for_clips_without_any_visit(spark, folder):
    got = [(r.camera, r.clip_id, r.global_id, r.n_frames, r.first_ms, r.last_ms, r.duration_s) for r in visit_queries.person_fallback(spark, folder).collect()]
    assert got == [("cam_07", "s08_a", 1, 2, 8000, 9500, 1.5)]
