from trackloom.operators.linking import merge_edges
from trackloom.plans import link_queries

COLUMNS = "clip_id string, tracklet_id bigint, source_gid bigint, start_frame bigint, end_frame bigint, entry_side string, exit_side string, motion_dx double, motion_dy double, median_h_ratio double, median_aspect double, quality double"


def stretches(spark, spans):
    return spark.createDataFrame([(clip, i, i, s, e, "left", "left", 2.0, 0.0, 0.5, 0.4, 1.0) for clip, i, s, e in spans], COLUMNS)


def roots(spark, folder, spans):
    stretches(spark, spans).write.parquet(str(folder / "tracklets.parquet"))
    return {(r.clip_id, r.node): r.root for r in link_queries.group_merge(spark, str(folder)).collect()}


def test_merges_near_and_far_stretches(spark, tmp_path):
    spans = [("near", 1, 0, 100), ("near", 2, 102, 200), ("far", 1, 0, 100), ("far", 2, 2300, 2400), ("too_far", 1, 0, 100), ("too_far", 2, 2301, 2400), ("touch", 1, 0, 100), ("touch", 2, 100, 200)]
    got = roots(spark, tmp_path, spans)
    assert (got["near", 2], got["far", 2]) == (1, 1)
    assert got["too_far", 2] == 2
    assert got["touch", 2] == 2  # they share a frame


def test_no_limit_on_predecessors_and_no_self(spark):
    many = stretches(spark, [("c", i, 0, 100 + i % 3) for i in range(90)] + [("c", 99, 110, 110)])
    edges = [(r.a, r.b) for r in merge_edges(many).collect()]
    assert sorted(edges) == [(i, 99) for i in range(90)]
