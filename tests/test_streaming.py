from datetime import datetime, timedelta, timezone

import pytest

from trackloom.operators.visits import online_visits
from trackloom.streaming.stateful import ingest, stream_sessions, stream_tracks, stream_visits

START = datetime(2025, 3, 1, tzinfo=timezone.utc)


def feed(spark, tmp_path, batches, schema):
    """A stream that reads one batch of rows at a time."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b={i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "b=*"))


def run(spark, stream, name, tmp_path):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_sessions_close_behind_the_watermark(spark, tmp_path):
    schema = "clip_id string, global_id bigint, captured_at timestamp"
    at = lambda s: START + timedelta(seconds=s)
    batches = [[("a", 1, at(s)) for s in (0, 10, 35)], [("a", 1, at(120)), ("a", 0, at(0))], [("a", 1, at(7200))], [("a", 1, at(9000))]]
    got = run(spark, stream_sessions(feed(spark, tmp_path, batches, schema)), "sessions", tmp_path)
    spans = sorted((int((r.start_at.replace(tzinfo=timezone.utc) if r.start_at.tzinfo is None else r.start_at).timestamp() - r.end_at.timestamp()) if r.start_at.tzinfo else int((r.start_at - r.end_at).total_seconds()), r.n_boxes) for r in got)
    assert (-35, 3) in spans and (0, 1) in spans


def test_visits_equal_the_batch_operator(spark, tmp_path):
    schema = "clip_id string, global_id bigint, ms bigint, zone_key string, row_idx bigint, captured_at timestamp"
    zones = ["a"] * 6 + ["b"] * 2 + ["a"] * 3 + ["b"] * 8 + [None] * 6 + ["a"] * 5
    rows = [("k", 1, 400 * i, z, i, START + timedelta(milliseconds=400 * i)) for i, z in enumerate(zones)]
    late = [("k", 2, 10_000_000, None, 99, START + timedelta(hours=2)), ("k", 3, 10_000_001, None, 98, START + timedelta(hours=4))]
    batches = [rows[:7], rows[7:16], rows[16:], late[:1], late[1:]]
    got = run(spark, stream_visits(feed(spark, tmp_path, batches, schema)), "visits", tmp_path)
    streamed = sorted((r.zone_key, r.enter_ms, r.exit_ms) for r in got if r.global_id == 1)
    batch = sorted((r.zone_key, r.enter_ms, r.exit_ms) for r in online_visits(spark.createDataFrame(rows, schema)).collect())
    assert streamed == batch and len(batch) >= 3


def test_tracks_go_on_over_batches(spark, tmp_path):
    schema = "clip_id string, frame_idx bigint, row_idx bigint, x1 double, y1 double, x2 double, y2 double, conf double"
    box = lambda f, x: (x + 2.0 * f, 10.0, x + 2.0 * f + 40, 130.0)
    rows = [("a", f, 2 * f + k, *box(f, 300 * k), 0.9) for f in range(20) for k in (0, 1)]
    late = [("a", 3, 900, *box(3, 0), 0.9)]
    got = {r.row_idx: r.local_id for r in run(spark, stream_tracks(feed(spark, tmp_path, [rows[:20], rows[20:], late], schema)), "tracks_out", tmp_path)}
    assert all(got[r[2]] == r[2] % 2 + 1 for r in rows) and got[900] == 0


def test_ingest_is_repeatable(spark, tmp_path):
    schema = "camera string, clip_id string, row_idx bigint"
    stream = feed(spark, tmp_path, [[("c1", "a", 1), ("c1", "b", 2)], [("c2", "a", 3)]], schema)
    for _ in range(2):
        query = ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp2"))
        query.awaitTermination(120)
        assert query.exception() is None
        assert sorted(r.row_idx for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


@pytest.fixture(autouse=True)
def few_state_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
