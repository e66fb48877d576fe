import json

from pyspark.sql import functions as F

from trackloom.sources.tracks import parsed, read_tracks_csv, read_zone_file, replace_clips, write_report, write_tracks_csv, write_zone_file

COLUMNS = ["frame_idx", "ts_sec", "global_id", "x1", "y1", "x2", "y2", "zone_id", "overlap_n"]


TEXT = "frame_idx string, ts_sec string, global_id string, x1 string, y1 string, x2 string, y2 string"


def test_tolerant_csv(spark, tmp_path):
    (tmp_path / "shop_1_tracks.csv").write_text(
        ",".join(COLUMNS) + "\n3,0.25,7.0,1,2,3,4, hot ,0.5\n4,0.3,,1,2,3,4,,\nbad,0.3,1,1,2,3,4,z,\n5,0.4,2,1,2,x,4,z,\n6,0.5, 8 ,1,2,3,4\n"
    )
    rows = read_tracks_csv(spark, str(tmp_path / "*.csv"), COLUMNS).orderBy("row_idx").collect()
    assert [(r.frame_idx, r.global_id, r.zone_id, r.overlap, r.clip_id) for r in rows] == [(3, 7, "hot", 0.5, "shop_1"), (4, 0, None, None, "shop_1"), (6, 8, None, None, "shop_1")]


def test_parsed_drops_zero_bytes(spark):
    raw = spark.createDataFrame([("1\x00", "0.5", "\x00 3.0", "1", "2", "3", "4")], TEXT)
    assert parsed(raw).select("frame_idx", "global_id").first() == (1, 3)


def test_rows_without_a_time_stay(spark):
    raw = spark.createDataFrame([("1", None, "3", *"1234"), ("2", "x", "3", *"1234"), ("3", " ", "3", *"1234"), ("4", "0.5", "3", *"1234")], TEXT)
    assert [(r.frame_idx, r.ts_sec) for r in parsed(raw).orderBy("frame_idx").collect()] == [(1, None), (2, None), (3, None), (4, 0.5)]


def test_strict_rows_hold_whole_numbers(spark):
    raw = spark.createDataFrame([("1", "0", "3", *"1234"), ("2.0", "0", "3", *"1234"), ("3", "0", "3.0", *"1234"), ("4", "0", "", *"1234"), (" 5\x00", "0", "-1", *"1234")], TEXT)
    assert [(r.frame_idx, r.global_id) for r in parsed(raw, strict=True).orderBy("frame_idx").collect()] == [(1, 3), (5, -1)]
    assert parsed(raw).count() == 5


def test_ordinals_of_several_split_files(spark, tmp_path):
    sizes = {"c": 50, "a": 20_000, "b": 3_000, "empty": 0}
    for name, n in sizes.items():
        (tmp_path / f"{name}_tracks.csv").write_text("\n".join([",".join(COLUMNS), *(f"{i},0.5,{'bad' if i % 7 == 3 else 1},1,2,3,4,z,{i}" for i in range(n))]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        rows = read_tracks_csv(spark, str(tmp_path / "*.csv"), COLUMNS)
        assert spark.read.csv(str(tmp_path / "a_tracks.csv")).rdd.getNumPartitions() > 3
        got = rows.select("clip_id", "row_idx", "frame_idx").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r.clip_id, r.row_idx, r.frame_idx) for r in got) == sorted((name, i, i) for name, n in sizes.items() for i in range(n) if i % 7 != 3)


def test_zone_file_written_and_read(spark, tmp_path):
    rows = [("c", "a", "A", None, "[[0,0],[1,0],[1,1]]"), ("c", "line", "L", "x", "[[0,0],[1,0]]"), ("c", "odd", "O", "x", "nothing"), ("c", " ", "O", "x", "[[0,0],[1,0],[1,1]]"), ("d", "z", "Z", "x", "[]")]
    zones = spark.createDataFrame(rows, "camera_id string, zone_id string, zone_name string, zone_type string, polygon string")
    path = str(tmp_path / "z.json")
    skipped = write_zone_file(zones, "c", path)
    assert {r["zone_id"]: r["reason"] for r in skipped} == {"line": "fewer than three points", "odd": "no polygon", " ": "no zone_id"}
    assert [(r.camera_id, r.zone_id, r.zone_name) for r in read_zone_file(spark, path).collect()] == [("c", "a", "A")]


def test_csv_and_report_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.125), (2, 1 / 3)], "k bigint, v double")
    write_tracks_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv")).orderBy("k").collect()
    assert [(r.k, r.v) for r in back] == [("1", "0.125000"), ("2", "0.333333")]
    write_report(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_replacing_a_clip_leaves_the_others(spark, tmp_path):
    out = str(tmp_path / "t")
    rows = lambda v, clips: spark.createDataFrame([("c", k, v) for k in clips], "camera string, clip_id string, v bigint")
    replace_clips(rows(1, ["a", "b"]), out)
    for _ in range(2):
        replace_clips(rows(2, ["b"]), out)
        assert sorted((r.clip_id, r.v) for r in spark.read.parquet(out).collect()) == [("a", 1), ("b", 2)]


def test_zone_file(spark, tmp_path):
    path = tmp_path / "zones.json"
    path.write_text(json.dumps({"camera_id": "c", "zones": [{"zone_id": "z", "polygon": [[0, 0], [1, 0], [1, 1]]}, {"zone_id": "line", "polygon": [[0, 0], [1, 0]]}, {"polygon": []}]}))
    rows = read_zone_file(spark, str(path)).collect()
    assert [(r.camera_id, r.zone_id, r.zone_rank) for r in rows] == [("c", "z", 0)]


def test_polygon_edges(spark):
    from trackloom.functions.geometry import in_polygon

    square = F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (10, 0), (10, 10), (0, 10))])
    points = {(5, 5): True, (10, 5): False, (0, 0): True, (5, 10): False, (0, 5): True, (11, 5): False}
    row = spark.range(1).select(*[in_polygon(F.lit(float(x)), F.lit(float(y)), square) for x, y in points]).first()
    assert list(row) == list(points.values())
    line = F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(9.0), F.lit(9.0)))
    assert spark.range(1).select(in_polygon(F.lit(1.0), F.lit(1.0), line)).first()[0] is False
