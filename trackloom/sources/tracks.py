"""Track files: tolerant reading, writing, and replacing one clip's rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.operators.ranking import blocked_rank

#: Columns without which a row is none; a missing time is null.
_NUMBERS = ("frame_idx", "global_id", "x1", "y1", "x2", "y2")
#: Names under which optional columns occur, the first wins.
ALIASES = {"overlap": ("overlap", "overlap_n", "overlap_count"), "quality": ("quality", "q", "det_quality")}


def _number(text: Column) -> Column:
    return F.trim(F.regexp_replace(text.cast("string"), "\\x00", "")).try_cast("double")


def parsed(raw: DataFrame, strict: bool = False) -> DataFrame:
    """Rows of text columns as typed rows; rows without a number in a needed column are left out, a blank id is 0.

    Zero bytes and blanks around numbers are dropped, whole numbers may be written as ``10.0``; with ``strict`` frames and ids must
    be written as integers, and a blank id leaves the row out. A time that is missing or no number is null, the row stays.
    Other columns stay; those of ALIASES get one name.
    """
    id_text = F.trim(F.regexp_replace(F.coalesce(F.col("global_id").cast("string"), F.lit("")), "\\x00", ""))
    whole = lambda c: F.when(F.lit(not strict) | F.col(c).cast("string").rlike(r"^[\s\x00]*[+-]?[0-9]+[\s\x00]*$"), F.round(_number(F.col(c)))).cast("bigint")
    typed = raw.withColumns(
        {
            "frame_idx": whole("frame_idx"),
            "global_id": whole("global_id") if strict else F.when(id_text == "", 0).otherwise(whole("global_id")),
            **{c: _number(F.col(c)) for c in ("ts_sec", "x1", "y1", "x2", "y2")},
        }
    )
    for name, others in ALIASES.items():
        there = [c for c in others if c in raw.columns]
        if there:
            typed = typed.withColumn(name, F.coalesce(*[_number(F.col(c)) for c in there]))
    if "zone_id" in raw.columns:
        typed = typed.withColumn("zone_id", F.nullif(F.trim("zone_id"), F.lit("")))
    needed = F.lit(True)
    for c in _NUMBERS:
        needed = needed & F.col(c).isNotNull()
    return typed.where(needed)


def read_tracks_csv(spark: SparkSession, paths: str | list[str], columns: list[str], strict: bool = False) -> DataFrame:
    """CSV files of tracks as text columns, parsed; ``clip_id`` is the file's name without ``_tracks.csv``.

    ``row_idx`` is a row's place in its file, from 0, counting the rows that parsing leaves out too. A file may be read in several
    splits: rows are numbered within their split, and the sizes of the splits before are added, so no task numbers a whole file.
    ``columns`` names the columns in the files' order; nothing is inferred.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(paths)
    placed = raw.select(
        *columns,
        F.regexp_replace(F.col("_metadata.file_name"), r"(_tracks)?\.csv$", "").alias("clip_id"),
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__split"),
        F.monotonically_increasing_id().alias("__n"),
    )
    ranked = blocked_rank(placed, ["__file"], ["__split", "__n"], F.col("__split"), "__rank")
    return parsed(ranked.withColumn("row_idx", F.col("__rank") - 1).drop("__file", "__split", "__n", "__rank"), strict)


def write_tracks_csv(rows: DataFrame, folder: str) -> None:
    """One folder of CSV files with a header, numbers with six decimals."""
    text = [F.format_string("%.6f", F.col(c)).alias(c) if kind == "double" else F.col(c) for c, kind in rows.dtypes]
    rows.select(*text).write.mode("overwrite").option("header", True).csv(folder)


def replace_clips(rows: DataFrame, folder: str) -> None:
    """Writes rows partitioned by camera and clip and replaces only the clips that occur in them, so repeating it changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("camera", "clip_id").parquet(folder)


def read_zone_file(spark: SparkSession, path: str) -> DataFrame:
    """Zones of a JSON (or, where a YAML reader is installed, YAML) file: ``{"camera_id": ..., "zones": [{"zone_id", "name", "polygon"}]}``.

    A zone file is one camera's configuration, so the driver reads it.
    """
    with open(path, encoding="utf-8") as file:
        text = file.read()
    if path.endswith((".yaml", ".yml")):
        import yaml

        content = yaml.safe_load(text)
    else:
        content = json.loads(text)
    rows = [
        (content["camera_id"], z["zone_id"], z.get("name"), z.get("zone_type"), json.dumps(z["polygon"]), i)
        for i, z in enumerate(content.get("zones", []))
        if z.get("zone_id") and len(z.get("polygon", [])) >= 3
    ]
    return spark.createDataFrame(rows, "camera_id string, zone_id string, zone_name string, zone_type string, polygon string, zone_rank int")


def write_zone_file(zones: DataFrame, camera_id: str, path: str) -> list[dict]:
    """Writes one camera's zones in the form that ``read_zone_file`` reads; returns the zones left out, each with its reason.

    A camera's zones are a configuration file, so the driver writes it. ``zones``: camera_id, zone_id, zone_name, zone_type, polygon
    (JSON). Left out are zones without an id, with a polygon that is no list of points, and with fewer than three points.
    """
    kept, skipped = [], []
    for row in zones.where(F.col("camera_id") == camera_id).orderBy("zone_id").collect():
        try:
            points = json.loads(row.polygon or "[]")
            points = [[float(x), float(y)] for x, y in points]
        except (ValueError, TypeError):
            points = None
        reason = "no zone_id" if not (row.zone_id or "").strip() else "no polygon" if points is None else "fewer than three points" if len(points) < 3 else None
        if reason:
            skipped.append({"zone_id": row.zone_id, "reason": reason})
        else:
            kept.append({"zone_id": row.zone_id, "name": row.zone_name, "zone_type": row.zone_type, "polygon": points})
    with open(path, "w", encoding="utf-8") as file:
        json.dump({"camera_id": camera_id, "zones": kept}, file, ensure_ascii=False, indent=1)
    return skipped


def write_report(report: DataFrame, folder: str) -> None:
    """A report as JSON lines."""
    report.coalesce(1).write.mode("overwrite").json(folder)
