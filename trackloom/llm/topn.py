"""Problem 5: the top N items within every group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Subgroups into which each group is hashed.
SUBGROUPS = 32


def top_pairs(scores: DataFrame, n: int = 3, subgroups: int = SUBGROUPS) -> DataFrame:
    """For every ``cam1_gid`` the ``n`` best ``cam2_gid`` by score: ``cam1_gid, cam2_gid, score, rank``.

    Method, two-stage salted ranking. A pair's best score comes from an aggregation that combines before it shuffles. Each
    group is then hashed by cam2_gid into subgroups, every subgroup is ranked and keeps ``n`` (map tasks already drop what
    cannot be among them), and only these survivors, at most ``n * subgroups`` a group, are ranked by score and identifier.

    Ties go to the lower cam2_gid, so every run gives the same rows. Defined cases: scores that are null, NaN or outside 0..1
    do not count, a pair without any other is left out; a pair scored several times has its best score; a null cam1_gid is a
    group of its own, a null cam2_gid an item that comes first among equals; groups with fewer pairs give all; an empty table
    gives no rows. Other columns are ignored.
    """
    if n < 1 or subgroups < 1:
        raise ValueError("n and subgroups must be positive")
    valid = scores.select("cam1_gid", "cam2_gid", F.col("score").cast("double").alias("score")).where("score BETWEEN 0 AND 1 AND NOT isnan(score)")
    pairs = valid.groupBy("cam1_gid", "cam2_gid").agg(F.max("score").alias("score"))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("cam2_gid"), F.lit(subgroups)))
    order = [F.desc("score"), F.asc_nulls_first("cam2_gid")]
    within = Window.partitionBy("cam1_gid", "salt").orderBy(*order)
    survivors = salted.withColumn("r", F.row_number().over(within)).where(F.col("r") <= n).drop("r", "salt")
    final = Window.partitionBy("cam1_gid").orderBy(*order)
    return survivors.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= n).withColumn("rank", F.col("rank").cast("bigint"))
