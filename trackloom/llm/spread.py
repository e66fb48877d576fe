"""Even work for Python stages."""

from __future__ import annotations

from pyspark.sql import DataFrame

from trackloom.session import ship_package


def spread(df: DataFrame) -> DataFrame:
    """``df``, or ``df`` dealt out evenly if its scan has fewer parts than the cluster has cores (one large row group, say).

    Also sees to it that the workers can import this package.
    """
    ship_package(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)
