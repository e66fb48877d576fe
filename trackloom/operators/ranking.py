"""Ranks within groups of any size: the group is cut into blocks, so that no task ever holds a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_offsets(blocks: DataFrame, keys: Sequence[str], block: str, sizes: Sequence[str]) -> DataFrame:
    """Adds ``<size>_before`` for each of ``sizes``: the sum over the group's earlier blocks.

    ``blocks`` has one row per (keys, block), so the window over a group sees its blocks, never its rows.
    """
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumns({f"{s}_before": F.coalesce(F.sum(s).over(before), F.lit(0).cast("bigint")) for s in sizes})


def blocked_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, name: str) -> DataFrame:
    """``row_number`` within ``keys`` by ``order``, without gathering a group in one task.

    ``block`` must not decrease along ``order`` within a group (a coarser form of its first column). Rows are ranked within
    their block; the number of rows of the earlier blocks is added. Nulls in ``keys`` form a group of their own.
    """
    # One struct holds keys and block: joins on it keep the partitioning, and its null fields are equal.
    rest = [c for c in df.columns if c not in keys]
    placed = df.select(F.struct(*keys, block.alias("__block")).alias("__part"), *rest)
    local = placed.withColumn("__in", F.row_number().over(Window.partitionBy("__part").orderBy(*[F.col(f"__part.{o}") if o in keys else F.col(o) for o in order])))
    before = Window.partitionBy(*[F.col(f"__part.{k}") for k in keys]).orderBy("__part.__block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0).cast("bigint")).alias("__n_before"))
    joined = local.join(offsets, "__part")
    return joined.select(*[F.col(f"__part.{c}").alias(c) if c in keys else F.col(c) for c in df.columns], (F.col("__n_before") + F.col("__in")).alias(name))


def at_index(df: DataFrame, keys: Sequence[str], value: str, block: Column, picks: dict) -> DataFrame:
    """Exact order statistics: one row per group with the values at positions of its sorted ``value`` (0 is the lowest).

    ``picks`` maps a name to a function from the group's size to a position. Ranks come from blocks of values, so a group is
    never sorted as a whole. ``block`` must not decrease with ``value``. Null values do not count.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, value)
    ranked = blocked_rank(rows, keys, [value], block, "__r")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).select(*[F.col(k).alias(f"__s{i}") for i, k in enumerate(keys)], "__n")
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__s{i}"))
    both = ranked.join(sizes, on)
    return both.groupBy(*keys).agg(*[F.max(F.when(F.col("__r") - 1 == pick(F.col("__n")), F.col(value))).alias(name) for name, pick in picks.items()])
