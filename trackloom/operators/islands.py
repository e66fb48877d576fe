"""Previous rows and gaps-and-islands within groups of any size, and folds over sorted groups."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.session import ship_package


def _placed(df: DataFrame, keys: Sequence[str], block: Column) -> DataFrame:
    """Rows with ``__part``, the struct of ``keys`` and ``__block``, in its place; partitioned by it.

    A struct is never null itself and equal structs have equal (also null) fields, so joins on it keep the partitioning, which
    null-safe comparisons of the single keys would not.
    """
    rest = [c for c in df.columns if c not in keys]
    return df.select(F.struct(*keys, block.alias("__block")).alias("__part"), *rest).repartition(F.col("__part"))


def _restored(df: DataFrame, columns: Sequence[str], keys: Sequence[str], *more: str) -> DataFrame:
    return df.select(*[F.col(f"__part.{c}").alias(c) if c in keys else F.col(c) for c in columns], *more)


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, carried: Sequence[str], name: str = "prev") -> DataFrame:
    """Adds the struct ``name`` of the ``carried`` columns of the row before, by ``order`` within ``keys``; null for a first row.

    ``block`` must not decrease along ``order``. A task sees one block of a group; a block's first row takes the last row of the
    block before from a table of one row per block. ``carried`` and ``order`` hold no keys.
    """
    row = F.struct(*carried)
    placed = _placed(df, keys, block)
    within = placed.withColumn("__lag", F.lag(row).over(Window.partitionBy("__part").orderBy(*order)))
    last = placed.groupBy("__part").agg(F.max_by(row, F.struct(*order)).alias("__last"))
    in_order = Window.partitionBy(*[F.col(f"__part.{k}") for k in keys]).orderBy("__part.__block")
    before = last.select("__part", F.lag("__last").over(in_order).alias("__edge"))
    joined = within.join(before, "__part").withColumn(name, F.coalesce("__lag", "__edge"))
    return _restored(joined, df.columns, keys, name)


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, carried: Sequence[str], cut: Callable[[Column], Column], name: str = "island") -> DataFrame:
    """Numbers the islands of each group from 1: an island starts at a group's first row and where ``cut(prev)`` is true.

    ``prev`` is the struct of ``carried`` columns of the row before; ``cut`` may use these and the same columns of the row. Rows are
    counted within blocks. One row per block tells its first and last row and its cuts; a window over these rows decides whether
    a block's first row is a cut and how many islands lie before, so no task holds a whole group. ``carried`` and ``order`` hold
    no keys.
    """
    row, at = F.struct(*carried), F.struct(*order)
    within = Window.partitionBy("__part").orderBy(*order)
    placed = _placed(df, keys, block)
    local = placed.withColumn("__prev", F.lag(row).over(within)).withColumn("__cut", F.coalesce((F.col("__prev").isNotNull() & cut(F.col("__prev"))).cast("int"), F.lit(0)))
    counted = local.withColumn("__in", F.sum("__cut").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = local.groupBy("__part").agg(F.sum("__cut").alias("__cuts"), F.min_by(row, at).alias("__first"), F.max_by(row, at).alias("__last"))
    groups = [F.col(f"__part.{k}") for k in keys]
    linked = blocks.withColumn("__prev", F.lag("__last").over(Window.partitionBy(*groups).orderBy("__part.__block"))).select("__part", "__cuts", "__prev", *[F.col(f"__first.{c}").alias(c) for c in carried])
    opens = F.when(F.col("__prev").isNull(), 1).otherwise(F.coalesce(cut(F.col("__prev")).cast("int"), F.lit(0)))
    before = Window.partitionBy(*groups).orderBy("__part.__block").rowsBetween(Window.unboundedPreceding, -1)
    sized = linked.withColumn("__opens", opens).withColumn("__n", F.col("__opens") + F.col("__cuts"))
    offsets = sized.select("__part", (F.col("__opens") + F.coalesce(F.sum("__n").over(before), F.lit(0))).alias("__offset"))
    joined = counted.join(offsets, "__part").withColumn(name, F.col("__in") + F.col("__offset"))
    return _restored(joined, df.columns, keys, name)


_ARROW = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}


def fold_sorted(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: Callable[[tuple], object], schema: str) -> DataFrame:
    """A sequential state machine over each group in order, for what depends on its own earlier decisions.

    ``start(key)`` gives an object with ``step(row) -> iterable of result tuples`` and ``end() -> iterable``. Rows are named tuples of plain
    Python values (nulls are None). Groups are streamed: a task holds one state and one batch, never a group. Results are tuples
    in the order of ``schema`` (bigint, string, double, boolean).
    """
    ship_package(df.sparkSession)
    fields = pa.schema([(name, _ARROW[kind]) for name, kind in (part.split() for part in schema.split(","))])
    width = len(keys)
    rest = [c for c in df.columns if c not in keys]
    names = [*keys, *rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Row = namedtuple("Row", names)
        state, current, begun = None, None, False

        def packed(results: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*results), fields)], schema=fields)

        for batch in batches:
            out: list[tuple] = []
            for row in map(Row._make, zip(*(c.to_pylist() for c in batch.columns))):
                key = row[:width]
                if not begun or key != current:
                    if begun:
                        out.extend(state.end())
                    state, current, begun = start(key), key, True
                out.extend(state.step(row))
            if out:
                yield packed(out)
        if begun and (out := list(state.end())):
            yield packed(out)

    placed = df.select(*names).repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order)
    return placed.mapInArrow(run, schema)
