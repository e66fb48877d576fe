"""Session helpers: where durable intermediates go, and when a table may be broadcast."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, as estimated from its own rows, that an operator sends to every executor.
BROADCAST_BYTES = 8 << 20


def local_session(app: str = "trackloom", cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def durable(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` into the folder that the cluster names in ``spark.checkpoint.dir``.

    The checkpoint is replicated storage shared by all executors, so losing an executor afterwards costs nothing. Where the session
    names no folder, a temporary one is set on a local master, and removed at exit; on a cluster that is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="trackloom-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable for the Python workers of every executor, once per application (``addPyFile``)."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    # Spark serves the archive from the driver; nothing reads this folder on another machine.
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='trackloom-')}/{root.name}", "zip", root.parent, root.name)
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def row_bytes(df: DataFrame):
    """A rough upper estimate of a row's size: texts by length, arrays by their JSON, anything else as 16 bytes."""
    total = F.lit(0).cast("bigint")
    for name, kind in df.dtypes:
        if kind == "string":
            size = F.coalesce(4 * F.length(F.col(f"`{name}`")), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            size = F.coalesce(2 * F.length(F.to_json(F.struct(F.col(f"`{name}`")))), F.lit(0))
        else:
            size = F.lit(0)
        total = total + size + 16
    return total


def measured(df: DataFrame, limit: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """``df`` with a broadcast hint, and True, if its rows, measured, take at most ``limit`` bytes; else ``df``, and False.

    ``df`` is kept (memory, then disk) so that measuring does not compute it twice. Beyond the limit the join that follows
    is an ordinary shuffled one, where adaptive execution splits skewed partitions.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    size = kept.agg(F.coalesce(F.sum(row_bytes(kept)), F.lit(0))).first()[0]
    return (F.broadcast(kept), True) if size <= limit else (kept, False)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The first of ``measured``."""
    return measured(df, limit)[0]
