"""Joins and ranks that stay bounded when one key owns a third of the rows."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 65536


def spread_lookup(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    spread: list[str],
    how: str = "inner",
    buckets: int | None = None,
) -> DataFrame:
    """Join ``left`` to ``right``, which is unique on ``keys``, without hot tasks.

    Left rows of one key are spread over ``buckets`` by a hash of ``spread``.
    The right side is copied only to the (key, bucket) pairs that occur: the
    distinct step is combined before its shuffle, so a hot key shrinks to at
    most ``buckets`` rows there. By default a key can fill every shuffle partition.
    """
    if buckets is None:
        buckets = max(64, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    left = left.withColumn("_bucket", F.pmod(F.xxhash64(*spread), F.lit(buckets)).cast("int"))
    targets = left.select(*keys, "_bucket").distinct().join(right, keys)
    return left.join(targets, [*keys, "_bucket"], how).drop("_bucket")


_LOCAL_FOLDERS: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """Folder for written intermediate tables: the cluster's checkpoint folder."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="rolecall-")
    return _LOCAL_FOLDERS[context.applicationId]


def materialize(df: DataFrame, folder: str | None = None, compression: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    All tables of an application share one folder, so that what it has left can be
    dropped as one when the application has ended. ``folder`` is another one, for
    tables that a step drops itself (``drop_folder``). ``compression`` other than
    the session's codec pays for whole texts. What the write has shuffled is of no use
    afterwards and is dropped with it.
    """
    spark = df.sparkSession
    target = f"{folder or f'{scratch_dir(spark)}/{spark.sparkContext.applicationId}'}/table-{uuid.uuid4().hex}"
    with _shuffles_dropped(spark):
        df.write.parquet(target, compression=compression)
    return spark.read.schema(df.schema).parquet(target)


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Executions that begin in here delete their shuffle files when they have ended."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of written tables, in whatever store it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def rank_in_groups(
    df: DataFrame,
    keys: list[str],
    level: str,
    position: str,
    name: str = "rank",
    hot: str | None = None,
) -> DataFrame:
    """Number the rows of each group by (``level`` descending, ``position``).

    Without ``hot`` this is one window per group: right when group sizes are
    known to fit a task. With ``hot``, a boolean column, the rows of hot groups
    are windowed per (level, block of positions) instead, and the rows ahead of
    each such cell come from two cumulative counts over cells, not over rows.
    ``level`` should take few values (a rounded score) and ``position`` be a
    dense number; read ``df`` from a written table, it is scanned twice.
    """
    if hot is None:
        w = Window.partitionBy(*keys).orderBy(F.desc(level), position)
        return df.withColumn(name, F.row_number().over(w))

    cell = ["_level", "_block"]
    df = df.withColumn("_level", F.when(F.col(hot), F.col(level))).withColumn(
        "_block", F.when(F.col(hot), F.floor(F.col(position) / BLOCK_ROWS))
    )
    cells = df.filter(hot).groupBy(*keys, *cell).agg(F.count(F.lit(1)).alias("_n"))
    levels = cells.groupBy(*keys, "_level").agg(F.sum("_n").alias("_n"))
    by_level = Window.partitionBy(*keys).orderBy(F.desc("_level")).rowsBetween(Window.unboundedPreceding, -1)
    by_block = Window.partitionBy(*keys, "_level").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.select(*keys, "_level", F.coalesce(F.sum("_n").over(by_level), F.lit(0)).alias("_above"))
    blocks = cells.select(*keys, *cell, F.coalesce(F.sum("_n").over(by_block), F.lit(0)).alias("_before"))
    offsets = blocks.join(levels, [*keys, "_level"])
    inside = Window.partitionBy(*keys, *cell).orderBy(F.desc(level), position)
    return (
        df.join(offsets, [*keys, *cell], "left")
        .withColumn(
            name,
            (
                F.row_number().over(inside)
                + F.coalesce(F.col("_above"), F.lit(0))
                + F.coalesce(F.col("_before"), F.lit(0))
            ).cast("int"),
        )
        .drop(*cell, "_above", "_before")
    )
