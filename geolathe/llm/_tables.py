"""Tables shared by all executors, bounded joins, and distributed running sums."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A side is broadcast only when it has been counted and has at most this many (slim) rows.
BROADCAST_ROWS = 20_000

#: The same for a table of ids alone (16 MB as Spark holds them).
SLIM_ROWS = 1_000_000

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local one only where that is unset and all runs in this process."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="geolathe-"))
    return _own_dir[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/geolathe-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names`` as columns that ``df`` does not have, whatever its own are called."""
    taken = {c.lower() for c in df.columns}
    mark = "_"
    while any(f"{mark}{n}" in taken for n in names):
        mark += "_"
    return [f"{mark}{n}" for n in names]


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if ``df`` (a staged table) has few rows; otherwise leave a shuffled join, whose skew AQE splits."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def running_before(df: DataFrame, value: str, order: Sequence[str], group: Sequence[str] = (), out: str = "before", parts: int | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows that come before, in ``order``, within ``group``.

    No group is gathered in one task: rows are dealt in ranges of (group, order), written with the number of
    their range, and each range gets the total of the ranges before it. Ties in ``order`` take any order among
    themselves, so end it with a column that tells rows apart. The result is a staged table.
    """
    number, total, ahead = free_names(df, "range", "total", "ahead")
    keys = [F.col(c) for c in [*group, *order]]
    ranged = df.repartitionByRange(*([parts] if parts else []), *keys)
    ranged = stage(ranged.withColumn(number, F.spark_partition_id()), "ranges")
    by = [*group, number]
    totals = ranged.groupBy(*by).agg(F.sum(value).alias(total))
    before = F.coalesce(F.sum(total).over(W.partitionBy(*group).orderBy(number).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = stage(totals.withColumn(ahead, before).drop(total), "ahead")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]
    on: Column = same[0]
    for c in same[1:]:
        on = on & c
    joined = ranged.alias("l").join(small(totals).alias("r"), on, "left").select("l.*", f"r.{ahead}")
    within = F.coalesce(F.sum(value).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return joined.withColumn(out, F.col(ahead) + within).drop(number, ahead)
