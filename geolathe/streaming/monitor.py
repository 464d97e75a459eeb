"""Incremental monitoring: new scene dates arrive as files and enter the state once."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_rows(arrived: DataFrame, processed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``arrived`` not yet in ``processed``, each once."""
    return arrived.dropDuplicates(keys).join(processed.select(*keys), keys, "left_anti")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: under ``spark.checkpoint.dir``; a local one only where all runs in this process."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(at or 'file://' + tempfile.mkdtemp()).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run_available(spark: SparkSession, source: str, schema, state: str, checkpoint: str, keys: list[str], glob: str = "*.parquet", prepare: Callable[[DataFrame], DataFrame] = lambda b: b) -> None:
    """Read the files not read before, ``prepare`` their rows, and append those with new keys to the state; running it again changes nothing.

    A batch is written to a folder of its own number, so one that is repeated after a failure replaces itself.
    """

    def append(batch: DataFrame, epoch: int) -> None:
        rows = prepare(batch)
        mine = f"{state}/batch={epoch}"
        known = rows.limit(0).select(*keys)
        if epoch:
            known = spark.read.schema(rows.schema).option("basePath", state).parquet(*[f"{state}/batch={i}" for i in range(epoch)]).select(*keys)
        new_rows(rows, known, keys).write.mode("overwrite").parquet(mine)

    stream = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(source)
    stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def processed(spark: SparkSession, state: str) -> DataFrame:
    """The state's rows, without the numbers of their batches."""
    return spark.read.parquet(state).drop("batch")


def record_run(spark: SparkSession, log: str, run_id: int, status: str, n_new: int, detail: str = "") -> None:
    """Append a run to the log."""
    spark.range(1).select(F.lit(run_id).cast("long").alias("run_id"), F.lit(status).alias("status"), F.lit(n_new).cast("long").alias("n_new"), F.lit(detail).alias("detail"), F.current_timestamp().alias("finished_at")).write.mode("append").parquet(log)


def run_history(spark: SparkSession, log: str, limit: int = 20) -> DataFrame:
    """The last runs, latest first."""
    return spark.read.parquet(log).orderBy(F.desc("run_id")).limit(limit)


def arrivals(scenes: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Scenes a window and provider; on a stream the watermark bounds the state."""
    s = scenes.withColumn("ts", F.col("datetime").cast("timestamp"))
    if s.isStreaming:
        s = s.withWatermark("ts", late)
    return s.groupBy(F.window("ts", window).alias("w"), "provider").agg(F.count("*").alias("n"), F.avg("cloud_cover").alias("cloud"))
