"""Jump consistent hashing: stable keys to shards without a table, and gapless slots within each shard.

When shards are appended, a key either stays or moves to a new shard, and the least possible share moves.

Defined results: a null text has size 1 and the crc of no bytes; a null key goes by one fixed hash, so all such
rows share a shard; repeated rows share a shard and have slots of their own; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._tables import free_names, running_before

SHARDS = 16


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key, for all keys at once."""
    key = keys.astype(np.uint64)
    at = np.zeros(len(key), np.int64)
    ahead = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        at[live] = ahead[live]
        k = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        key[live] = k
        ahead[live] = ((at[live] + 1) * (float(1 << 31) / ((k >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        live = live[ahead[live] < shards]
    return at


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a key of any type."""

    @F.pandas_udf(T.IntegerType())
    def run(h: pd.Series) -> pd.Series:
        return pd.Series(jump(h.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return run(F.xxhash64(key))


def shard(docs: DataFrame, key: str = "doc_id", shards: int = SHARDS, order: list[str] | None = None) -> DataFrame:
    """``docs`` with shard, grown_shard (with one shard more) and slot (gapless from 0 in its shard, by a hash of the key and ``order``); columns of these names are replaced."""
    one, h = free_names(docs, "one", "h")
    placed = docs.withColumns({"shard": shard_of(F.col(key), shards), "grown_shard": shard_of(F.col(key), shards + 1), one: F.lit(1).cast("long"), h: F.xxhash64(key)})
    return running_before(placed, one, [h, *(order or [key])], ["shard"], "slot").drop(one, h)


def op_shard(docs: DataFrame) -> DataFrame:
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = docs.select("doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.lit("key").alias("law"))
    return shard(slim, order=["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
