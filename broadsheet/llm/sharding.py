"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A stable key and the number of shards decide a row's shard; there is no ring table. When a
shard is appended, about ``1 / (n + 1)`` of the rows move, all of them into the new shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import split_rank

_MULTIPLIER = np.uint64(2862933555777941757)  # fixed by the published algorithm


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key, for all keys at once."""
    state = keys.astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(state), np.int64)
    moving, jump = np.arange(len(state)), np.zeros(len(state), np.int64)
    while len(moving):
        shard[moving] = jump
        with np.errstate(over="ignore"):
            s = state[moving] * _MULTIPLIER + np.uint64(1)
        state[moving] = s
        jump = ((shard[moving] + 1) * (2147483648.0 / ((s >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        stays = jump < shards
        moving, jump = moving[stays], jump[stays]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    """The shard of an integer key (a null key counts as 0)."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf("int")
    def jump(k: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(k.to_numpy(np.int64), shards).astype(np.int32))

    return jump(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def assign_shards(df: DataFrame, shards: int, key: str = "doc_id", out: str = "shard") -> DataFrame:
    """Adds column ``out``, replacing one of that name. Integer keys are used as they are, others by
    their xxhash64. Equal keys, repeated rows among them, share a shard; null keys count as 0; an
    empty table stays empty; other columns pass through untouched."""
    c = df[key]
    if df.schema[key].dataType.typeName() not in ("byte", "short", "integer", "long"):
        c = F.when(c.isNull(), F.lit(0)).otherwise(F.xxhash64(c))
    return df.withColumn(out, shard_of(c, shards))


def shard_slots(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot, grown_shard) for each row.

    ``size``: UTF-8 bytes of the text plus 16 (a null text has none, and the CRC of no bytes, 0);
    ``slot``: the row's gapless place from 0 in its shard, by the CRC of its key;
    ``grown_shard``: the shard with one more shard. The text itself isn't shuffled.
    """
    t = F.coalesce(df[text], F.lit(""))
    slim = df.select(df[key], (F.octet_length(t) + 16).cast("long").alias("size"), F.crc32(t).alias("text_crc32"))
    placed = assign_shards(assign_shards(slim, shards, key), shards + 1, key, "grown_shard")
    spread = F.shiftleft(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), 32)
    return split_rank(placed, ["shard"], spread, [key, "text_crc32", "size"], "slot")


def write_shards(df: DataFrame, shards: int, path: str, key: str = "doc_id", files_per_shard: int = 1) -> None:
    """Writes one folder ``shard=n`` for each shard; ``files_per_shard`` spreads large shards over tasks."""
    placed = assign_shards(df, shards, key)
    salt = F.pmod(F.xxhash64(key), F.lit(files_per_shard))
    placed.repartition(shards * files_per_shard, "shard", salt).write.mode("overwrite").partitionBy("shard").parquet(path)
