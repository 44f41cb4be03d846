"""Sharding by jump consistent hashing.

The shard of a row follows from its id and the number of shards alone; there is no ring
table.  Going from n to n + 1 shards moves about 1 / (n + 1) of the rows, all of them
into the new shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowcascade.llm.common import named, number_rows

_STEP = np.uint64(2862933555777941757)     # fixed value of the published method
NULL_KEY = -1


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key.

    A key jumps from shard to shard, each jump drawn from a generator seeded by the key,
    and stays where the next jump would leave the range.
    """
    if shards < 1:
        raise ValueError("there must be at least one shard")
    state = np.array(keys).astype(np.int64).astype(np.uint64)
    at = np.zeros(len(state), np.int64)
    ahead = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while live.size:
        at[live] = ahead[live]
        state[live] = state[live] * _STEP + np.uint64(1)
        draw = ((state[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        ahead[live] = ((at[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        live = live[ahead[live] < shards]
    return at.astype(np.int32)


def shard_of(key, shards: int):
    """Column of the shard of a long column; a null key counts as -1."""
    @F.pandas_udf("int")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for keys in batches:
            yield pd.Series(jump_hash(keys.to_numpy(), shards))
    return place(F.coalesce(key, F.lit(NULL_KEY).cast("long")))


def shard_rows(docs: DataFrame, shards: int, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """One row per document: size, crc, shard, place in the shard, shard after adding one.

    Null id: key -1.  Null text: no bytes, so size 16 and crc 0.  Repeated rows and equal
    ids fall into the same shard and get slots of their own, in an order that shows no
    difference between equal rows.  An empty table gives an empty result.  Other columns
    are not read.

    Slots run from 0 without gaps in each shard.  No task numbers a whole shard: the rows
    are range-partitioned by shard and id, each partition numbers its own part, and the
    counts per partition give the offset.
    """
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        named(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumns({"shard": shard_of(F.col("doc_id"), shards),
                             "grown_shard": shard_of(F.col("doc_id"), shards + 1)})
    placed = number_rows(rows, ["shard"], ["doc_id", "text_crc32", "size"], "shards", "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                         "slot", "grown_shard")
