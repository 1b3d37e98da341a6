"""Sharding by jump consistent hashing.

The shard of a row is a pure function of its stable key and the number of shards: no ring table is kept, and when one
shard is appended only the fraction 1/(n+1) of the rows moves, all of it into the new shard. Slots number a shard's rows
gapless from 0 in the order in which they were placed: a row's rank among those of its task and shard is stored with it, and
prefix sums over the tasks' counts give each task its first slot in a shard. No row is grouped by key or shard, so a key that
a third of all rows share is dealt out like any other.

Defined cases: a null key hashes as its own fixed key; rows with equal keys share a shard, whatever their slots; columns named
as new ones are replaced; null text weighs 8 bytes and has the checksum of the empty string; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .exchange import stored


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash (Lamping and Veach 2014) of uint64 keys, over a whole array at a time."""
    key, b, j = keys.astype(np.uint64).copy(), np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    while len(live):
        b[live] = j[live]
        with np.errstate(over="ignore"):
            key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        j[live] = ((b[live] + 1).astype(np.float64) * step).astype(np.int64)
        live = live[j[live] < shards]
    return b


def assign_shards(rows: DataFrame, key_hash: str, shards: int) -> DataFrame:
    """rows with shard, slot and grown_shard (the shard if there were one more). key_hash: an SQL expression, a long."""
    ship(rows.sparkSession)
    own = [c for c in rows.columns if c not in ("shard", "slot", "grown_shard")]
    hashed = rows.select(*own, F.expr(key_hash).alias("_key"))
    new = [T.StructField("shard", T.IntegerType()), T.StructField("grown_shard", T.IntegerType()), T.StructField("_task", T.IntegerType()), T.StructField("_rank", T.LongType())]
    schema = T.StructType([*(rows.schema[c] for c in own), *new])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, met = TaskContext.get().partitionId(), np.zeros(shards, np.int64)
        for batch in batches:
            keys = batch.column("_key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            shard, grown = jump_hash(keys, shards), jump_hash(keys, shards + 1)
            order = np.argsort(shard, kind="stable")
            n = np.bincount(shard, minlength=shards)
            rank = np.empty(len(shard), np.int64)
            rank[order] = np.arange(len(shard)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(met, n)
            met += n
            columns = [pa.array(c.astype(np.int32)) for c in (shard, grown, np.full(len(shard), task))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *columns, pa.array(rank)], names=schema.names)

    placed = stored(hashed.mapInArrow(place, schema), "shards")
    counts = placed.groupBy("shard", "_task").agg(F.count("*").alias("_n"))
    # shards x tasks narrow rows
    before = counts.select("shard", "_task", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_task")) - F.col("_n")).alias("_before"))
    out = placed.join(before, ["shard", "_task"]).withColumn("slot", F.col("_before") + F.col("_rank"))
    return out.select(*own, "shard", "slot", "grown_shard")


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs(doc_id, text)."""
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = assign_shards(narrow, "xxhash64(coalesce(cast(doc_id as string), ''))", shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
