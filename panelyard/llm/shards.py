"""Placement of rows on shards by a permutation-filled lookup table (DataFrame functions only).

Each shard orders all slots of a prime-sized table by its own permutation (start and step
from a digest of its name). Shards take turns; each claims the first slot in its order
that is free. So shards get equal numbers of slots (to within one), and adding or
removing a shard moves few others. The table is broadcast (its size is a parameter, not
the data's); a row's key hashes to a slot, whose shard is read in constant time.

Defined cases: a null key is placed by the row's fallback column, so that many null keys
don't load one shard; equal keys (or null keys with equal fallback) share a shard; an
empty table gives an empty result. Extra columns pass through; `slot` and `shard` replace
columns of those names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SIZE = 65_537


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill(shards: list[str], size: int = SIZE) -> list[int]:
    """The number of the shard that holds each slot."""
    if not _prime(size) or not 0 < len(set(shards)) == len(shards) <= size:
        raise ValueError("the size must be a prime of at least the number of shards, whose names differ")
    digests = [hashlib.sha256(s.encode()).digest() for s in shards]
    at = [int.from_bytes(d[:8]) % size for d in digests]
    step = [int.from_bytes(d[8:16]) % (size - 1) + 1 for d in digests]
    table, free = [-1] * size, size
    while free:
        for k in range(min(len(shards), free)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % size
            table[at[k]] = k
            free -= 1
    return table


def lookup(spark: SparkSession, shards: list[str], size: int = SIZE) -> DataFrame:
    """(slot, shard), `size` rows."""
    return spark.createDataFrame([(k, shards[s]) for k, s in enumerate(fill(shards, size))], "slot int, shard string")


def place(rows: DataFrame, shards: list[str], key: str, fallback: str, size: int = SIZE) -> DataFrame:
    """rows with the slot and the shard of each."""
    kept = [common.quoted(c) for c in rows.columns if c.lower() not in ("slot", "shard")]
    k, other = F.col(common.quoted(key)), F.col(common.quoted(fallback))
    hashed = F.when(k.isNull(), F.xxhash64(other)).otherwise(F.xxhash64(k))
    slotted = rows.select(*kept, F.pmod(hashed, F.lit(size)).cast("int").alias("slot"))
    return slotted.join(F.broadcast(lookup(rows.sparkSession, shards, size)), "slot").select(*kept, "slot", "shard")


def balance(placed: DataFrame) -> DataFrame:
    """Rows of each shard."""
    return placed.groupBy("shard").agg(F.count("*").alias("n_rows"))


def write(placed: DataFrame, path: str, files: int = 8) -> None:
    """One folder a shard; each shard's rows are dealt over several tasks by a salt."""
    salted = placed.withColumn("__salt", F.pmod(F.xxhash64(*(common.quoted(c) for c in placed.columns)), F.lit(files)))
    salted.repartition(common.partitions(placed.sparkSession), "shard", "__salt").drop("__salt").write.partitionBy("shard").parquet(path)
