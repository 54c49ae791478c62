"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a prime-sized table (an offset and a step, both from a
hash of its name); the shards take turns, each claiming its most preferred free slot, until the table is full. A row's
shard is the owner of the slot its key hashes to, so adding or losing a shard moves few keys. The table's size depends
on the number of shards only (about 100 slots a shard): it is filled once on the driver and broadcast.

Defined results: a null key counts as the empty string; equal keys, hot ones too, go to one shard and no shuffle is
made for it; repeated rows get the same shard each; an empty table gives an empty result; a column of the input named
like an output column is replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versoscan.llm.shared import table

SHARDS = 64
SLOTS_PER_SHARD = 100
MAX_SHARDS = 10_000  # bounds what is broadcast: a million slots


def next_prime(n: int) -> int:
    while n < 2 or any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def fill_table(shards: list[str], slots: int) -> list[int]:
    """The owner (an index of ``shards``) of each slot; ``slots`` must be prime and at least the number of shards."""
    if not shards or len(shards) > MAX_SHARDS:
        raise ValueError(f"between 1 and {MAX_SHARDS} shards")
    if len(set(shards)) < len(shards) or slots < len(shards) or next_prime(slots) != slots:
        raise ValueError("names must differ and the table's size be a prime that is not below their number")
    number = lambda salt, name: int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)
    at = [number("offset", s) % slots for s in shards]
    step = [number("step", s) % (slots - 1) + 1 for s in shards] if slots > 1 else [0]
    owner = [-1] * slots
    left = slots
    while True:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            owner[at[i]] = i
            left -= 1
            if not left:
                return owner


def slot_of(key: Column, slots: int) -> Column:
    """From the first 60 bits of the key's MD5, which any engine can compute."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long") % slots


def assign_shards(df: DataFrame, key: str, shards: list[str], slots_per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """df with ``slot`` and ``shard`` (an index of ``shards``): a lookup join with the broadcast table, no shuffle."""
    slots = next_prime(slots_per_shard * len(shards))
    owners = F.lit(",".join(map(str, fill_table(shards, slots))))
    lookup = df.sparkSession.range(1, numPartitions=1).select(F.posexplode(F.split(owners, ",")).alias("slot", "shard"))
    lookup = lookup.select(F.col("slot").cast("long"), F.col("shard").cast("int"))
    out = df.drop(*(c for c in ("slot", "shard") if c != key)).withColumn("slot", slot_of(F.col(key), slots))
    return out.join(F.broadcast(lookup), "slot")


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", shard_names()).select("doc_id", "slot", "shard")


def oracle(shards: int = SHARDS) -> str:
    slots = next_prime(SLOTS_PER_SHARD * shards)
    owners = ",".join(map(str, fill_table(shard_names(shards), slots)))
    return f"""
with t as (select string_split('{owners}', ',') as owners),
d as (select doc_id, cast(('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15)) as bigint) % {slots} as slot from documents)
select doc_id, slot, cast(owners[slot + 1] as integer) as shard from d, t
"""
