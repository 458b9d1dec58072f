"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size: an offset and a step from a hash of its name.
Shards take turns, each claiming the first slot of its order that is still free, until the table is full; so every shard holds
nearly the same number of slots, and a shard that goes gives up its slots while nearly all others stay. The table has as many
rows as slots, whatever the data, and is broadcast; a key is placed by one hash and one lookup.
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537
"""Prime, and well above 100 slots a shard for the shard numbers in use."""


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the position of its shard in ``shards``."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must have names, each its own")
    if not is_prime(slots) or slots <= len(shards):
        raise ValueError("slots must be a prime above the number of shards")
    digest = [md5(s.encode()).digest() for s in shards]
    at = [int.from_bytes(d[:8], "big") % slots for d in digest]
    step = [int.from_bytes(d[8:], "big") % (slots - 1) + 1 for d in digest]
    table, free = [-1] * slots, slots
    while True:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            table[at[k]] = k
            free -= 1
            if not free:
                return table


def table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``slot, shard`` as rows."""
    line = ",".join(map(str, fill(shards, slots)))
    rows = spark.range(1).select(F.posexplode(F.split(F.lit(line), ",")).alias("slot", "k"))
    return rows.select("slot", F.element_at(F.array(*map(F.lit, shards)), F.col("k").cast("int") + 1).alias("shard"))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """From the first 60 bits of the MD5 of the key as text; a null key counts as the empty text."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long") % slots).cast("int")


def place(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS, out: str = "shard", slot: str = "slot") -> DataFrame:
    """``df`` with the slot and the shard of each row's ``key``; rows with one key stay together. Existing columns of these
    names are refused.

    Only functions of Spark SQL and one broadcast of ``slots`` rows; no shuffle. A hot key goes to one shard by definition:
    add a second column to the key to spread it.
    """
    if {out, slot} & set(df.columns):
        raise ValueError(f"the input has a column {out} or {slot} already")
    lookup = table(df.sparkSession, shards, slots).withColumnsRenamed({"slot": slot, "shard": out})
    return df.withColumn(slot, slot_of(F.col(key), slots)).join(F.broadcast(lookup), slot).select(*(f"`{c}`" for c in df.columns), slot, out)
