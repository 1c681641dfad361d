"""Placement of documents on shards by a permutation-filled lookup table.

Every shard has an order of preference over the slots of a table of prime size: a start and a step drawn from its
name. In turns each shard claims its next preferred slot that is free, until all are taken, so that shards get equal shares
(to one slot) and a shard that leaves or joins moves few slots of the others. The table has a size fixed by its
parameter, is broadcast, and a document's slot is its hashed key modulo the size: one look-up, no shuffle.

Null ids are placed as the empty key. Equal keys go to the same shard; a hot key costs nothing, as nothing is grouped.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playlytics.llm.common import free_name

SLOTS = 16_381  # prime
MAX_SLOTS = 1 << 20  # bound of the broadcast table
SHARDS = tuple(f"shard-{i:03d}" for i in range(128))


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def preference(shard: str, slots: int) -> tuple[int, int]:
    """Start and step through the table; the step is not 0, so with a prime size it visits every slot."""
    digest = hashlib.md5(shard.encode()).digest()
    return int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:], "big") % (slots - 1) + 1


def fill(shards: Sequence[str] = SHARDS, slots: int = SLOTS, turns: Sequence[int] | None = None) -> list[int]:
    """The number of the shard of every slot. ``turns`` claims per round weigh the shards."""
    if not is_prime(slots) or not len(set(shards)) == len(shards) <= slots <= MAX_SLOTS or not shards:
        raise ValueError("the table needs a prime size, from the number of distinct shards to 2**20")
    turns = turns or [1] * len(shards)
    if len(turns) != len(shards) or min(turns) < 0 or not any(turns):
        raise ValueError("turns must not be negative, nor all zero")
    at = [preference(s, slots) for s in shards]
    nxt = [start for start, _ in at]
    table, free = [-1] * slots, slots
    while free:
        for shard, (_, step) in enumerate(at):
            for _ in range(min(turns[shard], free)):
                while table[nxt[shard]] >= 0:
                    nxt[shard] = (nxt[shard] + step) % slots
                table[nxt[shard]] = shard
                free -= 1
    return table


def lookup(spark: SparkSession, shards: Sequence[str], slots: int, turns: Sequence[int] | None = None) -> DataFrame:
    """The table as rows (slot, shard)."""
    numbers = F.split(F.lit(",".join(map(str, fill(shards, slots, turns)))), ",")
    names = F.array(*map(F.lit, shards))
    number = F.element_at(numbers, F.col("id").cast("int") + 1).cast("int")
    return spark.range(slots).select(F.col("id").alias("slot"), F.element_at(names, number + 1).alias("shard"))


def slot_of(key: Column, slots: int) -> Column:
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.conv(digits, 16, 10).cast("bigint") % slots


def place(
    docs: DataFrame, key: str = "doc_id", shards: Sequence[str] = SHARDS, slots: int = SLOTS, turns: Sequence[int] | None = None
) -> DataFrame:
    """Add ``slot`` and ``shard`` (with underscores in front where ``docs`` has such columns)."""
    slot, shard = free_name(docs, "slot"), free_name(docs, "shard")
    table = lookup(docs.sparkSession, shards, slots, turns).withColumnsRenamed({"slot": slot, "shard": shard})
    placed = docs.withColumn(slot, slot_of(F.col(key), slots))
    return placed.join(F.broadcast(table), slot).select(*docs.columns, slot, shard)
