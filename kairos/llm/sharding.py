"""Placement by a permutation-filled lookup table (consistent hashing).

Each shard has its own preference order over the slots of a prime-sized table:
(offset + j * skip) mod size.  Shards take turns; at its turn a shard claims its
next unclaimed slot, until the table is full, so shares differ by one slot at
most and a changed shard list moves few slots.  The table depends on the shard
names only.  It is broadcast (``TABLE_SIZE`` rows of 16 bytes, whatever the
data), and a row's shard is one look-up of its key's hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prime number of slots, over 100 times the number of shards.
TABLE_SIZE = 4099
SHARDS = tuple(f"shard-{i:02d}" for i in range(32))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def lookup_table(shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE) -> list[int]:
    """Shard number of each slot.  ``size`` must be prime and at least the number of shards.

    Names are used as given: a repeated name is refused, order breaks ties of turn."""
    if not shards or len(set(shards)) != len(shards) or size < len(shards):
        raise ValueError("shards must be distinct, at least one, and no more than slots")
    if size < 2 or any(size % d == 0 for d in range(2, int(size ** 0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    place = [_number(f"offset:{s}") % size for s in shards]
    skip = [_number(f"skip:{s}") % (size - 1) + 1 for s in shards]
    table = [-1] * size
    left = size
    while True:
        for i in range(len(shards)):
            while table[place[i]] >= 0:
                place[i] = (place[i] + skip[i]) % size
            table[place[i]] = i
            left -= 1
            if not left:
                return table


def slot(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key; a null key counts as the word null."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % size


def place(df: DataFrame, key: str = "doc_id", shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE,
          slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """``df`` with the slot and shard name of each row; equal keys share a shard.

    Columns of those names are replaced.  Null keys all go to one shard, repeated
    rows stay repeated, an empty table stays empty."""
    df = df.drop(slot_col, shard_col)
    filled = F.split(F.lit(",".join(map(str, lookup_table(shards, size)))), ",")
    names = F.array(*[F.lit(s) for s in shards])
    table = (df.sparkSession.range(1).select(F.posexplode(filled).alias("_slot", "_n"))
             .select(F.col("_slot").cast("long").alias(slot_col),
                     F.element_at(names, F.col("_n").cast("int") + 1).alias(shard_col)))
    return (df.withColumn(slot_col, slot(F.col(key), size)).join(F.broadcast(table), slot_col)
            .select(*[F.col(f"`{c}`") for c in df.columns], slot_col, shard_col))
