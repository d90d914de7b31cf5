"""Sharding by a permutation-filled lookup table.

Each shard orders the slots of a prime-sized table by a permutation of its own, (offset + j * skip)
mod size. Shards take turns: each claims the first slot in its order that is still free, until none
is. All shards then hold as many slots to within one; when a shard is added or goes, few slots change
hands. The table has a fixed number of slots (TABLE_SIZE by default), so its size is bounded by a
parameter, and placement is a join with the broadcast table.

A row's slot is the MD5 of its key's text, its first 60 bits, modulo the table's size. A null key
counts as empty text. Repeated keys go to one shard. An empty input gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A prime, some hundred times the number of shards.
TABLE_SIZE = 16_411


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """For each slot the place of its shard in ``shards``."""
    if not _prime(size) or not 0 < len(set(shards)) == len(shards) <= size:
        raise ValueError("size must be prime, and shards distinct, some, and at most as many")
    at, skip = [], []
    for name in shards:
        digest = hashlib.md5(name.encode()).digest()
        at.append(int.from_bytes(digest[:8], "big") % size)
        skip.append(int.from_bytes(digest[8:], "big") % (size - 1) + 1 if size > 2 else 1)
    table, free = [-1] * size, size
    while free:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % size
            table[at[k]] = k
            free -= 1
            if not free:
                break
    return table


def place(df: DataFrame, shards: list[str], key: str = "doc_id", size: int = TABLE_SIZE) -> DataFrame:
    """df with slot (int) and shard (string)."""
    table = lookup_table(shards, size)
    spark = df.sparkSession
    slots = spark.createDataFrame([(i, shards[k]) for i, k in enumerate(table)], "slot int, shard string")
    digest = F.conv(F.substring(F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10)
    rest = [c for c in df.columns if c not in ("slot", "shard")]
    # The table has `size` rows, whatever the input.
    return df.select(*(f"`{c}`" for c in rest), (digest.cast("long") % size).cast("int").alias("slot")).join(F.broadcast(slots), "slot", "left").select(*(f"`{c}`" for c in rest), "slot", "shard")
