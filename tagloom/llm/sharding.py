"""Placement of rows on shards by a permutation-filled look-up table.

Every shard orders the slots of a table of prime size by its own preference (an offset and a step drawn from its name)
and the shards take turns: each claims the first slot in its order that is still free. The table is full when every slot
is claimed, shards differ by at most one slot, and when a shard comes or goes most slots keep their owner. A key is hashed
to a slot and the slot names the shard, so placing a row is one look-up in a broadcast table whose size is the fixed
number of slots, whatever the data.

Defined results: a null key is placed like the empty string; equal keys share a shard; repeated rows are kept; columns
of the input stay, and ones named like an output column are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Number of slots: a prime, over a hundred times the number of shards for an even spread.
SLOTS = 65_537


def _hash(name: str, seed: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{seed}:{name}".encode()).digest()[:8], "big")


def prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """Number of the shard that owns each slot. Shards are taken in the order of their names, so the order given does
    not matter."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need distinct names")
    if not prime(slots) or slots < len(shards):
        raise ValueError("the number of slots must be a prime, and as large as the number of shards at least")
    turn = sorted(range(len(shards)), key=shards.__getitem__)
    at = [_hash(s, "offset") % slots for s in shards]
    step = [_hash(s, "step") % (slots - 1) + 1 for s in shards]
    owner, free = np.full(slots, -1, np.int32), slots
    while True:
        for k in turn:
            while owner[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            owner[at[k]] = k
            free -= 1
            if not free:
                return owner


def slot(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key, from the first 60 bits of its hash: the same on any engine."""
    hexed = F.substring(F.sha2(F.coalesce(key.cast("string"), F.lit("")).cast("binary"), 256), 1, 15)
    return F.pmod(F.conv(hexed, 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(rows: DataFrame, key_col: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """All columns with ``slot`` and ``shard``. The broadcast table has exactly ``slots`` rows."""
    import pandas as pd

    names = np.array(shards, dtype=object)
    table = rows.sparkSession.createDataFrame(
        pd.DataFrame({"slot": np.arange(slots, dtype=np.int32), "shard": names[fill(shards, slots)]}), "slot int, shard string"
    )
    keyed = rows.withColumn("slot", slot(F.col(key_col), slots)).drop("shard")
    return keyed.join(F.broadcast(table), "slot", "left")


def balance(placed: DataFrame, size: Column) -> DataFrame:
    """Rows and bytes of each shard; one partial row for each shard and task is shuffled."""
    return placed.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum(size).alias("n_bytes"))
