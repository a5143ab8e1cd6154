"""Shards by a permutation-filled lookup table, in DataFrame operations only.

Every shard has an order of preference over the slots of a table of prime size, an offset
and a step of its own. Shards take turns; in its turn a shard claims the first slot in its
order that is still free. The table ends up even to within one slot a turn, and a shard
that comes or goes moves little more than its share. A row's slot is a hash of its key, its
shard one lookup: the table has a fixed size, is broadcast, and no row is shuffled.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hex digits of md5 that make a number: 52 bits, exact in every engine.
DIGITS = 13
#: Largest table: a few megabytes when broadcast.
MAX_SLOTS = 1 << 20


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:DIGITS], 16)


def fill(shards: dict[str, int], slots: int) -> list[str]:
    """The shard of each slot. `shards` gives the turns of each in a round (1: equal shares); turns go by name."""
    if slots < 3 or slots > MAX_SLOTS or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"the number of slots must be a prime between 3 and {MAX_SLOTS}")
    if not shards or min(shards.values()) < 1 or sum(shards.values()) > slots:
        raise ValueError("there must be shards, each with a turn or more a round, and a slot for every turn")
    names = sorted(shards)
    at = {n: _number(f"{n}:offset") % slots for n in names}
    step = {n: _number(f"{n}:step") % (slots - 1) + 1 for n in names}
    owner: list[str | None] = [None] * slots
    claimed = 0
    while True:
        for name in names:
            for _ in range(shards[name]):
                while owner[at[name]] is not None:
                    at[name] = (at[name] + step[name]) % slots
                owner[at[name]] = name
                claimed += 1
                if claimed == slots:
                    return owner


def table(spark: SparkSession, shards: dict[str, int], slots: int) -> DataFrame:
    """(slot, shard), one row per slot."""
    filled = F.split(F.lit("\n".join(fill(shards, slots))), "\n")
    return spark.range(1).select(F.posexplode(filled).alias("slot", "shard"))


def slot_of(key: Column, slots: int) -> Column:
    """Slot of a key; a null key counts as the empty text."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, DIGITS)
    return (F.conv(digits, 16, 10).cast("long") % slots).cast("int")


def place(df: DataFrame, key: str, shards: dict[str, int], slots: int, names: tuple[str, str] = ("slot", "shard")) -> DataFrame:
    """`df` with its slot and shard, every row as it is; columns of these `names` that it had give way to them.

    Rows with the same key, repeated rows among them, share a shard; null keys share the
    shard of the empty text. An empty table stays empty. Rows stay where they are: a hot key
    is no hot task here.
    """
    slot, shard = (f"placed_{uuid.uuid4().hex[:8]}_{x}" for x in ("slot", "shard"))
    looked_up = F.broadcast(table(df.sparkSession, shards, slots).select(F.col("slot").alias(slot), F.col("shard").alias(shard)))
    joined = df.withColumn(slot, slot_of(F.col(key), slots)).join(looked_up, slot, "left")
    kept = [c for c in df.columns if c not in names]
    return joined.select(*kept, F.col(slot).alias(names[0]), F.col(shard).alias(names[1]))


def write(df: DataFrame, key: str, shards: dict[str, int], slots: int, path: str, files_per_shard: int = 8) -> None:
    """Every shard in a folder of its own under `path`, in `files_per_shard` files dealt by another hash; a column `shard` gives way to it."""
    file, at = (f"placed_{uuid.uuid4().hex[:8]}_{x}" for x in ("file", "slot"))
    dealt = F.pmod(F.xxhash64(F.col(key).cast("string"), F.monotonically_increasing_id()), F.lit(files_per_shard))
    placed = place(df.withColumn(file, dealt), key, shards, slots, (at, "shard"))
    placed.repartition(len(shards) * files_per_shard, "shard", file).drop(at, file).write.partitionBy("shard").parquet(path)
