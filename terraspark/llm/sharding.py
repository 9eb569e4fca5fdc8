"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size: slot (offset + i * skip) mod size for
i = 0, 1, ..., with offset and skip from hashes of its name. Shards take turns (a shard of weight w has w turns a
round) claiming their first slot that is free, until the table is full. A row's key hash picks a slot; the table, of
fixed size, is broadcast, so placing a row takes constant time and no shuffle. When a shard joins or leaves, few other
slots change hands.

Defined cases: a row whose key is null in every column is placed by a hash of the whole row, so that such rows spread
out. Equal keys go to one shard, repeated rows too; with spread > 1 a key's rows share that many slots, which is for
keys that may hold a large part of all rows. Input columns named slot or shard are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import with_columns

SIZE = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8, person=salt.encode()).digest(), "little")


def lookup_table(shards: dict[str, int] | list[str] | tuple[str, ...], size: int = SIZE) -> list[int]:
    """For every slot the position of its shard in `shards` (names, or names with weights of 1 or more)."""
    if size < 2 or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be prime")
    weights = dict(shards) if isinstance(shards, dict) else dict.fromkeys(shards, 1)
    if not weights or len(weights) > size or min(weights.values()) < 1:
        raise ValueError("there must be shards, no more than slots, of weight 1 at least")
    turns = [(k, _number(n, "offset") % size, _number(n, "skip") % (size - 1) + 1) for k, n in enumerate(weights)]
    left, nexts, table = size, [0] * len(turns), [-1] * size
    each = list(weights.values())
    while left:
        for k, offset, skip in turns:
            for _ in range(each[k]):
                if not left:
                    break
                i = nexts[k]
                while table[slot := (offset + i * skip) % size] >= 0:
                    i += 1
                table[slot], nexts[k] = k, i + 1
                left -= 1
    return table


def slot_of(keys: list[Column], row: Column, size: int, spread: int = 1) -> Column:
    nothing = F.lit(True)
    for k in keys:
        nothing &= k.isNull()
    more = [F.pmod(row, F.lit(spread))] if spread > 1 else []
    return F.pmod(F.when(nothing, row).otherwise(F.xxhash64(*keys, *more)), F.lit(size)).cast("int")


def place(rows: DataFrame, keys: list[str], shards: dict[str, int] | list[str] | tuple[str, ...] = SHARDS, size: int = SIZE, spread: int = 1) -> DataFrame:
    """rows with slot and shard (its name)."""
    names = list(shards)
    table = rows.sparkSession.createDataFrame([(i, names[k]) for i, k in enumerate(lookup_table(shards, size))], "slot int, shard string")
    row = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])))
    # The slot is known before columns of the outputs' names go: they may be keys.
    keyed = with_columns(rows, slot=slot_of([F.col(f"`{k}`") for k in keys], row, size, spread)).drop("shard")
    return keyed.join(F.broadcast(table), "slot").select(*[F.col(f"`{c}`") for c in keyed.columns], "shard")


def write(placed: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """Placed rows as Parquet in a folder for each shard."""
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(files_per_shard))
    placed.repartition("shard", spread).write.partitionBy("shard").parquet(path)
