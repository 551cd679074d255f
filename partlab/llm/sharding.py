"""Shard placement by a permutation-filled lookup table.

Every shard has a permutation of the slots of a prime-sized table (an offset and a step from
its name's hash). Shards take turns; each claims the next slot in its order that is free,
until the table is full. A key's slot is its hash modulo the table size, so placing a row is
one look-up in a table of fixed size, and adding or removing a shard moves few keys.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The table is broadcast; this bounds it.
MOST_SLOTS = 1 << 20


def _hash(text: str, part: int) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[8 * part : 8 * part + 8], 16)


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int) -> list[int]:
    """The owner (index into ``shards``) of each slot. Slots per shard differ by one at most."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct, and one at least")
    if not _prime(size) or size < len(shards) or size > MOST_SLOTS:
        raise ValueError(f"the table size must be a prime from {len(shards)} to {MOST_SLOTS}")
    offset = [_hash(s, 0) % size for s in shards]
    step = [_hash(s, 1) % (size - 1) + 1 for s in shards]
    at = [0] * len(shards)
    owner = [-1] * size
    for turn in range(size):
        s = turn % len(shards)
        while owner[slot := (offset[s] + at[s] * step[s]) % size] >= 0:
            at[s] += 1
        owner[slot] = s
        at[s] += 1
    return owner


def slot_of(key: Column, size: int) -> Column:
    """Slot of a key: the first 32 bits of the MD5 of its text, modulo the table size. A null
    key counts as the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % size).cast("int")


def place(df: DataFrame, key: Column, shards: list[str], size: int) -> DataFrame:
    """``df`` with ``slot`` (INT) and ``shard`` (STRING), which replace columns of these names.

    One row for each row of ``df``, without a shuffle: the table of ``size`` rows, which
    ``MOST_SLOTS`` bounds, is broadcast.
    """
    spark: SparkSession = df.sparkSession
    owner = lookup_table(shards, size)
    slots = spark.createDataFrame([(i, shards[s]) for i, s in enumerate(owner)], "slot int, shard string")
    keep = [F.col(f"`{c}`") for c in df.columns if c not in ("slot", "shard")]
    return df.select(*keep, slot_of(key, size).alias("slot")).join(F.broadcast(slots), "slot").select(*keep, "slot", "shard")


def write_shards(df: DataFrame, key: Column, shards: list[str], size: int, path: str, files_each: int = 1) -> None:
    """Write one folder ``shard=<name>`` for each shard that has rows.

    Rows of a shard are dealt over ``files_each`` tasks by a hash of the whole row, so that a
    hot key doesn't end in a single task.
    """
    placed = place(df, key, shards, size)
    deal = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(files_each))
    placed.repartition(max(1, len(shards) * files_each), F.col("shard"), deal).write.partitionBy("shard").parquet(path)


def oracle(shards: list[str], size: int, table: str, key: str) -> str:
    """DuckDB SQL for :func:`place` that fills the table by itself."""
    names = ", ".join(f"({i}, '{s}')" for i, s in enumerate(shards))
    n = len(shards)
    return f"""
    WITH RECURSIVE shard(i, name) AS (VALUES {names}),
    pref AS (SELECT list(('0x' || substr(md5(name), 1, 8))::BIGINT % {size} ORDER BY i) AS off,
                    list(('0x' || substr(md5(name), 9, 8))::BIGINT % {size - 1} + 1 ORDER BY i) AS step FROM shard),
    fill(turn, owner, nxt) AS (
        SELECT 0, list_transform(range({size}), lambda x: -1), list_transform(range({n}), lambda x: 0) FROM pref
        UNION ALL
        SELECT turn + 1,
               owner[1:slot] || [turn % {n}] || owner[slot + 2:{size}],
               nxt[1:turn % {n}] || [(j + 1)::INTEGER] || nxt[turn % {n} + 2:{n}]
        FROM (SELECT *, (off[turn % {n} + 1] + j * step[turn % {n} + 1]) % {size} AS slot
              FROM (SELECT f.*, p.off, p.step,
                           list_filter(range(nxt[turn % {n} + 1], {size}),
                                       lambda x: owner[(off[turn % {n} + 1] + x * step[turn % {n} + 1]) % {size} + 1] = -1)[1] AS j
                    FROM fill f, pref p WHERE turn < {size}))),
    slots AS (SELECT unnest(range({size})) AS slot, unnest(owner) AS i FROM fill WHERE turn = {size})
    SELECT d.{key}, d.slot::INTEGER AS slot, shard.name AS shard
    FROM (SELECT {key}, ('0x' || substr(md5(coalesce({key}::VARCHAR, '')), 1, 8))::BIGINT % {size} AS slot FROM {table}) d
    JOIN slots ON slots.slot = d.slot JOIN shard ON shard.i = slots.i
    """
