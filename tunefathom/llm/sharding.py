"""Sharding by a permutation-filled lookup table.

Every shard orders all slots of a table of prime size by a permutation of its own (a start and a step from a hash of
its name). The shards take turns, each claiming the first slot of its order that is still free, until the table is
full: slots per shard differ by one at most, and another set of shards moves few slots. A row's slot is a hash of its
key; the table has a fixed size, so it is broadcast and placing a row is one probe whatever the corpus.

Defined results: a null key goes to the slot of its own hash like any other; equal keys share a shard; other columns
stay, and ``slot`` and ``shard`` replace input columns of that name; an empty input gives an empty result. At least
one shard and a prime table no smaller than the number of shards are required.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A prime; with 64 shards each holds 127 or 128 slots.
TABLE_SIZE = 8_191
SHARDS = [f"shard-{i:03d}" for i in range(64)]
_HEX = 15  # leading hexadecimal digits of an MD5 used as a number


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:_HEX], 16)


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> np.ndarray:
    """The number of the shard that owns each slot."""
    if not shards or len(set(shards)) < len(shards) or size < len(shards) or size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("distinct shards and a prime table size of at least their number are needed")
    start = [_number("start " + s) % size for s in shards]
    step = [1 + _number("step " + s) % (size - 1) for s in shards]
    owner = np.full(size, -1, dtype=np.int32)
    place = list(start)
    for turn in range(size):
        shard = turn % len(shards)
        slot = place[shard]
        while owner[slot] >= 0:
            slot = (slot + step[shard]) % size
        owner[slot], place[shard] = shard, (slot + step[shard]) % size
    return owner


def slot(key: Column, size: int = TABLE_SIZE) -> Column:
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, _HEX)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(size))


def table_frame(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    owners = lookup_table(shards, size).tolist()
    return spark.createDataFrame([(i, shards[o]) for i, o in enumerate(owners)], "slot long, shard string")


def assign_shards(rows: DataFrame, key: str, shards: list[str] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """Adds ``slot`` and ``shard``. Map-only: the table's ``size`` rows are broadcast."""
    placed = rows.drop("shard").withColumn("slot", slot(F.col(key), size))
    return placed.join(F.broadcast(table_frame(rows.sparkSession, shards, size)), "slot").select(*placed.columns, "shard")


def write_shards(rows: DataFrame, key: str, path: str, shards: list[str] = SHARDS, size: int = TABLE_SIZE, files_per_shard: int = 1) -> None:
    """Write one Parquet folder per shard; ``files_per_shard`` tasks share a shard, rows dealt to them by slot."""
    placed = assign_shards(rows, key, shards, size)
    part = F.pmod(F.col("slot"), F.lit(files_per_shard))
    placed.repartition(len(shards) * files_per_shard, "shard", part).write.partitionBy("shard").parquet(path)


def sql(shards: list[str] = SHARDS, size: int = TABLE_SIZE) -> str:
    """The same placement of ``documents`` in DuckDB's SQL.

    The turns are a recursive query with one bit per claimed slot.
    """
    names = ", ".join(f"({i}, '{s}')" for i, s in enumerate(shards))
    digits = f"CAST('0x' || substr(md5({{}}), 1, {_HEX}) AS BIGINT)"
    start, step = digits.format("'start ' || name"), digits.format("'step ' || name")
    return f"""
WITH RECURSIVE shards(id, name) AS (VALUES {names}),
orders AS MATERIALIZED (SELECT id, list((({start} % {size}) + j * (1 + {step} % {size - 1})) % {size} ORDER BY j) AS p FROM shards, range({size}) AS r(j) GROUP BY id),
turns AS (
  SELECT 0 AS turn, CAST(repeat('0', {size}) AS BIT) AS claimed, CAST(-1 AS BIGINT) AS slot
  UNION ALL
  SELECT turn + 1, set_bit(claimed, CAST(s AS INTEGER), 1), s FROM (
    SELECT turn, claimed, list_extract(list_filter(p, lambda x: get_bit(claimed, CAST(x AS INTEGER)) = 0), 1) AS s
    FROM turns JOIN orders ON id = turn % {len(shards)} WHERE turn < {size})),
owners AS (SELECT slot, name AS shard FROM turns JOIN shards ON (turn - 1) % {len(shards)} = id WHERE turn > 0)
SELECT d.doc_id, d.slot, shard FROM (SELECT doc_id, {digits.format("CAST(doc_id AS VARCHAR)")} % {size} AS slot FROM documents) d JOIN owners USING (slot)"""
