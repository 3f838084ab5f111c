"""Sharding by a permutation-filled lookup table.

Every shard has a preference order of the slots of a table of prime size: an offset and a step, both
from its name. Shards take turns; each claims the first free slot of its order, until all slots are
taken. So shards get equal shares to within one slot, and few slots change hands when a shard comes
or goes. The table is broadcast (its size is a parameter) and a document's slot is a hash of its key.
"""

from __future__ import annotations

import functools
import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS, SHARDS = 10_007, 64


@functools.lru_cache(8)
def table(names: tuple[str, ...], slots: int = SLOTS) -> tuple[int, ...]:
    """The shard of each slot, as an index into names. slots: a prime, no fewer than the names."""
    if slots < len(names) or not names or len(set(names)) < len(names):
        raise ValueError("names must be distinct, at least one, and no more than the slots")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the table's size must be a prime")

    def number(name, salt):
        return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)

    place = [number(n, "offset") % slots for n in names]
    step = [number(n, "step") % (slots - 1) + 1 for n in names]
    owner, left = [-1] * slots, slots
    while left:
        for i in range(len(names)):
            while owner[place[i]] >= 0:
                place[i] = (place[i] + step[i]) % slots
            owner[place[i]] = i
            left -= 1
            if not left:
                break
    return tuple(owner)


def slot(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 60 bits of its string's MD5, modulo the table's size; null counts as ''."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def placed(docs: DataFrame, key: str = "doc_id", names: tuple[str, ...] | None = None, slots: int = SLOTS) -> DataFrame:
    """docs with columns slot and shard (a name) added, in place of any of these names.

    Rows of equal keys share a shard; null keys share the slot of the empty string.
    """
    names = names or tuple(f"shard-{i:04d}" for i in range(SHARDS))
    owners = ",".join(names[i] for i in table(names, slots))
    if any("," in n for n in names):
        raise ValueError("names must not hold commas")
    lookup = docs.sparkSession.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("__slot", "shard"))
    out = docs.drop("slot", "shard") if {"slot", "shard"} & set(docs.columns) else docs
    return out.withColumn("__slot", slot(F.col(key), slots)).join(F.broadcast(lookup), "__slot").withColumnRenamed("__slot", "slot").select(*out.columns, "slot", "shard")


def write(docs: DataFrame, path: str, key: str = "doc_id", names: tuple[str, ...] | None = None, slots: int = SLOTS) -> None:
    """Write docs as Parquet, a folder for each shard; a shard's rows may come from several tasks."""
    placed(docs, key, names, slots).repartition("shard", F.pmod(F.col("slot"), F.lit(8))).write.partitionBy("shard").parquet(path)


def op9(docs: DataFrame) -> DataFrame:
    """The slot and shard of every row's doc_id; null keys share the slot of the empty string, repeated keys a shard."""
    return placed(docs.select("doc_id"))


def oracle(slots: int = SLOTS, shards: int = SHARDS) -> str:
    """DuckDB SQL for op9. It fills the table by itself: in turn, each shard takes the first slot of its order that is free."""
    number = "CAST('0x' || substr(md5('{}:' || name), 1, 15) AS BIGINT)"
    return f"""
WITH RECURSIVE names AS (SELECT i, 'shard-' || lpad(CAST(i AS VARCHAR), 4, '0') AS name FROM range({shards}) r(i)),
pref AS (SELECT i, name, {number.format('offset')} % {slots} AS first, {number.format('step')} % {slots - 1} + 1 AS step FROM names),
fill AS (
  SELECT CAST(0 AS BIGINT) AS turn, first AS slot, set_bit(CAST(repeat('0', {slots}) AS BIT), CAST(first AS INTEGER), 1) AS taken FROM pref WHERE i = 0
  UNION ALL
  SELECT turn, slot, set_bit(taken, CAST(slot AS INTEGER), 1) FROM (
    SELECT turn + 1 AS turn, arg_min((first + k * step) % {slots}, k) AS slot, taken FROM fill JOIN pref ON i = (turn + 1) % {shards}, range({slots}) r(k)
    WHERE turn + 1 < {slots} AND get_bit(taken, CAST((first + k * step) % {slots} AS INTEGER)) = 0 GROUP BY turn, taken)
),
owner AS (SELECT slot, name FROM fill JOIN pref ON i = turn % {shards}),
placed AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {slots} AS slot FROM documents)
SELECT doc_id, CAST(slot AS INTEGER) AS slot, name AS shard FROM placed JOIN owner USING (slot)
"""
