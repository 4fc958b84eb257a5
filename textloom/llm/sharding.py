"""Sharding by a permutation-filled lookup table.

Shards take turns: each claims the next free slot in its own order of preference (an offset and a step from its name) until a
table of prime size is full, so slots are shared evenly to within one turn and few move when a shard comes or goes. The table
has SLOTS rows whatever the data, which bounds what is broadcast; a document's slot is a hash of its id.

Defined cases: a null doc_id has a slot of its own (that of the word null). Equal ids share a shard; ties can't arise. An empty table gives no
rows. Text may be null (n_chars null). Extra columns pass through ``assign`` untouched; columns named slot and shard are those of an
earlier assignment and are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SLOTS = 2039
SHARDS = tuple(f"shard-{i:02d}" for i in range(16))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:12], 16)


def lookup(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[int]:
    """The shard's number of each slot; ``slots`` is a prime and at least the number of shards."""
    if slots < len(shards) or slots < 3 or any(slots % i == 0 for i in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime no smaller than the number of shards")
    at = [_number("offset " + s) % slots for s in shards]
    step = [_number("step " + s) % (slots - 1) + 1 for s in shards]
    taken, left = [-1] * slots, slots
    while left:
        for i in range(len(shards)):
            while taken[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            taken[at[i]] = i
            left -= 1
            if not left:
                break
    return taken


def assign(docs: DataFrame, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Adds slot and shard."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    slot = F.pmod(F.conv(F.substring(key, 1, 12), 16, 10).cast("long"), F.lit(slots))
    rows = docs.sparkSession.createDataFrame([(i, shards[s]) for i, s in enumerate(lookup(shards, slots))], "slot long, shard string")
    own = docs.drop("slot", "shard").withColumn("slot", slot)
    return own.join(F.broadcast(rows), "slot").select(*[c for c in docs.columns if c not in ("slot", "shard")], "slot", "shard")


def write_shards(docs: DataFrame, path: str, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> None:
    """Writes Parquet with a folder for each shard."""
    assign(docs, shards, slots).drop("slot").write.partitionBy("shard").parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n_chars"))
    return assign(docs)


ORACLE = f"""
WITH d AS (SELECT doc_id, length(text)::BIGINT AS n_chars, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT % {SLOTS} AS slot FROM documents)
SELECT doc_id, n_chars, slot::BIGINT AS slot, 'shard-' || lpad(({lookup()})[slot + 1]::VARCHAR, 2, '0') AS shard FROM d
"""
