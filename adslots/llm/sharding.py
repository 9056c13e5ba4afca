"""Sharding by rendezvous (highest random weight) hashing.

Every record key scores each shard with ``-weight / ln(u)``, ``u`` a uniform number fixed by key and shard,
and goes to the best one. A key's scores for the old shards don't change when a shard is added, so a record
either stays or moves to the new shard; a shard of twice the weight gets twice the keys.

Defined cases: a null key is hashed like any value (all null keys share a shard); repeated keys share a shard
and get slots of their own; equal rows are counted first and written out at the end, so that no task holds all of
them; a null text has size 1 and a null checksum; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, spread, unit_interval

#: Rows numbered by one window group; shards are cut into as many hash blocks as this needs.
BLOCK_ROWS = 1024


def rendezvous(key: Column | Sequence[Column], weights: Sequence[float]) -> Column:
    """The shard, 0 to len(weights)-1, that `key` goes to."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive and not empty")
    keys = [key] if isinstance(key, Column) else list(key)
    scores = [F.struct((F.lit(-float(w)) / F.log(unit_interval(*keys, F.lit(s)))).alias("score"), F.lit(s).alias("shard")) for s, w in enumerate(weights)]
    return (F.greatest(*scores) if len(scores) > 1 else scores[0])["shard"]


def gapless_slots(groups: DataFrame, shard: str, order: Sequence[str], n_rows: int, n_shards: int, slot: str = "slot", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """groups(shard, order..., n, ...), each of n equal rows, written out with the rows of each shard numbered
    0, 1, 2, ... without one task per shard: a shard is cut into hash blocks, groups are numbered inside a block,
    and a block starts where the blocks before it end. No block grows with the repeats of a row."""
    blocks = max(1, -(-n_rows // (n_shards * block_rows)))
    dealt = groups.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    starts = (
        dealt.groupBy(shard, "_block").agg(F.sum("n").alias("_size"))
        .select(shard, "_block", (F.sum("_size").over(W.partitionBy(shard).orderBy("_block")) - F.col("_size")).alias("_start"))
    )
    inside = dealt.withColumn("_at", F.sum("n").over(W.partitionBy(shard, "_block").orderBy(*order)) - F.col("n"))
    placed = inside.join(starts, [shard, "_block"])
    return spread(placed, *order).withColumn(slot, F.col("_start") + F.col("_at") + F.col("_row")).drop("n", "_block", "_start", "_at", "_row")


def shard_documents(docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, grown_weight: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, grown_shard (with one more shard) for every document."""
    key = F.col("doc_id")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    groups = cut(docs.select("doc_id", size.alias("size"), F.crc32(F.col("text")).alias("text_crc32")).groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n")))
    n_rows = groups.agg(F.sum("n")).first()[0] or 0
    placed = groups.select("doc_id", "size", "text_crc32", "n", rendezvous(key, list(weights)).alias("shard"), rendezvous(key, [*weights, grown_weight]).alias("grown_shard"))
    return gapless_slots(placed, "shard", ["doc_id", "text_crc32", "size"], n_rows, len(weights))
