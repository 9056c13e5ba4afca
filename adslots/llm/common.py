"""Helpers shared by the operators: tables, stored cuts, sums and numbers over all rows, keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import cut, drop_cut, scratch, shared_dir

__all__ = ["cut", "drop_cut", "lower_ascii", "running", "scratch", "shared_dir", "spread", "table", "unit_interval"]

#: Fixed value: words are maximal runs of characters other than ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: Equal rows written out by one task at a time.
SPREAD_ROWS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(groups: DataFrame, *key: str) -> DataFrame:
    """groups(..., n) with n rows for each row, numbered `_row` 0 to n-1; a large n is written out by many tasks."""
    chunks = groups.withColumn("_chunk", F.explode(F.expr(f"sequence(0L, (n - 1) div {SPREAD_ROWS})"))).repartition(*key, "_chunk")
    rows = F.sequence(F.col("_chunk") * SPREAD_ROWS, F.least((F.col("_chunk") + 1) * SPREAD_ROWS, F.col("n")) - 1)
    return chunks.withColumn("_row", F.explode(rows)).drop("_chunk")


def running(df: DataFrame, order: Sequence[Column], **sums: Column) -> DataFrame:
    """`df` with `position`, its row number from 0, and the named sums over all rows before it, in `order` (total).

    Rows are ranged into partitions, numbered and summed in each, and shifted by the partitions before: only one row for
    each partition is ever in one place."""
    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = cut(df.repartitionByRange(int(parts), *order).withColumn("_part", F.spark_partition_id()))
    what = {"position": F.lit(1).cast("long"), **sums}
    totals = ranged.groupBy("_part").agg(*[F.sum(c).alias(k) for k, c in what.items()])
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # over as many rows as there are partitions
    zero = lambda c: F.coalesce(c, F.lit(0))
    starts = totals.select("_part", F.struct(*[zero(F.sum(k).over(before)).alias(k) for k in what]).alias("_start"))
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = ranged.select("*", *[zero(F.sum(c).over(inside)).alias(k) for k, c in what.items()])
    return placed.join(F.broadcast(starts), "_part").select(*df.columns, *[(F.col(k) + F.col("_start")[k]).alias(k) for k in what])


def unit_interval(*cols: Column) -> Column:
    """A uniform double in (0, 1) fixed by the columns' values."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
