"""Balanced contiguous shards from a global prefix sum of sizes. DataFrame operations only.

Rows are put in order by range partitions, kept in the shared folder (so that the partition of a row is a
fact, not something that a lost executor may decide anew), and totalled by partition. A prefix sum over
those totals - one row for each partition - gives every partition its place in the whole; running sums
inside the partitions do the rest. The total is cut at equal targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, partitions


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text, 0 for null, and 1 for its end."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def byte_shards(rows: DataFrame, n_shards: int, size: str = "size", order: tuple[str, ...] = ("doc_id",), n_partitions: int | None = None) -> DataFrame:
    """rows and their shard (int, 0 to n_shards - 1) and slot (long, gapless from 0 in each shard).

    Shards follow `order` and are contiguous in it. A row goes to the shard in whose stretch of the total its
    middle lies, so each shard's bytes differ from an equal share by less than one row's size at either end.
    Nulls in `order` come first; rows that are equal in it keep some order among them, each with its own slot.
    No rows give no rows; with fewer rows than shards, or a row larger than a share, some shards stay empty.
    Null sizes count 0. All columns of rows stay, but those named shard or slot, which the result's own replace.
    """
    n = n_partitions or partitions(rows.sparkSession)
    stay = [F.col(f"`{c}`") for c in rows.columns if c not in ("shard", "slot")]
    # The rows travel as one column, so that no name of theirs meets one of these. The tie breaker also spreads a key that many rows have over partitions.
    packed = rows.select(F.struct(*stay).alias("row"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("s"), F.monotonically_increasing_id().alias("_tie"))
    sized = F.col("s")
    by = [*(F.col("row")[c] for c in order), F.col("_tie")]
    placed = kept(packed.repartitionByRange(n, *by).withColumn("_part", F.spark_partition_id()))
    totals = placed.groupBy("_part").agg(F.sum(sized).alias("b"), F.count("*").alias("r"))
    # One row for each partition, whatever the size of the data.
    over, before = Window.orderBy("_part"), Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in "br"), F.sum("b").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    inside = Window.partitionBy("_part").orderBy(*by)
    run = (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn("_begin", F.col("b_before") + F.sum(sized).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - sized)
        .withColumn("_row", F.col("r_before") + F.row_number().over(inside) - 1)
    )
    middle = (2 * F.col("_begin") + sized).cast("decimal(38,0)") * n_shards
    cut = F.least(F.lit(n_shards - 1), F.floor(middle / (2 * F.greatest(F.col("total"), F.lit(1))))).cast("int")
    run = run.withColumn("shard", cut)
    first = run.groupBy("shard").agg(F.min("_row").alias("_first"))  # n_shards rows
    return run.join(F.broadcast(first), "shard").select("row.*", "shard", (F.col("_row") - F.col("_first")).alias("slot"))
