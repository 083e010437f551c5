"""Contiguous shards of near equal bytes, in DataFrame operations alone.

Rows are dealt to ranges of ids and that dealing is written, so that it stands still. The totals of the ranges, summed
up in order, give each range the bytes and rows before it; a running sum within the range gives each row its place in
the whole order. Shards are cut at equal targets of that sum. Only one row a range, and one a shard, is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, parts, text_or_empty

#: Shards; bytes that a document takes besides its text.
SHARDS, OVERHEAD = 40, 16


def placed(rows: DataFrame, order: list[str], size: str) -> DataFrame:
    """The rows with ``place`` (from 0), ``before`` (sizes of the rows before) and ``total`` in the order of ``order``, nulls first.

    Equal keys are told apart by their place in the input, so that no key gathers in one range.
    """
    keys = [*order, "_salt"]
    ranged = rows.withColumn("_salt", F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange(parts(rows.sparkSession), *[F.col(c).asc_nulls_first() for c in keys])
    ranged = cut(ranged.withColumn("_range", F.spark_partition_id()))
    so_far = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias(f"{c}_before")
    totals = ranged.groupBy("_range").agg(F.sum(size).alias("_bytes"), F.count("*").alias("_rows"))
    totals = totals.select("_range", before("_bytes"), before("_rows"), F.sum("_bytes").over(Window.partitionBy()).alias("total"))
    own = Window.partitionBy("_range").orderBy(*[F.col(c).asc_nulls_first() for c in keys])
    sums = F.coalesce(F.sum(size).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = ranged.withColumn("place", F.row_number().over(own) - 1).withColumn("before", sums).join(F.broadcast(totals), "_range")
    out = out.withColumn("place", (F.col("place") + F.col("_rows_before")).cast("long")).withColumn("before", F.col("before") + F.col("_bytes_before"))
    return out.drop("_salt", "_range", "_bytes_before", "_rows_before")


def balanced(rows: DataFrame, order: list[str], size: str, shards: int = SHARDS) -> DataFrame:
    """The rows with ``shard`` and ``slot`` (place in the shard, from 0).

    A row belongs to the shard in which its middle byte lies, so a shard is off its target by one row's size at most.
    """
    shard = F.expr(f"least(((2 * before + `{size}`) * {shards}L) div (2 * total), {shards - 1}L)").cast("int")
    rows = placed(rows, order, size).withColumn("shard", shard)
    first = rows.groupBy("shard").agg(F.min("place").alias("_first"))
    return rows.join(F.broadcast(first), "shard").withColumn("slot", F.col("place") - F.col("_first")).drop("place", "before", "total", "_first")


def shard_rows(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each document.

    Shards are contiguous in (doc_id, size, checksum), null ids first; a shard's bytes differ from an equal part by the
    largest document at most. Null texts have size 16 and checksum 0; equal rows are documents of their own and may lie
    on both sides of a cut; a text of any length is one row, and only its length and checksum move; with fewer
    documents than shards some shards are empty; other columns aren't read; an empty table gives no rows.
    """
    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = balanced(rows, ["doc_id", "size", "text_crc32"], "size", shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
