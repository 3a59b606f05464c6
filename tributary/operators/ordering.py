"""Numbering rows of a whole table without putting the table into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tributary.session import materialize

CHUNK, POS, ROW = "_chunk", "_pos", "_row"


def number_rows(df: DataFrame, order_by: list[str | Column]) -> DataFrame:
    """Adds ``_row`` (0, 1, 2, ... in the given order), ``_chunk`` and ``_pos``.

    The rows are range-sorted and written once with their chunk and position
    as data, so every later reader sees the same numbers. Only one count per
    chunk is brought together to make the offsets, and there are no more
    chunks than shuffle partitions. ``order_by`` should be unique: equal keys
    cannot be spread over chunks.
    """
    in_order = df.orderBy(*order_by)
    placed = in_order.withColumn(CHUNK, F.spark_partition_id()).withColumn(
        POS, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    stored = materialize(placed, "ordered")
    sizes = stored.groupBy(CHUNK).agg(F.count(F.lit(1)).alias("_size"))
    offsets = carry_in(sizes, F.sum("_size"), "_offset", 0).select(CHUNK, "_offset")
    return (stored.join(F.broadcast(offsets), CHUNK)
            .withColumn(ROW, F.col("_offset") + F.col(POS)).drop("_offset"))


def carry_in(chunks: DataFrame, running: Column, name: str, default, *within: str) -> DataFrame:
    """A running aggregate over all earlier chunks (of one group ``within``), on a table of one row per chunk."""
    earlier = Window.partitionBy(*within).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn(name, F.coalesce(running.over(earlier), F.lit(default)))
