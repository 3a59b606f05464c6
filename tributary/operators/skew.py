"""Joins that stay spread out when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tributary.session import materialize, shuffled

# A key is hot when it has more rows than one task should take. There are at
# most rows / HOT_ROWS hot keys, a millionth of the rows.
HOT_ROWS = 1_000_000
# Tables of up to this many short rows are sent to every task.
BROADCAST_ROWS = 100_000


def hot_keys(counts: DataFrame, on: list[str], n: str = "n", total: int | None = None) -> DataFrame | None:
    """(on..., _copies) for the hot keys of counts(on..., n), as a written table; None when no key is hot.

    With a known ``total`` of rows too small for any hot key nothing is run.
    """
    if total is not None and total <= HOT_ROWS:
        return None
    found = materialize(counts.filter(F.col(n) > HOT_ROWS).select(*on, F.ceil(F.col(n) / HOT_ROWS).cast("int").alias("_copies")), "hot_keys")
    return None if found.isEmpty() else found


def lookup(rows: DataFrame, table: DataFrame, on: str, spread_by: str | Column) -> DataFrame:
    """Left join of ``rows`` with a table that holds each key once.

    A table of checked size goes to every task. A larger one meets the rows by
    key: hot keys are dealt out, and rows without a key stay out of the join.
    """
    small = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if small:
        return rows.join(F.broadcast(table), on, "left")
    keyed, rest = rows.filter(F.col(on).isNotNull()), rows.filter(F.col(on).isNull())
    hot = hot_keys(count_keys(keyed, [on]), [on])
    return salted_join(keyed, table, [on], hot, spread_by, "left").unionByName(rest, allowMissingColumns=True)


def count_keys(rows: DataFrame, on: list[str]) -> DataFrame:
    """Rows per key; each task combines its own rows first."""
    return rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))


def salted_join(rows: DataFrame, table: DataFrame, on: list[str], hot: DataFrame | None, spread_by: str | Column,
                how: str = "inner") -> DataFrame:
    """Join in which the rows of each hot key go to as many tasks as they need.

    Rows of a hot key are dealt out by the hash of ``spread_by`` (so a retried
    task deals them the same way), and the matching ``table`` rows are copied
    to each of those tasks. ``rows`` may be kept (left, semi, anti); ``table``
    must not be the kept side.
    """
    if hot is None:
        return rows.join(shuffled(table), on, how)
    by = F.col(spread_by) if isinstance(spread_by, str) else spread_by
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn(
        "_salt", F.when(F.col("_copies").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.col("_copies")).cast("int"))).drop("_copies")
    copies = F.when(F.col("_copies").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_copies") - 1))
    copied = table.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(copies)).drop("_copies")
    return dealt.join(shuffled(copied), [*on, "_salt"], how).drop("_salt")
