"""Digests of a ledger by ranges of ids, so that two snapshots are compared without reading both.

A leaf digests the events of LEAF consecutive ids of a run, each level above
digests FAN of the ranges below. Digests add up, so those of new events are
made alone and added to what is kept. Two trees are compared from the root
down, and only ranges that differ are looked into; only their events are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tributary.session import materialize

LEAF, FAN, LEVELS = 1024, 64, 6  # a root stands for 1024 * 64 ** 5 ids, a trillion

#: What is kept of a range: how many events, and two order-free sums of their hashes, so that equal changes do not cancel.
_SUMS = {"n": F.sum, "folded": F.bit_xor, "summed": F.sum}


def _content(columns: list[str]) -> Column:
    return F.xxhash64(F.to_json(F.struct(*sorted(columns))))


def leaves(events: DataFrame) -> DataFrame:
    """(run_id, range, n, folded, summed) of all leaf ranges that have events; combined in each task first."""
    h = _content(events.columns)
    rows = events.select("run_id", F.floor(F.col("id") / LEAF).alias("range"), F.lit(1).cast("long").alias("n"), h.alias("folded"),
                         F.pmod(F.xxhash64(h, F.lit("second")), F.lit(1 << 31)).alias("summed"))
    return added(rows)


def added(parts: DataFrame) -> DataFrame:
    """Digests of one set of events that were made in parts."""
    return parts.groupBy("run_id", "range").agg(*[how(c).alias(c) for c, how in _SUMS.items()])


def tree(leaf_rows: DataFrame) -> DataFrame:
    """(level, run_id, range, n, folded, summed), as a written table; level 0 are the leaves."""
    out, level = leaf_rows.withColumn("level", F.lit(0)), leaf_rows
    for k in range(1, LEVELS):
        level = added(level.withColumn("range", F.floor(F.col("range") / FAN)))
        out = out.unionByName(level.withColumn("level", F.lit(k)))
    return materialize(out, "digests")


def differing(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """(run_id, range) of the leaf ranges of ``earlier`` that ``later`` has otherwise or not at all.

    Two tables of ``tree`` are compared. A level takes part only below ranges that differ.
    """
    key, sums = ["run_id", "range"], list(_SUMS)
    suspects = None
    for level in reversed(range(LEVELS)):
        ours, theirs = (t.filter(F.col("level") == level).select(*key, *sums) for t in (earlier, later))
        if suspects is not None:
            above = suspects.withColumnRenamed("range", "above")
            ours, theirs = (t.withColumn("above", F.floor(F.col("range") / FAN)).join(above, ["run_id", "above"], "left_semi").drop("above") for t in (ours, theirs))
        same = F.lit(True)
        for c in sums:
            same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        met = ours.alias("a").join(theirs.alias("b"), (F.col("a.run_id") == F.col("b.run_id")) & (F.col("a.range") == F.col("b.range")), "left")
        suspects = materialize(met.filter(~same).select("a.run_id", "a.range"), "suspects")
        if level and suspects.isEmpty():
            break
    return suspects


def lost_events(earlier: DataFrame, later: DataFrame, earlier_tree: DataFrame, later_tree: DataFrame) -> DataFrame:
    """(run_id, id) of the events of ``earlier`` that ``later`` lacks or changed; only events of differing ranges are compared."""
    ranges = differing(earlier_tree, later_tree)

    def suspect(events: DataFrame) -> DataFrame:
        inside = events.withColumn("range", F.floor(F.col("id") / LEAF)).join(ranges, ["run_id", "range"], "left_semi")
        return inside.select("run_id", "id", _content(earlier.columns).alias("_content"))

    return suspect(earlier).join(suspect(later.select(earlier.columns)), ["run_id", "id", "_content"], "left_anti").select("run_id", "id")
