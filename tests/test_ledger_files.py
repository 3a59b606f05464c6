"""Ledger pages from few files, the tail from the current end, snapshots compared by digests, rows counted by bitmaps."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_operators import some_events
from tributary.operators import digests, ledger, review
from tributary.session import scratch_path
from tributary.streaming import tail


@pytest.fixture
def path(spark):
    path = scratch_path(spark, "ledger")
    ledger.append_clustered(some_events(spark, 400).unionByName(some_events(spark, 300, run="q", start=401)), path, events_per_file=50)
    ledger.append_clustered(some_events(spark, 100, start=701), path, events_per_file=50)
    return path


def test_pages_equal_the_scan_and_open_few_files(spark, path):
    whole = ledger.read_ledger(spark, path)
    assert ledger.files_of(spark, path).count() >= 16 and whole.count() == 800
    for run, after, limit in (("r", 0, 20), ("r", 195, 20), ("r", 390, 30), ("r", 780, 50), ("r", 800, 5), ("q", 0, 7), ("q", 650, 200), ("none", 0, 5), ("r", 0, 1000)):
        page = ledger.clustered_page(spark, path, run, after, limit)
        assert [r.id for r in page.collect()] == [r.id for r in ledger.tail_page(whole, run, after, limit).collect()], (run, after, limit)
        if limit <= 30:
            assert len(page.inputFiles()) <= 2 + limit // 25
    assert ledger.current_end(spark, path, "r") == 800 and ledger.current_end(spark, path, "none") == 0


def test_pages_over_loads_with_overlapping_ids(spark):
    """Ids of later loads lie between those of earlier ones; files have gaps."""
    rng = random.Random(2)
    path, ids = scratch_path(spark, "ledger"), list(range(1, 600))
    rng.shuffle(ids)
    for part in range(3):
        mine = spark.createDataFrame([(i,) for i in ids[part * 200:part * 200 + 200]], "k long")
        events = ledger.events(mine, run_id="r", stage="validate", type="AUTOFIX_APPLIED", actor="agent", entity_id=F.col("k"))
        ledger.append_clustered(events.select(F.col("entity_id").cast("long").alias("id"), "run_id", F.current_timestamp().alias("ts"), *[c for c in events.columns if c != "run_id"]), path, 40)
    for after, limit in ((0, 10), (77, 25), (590, 30), (300, 1)):
        assert [r.id for r in ledger.clustered_page(spark, path, "r", after, limit).collect()] == [i for i in range(1, 600) if i > after][:limit]


def test_a_tail_from_the_current_end_shows_what_comes_after(spark, path):
    out = scratch_path(spark, "tail")
    end = ledger.current_end(spark, path, "r")
    assert tail.drain(tail.follow(spark, path, "r"), out, out + "-progress").count() == 0
    ledger.append_clustered(some_events(spark, 5, start=801).unionByName(some_events(spark, 5, run="q", start=806)), path)
    got = tail.drain(tail.follow(spark, path, "r", from_id=end), out, out + "-progress")
    assert sorted(r.id for r in got.collect()) == [801, 802, 803, 804, 805]
    again = scratch_path(spark, "tail")
    assert sorted(r.id for r in tail.drain(tail.follow(spark, path, "q", from_id=690), again).collect()) == [*range(691, 701), *range(806, 811)]


def test_digests_name_what_was_lost_or_changed(spark, monkeypatch):
    monkeypatch.setattr(digests, "LEAF", 4)
    monkeypatch.setattr(digests, "FAN", 3)
    whole = some_events(spark, 500).unionByName(some_events(spark, 60, run="q", start=501))
    whole = spark.createDataFrame(whole.collect(), whole.schema)
    changed = whole.filter("id <> 77").withColumn("reason", F.when(F.col("id").isin(3, 520), "other").otherwise(F.col("reason")))
    later = changed.unionByName(some_events(spark, 40, start=561))
    trees = [digests.tree(digests.leaves(df)) for df in (whole, later)]
    assert sorted((r.run_id, r.id) for r in digests.lost_events(whole, later, *trees).collect()) == [("q", 520), ("r", 3), ("r", 77)]
    assert digests.differing(trees[0], trees[0]).isEmpty() and digests.lost_events(whole, whole, trees[0], trees[0]).isEmpty()
    # only the ranges of those events, and those that were not full yet, are looked into
    assert {(r.run_id, r["range"]) for r in digests.differing(*trees).collect()} == {("r", 0), ("r", 19), ("q", 130)}
    parts = digests.leaves(later.filter("id <= 300")).unionByName(digests.leaves(later.filter("id > 300")))
    assert digests.differing(digests.tree(digests.added(parts)), trees[1]).isEmpty()


def test_two_equal_events_do_not_cancel(spark):
    one = some_events(spark, 3)
    one = spark.createDataFrame(one.collect(), one.schema)
    twice = one.unionByName(one.filter("id = 2")).unionByName(one.filter("id = 2"))
    assert not digests.differing(digests.tree(digests.leaves(one)), digests.tree(digests.leaves(twice))).isEmpty()


def test_distinct_numbers_by_bitmaps(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.choice([0, 1, 32767, 32768, (1 << 44) + rng.randrange(100_000), rng.randrange(200)])) for _ in range(3000)]
    got = {r.g: r.n for r in review.distinct_numbers(spark.createDataFrame(rows, "g string, seq long"), "g", "seq", "n").collect()}
    assert got == {g: len({n for h, n in rows if h == g}) for g in "ab"}
