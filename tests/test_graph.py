"""Groups from pairs, and records that people merged."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_operators import CONTRACT
from tributary.operators import graph, review


def groups_of(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return sorted((x, find(x)) for x in parent)


@pytest.mark.parametrize("pairs", [
    [], [(5, 5)], [(i, i + 1) for i in range(200)], [(0, i) for i in range(100)], [(None, 3), (3, None)],
    random.Random(1).sample([(i, j) for i in range(90) for j in range(i)], 70)], ids=["none", "loop", "chain", "star", "null", "random"])
def test_connected_groups(spark, pairs):
    df = spark.createDataFrame(pairs, "a long, b long")
    assert sorted(tuple(r) for r in graph.connected(df, "a", "b").collect()) == groups_of(pairs)


def records(spark, rows):
    """(key, email, phone, salary) as records, each value from the source named like its key."""
    made = spark.createDataFrame([("r", k, e, p, s, "ready" if k != "c" else "quarantined") for k, e, p, s in rows],
                                 "run_id string, canonical_key string, email string, phone string, salary string, status string")
    for n in CONTRACT.names:
        if n not in made.columns:
            made = made.withColumn(n, F.lit(None).cast("string"))
    filled = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), F.when(F.col(n) != "", F.col("canonical_key")).alias("value")) for n in CONTRACT.names]), lambda e: e["value"].isNotNull())
    return made.withColumns({"provenance": F.map_from_entries(filled), "row_count": F.lit(2).cast("long"), "errors": F.array(F.lit("x"))})


def items(spark, members, said):
    """Near-duplicate items (group, key) and what was said on each group."""
    found = spark.createDataFrame([("r", "NEAR_DUPLICATE_RECORD", g, k, "{}", None, 0) for g, k in members],
                                  "run_id string, type string, group_key string, affected_id string, context string, proposal string, seq long")
    answers = spark.createDataFrame([("r", g, a, None, v, True) for g, a, v in said], "run_id string, group_key string, action string, field string, value string, remember boolean")
    return review.resolve(review.items(found), answers.withColumn("resolved_at", F.to_timestamp(F.lit("2024-01-01")))), review.members(found)


def test_overlapping_merges_make_one_record_with_all_values(spark):
    rows = [("a", None, None, "1"), ("b", "b@x", None, "2"), ("c", "c@x", "9", None), ("d", "d@x", None, None), ("e", "e@x", None, None), ("f", "f@x", "", None)]
    resolved, members = items(spark, [("g1", "a"), ("g1", "b"), ("g2", "id:b"), ("g2", "c"), ("g3", "d"), ("g3", "e"), ("g4", "f"), ("g4", "d")],
                              [("g1", "correct", "merge"), ("g2", "correct", "merge"), ("g3", "correct", "separate"), ("g4", "reject", "merge")])
    out = {r.canonical_key: r for r in review.apply_resolutions(records(spark, rows), resolved, members, CONTRACT).collect()}
    assert set(out) == {"a", "d", "e", "f"}
    a = out["a"]
    assert (a.email, a.phone, a.salary, a.status, a.row_count) == ("b@x", "9", "1", "ready", 6)
    assert a.provenance == {"email": "b", "phone": "c", "salary": "a"} and out["f"].status == out["d"].status == "rejected"
    log = review.merged_by_people(review.merge_groups(resolved, members))
    assert sorted((r.canonical_key, r.merged_key) for r in log.collect()) == [("a", "b"), ("a", "c")]


def test_corrected_values_say_so_and_move_with_a_merge(spark):
    rows = [("a", None, None, None), ("b", "old@x", None, None)]
    found = spark.createDataFrame([("r", "SENSITIVE_FIELD_CONFLICT", "s", "b", '{"field":"email"}', '{"canonical_value":"new@x"}', 0), ("r", "NEAR_DUPLICATE_RECORD", "g", "a", "{}", None, 0),
                                   ("r", "NEAR_DUPLICATE_RECORD", "g", "b", "{}", None, 0)],
                                  "run_id string, type string, group_key string, affected_id string, context string, proposal string, seq long")
    said = spark.createDataFrame([("r", "s", "approve", None, None, True), ("r", "g", "correct", None, "merge", True)],
                                 "run_id string, group_key string, action string, field string, value string, remember boolean").withColumn("resolved_at", F.to_timestamp(F.lit("2024-01-01")))
    made = review.apply_resolutions(records(spark, rows), review.resolve(review.items(found), said), review.members(found), CONTRACT).collect()
    assert [(r.canonical_key, r.email, r.provenance) for r in made] == [("a", "new@x", {"email": "review"})]


def test_merging_nothing(spark):
    resolved, members = items(spark, [("g1", "a"), ("g1", "zz")], [("g1", "correct", "merge")])
    out = review.apply_resolutions(records(spark, [("a", "a@x", None, None), ("b", "b@x", None, None)]), resolved, members, CONTRACT)
    assert sorted(r.canonical_key for r in out.collect()) == ["a", "b"]  # the other one is not among the records
