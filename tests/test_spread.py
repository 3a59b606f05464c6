"""Tables that grow with the input stay off the driver."""

import pytest
from pyspark.sql import functions as F

from tributary.operators import graph, review, skew
from tributary.plans.resume import SavedRun
from tributary.session import materialize, scratch_path


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left", "left_anti", "left_semi"])
def test_small_files_are_not_broadcast(spark, how):
    rows = materialize(spark.range(50).withColumn("v", F.lit("x")))
    other = materialize(spark.range(20).withColumn("w", F.col("id") * 2))
    met = rows.join(other.filter("w > 4").groupBy("id").agg(F.max("w").alias("w")), "id", how)
    assert "BroadcastHashJoin" not in plan(met) and "SortMergeJoin" in plan(met)
    assert met.count() == {"inner": 17, "left": 50, "left_anti": 33, "left_semi": 17}[how]


def test_asked_broadcast_stays(spark):
    met = materialize(spark.range(50)).join(F.broadcast(materialize(spark.range(3))), "id")
    assert "BroadcastHashJoin" in plan(met) and met.count() == 3


def test_joined_rows_are_not_broadcast(spark):
    """The output of a join is no written table; what it meets is shuffled as well."""
    rows = spark.range(9).join(spark.range(5), "id")
    assert "BroadcastHashJoin" not in plan(skew.salted_join(spark.range(9), spark.range(5), ["id"], None, "id"))
    assert "SortMergeJoin" in plan(skew.salted_join(rows, rows.groupBy("id").count(), ["id"], None, "id"))
    items = spark.createDataFrame([("r", "g", "pending")], "run_id string, group_key string, status string")
    said = spark.createDataFrame([("r", "g", "reject")], "run_id string, group_key string, action string")
    assert "BroadcastHashJoin" not in plan(review.resolve(items, said))


def test_saved_tables_are_not_broadcast(spark):
    path = scratch_path(spark, "saved")
    spark.range(4).select(F.col("id").alias("seq"), F.lit("a").alias("v")).write.parquet(f"{path}/staged/step=0")
    spark.range(1).select(F.col("id").alias("seq"), F.lit("b").alias("v")).write.parquet(f"{path}/staged/step=1")
    table = SavedRun(spark, path).table("staged")
    met = table.join(spark.range(4).withColumnRenamed("id", "seq"), "seq")
    assert "BroadcastHashJoin" not in plan(met)
    assert sorted(tuple(r) for r in met.collect()) == [(0, "b"), (1, "a"), (2, "a"), (3, "a")]


def test_groups_of_pairs_as_before(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (5, 5)], "a long, b long")
    assert sorted(tuple(r) for r in graph.connected(pairs, "a", "b").collect()) == [(1, 1), (2, 1), (3, 1), (5, 5), (7, 7), (8, 7)]


def test_customers_of_a_small_file_are_dealt_out(spark, tmp_path):
    from tributary.sources import bridge

    spark.createDataFrame([(i, f"n{i}", i % 5, 1.5 * i, "BUILDING") for i in range(30)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string") \
        .coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    for name in bridge.EXPORTS:
        assert "hashpartitioning(c_custkey" in plan(bridge.export(spark, str(tmp_path), name))
    assert sorted(r["_row_num"] for r in bridge.export(spark, str(tmp_path), "src_a").collect()) == list(range(1, 31))


def test_each_date_text_is_read_once(spark):
    from tributary.operators import staging

    rows = [("3 Jan 2020", "13/01/2020", "01/02/2020", None)] * 3 + [("2020-01-03", "13/01/2020", "02/01/2020", None)] * 2 + [(None, "01/13/2020", "", None)]
    df = spark.createDataFrame(rows, "named string, both string, open string, empty string")
    found = staging.column_date_orders(df, "s", df.columns)
    assert "keys=[column" in plan(found) and "value" in plan(found)
    assert {r["column"]: r["date_order"] for r in found.collect()} == {"named": "DMonY", "both": "AMBIGUOUS", "open": "AMBIGUOUS", "empty": None}
    none = staging.column_date_orders(df.limit(0), "s", df.columns).collect()  # a row a column, also without rows
    assert [(r["column"], r["date_order"]) for r in none] == [(c, None) for c in df.columns]
