"""The store of delivered records: what a batch reads, what a retry leaves, what is put together."""

import random

import pytest
from pyspark.sql import functions as F

from tributary.operators.delivery import accept
from tributary.operators.keyed_store import KeyedStore
from tributary.session import scratch_path
from tributary.streaming import tail

SCHEMA = "employee_id string, idempotency_key string, payload string"


@pytest.fixture
def store(spark):
    return KeyedStore(spark, scratch_path(spark, "store"), "employee_id", SCHEMA, parts=8, slots=3).open()


def rows(spark, ids):
    return spark.createDataFrame([(i, f"k{i}", "p") for i in ids], SCHEMA)


def test_a_batch_reads_only_the_parts_of_its_ids(spark, store):
    store.append(rows(spark, [f"E{i}" for i in range(200)]), 0)
    asked = rows(spark, ["E5", "E5", None])
    parts = store.touched(asked)
    assert len(parts) == 1
    files = store.read(parts, before=1).inputFiles()
    assert len(files) == 1 and all(f"part={parts[0]}/" in f for f in files)
    found = store.read(parts, before=1)
    assert found.filter("employee_id = 'E5'").count() == 1 and 0 < found.count() < 60
    assert len(store.all().inputFiles()) == 8 and store.all().count() == 200
    assert store.read([], before=1).count() == 0 and store.read(parts, before=0).count() == 0


def test_a_batch_that_is_run_again_replaces_itself(spark, store):
    store.append(rows(spark, ["E1", "E2"]), 0)
    store.append(rows(spark, ["E3", "E4", "E5"]), 1)
    store.append(rows(spark, ["E3", "E4", "E5"]), 1)
    assert sorted(r.employee_id for r in store.all().collect()) == ["E1", "E2", "E3", "E4", "E5"]
    assert sorted(r.employee_id for r in store.read(list(range(8)), before=1).collect()) == ["E1", "E2"]


def test_parts_are_written_out_whole_after_some_slots(spark, store):
    for n in range(10):
        store.append(rows(spark, [f"E{n}_{i}" for i in range(40)]), n)
        if n % 4 == 3:
            store.append(rows(spark, [f"E{n}_{i}" for i in range(40)]), n)  # a retry, also of a batch that wrote whole parts
            assert store.vacuum(before=n + 1) >= (0 if n < 4 else 8)
    assert store.all().count() == store.all().distinct().count() == 400
    assert max(map(len, store.live(list(range(8)), 10).values())) <= 4
    assert any("whole-" in s for slots in store.live(list(range(8)), 10).values() for s in slots)


def test_the_number_of_parts_stays(spark, store):
    store.append(rows(spark, ["E1"]), 0)
    again = KeyedStore(spark, store.path, "employee_id", SCHEMA, parts=99).open()
    assert again.parts == 8 and again.all().count() == 1


def test_many_batches_answer_as_one(spark):
    """Requests in files, answered file by file, one of them twice, against the acceptance of all of them at once."""
    rng = random.Random(4)
    schema = "request_seq long, employee_id string, idempotency_key string, payload string"
    made = [(n, rng.choice([None, *(f"E{i}" for i in range(30))]), f"k{rng.randrange(3)}", "p") for n in range(120)]
    base = scratch_path(spark, "delivery")
    for i in range(0, 120, 20):
        spark.createDataFrame(made[i:i + 20], schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        tail.deliver(spark.readStream.schema(schema).parquet(f"{base}/in"), f"{base}/store", f"{base}/answers", f"{base}/progress", parts=4).awaitTermination()
    answers = lambda df: sorted((r.request_seq, r.outcome, r.http_status) for r in df.collect())
    got = spark.read.parquet(f"{base}/answers")
    assert answers(got) == answers(accept(spark.createDataFrame(made, schema)))
    held = tail.delivered_store(spark, f"{base}/store").all()
    assert held.count() == got.filter(F.col("outcome") == "created").count() == held.select("employee_id").distinct().count()


def test_a_large_part_is_written_by_several_tasks(spark, store):
    one = KeyedStore(spark, scratch_path(spark, "store"), "employee_id", SCHEMA, parts=1).open()
    many = spark.range(60_000).selectExpr("concat('E', id) AS employee_id", "sha2(string(id), 256) AS idempotency_key", "'p' AS payload")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        written = one.append(many, 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(one.all().inputFiles()) > 2
    assert sorted(one.all().collect()) == sorted(many.collect()) == sorted(written.drop("part").collect())
