"""Search through postings against the scan."""

import random

import pytest
from pyspark.sql import functions as F

from tributary.operators import reports
from tributary.operators.search_index import SearchIndex
from tributary.session import scratch_path

SCHEMA = "canonical_key string, first_name string, last_name string, email string, department string, status string"


def records(spark, n, seed=1):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abcdeéX ") for _ in range(rng.randrange(k)))
    return spark.createDataFrame([(f"E{i}", word(9), word(12), rng.choice([None, f"{word(5)}@x.com"]), rng.choice([None, "Sales", "", "HR"]), rng.choice(["pushed", "ready"])) for i in range(n)], SCHEMA)


@pytest.fixture(scope="module")
def loaded(spark):
    index = SearchIndex(spark, scratch_path(spark, "search"), parts=8)
    first, newer = records(spark, 150), records(spark, 60, seed=2)
    index.add(first, 1)
    index.add(newer, 2)
    index.add(newer, 2)  # once more, after a failure
    now = newer.unionByName(first.join(newer.select("canonical_key"), "canonical_key", "left_anti").select(first.columns))
    return index, spark.createDataFrame(now.collect(), SCHEMA)


@pytest.mark.parametrize("text", ["", "a", "E1", "ab", " SALES ", "@x.com", "ace", "x a", "nothing like it", "éa", "E14", "hr", "com"])
def test_search_equals_the_scan(loaded, text):
    index, now = loaded
    for tab in ("all", "pushed", "other"):
        assert sorted(map(tuple, index.search(text, tab).collect())) == sorted(map(tuple, reports.search(now, text, tab).collect()))


def test_a_search_reads_its_own_posting_keys(spark, loaded):
    index, now = loaded
    keys = index.rarest("@x.com")
    assert len(keys) == 3 and index.rarest("qqq") is None and index.rarest("sales") and len(index.rarest("ab")) == 1
    store = index._postings()
    asked = spark.createDataFrame([(k,) for k in keys], "gram string")
    assert len(store.touched(asked)) <= 3 < len([n for n in store._names(store.path) if n.startswith("part=")])
    found = index.candidates(keys)
    assert found.count() == now.filter(F.contains("email", F.lit("@x.com"))).count() + found.join(now.filter("email IS NULL"), "canonical_key", "left_semi").count()


def test_a_load_writes_its_postings_once_beside_the_store(spark, monkeypatch):
    from tributary.operators import keyed_store, search_index
    from tributary.session import materialize

    written = []
    for module in (keyed_store, search_index):
        monkeypatch.setattr(module, "materialize", lambda df, label="stage": written.append(sorted(df.columns)) or materialize(df, label))
    index = SearchIndex(spark, scratch_path(spark, "search"), parts=4)
    index.add(records(spark, 40), 1)
    assert sum("gram" in columns for columns in written) == 1
    counts = spark.read.parquet(f"{index.path}/counts")
    assert counts.agg(F.sum("n")).first()[0] == index._postings().all().count() > 0
