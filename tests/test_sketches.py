"""Profiles from sketches of files: merged, added to, and near the exact counts."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tests.test_operators import CONTRACT
from tributary.operators import mapping, profile, sketches
from tributary.sources import readers


def write(path, name, rows):
    (path / name).write_text("id,mail,amount,day,dept,flat\n" + "".join(",".join(map(str, r)) + "\n" for r in rows))


def make(start, n, rng):
    return [(f"E{1000 + i}", f"a{i}@x.com" if i % 9 else "", rng.randrange(50) * 10, f"0{1 + i % 9}/01/20{10 + i % 13}", rng.choice(["eng", "HR", "odd"]), "same") for i in range(start, start + n)]


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(4)
    for i in range(3):
        write(tmp_path, f"{i}.csv", make(i * 2000, 2500, rng))  # files overlap
    return tmp_path


def exact(spark, folder):
    return {r.column: r for r in profile.profile([readers.read_source(spark, str(folder), "s", "csv")], CONTRACT).collect()}


def test_merged_sketches_are_near_the_exact_profile(spark, folder, tmp_path_factory):
    store = str(tmp_path_factory.mktemp("store") / "t")
    assert len(sketches.load(spark, str(folder), "s", "csv", store, CONTRACT)) == 3
    got = {r.column: r for r in sketches.profiles(spark, store, CONTRACT).collect()}
    want = exact(spark, folder)
    assert set(got) == set(want)
    for c, w in want.items():
        g = got[c]
        assert (g.total_count, g.non_null_count, g.null_rate, g.inferred_type, g.sample_values) == (w.total_count, w.non_null_count, w.null_rate, w.inferred_type, w.sample_values), c
        assert abs(g.distinct_count - w.distinct_count) <= 0.04 * w.distinct_count, c
        assert set(g.hits) == set(w.hits) and all(abs(g.hits[k] - w.hits[k]) <= 0.04 * max(w.hits[k], 1) for k in w.hits), c
    assert got["flat"].frequent[0]["item"] == "same" and got["flat"].frequent[0]["count"] == 7500
    decided = {r.column: r.mapped_to for r in mapping.decide(sketches.profiles(spark, store, CONTRACT).drop("frequent"), CONTRACT).collect()}
    assert decided == {r.column: r.mapped_to for r in mapping.decide(profile.profile([readers.read_source(spark, str(folder), "s", "csv")], CONTRACT), CONTRACT).collect()}


def test_a_second_load_reads_new_and_changed_files_only(spark, folder, tmp_path_factory):
    store = str(tmp_path_factory.mktemp("store") / "t")
    rng = random.Random(5)
    assert len(sketches.load(spark, str(folder), "s", "csv", store)) == 3 and sketches.load(spark, str(folder), "s", "csv", store) == []
    write(folder, "new file+1.csv", make(9000, 500, rng))
    assert [os.path.basename(f) for f in sketches.load(spark, str(folder), "s", "csv", store)] in (["new file+1.csv"], ["new%20file+1.csv"])
    write(folder, "0.csv", make(0, 100, rng))
    os.utime(folder / "0.csv", (10 ** 9, 10 ** 9))
    assert [os.path.basename(f) for f in sketches.load(spark, str(folder), "s", "csv", store)] == ["0.csv"]
    got = {r.column: r for r in sketches.profiles(spark, store).collect()}
    for c, w in exact(spark, folder).items():
        assert got[c].total_count == w.total_count == 5600 and abs(got[c].distinct_count - w.distinct_count) <= 0.04 * w.distinct_count
    sketches.load(spark, str(folder / "1.csv"), "other", "csv", store)
    assert {r.source for r in sketches.profiles(spark, store).select("source").distinct().collect()} == {"s", "other"}


def test_what_is_kept_does_not_grow_with_the_values(spark, tmp_path):
    sizes = []
    for n in (3_000, 60_000):
        df = spark.range(n).select(F.col("id").cast("string").alias("k"), F.md5(F.col("id").cast("string")).alias("h"))
        df.coalesce(1).write.parquet(str(tmp_path / f"d{n}"))
        sketches.load(spark, str(tmp_path / f"d{n}"), "s", "parquet", str(tmp_path / f"store{n}"))
        sizes.append(sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path / f"store{n}") for f in fs if f.endswith(".parquet")))
        found = sketches.profiles(spark, str(tmp_path / f"store{n}")).filter("column = 'h'").first()
        assert abs(found.distinct_count - n) <= 0.04 * n and found.total_count == n
    assert sizes[1] < 2 * sizes[0] and sizes[1] < 200_000
