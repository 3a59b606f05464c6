"""CSV records over several lines: many blocks against one task."""

import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from tributary.sources import readers
from tributary.sources.records import Dialect


@contextmanager
def blocks_of(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def one_task(spark, path, **options):
    """What Spark reads where one task reads the whole file."""
    return [tuple(r) for r in spark.read.options(**readers.CSV | {"multiLine": "true"} | options).csv(str(path)).coalesce(1).collect()]


def split(spark, path, size=64, **options):
    with blocks_of(spark, size):
        rows = readers.read_raw(spark, str(path), "s", "csv", multiLine="true", **options).orderBy(readers.ROW_NUM).collect()
    assert [r[readers.ROW_NUM] for r in rows] == list(range(1, len(rows) + 1))
    return [tuple(r)[:-2] for r in rows]


def cell(rng, escape):
    kind = rng.randrange(8)
    inner = lambda: "".join(rng.choice(["a", "b", ",", "\n", "\n", " ", "é", escape + '"', "x" * rng.randrange(9)]) for _ in range(rng.randrange(12)))
    return f'"{inner()}"' if kind < 4 else rng.choice(["plain", "5\" pipe", "", " \"not quoted", "y" * 30]) if kind < 7 else '"' + "long\n" * rng.randrange(40) + '"'


@pytest.mark.parametrize("seed, escape, end", [(1, "\\", "\n"), (2, '"', "\n"), (3, "\\", "\r\n"), (4, '"', "\r\n"), (5, "\\", "\n")])
def test_many_blocks_equal_one_task(spark, tmp_path, seed, escape, end):
    rng = random.Random(seed)
    text = "a,b,c\n" + "".join(",".join(cell(rng, escape) for _ in range(3)) + "\n" + "\n" * (rng.randrange(9) == 0) for _ in range(120))
    path = tmp_path / "t.csv"
    path.write_bytes(text.replace("\n", end).encode())
    want = one_task(spark, path, escape=escape)
    assert len(want) > 100 and any("\n" in (c or "") for r in want for c in r)
    for size in (64, 333, 1 << 20):
        assert split(spark, path, size, escape=escape) == want


def test_several_files_headers_and_order(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text('"first\nname",b\n' + "".join(f'"{i}\n{j}",x\n' for j in range(30)))
    (tmp_path / "9.csv").write_text('"first\nname",b\n')
    got = split(spark, tmp_path)
    assert got == [(f"{i}\n{j}", "x") for i in range(3) for j in range(30)]
    clean = readers.read_source(spark, str(tmp_path), "s", "csv", multiLine="true")
    assert clean.columns == ["first\nname", "b", readers.ROW_NUM, readers.SOURCE] or set(clean.columns) == {"first\nname", "b", readers.ROW_NUM, readers.SOURCE}
    assert split(spark, tmp_path, header="false")[0] == ("first\nname", "b")


def test_records_that_do_not_fit_and_open_quotes(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b\n1,"x\ny"\n2\n3,"p\nq",r\n4,z\n')
    with pytest.raises(Exception, match="malformed CSV record"):
        readers.read_raw(spark, str(path), "s", "csv", multiLine="true").collect()
    kept = readers.read_raw(spark, str(path), "s", "csv", multiLine="true", mode="DROPMALFORMED")
    assert sorted(tuple(r)[:2] for r in kept.collect()) == [("1", "x\ny"), ("4", "z")]
    assert {r["line"] for r in readers.rejects(spark, str(path), multiLine="true").collect()} == {"2", '3,"p\nq",r'}
    path.write_text('a,b\n1,"x\ny\n2,z\n')
    with pytest.raises(ValueError, match="not closed"):
        readers.read_raw(spark, str(path), "s", "csv", multiLine="true")
    path.write_text("a,b\n")
    assert readers.read_raw(spark, str(path), "s", "csv", multiLine="true").count() == 0
    from tributary.sources.records import split_records
    path.write_text('a,b\n1,"' + "x\n" * 30 + '"\n')
    with pytest.raises(ValueError, match="runs over 31 lines"):
        split_records(spark, str(path), max_lines=20)
    with pytest.raises(ValueError, match="one character"):
        Dialect(sep="||")


def test_long_cells_do_not_exhaust_the_stack(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b\n1,"' + ('x,\\"' * 30_000 + "\n") * 2 + '"\n2,' + "z" * 50_000 + "\n")
    assert split(spark, path, 1 << 16) == one_task(spark, path)


def test_only_torn_lines_meet_by_record(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n" + "".join(f"{i},plain\n" for i in range(50)) + '50,"x\ny"\n')
    plan = readers.read_raw(spark, str(path), "s", "csv", multiLine="true")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 1 and "Union" in plan
    assert readers.read_raw(spark, str(path), "s", "csv", multiLine="true").filter(F.col("b").contains("\n")).count() == 1
