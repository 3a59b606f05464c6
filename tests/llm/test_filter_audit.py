"""The filter audit against plain loops over all orders."""

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tributary.llm import filter_audit
from tributary.llm.common import importable

ROWS = "doc_id long, text string, source string, mask string, n string, bucket string, settled string"
FEW = lambda text: {"A": F.length(text) < 3, "C": text.contains("c")}


def fails(rows, plain):
    found = []
    for i, t, s in rows:
        copy = i is not None and any(j is not None and j < i and (u or "") == (t or "") for j, u, _ in rows)
        found.append((i, s or "", "".join(k for k, f in plain.items() if f(t or "")) + "E" * copy))
    return found


def expected(rows, labels, plain):
    judged, letters = fails(rows, plain), "".join([*plain, "E"])
    label = {}
    for i, q, x in labels:
        old = label.get(i, (0, 0))
        label[i] = (max(old[0], int(q == 1)), max(old[1], int(x == 1)))
    out, shapley = {}, {}
    for order in permutations(letters):
        for part in {s for _, s, _ in judged}:
            mine = [(label.get(i, (0, 0)) if i is not None else (0, 0), f) for i, s, f in judged if s == part]
            for step, own in enumerate(order):
                gone = [lf for lf in mine if set(lf[1]) & set(order[:step])]
                removed = [lf for lf in mine if own in lf[1] and lf not in gone]
                kept = [lf for lf in mine if not set(lf[1]) & set(order[:step + 1])]
                out[part, "".join(order), step + 1] = [len(kept), len(removed), sum(own in f for _, f in gone), sum(f == own for _, f in mine),
                                                       sum(g for (g, _), _ in removed), sum(x for (_, x), _ in removed)]
                shapley[part, own] = shapley.get((part, own), 0) + len(removed)
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


PLAIN = {"A": lambda t: len(t) < 3, "C": lambda t: "c" in t}


def make(seed, n=120):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, "", "c", "ccc", "hot text", "hot text", "hot text", "x", f"own {rng.randrange(50)}"]), rng.choice([None, "", "s", "é"])) for _ in range(n)]
    labels = [(rng.choice([None, *range(40)]), rng.choice([0, 1, None]), rng.choice([0, 1])) for _ in range(50)]
    return rows, labels


def write(spark, path, rows):
    """One file for each row group given, rows of larger ids first: the stream has to take earlier counts back."""
    for part in rows:
        spark.createDataFrame([(*r, "m", "n", "b", "s") for r in part], ROWS).coalesce(1).write.mode("append").parquet(path)


def report(spark, path, labels, **options):
    importable(spark)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return sorted(tuple(r) for r in filter_audit.audit(spark, path, known, FEW, **options).collect())


@pytest.mark.parametrize("seed, batches", [(1, 6), (2, 1)])
def test_audit_equals_loops_over_orders(spark, tmp_path, monkeypatch, seed, batches):
    monkeypatch.setattr(filter_audit, "TEXTS_PER_KEY", 3)
    rows, labels = make(seed)
    rows.sort(key=lambda r: -1 if r[0] is None else -r[0])
    write(spark, str(tmp_path / "d"), [rows[i:i + 20] for i in range(0, len(rows), 20)])
    assert report(spark, str(tmp_path / "d"), labels, batches=batches) == expected(rows, labels, PLAIN)


def test_a_kept_folder_takes_up_new_files_only(spark, tmp_path):
    rows, labels = make(3, 40)
    rows.sort(key=lambda r: -1 if r[0] is None else -r[0])
    path, folder = str(tmp_path / "d"), str(tmp_path / "state")
    write(spark, path, [rows[:25]])
    assert report(spark, path, labels, folder=folder) == expected(rows[:25], labels, PLAIN)
    write(spark, path, [rows[25:]])
    assert report(spark, path, labels, folder=folder) == expected(rows, labels, PLAIN)
    assert len(list((tmp_path / "state" / "progress" / "commits").glob("[0-9]"))) == 2
    assert report(spark, path, labels, folder=folder) == expected(rows, labels, PLAIN)  # nothing new


def test_retractions_are_rows_of_the_counters(spark, tmp_path):
    path, folder = str(tmp_path / "d"), str(tmp_path / "state")
    write(spark, path, [[(9, "same text", "a")], [(5, "same text", "b")], [(1, "same text", "c"), (1, "same text", "c")]])
    assert [r[3:5] for r in report(spark, path, [], folder=folder, batches=3) if r[1:3] == ("EAC", 1)] == [(0, 1), (0, 1), (2, 0)]
    deltas = sorted(tuple(r) for r in spark.read.parquet(f"{folder}/deltas").select("part", "mask", "n").collect())
    assert ("a", 0, -1) in deltas and ("a", 4, 1) in deltas and ("b", 0, -1) in deltas and ("b", 4, 1) in deltas


def test_empty_table_and_long_text(spark, tmp_path):
    write(spark, str(tmp_path / "none"), [[]])
    assert report(spark, str(tmp_path / "none"), []) == []
    rows = [(2, "word " * 200_000, None), (1, "word " * 200_000, "s"), (None, None, "s")]
    write(spark, str(tmp_path / "long"), [rows])
    assert report(spark, str(tmp_path / "long"), []) == expected(rows, [], PLAIN)
