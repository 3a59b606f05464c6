import random

import pytest
from pyspark.sql import functions as F

from tests import model
from tributary.contract import employee_contract
from tributary.operators import entity, near_dup, skew

CONTRACT = employee_contract()
SCHEMA = "seq long, source string, source_ord int, row_num long, " + ", ".join(f"{n} string" for n in CONTRACT.names)


def staged(spark, rows):
    """rows: (seq, id, email, first_last or None)."""
    out = []
    for seq, id_, mail, name in rows:
        first, last = name.split("_") if name else (None, None)
        values = {"employee_id": id_, "email": mail, "first_name": first, "last_name": last}
        out.append((seq, f"s{seq % 3}", seq % 3, seq, *[values.get(n) for n in CONTRACT.names]))
    return spark.createDataFrame(out, SCHEMA)


def random_rows(seed, n=300, ids=60, mails=60, names=40):
    rnd = random.Random(seed)
    rows = []
    for seq in range(1, n + 1):
        rows.append((seq,
                     f"E{rnd.randrange(ids)}" if rnd.random() < 0.4 else None,
                     f"m{rnd.randrange(mails)}@x" if rnd.random() < 0.5 else None,
                     f"f{rnd.randrange(names)}_l" if rnd.random() < 0.5 else None))
    return rows


def linked(df, **options):
    return {r.seq: (r.entity_seq, r.matched_by) for r in entity.link(df, **options).collect()}


@pytest.mark.parametrize("guard", [True, False])
@pytest.mark.parametrize("seed", [1, 2])
def test_links_equal_the_row_by_row_rule(spark, seed, guard):
    rows = random_rows(seed)
    assert linked(staged(spark, rows), forbid_conflicting_ids=guard) == model.link(rows, guard)


def test_chain_needs_several_rounds(spark):
    rows = [(1, "a", "p", None), (2, "b", "p", "x_y"), (3, None, "q", "x_y"), (4, "c", "q", None), (5, "c", "r", None), (6, None, "r", None),
            (7, None, None, None)]
    assert linked(staged(spark, rows)) == model.link(rows)


def test_round_limit_is_an_error(spark):
    rows = [(i, f"k{i // 2}", f"m{(i + 1) // 2}", None) for i in range(1, 12)]
    with pytest.raises(RuntimeError):
        entity.link(staged(spark, rows), max_rounds=1)
    assert linked(staged(spark, rows)) == model.link(rows)


@pytest.mark.parametrize("hot", [False, True])
def test_a_third_of_all_rows_shares_a_key(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(skew, "HOT_ROWS", 20)
    rows = random_rows(5)
    rows = [(s, i, "office@x" if s % 3 == 0 else m, "same_name" if s % 3 == 1 else n) for s, i, m, n in rows]
    df = staged(spark, rows)
    assert linked(df) == model.link(rows)


def test_links_do_not_depend_on_partitions(spark):
    rows = random_rows(9)
    base = linked(staged(spark, rows).repartition(1))
    assert base == linked(staged(spark, rows).repartition(7, "email"))


def test_seeds_are_their_own_entities_and_every_row_has_one(spark):
    got = linked(staged(spark, random_rows(4)))
    seeds = {s for s, (e, m) in got.items() if m == "seed"}
    assert all(e in seeds for e, _ in got.values()) and all(got[s][0] == s for s in seeds)


def person(seq, source, ord_, **values):
    return (seq, source, ord_, seq, *[values.get(n) for n in CONTRACT.names])


def test_merge_precedence_gaps_sensitive_and_provenance(spark):
    rows = spark.createDataFrame([
        person(1, "pay", 0, employee_id="E1", salary="10", hire_date="2020-01-01", job_title=" "),
        person(2, "crm", 1, employee_id="E1", salary="20", hire_date="2020-02-02", phone="5", job_title="Clerk"),
        person(3, "hr", 2, employee_id="E1", salary="10", hire_date="2020-02-02", email="a@b.c"),
    ], SCHEMA)
    links = entity.link(rows)
    merged = entity.merge(rows, links, CONTRACT, ["hr", "crm"])
    r = merged.first()
    assert (r.canonical_key, r.row_count) == ("E1", 3)
    assert (r.salary, r.hire_date, r.phone, r.email, r.job_title) == ("10", "2020-02-02", "5", "a@b.c", "Clerk")
    assert r.provenance["salary"] == "pay" and r.provenance["hire_date"] == "hr" and r.provenance["job_title"] == "crm"
    lost = entity.conflicts(rows, links, merged, CONTRACT).collect()
    assert [(c.field, c.winning_source, c.losing_source, c.losing_value) for c in lost] == [("hire_date", "hr", "pay", "2020-01-01")]
    clash = entity.sensitive_conflicts(rows, links, merged, CONTRACT).collect()
    assert [(c.field, c.kept_value, c.other_source, c.other_value, c.differing_rows) for c in clash] == [("salary", "10", "crm", "20", 1)]


def test_conflicting_ids_meet_through_a_row_without_id(spark):
    rows = [(1, None, "m@x", "a_b"), (2, "E1", "m@x", None), (3, "E2", None, "a_b")]
    df = staged(spark, rows)
    found = entity.identity_conflicts(df, entity.link(df)).collect()
    assert [(r.entity_seq, r.first_id, r.last_id) for r in found] == [(1, "E1", "E2")]


def test_hot_entity_conflicts_are_dealt_out(spark, monkeypatch):
    rows = spark.createDataFrame([person(i, "s", 0, employee_id="E1" if i % 3 else f"E{i}", job_title=f"t{i}") for i in range(1, 100)], SCHEMA)
    links = entity.link(rows)
    merged = entity.merge(rows, links, CONTRACT, ["s"])
    plain = sorted(map(tuple, entity.conflicts(rows, links, merged, CONTRACT).collect()))
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    assert sorted(map(tuple, entity.conflicts(rows, links, merged, CONTRACT).collect())) == plain
    assert len(plain) == 65


def random_names(seed):
    rnd = random.Random(seed)
    names = set()
    for _ in range(40):
        base = "".join(rnd.choice("abcde ") for _ in range(rnd.choice([2, 3, 6, 10, 12, 15, 18, 22, 30, 45]))).strip() or "x"
        names.add(base)
        for _ in range(5):
            letters = list(base)
            for _ in range(rnd.randint(1, 5)):
                at = rnd.randrange(len(letters) + 1)
                if rnd.random() < 0.5 and len(letters) > 1:
                    letters.pop(min(at, len(letters) - 1))
                else:
                    letters.insert(at, rnd.choice("abcde"))
            names.add("".join(letters).strip() or "y")
    return [(rnd.choice(["d1", "d1", "d2"]), n) for n in sorted(names)]


@pytest.mark.parametrize("threshold", [80.0, 85.0, 90.0, 95.0])
def test_near_names_equal_brute_force(spark, threshold):
    rows = random_names(int(threshold))
    node_rows = near_dup.nodes(spark.createDataFrame(rows, "block string, name string"))
    got = sorted((r.block, r.name_a, r.name_b) for r in near_dup.similar_names(node_rows, threshold).collect())
    want = sorted((x, a, b) for i, (x, a) in enumerate(rows) for y, b in rows[i + 1:] if x == y and model.ratio(a, b) >= threshold)
    assert got == want


def test_one_name_held_by_many_is_one_group(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 5)
    rows = spark.createDataFrame(
        [person(i, "s", 0, employee_id=f"E{i}", first_name="Rahul", last_name="Sharma", date_of_birth="1992-05-14") for i in range(40)]
        + [person(99, "s", 0, employee_id="E99", first_name="Sherma", last_name="RAHUL", date_of_birth="1992-05-14"),
           person(100, "s", 0, employee_id="E100", first_name="Rahul", last_name="Sharma", date_of_birth="1990-01-01")], SCHEMA)
    merged = entity.merge(rows, entity.link(rows), CONTRACT, ["s"])
    groups = near_dup.near_duplicates(merged)
    got = sorted((r.name_a, r.name_b, r.similarity, r.entities_a, r.entities_b) for r in groups.collect())
    assert got == [("rahul sharma", "rahul sharma", 100.0, 40, 40), ("rahul sharma", "rahul sherma", 91.7, 40, 1)]
    who = near_dup.near_duplicate_members(merged, groups).groupBy("name_a", "name_b").agg(F.countDistinct("canonical_key").alias("n"))
    assert sorted(r.n for r in who.collect()) == [40, 41]


def test_threshold_bounds(spark):
    node_rows = near_dup.nodes(spark.createDataFrame([("d", "ab")], "block string, name string"))
    with pytest.raises(ValueError):
        near_dup.similar_names(node_rows, 60.0)


def far_pairs(spark, names, threshold=90.0):
    node_rows = near_dup.nodes(spark.createDataFrame([("d", n) for n in names], "block string, name string"))
    met = near_dup._rarest(node_rows, threshold).agg(F.sum("n")).first()[0]
    return node_rows, met, near_dup.candidates(node_rows, threshold).count()


def shared_first_name(count, seed=3):
    """Long names with one first name; every fiftieth comes again with its last name edited."""
    rnd = random.Random(seed)
    names = set()
    while len(names) < count:
        last = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(14, 20)))
        names.add(f"alexandria {last}")
        if len(names) % 50 == 0:
            names.add(f"alexandria {last[:4]}{last[5:9]}x{last[9:]}")
    return sorted(names)[:count]


def test_long_names_with_one_first_name_meet_few_others(spark):
    """Pairs that are compared letter by letter grow with the names; those that meet are a small part of all pairs."""
    small, large = (far_pairs(spark, shared_first_name(n)) for n in (1000, 4000))
    assert large[2] < 6 * small[2] and large[1] < 4000 * 4000 / 20
    names = shared_first_name(400)
    got = sorted((r.name_a, r.name_b) for r in near_dup.similar_names(far_pairs(spark, names)[0]).collect())
    assert got == sorted((a, b) for i, a in enumerate(names) for b in names[i + 1:] if model.ratio(a, b) >= 90.0) and got


@pytest.mark.parametrize("threshold", [80.0, 90.0])
def test_names_of_two_tables_equal_brute_force(spark, threshold):
    left, right = random_names(11), random_names(12)[:150] + random_names(11)[::7]
    tables = [near_dup.nodes(spark.createDataFrame(rows, "block string, name string")) for rows in (left, right)]
    got = sorted((r.block, r.name_a, r.name_b) for r in near_dup.similar_between(*tables, threshold).collect())
    assert got == sorted({(x, a, b) for x, a in left for y, b in right if x == y and a != b and model.ratio(a, b) >= threshold})


def test_hashes_that_many_names_meet_on_are_dealt_out(spark, monkeypatch):
    rows = random_names(7)
    node_rows = near_dup.nodes(spark.createDataFrame(rows, "block string, name string"))
    plain = sorted(map(tuple, near_dup.similar_names(node_rows, 80.0).collect()))
    monkeypatch.setattr(skew, "HOT_ROWS", 4)
    monkeypatch.setattr(near_dup, "_PAIRS_PER_TASK", 4)
    assert sorted(map(tuple, near_dup.similar_names(node_rows, 80.0).collect())) == plain


def test_two_dropped_letters_meet_whole_names_only(spark):
    names = ["fama naabcdefg", "fama naabxxefg", "fama naabefg", "fama naabef"]
    node_rows = near_dup.nodes(spark.createDataFrame([("d", n) for n in names], "block string, name string"))
    name = {r.node: r["name"] for r in node_rows.collect()}
    met = {frozenset((name[r.node_a], name[r.node_b])) for r in near_dup._pairs_by_remainder(node_rows, 90.0).collect()}
    # the first two have 12 letters in common where 13 are needed; before, they met on those
    assert met == {frozenset(p) for p in ((names[0], names[2]), (names[1], names[2]), (names[2], names[3]))}


@pytest.mark.parametrize("threshold", [80.0, 86.0, 90.0, 93.0])
def test_lengths_whose_names_meet_whole_names_only(threshold):
    for n in near_dup._whole_after_two(threshold):
        for m in near_dup._partners(n, threshold):
            need = near_dup._needed(n, m, threshold)
            assert n - need != 2 or m - need > 2 or m == need
