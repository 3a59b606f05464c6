"""Almost known enum values, and rules that stand in a table more than once."""

import random

from pyspark.sql import functions as F

from tests import model
from tributary.contract import Contract
from tributary.operators import fuzzy, mapping, staging
from tributary.sources.readers import ROW_NUM, SOURCE

CONTRACT = Contract.from_dict({"entity": "e", "fields": {
    "team": {"type": "enum", "values": {"Engineering": ["software development"], "Sales": [], "Sails": [], "Operations": ["ops"]}},
    "day": {"type": "date"}, "note": {}}})


def closest(spark, values, words, threshold=90.0):
    v = spark.createDataFrame(values, "field string, value string")
    w = spark.createDataFrame(words, "field string, word string, canonical string")
    return {(r.field, r.value): (r.canonical, r.word, round(r.similarity, 3)) for r in fuzzy.closest_words(v, w, threshold).collect()}


def test_closest_words_equal_brute_force(spark):
    rng = random.Random(8)
    make = lambda: "".join(rng.choice("abcd") for _ in range(rng.choice([3, 5, 9, 14, 22, 31])))
    words = [(rng.choice("fg"), w, f"c{rng.randrange(30)}") for w in {make() for _ in range(60)}]
    values = [(f, rng.choice([w, w.upper(), w[:2] + w[3:], w + "a", w[1:] + "b", make(), " " + w])) for f, w, _ in words for _ in range(3)] + [("f", None), (None, "abc"), ("g", " ")]
    for threshold in (80.0, 90.0):
        known = {}
        for f, w, c in sorted(words):
            known[f, w] = min(known.get((f, w), c), c)
        want = {}
        for f, v in {(f, (v or "").lower().strip()) for f, v in values}:
            near = [(-model.ratio(v, w), w, c) for (g, w), c in known.items() if g == f and model.ratio(v, w) >= threshold]
            if v and f and (f, v) not in known and near:
                best = [n for n in near if abs(n[0] - min(near)[0]) < 1e-9]
                if len({c for _, _, c in best}) == 1:
                    want[f, v] = (min(best)[2], min(best)[1], round(-min(best)[0], 3))
        assert closest(spark, values, words, threshold) == want and want


def test_two_meanings_are_nobody_s(spark):
    assert closest(spark, [("f", "sallss"), ("f", "engineerin")], [("f", "salls", "A"), ("f", "sallssx", "B"), ("f", "engineering", "C")], 80.0) == {
        ("f", "sallss"): ("B", "sallssx", 92.308), ("f", "engineerin"): ("C", "engineering", 95.238)}
    assert closest(spark, [("f", "abcde")], [("f", "abcd", "A"), ("f", "bcde", "B")], 80.0) == {}
    assert closest(spark, [], [("f", "abcd", "A")]) == {} and closest(spark, [("f", "abcd")], []) == {}


def staged(spark, rows, rules=None, **options):
    source = spark.createDataFrame(rows, f"team string, day string, {ROW_NUM} long").withColumn(SOURCE, F.lit("s"))
    out = staging.stage({"s": source}, {"s": {"team": "team", "day": "day"}}, CONTRACT, rules, **options)
    return [(r.team, r.day) for r in out.orderBy("row_num").collect()]


def test_fuzzy_enums_are_off_by_default_and_rules_come_first(spark):
    rows = [("Enginering", None, 1), ("software developmnt", None, 2), ("sals", None, 3), ("OPS", None, 4), ("enginering", None, 5), ("zzz", None, 6), (None, None, 7)]
    raw = [t for t, _, _ in rows]
    assert [t for t, _ in staged(spark, rows)] == [*raw[:3], "Operations", *raw[4:]]
    near = ["Engineering", "Engineering", "sals", "Operations", "Engineering", "zzz", None]  # sals is like two words
    assert [t for t, _ in staged(spark, rows, enum_threshold=85.0)] == near
    rules = spark.createDataFrame([("enum_value", "team:ENGINERING", '{"canonical_value":"Sales"}', True, "r1")],
                                  "kind string, fingerprint string, action string, enabled boolean, rule_id string")
    assert [t for t, _ in staged(spark, rows, rules, enum_threshold=85.0)] == ["Sales", "Engineering", "sals", "Operations", "Sales", "zzz", None]


def test_rules_that_stand_twice_do_not_multiply_rows(spark):
    made = [("enum_value", "team:LOA", "A", True, "2024-01-01", "r1"), ("enum_value", "team:LOA", "B", True, "2024-02-01", "r2"), ("enum_value", "team:X", "A", True, "2024-01-01", "r3"),
            ("enum_value", "team:X", "B", False, "2024-02-01", "r4")]
    action = F.concat(F.lit('{"canonical_value":"'), "action", F.lit('"}'))
    schema = "kind string, fingerprint string, action string, enabled boolean, created_at string, rule_id string"
    rules = spark.createDataFrame(made, schema).withColumn("action", action)
    dates = spark.createDataFrame([("date_format", "s:day", '{"format":"MDY"}', True, "2024-01-01", f"r{i}") for i in range(3)], schema)
    rows = [("loa", "03/04/2024", 1), ("x", "01/02/2024", 2)]
    assert staged(spark, rows, rules.unionByName(dates).unionByName(rules)) == [("B", "2024-03-04"), ("x", "2024-01-02")]
    top = spark.createDataFrame([("s", "col")], "source string, column string")
    learned = dates.withColumns({"kind": F.lit("mapping"), "fingerprint": F.lit("s:col"), "action": F.lit('{"target_field":"note"}')})
    assert [r.rule_target for r in mapping._learned(top, learned).collect()] == ["note"]
