"""Sources, ordering, quality, review, rules, delivery, ledger and streams on small inputs."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tributary.contract import Contract, employee_contract
from tributary.operators import delivery, ledger, mapping, ordering, profile, quality, reports, review, rules, skew
from tributary.session import materialize, run_scope, scratch_path
from tributary.sources import exports, readers
from tributary.streaming import tail

CONTRACT = employee_contract()


# -- contract and sources ----------------------------------------------------------------------

def test_contract_accessors_and_files(tmp_path, spark):
    assert [f.name for f in CONTRACT.identity] == ["employee_id", "email"]
    assert [f.name for f in CONTRACT.sensitive] == ["date_of_birth", "salary"] and len(CONTRACT.required) == 7
    doc = tmp_path / "c.yaml"
    doc.write_text("entity: x\nfields:\n  a: {type: enum, values: {Full: [f]}}\n  b: {required: true}\n")
    loaded = Contract.load(doc)
    assert loaded["a"].vocabulary() == {"full": "Full", "f": "Full"} and loaded["b"].required
    assert loaded.as_frame(spark).count() == 2
    with pytest.raises(ValueError):
        Contract.from_dict({"fields": {}})
    with pytest.raises(ValueError):
        Contract.from_dict({"entity": "x", "fields": {"a": {"type": "blob"}}})


def test_csv_source_is_all_text_and_numbered(spark, tmp_path):
    path = tmp_path / "people.csv"
    path.write_text("id,name\n007, Ann \nNA,N/A\n3,\"x, y\"\n")
    rows = readers.read_source(spark, str(path), "people").orderBy(readers.ROW_NUM).collect()
    assert [(r.id, r.name, r[readers.ROW_NUM], r[readers.SOURCE]) for r in rows] == [
        ("007", "Ann", 1, "people"), (None, None, 2, "people"), ("3", "x, y", 3, "people")]
    landed = readers.landing(readers.read_source(spark, str(path), "people")).orderBy("row_num").first()
    assert landed.raw_json == '{"id":"007","name":"Ann"}'


def test_csv_rows_that_do_not_fit_are_refused_and_listed(spark, tmp_path):
    path = tmp_path / "ragged.csv"
    path.write_text("a,b\n1,2\n1,2,3\n4\n5,6\n")
    with pytest.raises(Exception):
        readers.read_source(spark, str(path), "ragged").count()
    assert sorted(r.line for r in readers.rejects(spark, str(path)).collect()) == ["1,2,3", "4"]
    rest = readers.read_source(spark, str(path), "ragged", mode="DROPMALFORMED").orderBy(readers.ROW_NUM)
    assert [(r.a, r.b) for r in rest.collect()] == [("1", "2"), ("5", "6")]


def test_quoted_line_breaks_and_raw_cells(spark, tmp_path):
    path = tmp_path / "notes.csv"
    path.write_text('id,note\n1,"two\nlines"\n 2 ,N/A\n')
    with pytest.raises(Exception):
        readers.read_source(spark, str(path), "notes").count()
    raw = readers.read_raw(spark, str(path), "notes", multiLine="true")
    assert [r.raw_json for r in readers.landing(raw).orderBy("row_num").collect()] == [
        '{"id":"1","note":"two\\nlines"}', '{"id":" 2 ","note":"N/A"}']
    clean = readers.read_source(spark, str(path), "notes", multiLine="true").orderBy(readers.ROW_NUM).collect()
    assert [(r.id, r.note) for r in clean] == [("1", "two\nlines"), ("2", None)]


def test_row_numbers_follow_files_and_blocks(spark, tmp_path):
    folder = tmp_path / "parts.csv"
    folder.mkdir()
    n = 0
    for part in range(3):
        lines = ["v"] + [str(n + k) for k in range(1000)]
        n += 1000
        (folder / f"part-{part}.csv").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        df = readers.read_source(spark, str(folder), "parts")
        assert df.filter(F.col("v").cast("long") + 1 != F.col(readers.ROW_NUM)).count() == 0 and df.count() == 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_source_guards(spark, tmp_path):
    with pytest.raises(ValueError):
        readers.read_source(spark, "book.xlsx", "book")
    with pytest.raises(Exception):
        readers.read_source(spark, str(tmp_path / "missing.csv"), "missing").count()


def test_json_and_parquet_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5), (2, None)], "a int, b double")
    for fmt in ("json", "parquet", "orc"):
        path = str(tmp_path / f"t.{fmt}")
        df.coalesce(1).write.format(fmt).save(path)
        got = readers.read_source(spark, path, "t", fmt).orderBy("a").collect()
        assert [(r.a, r.b) for r in got] == [("1", "2.5"), ("2", None)]


# -- profile -----------------------------------------------------------------------------------

def test_profile_counts_samples_and_types(spark):
    data = [(i, "x@y.z" if i % 2 else "a@b.c", str(i), "" if i < 3 else f"0{1 + i % 9}/01/2020", "same") for i in range(1, 11)]
    df = readers.from_frame(spark.createDataFrame(data, "row_num long, mail string, num string, day string, flat string"), "s", "row_num")
    p = {r.column: r for r in profile.profile([df]).collect()}
    assert (p["mail"].inferred_type, p["num"].inferred_type, p["day"].inferred_type, p["flat"].inferred_type) == ("email", "decimal", "date", "string")
    assert (p["day"].total_count, p["day"].non_null_count, p["day"].null_rate) == (10, 8, 0.2)
    assert p["num"].sample_values == ["1", "2", "3", "4", "5"] and p["mail"].sample_values == ["x@y.z", "a@b.c"]
    assert (p["flat"].distinct_count, p["flat"].uniqueness_ratio) == (1, 0.1)
    quick = {r.column: r for r in profile.column_stats_quick(profile.cells(df)).collect()}
    assert all(quick[c].distinct_count == p[c].distinct_count for c in p)


# -- ordering ----------------------------------------------------------------------------------

@pytest.fixture
def many_chunks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_number_rows_is_a_total_order(spark, many_chunks):
    keys = list(range(500))
    random.Random(1).shuffle(keys)
    df = ordering.number_rows(spark.createDataFrame([(k,) for k in keys], "k int").repartition(6), ["k"])
    assert df.filter("k <> _row").count() == 0 and df.select("_chunk").distinct().count() > 1


# -- quality -----------------------------------------------------------------------------------

GOOD = {"employee_id": "E1001", "first_name": "A", "last_name": "B", "email": "a@b.c", "hire_date": "2020-01-01", "department": "HR",
        "employment_status": "Active", "salary": "100"}


def records(spark, *changes):
    schema = "canonical_key string, " + ", ".join(f"{n} string" for n in CONTRACT.names)
    rows = [(f"k{i}", *[{**GOOD, **c}.get(n) for n in CONTRACT.names]) for i, c in enumerate(changes)]
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("change, errors, outcome", [
    ({}, [], "valid"),
    ({"email": None, "department": " "}, ["required:email", "required:department"], "quarantined"),
    ({"email": "a b@c.d"}, [], "valid"),
    ({"email": "nope"}, ["email:email"], "quarantined"),
    ({"employee_id": "X1", "manager_id": "E12"}, ["pattern:employee_id", "pattern:manager_id"], "quarantined"),
    ({"salary": "$1,200"}, [], "valid"),
    ({"salary": "INR 1200"}, [], "valid"),
    ({"salary": "-5"}, ["minimum:salary"], "quarantined"),
    ({"salary": "abc"}, ["number:salary"], "quarantined"),
    ({"employment_status": "LOA"}, ["enum:employment_status"], "quarantined"),
])
def test_ladder(spark, change, errors, outcome):
    r = quality.ladder(records(spark, change), CONTRACT).first()
    assert (r.errors, r.outcome) == (errors, outcome)


def test_repairs_are_listed(spark):
    r = quality.ladder(records(spark, {"email": "a b@c.d", "salary": "INR 12000000"}), CONTRACT).first()
    assert r.fixes == ["email", "salary"] and (r.email, r.salary) == ("ab@c.d", "12000000.0")
    below = quality.ladder(records(spark, {"salary": "-5"}), CONTRACT).first()
    assert (below.fixes, below.salary, below.outcome) == ([], "-5", "quarantined")
    assert r.errors_before == ["email:email", "number:salary"]


def test_optional_shape_checks(spark):
    df = records(spark, {"phone": "12", "hire_date": "31/02/2020"})
    assert quality.ladder(df, CONTRACT).first().errors == []
    assert quality.ladder(df, CONTRACT, check_dates=True, check_phones=True).first().errors == ["date:hire_date", "phone:phone"]


def test_ranges_references_and_date_order(spark):
    df = records(spark, {"manager_id": "E1001", "date_of_birth": "2010-01-01"}, {"employee_id": "E1002", "manager_id": "E9999"})
    assert [r.canonical_key for r in quality.orphan_references(df, "manager_id", df, "employee_id").collect()] == ["k1"]
    late = quality.date_order_violations(df, "date_of_birth", "hire_date", months=192)
    assert [(r.canonical_key, r.rule) for r in late.collect()] == [("k0", "too_soon")]
    found = quality.range_violations(df, {"salary": (None, 50.0)}, ["canonical_key"]).collect()
    assert [(r.field, r.value, r.rule) for r in found] == [("salary", 100.0, "maximum")] * 2


def test_orphans_with_a_hot_missing_reference(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    df = spark.createDataFrame([(i, "gone" if i % 3 else str(i % 5)) for i in range(90)], "i int, ref string")
    known = spark.createDataFrame([(str(k),) for k in range(5)], "id string")
    assert quality.orphan_references(df, "ref", known, "id").count() == 60


def test_salted_join_equals_plain_join(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 7}") for i in range(200)], "i int, k string")
    table = spark.createDataFrame([("hot", 1), ("hot", 2), ("k0", 3), ("zz", 4)], "k string, v int")
    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    hot = skew.hot_keys(skew.count_keys(rows, ["k"]), ["k"])
    assert [r.k for r in hot.collect()] == ["hot"]
    for how in ("inner", "left", "left_semi", "left_anti"):
        salted = skew.salted_join(rows, table, ["k"], hot, "i", how)
        assert sorted(map(str, salted.collect())) == sorted(map(str, rows.join(table, "k", how).select(salted.columns).collect()))


# -- review and resolutions --------------------------------------------------------------------

def items_from(spark, rows):
    return spark.createDataFrame(rows, "run_id string, type string, group_key string, affected_id string, context string, proposal string, seq long")


def test_items_keep_the_first_context_and_count_members(spark):
    found = items_from(spark, [("r", "ENUM_VALUE_AMBIGUOUS", "g", "b", "c2", "p2", 2), ("r", "ENUM_VALUE_AMBIGUOUS", "g", "a", "c1", "p1", 1),
                               ("r", "ENUM_VALUE_AMBIGUOUS", "g", "a", "c3", "p3", 3)])
    r = review.items(found).first()
    assert (r.context, r.proposal, r.affected_count, r.status) == ("c1", "p1", 2, "pending")
    assert sorted(m.affected_id for m in review.members(found).collect()) == ["a", "b"]


def test_queue_shows_pending_and_newest_first(spark):
    rows = spark.createDataFrame([("a", "resolved", "2024-01-03"), ("b", "pending", "2024-01-01"), ("c", "pending", "2024-01-02")],
                                 "group_key string, status string, created_at string")
    assert [r.group_key for r in review.queue(rows).collect()] == ["c", "b", "a"]


def test_breaker_limits(spark):
    found = items_from(spark, [("r", "VALIDATION_FAILED_TWICE", f"g{i}", f"k{i}", "{}", None, 0) for i in range(21)])
    assert review.breaker(found, F.lit(1000)).first().tripped
    few = found.filter("group_key < 'g2'")
    assert not review.breaker(few, F.lit(1000)).first().tripped
    assert review.breaker(few, F.lit(12)).first().tripped
    runs = spark.createDataFrame([("r",), ("q",)], "run_id string")
    gate = {r.run_id: r.run_status for r in review.run_gate(runs, review.items(found), review.breaker(found, F.lit(1000))).collect()}
    assert gate == {"r": "halted", "q": "completed"}


def test_resolutions_route_by_item_type(spark):
    canonical = records(spark, {"email": None}, {"salary": "-1"}, {}, {}, {}).withColumns({"run_id": F.lit("r"), "status": F.lit("quarantined")})
    found = items_from(spark, [
        ("r", "VALIDATION_FAILED_TWICE", "v0", "k0", '{"field":"email"}', None, 0),
        ("r", "VALIDATION_FAILED_TWICE", "v1", "k1", '{"field":"salary"}', None, 0),
        ("r", "SENSITIVE_FIELD_CONFLICT", "c2", "id:k2", '{"field":"salary"}', '{"canonical_value":"777"}', 0),
        ("r", "NEAR_DUPLICATE_RECORD", "n", "k3", "{}", None, 0), ("r", "NEAR_DUPLICATE_RECORD", "n", "k4", "{}", None, 0),
        ("r", "ENUM_VALUE_AMBIGUOUS", "e", "k2", '{"field":"department"}', '{"canonical_value":"HR"}', 0)])
    said = spark.createDataFrame([
        ("r", "v0", "correct", None, "new@x.y", True), ("r", "v1", "reject", None, None, False), ("r", "c2", "approve", None, None, True),
        ("r", "n", "correct", None, "merge", True), ("r", "e", "correct", None, "Sales", True)],
        "run_id string, group_key string, action string, field string, value string, remember boolean"
    ).withColumn("resolved_at", F.to_timestamp(F.lit("2024-01-01")))
    resolved = review.resolve(review.items(found), said)
    out = {r.canonical_key: r for r in review.apply_resolutions(canonical, resolved, review.members(found), CONTRACT).collect()}
    assert set(out) == {"k0", "k1", "k2", "k3"}
    assert (out["k0"].email, out["k0"].status) == ("new@x.y", "ready") and out["k1"].status == "rejected"
    assert (out["k2"].salary, out["k2"].department, out["k2"].status) == ("777", "HR", "quarantined")
    held = review.withheld_keys(review.items(found).filter("group_key = 'n'"), review.members(found))
    assert sorted(r.canonical_key for r in held.collect()) == ["k3", "k4"]


# -- rules -------------------------------------------------------------------------------------

def test_rule_upsert_lookup_toggle_and_listing(spark):
    def rule(fp, action, enabled=True, at="2024-01-01", used=0, client="c"):
        return (f"id_{fp}_{at}", client, "enum_value", fp, action, "item", enabled, used)
    def table(*rows):
        df = spark.createDataFrame([(*r[:7], r[7]) for r in rows], "rule_id string, client_id string, kind string, fingerprint string, "
                                   "action string, source_item string, enabled boolean, times_applied long")
        return df.withColumn("created_at", F.to_timestamp(F.substring_index("rule_id", "_", -1)))
    old = table(rule("a", '{"canonical_value":"X"}', enabled=False, used=3), rule("b", '{"canonical_value":"Y"}', used=1))
    new = table(rule("a", '{"canonical_value":"Z"}', at="2024-02-01"))
    out = {r.fingerprint: r for r in rules.upsert(old, new).collect()}
    assert (out["a"].action, out["a"].enabled, out["a"].times_applied, out["a"].rule_id) == ('{"canonical_value":"Z"}', True, 3, "id_a_2024-01-01")
    assert out["b"].action == '{"canonical_value":"Y"}'
    assert rules.find(old, "c", "enum_value").count() == 1 and rules.find(old, "other", "enum_value").count() == 0
    off = rules.toggle(rules.upsert(old, new), "id_b_2024-01-01")
    assert {r.fingerprint: r.enabled for r in off.collect()} == {"a": True, "b": False}
    assert [r.action_display for r in rules.listing(old, "c").orderBy("fingerprint").collect()] == ["value means X", "value means Y"]
    assert mapping.empty_rules(spark).count() == 0


def test_proposals_and_fallbacks(spark):
    cache = spark.createDataFrame([("p1",)], "prompt string").select(
        mapping.prompt_key(F.lit(" sys"), F.col("prompt")).alias("prompt_key"), F.lit("answer").alias("response"))
    asked = spark.createDataFrame([("p1 ",), ("p2",)], "prompt string").select("prompt", mapping.prompt_key(F.lit(" sys"), F.col("prompt")).alias("prompt_key"))
    got = {r.prompt: (r.cached, r.proposal) for r in mapping.lookup_proposals(asked, cache, F.lit("none")).collect()}
    assert got == {"p1 ": (True, "answer"), "p2": (False, "none")}
    raw = spark.createDataFrame([("employment_status", "loa"), ("department", "Zed")], "f string, v string")
    guess = [tuple(r.g) for r in raw.select(mapping.enum_fallback(F.col("f"), F.col("v"), CONTRACT).alias("g")).collect()]
    assert guess == [("On Leave", 0.95), ("Engineering", 0.5)]


# -- delivery ----------------------------------------------------------------------------------

def attempts(spark, rows):
    return spark.createDataFrame([(i, "r", rec, att, code) for i, (rec, att, code) in enumerate(rows)],
                                 "id long, run_id string, record_id string, attempt int, http_status int")


def test_attempt_outcomes(spark):
    df = attempts(spark, [("a", 1, 503), ("a", 2, 201), ("b", 1, 422), ("c", 1, 503), ("c", 2, 503), ("c", 3, 503), ("d", 1, 200), ("d", 2, 503)])
    got = {r.record_id: (r.status, r.attempts_used) for r in delivery.attempt_status(df).collect()}
    assert got == {"a": ("pushed", 2), "b": ("rejected", 1), "c": ("failed", 3), "d": ("pushed", 1)}
    waits = {(r.record_id, r.attempt): r.wait_s for r in delivery.backoff(df, base=0.5).collect()}
    assert waits[("c", 1)] == 0.5 and waits[("c", 2)] == 1.0 and waits[("c", 3)] is None and waits[("b", 1)] is None
    assert {r.record_id for r in delivery.rollback_set(df, "r").collect()} == {"a", "d"}
    assert {r.record_id for r in delivery.retry_set(delivery.attempt_status(df)).collect()} == {"b", "c"}
    item = review.items(delivery.rejected_findings(delivery.attempt_status(df), "r", missing_id_codes=(422,))).first()
    assert item.group_key == "refused/b" and '"canonical_value":"E' in item.proposal


@pytest.mark.parametrize("seed", [1, 2])
def test_outage_scan_equals_a_loop(spark, many_chunks, seed):
    rnd = random.Random(seed)
    codes = [rnd.choice([201, 503, 503, 503, 422]) for _ in range(200)]
    df = attempts(spark, [(f"{i:04d}", 1, c) for i, c in enumerate(codes)])
    scanned = delivery.outage_scan(delivery.attempt_status(df), limit=3, batch_size=10)
    got = {r.position: (r.consecutive_failures, r.outage) for r in scanned.collect()}
    streak, want, stop = 0, {}, None
    for i, c in enumerate(codes):
        streak = 0 if c == 201 else streak + (c == 503)
        want[i] = (streak, streak >= 3 and c == 503)
        stop = i if stop is None and want[i][1] else stop
    assert got == want
    final = {r.position: r.final_status for r in delivery.compensate(scanned).collect()}
    for i, c in enumerate(codes):
        status = {201: "pushed", 422: "rejected", 503: "failed"}[c]
        expected = "not_attempted" if i > stop else "rolled_back" if i // 10 == stop // 10 and status == "pushed" else status
        assert final[i] == expected


def test_an_outage_stops_only_its_run(spark, many_chunks):
    schema = "id long, run_id string, record_id string, attempt int, http_status int"
    rows = [(2 * i + r, f"run{r}", f"{r}-{i}", 1, c) for r, codes in enumerate([(201, 503, 503, 201, 201), (503, 201, 503, 503, 503, 201)])
            for i, c in enumerate(codes)]
    scanned = delivery.outage_scan(delivery.attempt_status(spark.createDataFrame(rows, schema)), limit=3, batch_size=3)
    final = {r.record_id: (r.position, r.final_status) for r in delivery.compensate(scanned).collect()}
    assert [final[f"0-{i}"] for i in range(5)] == [(0, "pushed"), (1, "failed"), (2, "failed"), (3, "pushed"), (4, "pushed")]
    assert [final[f"1-{i}"][1] for i in range(6)] == ["failed", "pushed", "failed", "failed", "failed", "not_attempted"]
    item = review.items(delivery.outage_findings(scanned, "run1")).collect()
    assert [(i.type, i.affected_count) for i in item] == [("TARGET_OUTAGE_HALT", 1)]
    assert delivery.outage_findings(scanned, "run0").count() == 0


def test_no_outage_changes_nothing(spark):
    df = attempts(spark, [("a", 1, 201), ("b", 1, 503), ("c", 1, 422)])
    final = delivery.compensate(delivery.outage_scan(delivery.attempt_status(df)))
    assert {r.record_id: r.final_status for r in final.collect()} == {"a": "pushed", "b": "failed", "c": "rejected"}


@pytest.mark.parametrize("hot", [False, True])
def test_acceptance_is_idempotent_and_unique(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(skew, "HOT_ROWS", 2)
    rows = [(1, "E1", "k1"), (2, "E1", "k1"), (3, "E1", "k2"), (4, None, "k3"), (5, "E2", "k4"), (6, "E1", "k1"), (7, "E3", "k9")]
    requests = spark.createDataFrame(rows, "request_seq long, employee_id string, idempotency_key string")
    earlier = spark.createDataFrame([("E3", "k9"), ("E2", "old")], "employee_id string, idempotency_key string")
    got = {r.request_seq: (r.outcome, r.http_status) for r in delivery.accept(requests, earlier).collect()}
    assert got == {1: ("created", 201), 2: ("already_processed", 200), 3: ("conflict", 409), 4: ("missing_id", 400), 5: ("conflict", 409),
                   6: ("already_processed", 200), 7: ("already_processed", 200)}


def test_idempotency_key_follows_content(spark):
    df = spark.createDataFrame([("k", "1", None), ("k", "1", "x"), ("k", "1", None)], "key string, a string, b string")
    keys = [r[0] for r in df.select(delivery.idempotency_key(F.col("key"), ["b", "a"])).collect()]
    assert keys[0] == keys[2] != keys[1]


def test_a_scope_removes_its_own_tables(spark):
    kept = materialize(spark.range(3))
    with run_scope(spark) as folder:
        inner = materialize(spark.range(5))
        assert inner.count() == 5 and os.path.isdir(folder.removeprefix("file:"))
        with pytest.raises(ValueError), run_scope(spark) as nested:
            materialize(spark.range(7))
            raise ValueError
        assert not os.path.exists(nested.removeprefix("file:")) and inner.count() == 5
    assert not os.path.exists(folder.removeprefix("file:")) and kept.count() == 3


def test_saving_replaces_only_its_run(spark):
    path = scratch_path(spark, "canonical")
    delivery.save_canonical(records(spark, {}, {}), "r1", path)
    delivery.save_canonical(records(spark, {}), "r2", path)
    delivery.save_canonical(records(spark, {}, {}, {}), "r2", path)
    assert {r.run_id: r["count"] for r in spark.read.parquet(path).groupBy("run_id").count().collect()} == {"r1": 2, "r2": 3}


# -- exports, ledger and streams ---------------------------------------------------------------

def some_events(spark, n, run="r", start=1):
    df = spark.range(n).withColumn("k", F.concat(F.lit("k"), F.col("id").cast("string")))
    batch = ledger.events(df, run_id=run, stage="validate", type="AUTOFIX_APPLIED", actor="agent", entity_id=F.col("k"))
    return ledger.number_events([batch], ts=F.to_timestamp(F.lit("2024-01-01")), first_id=start)


def test_unknown_events_are_refused(spark):
    with pytest.raises(ValueError):
        ledger.events(spark.range(1), run_id="r", stage="validate", type="NO_SUCH", actor="agent")


def test_append_only_ledger_and_its_checks(spark):
    path = scratch_path(spark, "ledger")
    ledger.append(some_events(spark, 10), path)
    before = ledger.read_ledger(spark, path)
    snapshot = spark.createDataFrame(before.collect(), before.schema)
    ledger.append(some_events(spark, 5, start=11), path)
    after = ledger.read_ledger(spark, path)
    check = ledger.integrity(after).first()
    assert (check.event_count, check.min_id, check.max_id, check.ids_unique, check.ids_dense) == (15, 1, 15, True, True)
    assert ledger.lost_events(snapshot, after).isEmpty()
    changed = after.withColumn("entity_id", F.when(F.col("id") == 3, "other").otherwise(F.col("entity_id")))
    assert [r.id for r in ledger.lost_events(snapshot, changed).collect()] == [3]
    assert [r.id for r in ledger.tail_page(after, "r", 12, 2).collect()] == [13, 14]
    assert [r.id for r in reports.audit_view(after, "r", limit=3).collect()] == [15, 14, 13]


def test_ledger_stream_continues_where_it_stopped(spark):
    path, out = scratch_path(spark, "ledger"), scratch_path(spark, "tail")
    ledger.append(some_events(spark, 6), path)
    tail.drain(tail.after(tail.read_events(spark, path), "r", from_id=2), out, out + "-progress")
    ledger.append(some_events(spark, 4, start=7), path)
    got = tail.drain(tail.after(tail.read_events(spark, path), "r", from_id=2), out, out + "-progress")
    assert sorted(r.id for r in got.collect()) == list(range(3, 11))


def test_delivery_stream_answers_each_request_once(spark):
    base = scratch_path(spark, "delivery")
    schema = "request_seq long, employee_id string, idempotency_key string, payload string"
    def put(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(base + "/in")
    def run():
        stream = spark.readStream.schema(schema).parquet(base + "/in")
        tail.deliver(stream, base + "/store", base + "/answers", base + "/progress").awaitTermination()
    put([(1, "E1", "k1", "p"), (2, "E2", "k2", "p"), (3, "E1", "k1", "p")])
    run()
    put([(4, "E1", "k1", "p"), (5, "E2", "kX", "p"), (6, "E3", "k3", "p")])
    run()
    answers = {r.request_seq: r.outcome for r in spark.read.parquet(base + "/answers").collect()}
    assert answers == {1: "created", 2: "created", 3: "already_processed", 4: "already_processed", 5: "conflict", 6: "created"}
    assert sorted(r.employee_id for r in tail.delivered_store(spark, base + "/store").all().collect()) == ["E1", "E2", "E3"]


def test_record_and_audit_exports(spark, tmp_path):
    canonical = records(spark, {}, {"phone": "+911"}).withColumn("status", F.lit("ready"))
    exports.write_records_csv(canonical, str(tmp_path / "r.csv"))
    back = spark.read.csv(str(tmp_path / "r.csv"), header=True).orderBy("employee_id").collect()
    assert list(back[0].asDict()) == list(exports.RECORD_COLUMNS) and [r.employee_id for r in back] == ["k0", "k1"] and back[1].phone == "+911"
    exports.write_records_json(canonical, CONTRACT.names, str(tmp_path / "r.json"))
    assert spark.read.json(str(tmp_path / "r.json")).select("record.employee_id").first()[0] == "E1001"
    events = some_events(spark, 3)
    exports.write_audit_csv(events, "r", str(tmp_path / "a.csv"))
    assert spark.read.csv(str(tmp_path / "a.csv"), header=True).columns == list(exports.AUDIT_COLUMNS)
    exports.write_audit_json(events, "r", str(tmp_path / "a.json"))
    assert spark.read.json(str(tmp_path / "a.json")).count() == 3


def test_reports_of_an_unknown_run_are_zero(spark):
    rows = spark.createDataFrame([("r", "ready")], "run_id string, status string")
    r = reports.run_summary(rows, rows, rows, "other").first()
    assert (r.source_rows_in, r.canonical_records, r.ready, r.pending_review) == (0, 0, 0, 0)
    events = some_events(spark, 4).unionByName(some_events(spark, 1).withColumn("actor", F.lit("human")))
    total = reports.scoreboard(events, "r").filter("stage IS NULL").first()
    assert (total.agent, total.human, total.autonomy_pct) == (4, 1, 80.0)
    nothing = reports.scoreboard(events, "none").filter("stage IS NULL").first()
    assert (nothing.agent, nothing.human, nothing.autonomy_pct) == (0, 0, 100.0)
    assert reports.sync_rate(rows).first().sync_rate == 0


def test_search_tabs(spark):
    canonical = records(spark, {"first_name": "Zed"}, {}).withColumn("status", F.when(F.col("canonical_key") == "k0", "pushed").otherwise("ready"))
    assert [r.canonical_key for r in reports.search(canonical, "zE").collect()] == ["k0"]
    assert reports.search(canonical, "", "pushed").count() == 1 and reports.search(canonical, "zed", "other").count() == 0


def test_a_run_without_valid_records_leaves_nothing_behind(spark, tmp_path):
    path = str(tmp_path / "canonical")
    delivery.save_canonical(records(spark, {}, {}), "r:1", path)
    delivery.save_canonical(records(spark, {}), "r2", path)
    delivery.save_canonical(records(spark, {}, {}).limit(0), "r:1", path)
    assert [r["run_id"] for r in spark.read.parquet(path).select("run_id").collect()] == ["r2"]


def test_amounts_are_never_written_with_an_exponent(spark):
    from tributary.operators.quality import number_text
    wanted = {12345678.9: "12345678.9", 0.0001: "0.0001", 2e15: "2000000000000000.0", -5.0: "-5.0", 0.0: "0.0", 100.0: "100.0"}
    got = spark.createDataFrame([(v,) for v in wanted], "v double").select("v", number_text(F.col("v")).alias("t")).collect()
    assert {r["v"]: r["t"] for r in got} == wanted


def test_export_keys_of_many_customers_stay_apart(spark):
    from tributary.sources import bridge
    keys = "(SELECT k AS c_custkey, k % 25 AS c_nationkey, 1.5D AS c_acctbal, 'BUILDING' AS c_mktsegment FROM VALUES (1L), (12L), (999999L), (1000000L), (1000012L), (1499999L), (9999999L), (97000012L) AS t(k))"
    for name in ("src_a", "src_c"):
        rows = spark.sql(bridge.EXPORTS[name].replace("FROM customer", f"FROM {keys}"))
        assert rows.count() == rows.select("row_num").distinct().count()
    ids = [r["emp_no"] for r in spark.sql(bridge.SRC_A.replace("FROM customer", f"FROM {keys}")).collect()]
    assert len(set(ids)) == 8 and {"E000001", "E1499999", "E97000012"} <= set(ids)


def test_delivery_events_tell_what_happened(spark):
    codes = {"a": [503, 201], "b": [422], "c": [503, 503, 503], "d": [503, 503, 503], "e": [201], "f": [503, 503, 503], "g": [201]}
    rows, n = [], 0
    for record, tries in codes.items():
        for attempt, code in enumerate(tries, 1):
            rows.append((n := n + 1, "r", record, attempt, code))
    rows.append((99, "other", "a", 1, 201))
    df = spark.createDataFrame(rows, "id long, run_id string, record_id string, attempt int, http_status int")
    made = ledger.number_events(delivery.delivery_events(df, "r", limit=2, batch_size=3)).collect()
    told = sorted((r.type, r.entity_id, r.field) for r in made)
    assert [t for t in told if t[0] in ("PUSH_SUCCEEDED", "PUSH_FAILED", "BATCH_ROLLED_BACK")] == [
        ("PUSH_FAILED", "b", None), ("PUSH_FAILED", "c", None), ("PUSH_FAILED", "d", None), ("PUSH_SUCCEEDED", "a", None)]
    assert ("PUSH_RETRIED", "a", "1") in told and sum(t[0] == "PUSH_ATTEMPT" for t in told) == 9 and sum(t[0] == "PUSH_RETRIED" for t in told) == 5
    rolled = ledger.number_events(delivery.delivery_events(df, "r", limit=2, batch_size=4)).filter("type = 'BATCH_ROLLED_BACK'").collect()
    assert [(r.entity_id, r.after, r.actor) for r in rolled] == [("0", "1", "system")]
