"""Two runs over the planted HR exports: what is decided, what is asked, and what memory saves."""

import pytest
from pyspark.sql import functions as F

from tests import hr
from tributary.contract import employee_contract
from tributary.operators import mapping, review, rules
from tributary.operators.mapping import MappingOptions
from tributary.plans.migrate import Options, migrate

CONTRACT = employee_contract()
PRECEDENCE = ("master", "legacy", "payroll")


def options(run_id, **more):
    # the pseudo-parity settings: month-first for undecided dates, near-duplicate threshold 85, name matches always allowed
    return Options(run_id=run_id, client_id="acme", precedence=PRECEDENCE, default_date_order="MDY", near_dup_threshold=85.0,
                   forbid_conflicting_ids=False, excuse_reviewed_enums=False, **more)


def count_by_type(run):
    return {r["type"]: r["n"] for r in run.items.groupBy("type").agg(F.count(F.lit(1)).alias("n")).collect()}


@pytest.fixture(scope="module")
def run1(spark):
    return migrate(hr.sources(spark), CONTRACT, options=options("run1"))


@pytest.fixture(scope="module")
def learned(spark, run1):
    t, raw = F.col("type"), F.get_json_object("context", "$.raw_value")
    decided = run1.items.filter(t.isin(*review.COLUMN_LEVEL)).select(
        "run_id", "group_key", F.when(t == "MAPPING_AMBIGUITY", "correct").otherwise("approve").alias("action"),
        F.lit(None).cast("string").alias("field"), F.when(t == "MAPPING_AMBIGUITY", "employee_id").alias("value"),
        F.lit(True).alias("remember"), F.to_timestamp(F.lit("2024-01-01")).alias("resolved_at"))
    made = rules.synthesize(review.resolve(run1.items, decided), "acme")
    return rules.upsert(mapping.empty_rules(spark), made)


@pytest.fixture(scope="module")
def run2(spark, learned):
    return migrate(hr.sources(spark), CONTRACT, rules=learned, options=options("run2"))


def test_mapping_scores_and_decisions(run1):
    d = {(r.source, r.column): r for r in run1.decisions.collect()}
    golden = {
        ("master", "Emp No"): ("employee_id", 0.940, 0.275, "ACCEPT"), ("master", "First Name"): ("first_name", 0.865, 0.145, "ACCEPT"),
        ("master", "E-mail"): ("email", 0.875, 0.335, "ACCEPT"), ("master", "DOB"): ("date_of_birth", 0.925, 0.183, "ACCEPT"),
        ("master", "Join Date"): ("hire_date", 0.925, 0.203, "ACCEPT"), ("master", "Mgr"): ("manager_id", 0.940, 0.413, "ACCEPT"),
        ("master", "Salary"): ("salary", 0.925, 0.390, "ACCEPT"), ("payroll", "EmpID"): ("employee_id", 0.940, 0.250, "ACCEPT"),
        ("legacy", "phone"): ("phone", 0.775, 0.206, "ACCEPT"), ("legacy", "birth_date"): ("date_of_birth", 0.925, 0.145, "ACCEPT"),
        ("legacy", "status"): ("employment_status", 0.925, 0.374, "ACCEPT"), ("legacy", "ref"): ("job_title", 0.629, 0.056, "AMBIGUOUS"),
    }
    for key, (field, score, margin, decision) in golden.items():
        r = d[key]
        assert (r.target_field, r.score, r.decision) == (field, score, decision), key
        assert r.margin == pytest.approx(margin, abs=0.0011), key
    assert d[("payroll", "Full Name")].mapped_to == "full_name" and d[("legacy", "name")].mapped_to == "full_name"


def test_82_rows_become_36_entities(run1):
    assert run1.staged.count() == 82 and run1.merged.count() == 36
    assert run1.links.filter("matched_by <> 'seed'").count() == 46
    assert run1.merged.filter("canonical_key = 'E1020'").first().email == "tara.thakur@example.com"


def test_valid_and_quarantined(run1):
    counts = {r.outcome: r["n"] for r in run1.checked.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {"valid": 32, "quarantined": 4}


def test_precedence_settles_hire_dates(run1):
    lost = run1.conflicts.collect()
    assert len(lost) == 25 and {r.field for r in lost} == {"hire_date"}
    assert {r.winning_source for r in lost} == {"master"} and {r.losing_source for r in lost} == {"payroll"}


def test_first_run_asks_ten_questions(run1):
    assert count_by_type(run1) == {
        "MAPPING_AMBIGUITY": 1, "CONFIRM_SENSITIVE_MAPPINGS": 1, "DATE_FORMAT_AMBIGUOUS": 1, "ENUM_VALUE_AMBIGUOUS": 1,
        "SENSITIVE_FIELD_CONFLICT": 1, "NEAR_DUPLICATE_RECORD": 1, "VALIDATION_FAILED_TWICE": 4}
    by = {r.type: r for r in run1.items.collect()}
    assert by["CONFIRM_SENSITIVE_MAPPINGS"].affected_count == 4 and by["ENUM_VALUE_AMBIGUOUS"].affected_count == 2
    near = run1.near_duplicates.first()
    assert (near.name_a, near.name_b, near.similarity, near.date_of_birth) == ("rahul sharma", "rahul sherma", 91.7, "1992-05-14")
    clash = run1.sensitive_conflicts.first()
    assert (clash.canonical_key, clash.kept_value, clash.other_value) == ("E1005", "80000", "88000")


def test_reviewed_enums_are_not_reported_twice(spark):
    run = migrate(hr.sources(spark), CONTRACT, options=Options(
        run_id="r", client_id="acme", precedence=PRECEDENCE, default_date_order="MDY", near_dup_threshold=85.0))
    assert sum(count_by_type(run).values()) == 8


def test_rules_from_decisions(learned):
    made = {(r.kind, r.fingerprint): r.action for r in learned.collect()}
    assert made == {
        ("mapping", "legacy:ref"): '{"target_field":"employee_id"}', ("enum_value", "employment_status:LOA"): '{"canonical_value":"On Leave"}',
        ("date_format", "payroll:DOJ"): '{"format":"DMY"}', ("sensitive_mapping_confirmed", "all_sensitive"): '{"action":"approved"}'}


def test_second_run_asks_four(run1, run2):
    assert count_by_type(run2) == {"SENSITIVE_FIELD_CONFLICT": 1, "NEAR_DUPLICATE_RECORD": 1, "VALIDATION_FAILED_TWICE": 2}
    counts = {r.outcome: r["n"] for r in run2.checked.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {"valid": 34, "quarantined": 2}
    assert run2.conflicts.count() == 25
    delta = rules.run_delta(run1.items.unionByName(run2.items), "run1", "run2")
    assert delta.agg(F.sum("first_items"), F.sum("second_items")).first() == (10, 4)


def test_rule_uses_are_counted(learned, run2):
    used = {r.kind: r.times_applied for r in rules.count_applied(learned, run2.rule_applications).collect()}
    assert used == {"mapping": 1, "enum_value": 2, "date_format": 1, "sensitive_mapping_confirmed": 0}


def test_gate_breaker_and_held_back_records(run1):
    gate = run1.gate.first()
    assert (gate.pending_items, gate.run_status) == (10, "paused")
    assert run1.breaker.first().tripped is False
    keys = {r.canonical_key for r in run1.deliverable().collect()}
    assert "E1005" not in keys and "E1012" not in keys and "E1001" in keys


def test_ledger_of_a_run(run1):
    ledger = run1.ledger()
    ids = sorted(r.id for r in ledger.select("id").collect())
    assert ids == list(range(1, len(ids) + 1))
    types = {r["type"]: r["n"] for r in ledger.groupBy("type").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert types["RECORDS_MERGED"] == 46 and types["CONFLICT_RESOLVED"] == 25 and types["FILE_INGESTED"] == 3
    assert types["ESCALATION_OPENED"] == 10 and types["COLUMN_PROFILED"] == 23
    again = run1.ledger()
    columns = ["id", "type", "entity_id", "field", "before", "after"]
    assert ledger.select(columns).exceptAll(again.select(columns)).isEmpty()


def test_pilot_style_iso_dates_stay_put(spark):
    rows = [{"Emp No": f"E80{i:02d}", "First Name": hr.FIRST[i], "Last Name": hr.LAST[i], "E-mail": f"p{i}@example.com",
             "DOB": f"1988-{i:02d}-{12 + i}", "Join Date": f"2021-0{1 + i % 9}-15", "Dept": "Tech", "Status": "Active"} for i in range(1, 11)]
    run = migrate({"pilot": hr.frame(spark, rows, "pilot")}, CONTRACT, options=Options(run_id="p", client_id="acme"))
    assert run.merged.filter("canonical_key = 'E8003'").first().date_of_birth == "1988-03-15"
    assert run.checked.filter("outcome = 'valid'").count() == 10


def test_two_columns_for_one_target(spark):
    rows = [{"email": f"a{i}@x.com", "e-mail": f"b{i}@x.com", "notes": "free text"} for i in range(5)]
    from tributary.operators.profile import profile
    d = {r.column: r for r in mapping.decide(profile([hr.frame(spark, rows, "s")], CONTRACT), CONTRACT).collect()}
    assert d["email"].decision == "ACCEPT" and d["e-mail"].decision == "DUPLICATE_TARGET" and d["e-mail"].mapped_to is None
    assert d["notes"].mapped_to is None
    forced = mapping.decide(profile([hr.frame(spark, rows, "s")], CONTRACT), CONTRACT, options=MappingOptions(force_review=("notes",)))
    assert forced.filter("column = 'notes'").first().decision == "AMBIGUOUS"


def test_rules_of_another_client_do_nothing(spark, run1, learned):
    """Two clients hold the same fingerprints with other actions; rows neither change nor double."""
    other = learned.withColumn("client_id", F.lit("other")).withColumn("action", F.regexp_replace("action", "Leave|Active|DMY|MDY|employee_id", "Terminated"))
    mine = migrate(hr.sources(spark), CONTRACT, rules=learned, options=options("run2"))
    both = migrate(hr.sources(spark), CONTRACT, rules=learned.unionByName(other), options=options("run2"))
    assert both.staged.count() == mine.staged.count() == run1.staged.count()
    assert sorted(map(str, both.staged.collect())) == sorted(map(str, mine.staged.collect()))
    alone = migrate(hr.sources(spark), CONTRACT, rules=other, options=options("run2"))
    assert sorted(map(str, alone.staged.collect())) == sorted(map(str, run1.staged.collect()))
