"""A saved run taken up again equals a full run with the same decisions, and writes only what they touch."""

import pytest
from pyspark.sql import functions as F

from tests import hr
from tributary.contract import employee_contract
from tributary.operators import ledger, mapping, review, rules
from tributary.plans.migrate import Options, migrate
from tributary.plans.resume import SavedRun, resume, save
from tributary.session import scratch_path

CONTRACT = employee_contract()
PRECEDENCE = ("master", "legacy", "payroll")
SAID = "run_id string, group_key string, action string, field string, value string, remember boolean"


def options(**more):
    return Options(run_id="run1", client_id="acme", precedence=PRECEDENCE, default_date_order="MDY", near_dup_threshold=85.0, **more)


@pytest.fixture(scope="module")
def run1(spark):
    return migrate(hr.sources(spark), CONTRACT, options=options())


def answers(spark, rows):
    return spark.createDataFrame([("run1", *r, True) for r in rows], SAID).withColumn("resolved_at", F.to_timestamp(F.lit("2024-01-01")))


def say(run, types):
    """One decision for each item of these types."""
    verdict = {"ENUM_VALUE_AMBIGUOUS": ("approve", None), "DATE_FORMAT_AMBIGUOUS": ("correct", "DMY"), "CONFIRM_SENSITIVE_MAPPINGS": ("approve", None),
               "SENSITIVE_FIELD_CONFLICT": ("correct", "77777"), "NEAR_DUPLICATE_RECORD": ("correct", "merge"), "VALIDATION_FAILED_TWICE": ("correct", "fixed@example.com")}
    return [(r.group_key, verdict[r.type][0], None, verdict[r.type][1]) for r in run.items.collect() if r.type in types]


def full(spark, run, said):
    """The records of a whole run with the rules that follow from the decisions, with the decisions on records applied."""
    decided = review.resolve(run.items, said)
    made = rules.upsert(mapping.empty_rules(spark), rules.synthesize(decided, "acme"))
    second = migrate(hr.sources(spark), CONTRACT, rules=made, options=options())
    status = F.when(F.col("outcome") == "valid", "ready").otherwise("quarantined")
    records = second.checked.withColumns({"run_id": F.lit("run1"), "status": status})
    return review.apply_resolutions(records, decided, run.members, CONTRACT)


def rows_of(records):
    columns = ["canonical_key", "entity_seq", *CONTRACT.names, "status", "row_count", "outcome", "errors"]
    return sorted((tuple(map(str, r[:-1])), sorted(r.provenance.items())) for r in records.select(*columns, "provenance").collect())


COLUMN = ("ENUM_VALUE_AMBIGUOUS", "DATE_FORMAT_AMBIGUOUS", "CONFIRM_SENSITIVE_MAPPINGS")
RECORD = ("SENSITIVE_FIELD_CONFLICT", "NEAR_DUPLICATE_RECORD", "VALIDATION_FAILED_TWICE")


@pytest.mark.parametrize("types", [COLUMN + RECORD, ("ENUM_VALUE_AMBIGUOUS", *RECORD)], ids=["all", "no dates"])
def test_resume_equals_a_full_run(spark, run1, types):
    path = scratch_path(spark, "saved")
    save(run1, path, "run1")
    said = answers(spark, say(run1, types))
    done = resume(SavedRun(spark, path), said, CONTRACT, hr.sources(spark), options())
    assert rows_of(SavedRun(spark, path).records()) == rows_of(full(spark, run1, said))
    # only what decisions touch is written
    written = spark.read.parquet(f"{path}/records/step=1")
    assert {r.entity_seq for r in done.touched.collect()} <= {r.entity_seq for r in written.collect()}
    if "DATE_FORMAT_AMBIGUOUS" not in types:
        assert 0 < written.count() <= 6 and spark.read.parquet(f"{path}/staged/step=1").count() == (2 if "ENUM_VALUE_AMBIGUOUS" in types else 0)
    assert spark.read.parquet(f"{path}/records/step=0").count() == 36


def test_steps_add_up(spark, run1):
    """Deciding one type after the other gives what deciding all at once gives; a step that is run again changes nothing."""
    path, at_once = scratch_path(spark, "saved"), scratch_path(spark, "saved")
    for p in (path, at_once):
        save(run1, p, "run1")
    run = SavedRun(spark, path)
    for step, types in enumerate([RECORD, COLUMN[:1], COLUMN[1:]], 1):
        done = resume(run, answers(spark, say(run1, types)), CONTRACT, hr.sources(spark), options())
        assert done.step == step
    assert run.last_step() == 3
    resume(run, answers(spark, say(run1, COLUMN[1:])), CONTRACT, hr.sources(spark), options(), step=3)
    together = resume(SavedRun(spark, at_once), answers(spark, say(run1, RECORD + COLUMN)), CONTRACT, hr.sources(spark), options())
    assert rows_of(run.records()) == rows_of(together.run.records())
    statuses = {(r.type, r.status) for r in run.table("items").collect()}
    assert ("NEAR_DUPLICATE_RECORD", "resolved") in statuses and ("MAPPING_AMBIGUITY", "pending") in statuses
    assert run.gate().first().run_status == "paused"  # the mapping is still open


def test_events_gate_and_refusals(spark, run1):
    path = scratch_path(spark, "saved")
    save(run1, path, "run1")
    run = SavedRun(spark, path)
    ambiguous = run1.items.filter("type = 'MAPPING_AMBIGUITY'").first().group_key
    with pytest.raises(ValueError, match="full run|run the migration again"):
        resume(run, answers(spark, [(ambiguous, "correct", None, "employee_id")]), CONTRACT, hr.sources(spark), options())
    done = resume(run, answers(spark, [*say(run1, COLUMN + RECORD), (ambiguous, "reject", None, None), ("no such item", "approve", None, None)]), CONTRACT, hr.sources(spark), options())
    events = done.ledger(first_id=500)
    kinds = {(r.type, r.actor): r["n"] for r in events.groupBy("type", "actor").agg(F.count(F.lit(1)).alias("n")).collect()}
    decided = run1.items.count()
    assert kinds["HUMAN_RESOLVED", "human"] == decided and kinds["RULE_CREATED", "human"] == 3 and kinds["RECORDS_MERGED", "human"] == 1
    assert kinds["VALUE_NORMALIZED", "rule"] >= 2 and kinds["RUN_COMPLETED", "agent"] == 1
    assert events.agg(F.min("id")).first()[0] == 500 and events.orderBy(F.desc("id")).first().type == "RUN_COMPLETED"
    assert done.gate.first().run_status == "completed"
    everything = ledger.number_events(run1.events + done.events)
    people = everything.filter("actor = 'human'").count() / everything.count()
    assert 0 < people < 1
    ready = {r.canonical_key for r in run.deliverable().collect()}
    assert "E1005" in ready and "E1012" in ready


def test_nothing_decided(spark, run1):
    path = scratch_path(spark, "saved")
    save(run1, path, "run1")
    before = rows_of(SavedRun(spark, path).records())
    done = resume(SavedRun(spark, path), answers(spark, []), CONTRACT, hr.sources(spark), options())
    assert rows_of(SavedRun(spark, path).records()) == before and done.touched.count() == 0
