"""A saved run taken up again: decisions applied to the records they concern, everything else left where it is.

A run is saved as tables under one folder, each in steps: step 0 holds all
rows, a later step only rows that changed. The latest step of a row counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tributary.contract import Contract
from tributary.functions import dates
from tributary.operators import entity, ledger, mapping, near_dup, review, rules, staging
from tributary.operators.skew import hot_keys, lookup, salted_join
from tributary.plans.migrate import Migration, Options, check_records
from tributary.session import materialize, shuffled
from tributary.sources.readers import ROW_NUM

#: Tables of a saved run and what tells their rows apart; those without a key never change.
KEYS = {"staged": ["seq"], "links": [], "decisions": [], "checked": ["entity_seq"], "records": ["entity_seq"], "items": ["run_id", "group_key"],
        "members": ["run_id", "group_key", "affected_id"]}
_SAID = {"action": "string", "field": "string", "value": "string", "remember": "boolean", "resolved_at": "timestamp"}


def _with_status(checked: DataFrame, run_id: str) -> DataFrame:
    return checked.withColumns({"run_id": F.lit(run_id), "status": F.when(F.col("outcome") == "valid", "ready").otherwise("quarantined")})


def _write(df: DataFrame, path: str, table: str, step: int) -> None:
    """A step is written anew when a resume is run again after a failure."""
    df.write.mode("overwrite").parquet(f"{path}/{table}/step={step}")


def save(run: Migration, path: str, run_id: str) -> None:
    """Keep what a later resume needs."""
    records = _with_status(run.checked, run_id)
    items = run.items.withColumns({name: F.lit(None).cast(kind) for name, kind in _SAID.items()})
    tables = {"staged": run.staged, "links": run.links, "decisions": run.decisions, "checked": records,
              "records": records.withColumn("live", F.lit(True)), "items": items, "members": run.members}
    for name, df in tables.items():
        _write(df, path, name, 0)


@dataclass(frozen=True)
class SavedRun:
    spark: SparkSession
    path: str

    def _steps(self, name: str) -> DataFrame:
        return shuffled(self.spark.read.parquet(f"{self.path}/{name}"))

    def last_step(self) -> int:
        return self._steps("items").agg(F.max("step")).first()[0]

    def table(self, name: str, before: int | None = None) -> DataFrame:
        """The rows of a table as of its last step, or of the last before ``before``; changed rows are looked up, the others stay as they are."""
        rows = self._steps(name)
        if before is not None:
            rows = rows.filter(F.col("step") < before)
        if not KEYS[name]:
            return rows.drop("step")
        later = rows.filter("step > 0").groupBy(*KEYS[name]).agg(F.max("step").alias("_last"))
        return shuffled(rows.join(later, KEYS[name], "left").filter(F.col("step") == F.coalesce("_last", F.lit(0))).drop("step", "_last"))

    def records(self) -> DataFrame:
        return self.table("records").filter("live").drop("live")

    def deliverable(self) -> DataFrame:
        """Ready records that no pending item holds back."""
        held = review.withheld_keys(self.table("items"), self.table("members")).select("canonical_key")
        return self.records().filter("status = 'ready'").join(held, "canonical_key", "left_anti")

    def gate(self) -> DataFrame:
        items = self.table("items")
        return review.run_gate(items.select("run_id").distinct(), items)


@dataclass(frozen=True)
class Resumed:
    """What a resume did: the step it wrote, the rules that follow, and its events."""

    run: SavedRun
    step: int
    rules: DataFrame
    touched: DataFrame
    gate: DataFrame
    events: list[DataFrame]

    def ledger(self, first_id: int) -> DataFrame:
        return ledger.number_events(self.events, first_id=first_id)


def resume(saved: SavedRun, resolutions: DataFrame, contract: Contract, sources: dict[str, DataFrame], options: Options = Options(), step: int | None = None) -> Resumed:
    """Apply decisions to a saved run and write what they change as its next step.

    resolutions: (run_id, group_key, action, field, value, remember, resolved_at) on pending items; others are left aside.
    Remembered enum and date decisions change cells, the entities of those rows are merged and checked again, and near
    duplicates are looked for anew where a birth date changed. Decisions on records, these and earlier ones, are applied
    to every entity in reach: those changed and all that merges tie to them. No other row is written. The result is that of a
    full run with the new rules whose records get the same decisions.

    A mapping decision gives a source other columns and so other entities; it takes a full run, and is refused here.
    ``step`` repeats a step that was not finished.
    """
    step = saved.last_step() + 1 if step is None else step
    items, members = (materialize(saved.table(name, before=step), name) for name in ("items", "members"))
    pending = items.filter("status = 'pending'").drop(*_SAID)
    decided = materialize(review.resolve(pending, resolutions).filter("status = 'resolved'"), "decided")
    if not decided.filter((F.col("type") == "MAPPING_AMBIGUITY") & (F.col("action") != "reject")).isEmpty():
        raise ValueError("a mapping decision changes a whole source: run the migration again with its rule")
    learned = materialize(rules.synthesize(decided, options.client_id), "rules")

    # cells, rows, entities
    staged, links = saved.table("staged", before=step), saved.table("links")
    cells = materialize(_changed_cells(staged, mapping.accepted(saved.table("decisions")), learned, contract, sources), "cells")
    by_row = cells.groupBy("seq").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_new"))  # a contract's fields at most
    changed = staged.join(by_row, "seq").select(*[
        F.when(F.map_contains_key("_new", F.lit(c)), F.element_at("_new", F.lit(c))).otherwise(F.col(c)).alias(c) if c in contract else F.col(c) for c in staged.columns])
    changed = materialize(changed, "changed")
    again = materialize(links.join(changed.select("seq"), "seq", "left_semi").select("entity_seq").distinct(), "again")
    sub_links = materialize(links.join(again, "entity_seq", "left_semi"), "links")
    kept = staged.join(sub_links.select("seq"), "seq", "left_semi").join(changed.select("seq"), "seq", "left_anti")
    sub_staged = materialize(kept.unionByName(changed), "staged")
    merged = materialize(entity.merge(sub_staged, sub_links, contract, list(options.precedence or sources)), "merged")
    checked = materialize(_with_status(check_records(staging.unrecognized_enums(sub_staged, contract), sub_links, merged, contract, options), options.run_id), "checked")

    # everyone whom a decision concerns, now or through an earlier merge
    old = saved.table("checked", before=step)
    was = old.join(again, "entity_seq", "left_semi").select("canonical_key")
    said = items.filter("status = 'resolved'").unionByName(decided.select(items.columns))
    record_level = decided.filter(~F.col("type").isin(*review.COLUMN_LEVEL))
    about = salted_join(members, record_level.select("run_id", "group_key"), ["run_id", "group_key"], hot_keys(record_level, ["run_id", "group_key"], "affected_count"), "affected_id")
    keys = checked.select("canonical_key").unionByName(was).unionByName(about.select(entity.canonical_key(F.col("affected_id")).alias("canonical_key"))).distinct()
    groups = materialize(review.merge_groups(said, members), "merge_groups")
    tied = groups.join(groups.join(keys, "canonical_key", "left_semi").select("run_id", "keep").distinct(), ["run_id", "keep"], "left_semi")
    keys = materialize(keys.unionByName(tied.select("canonical_key")).distinct(), "keys")
    pool = old.join(again, "entity_seq", "left_anti").join(keys, "canonical_key", "left_semi").unionByName(checked)
    pool = materialize(pool, "pool")
    live = materialize(review.apply_resolutions(pool, said, members, contract), "live")
    gone = pool.join(live.select("entity_seq"), "entity_seq", "left_anti")
    records = live.withColumn("live", F.lit(True)).unionByName(gone.withColumn("live", F.lit(False)))

    found = materialize(_findings(cells, sub_staged, sub_links, merged, checked, old, again, options, contract), "findings")
    new_items, open_items = _items_after(found, items, decided, checked, was, members)
    open_items = materialize(open_items, "items")
    new_members = review.members(found).join(new_items.select("run_id", "group_key"), ["run_id", "group_key"], "left_semi")

    _write(changed, saved.path, "staged", step)
    _write(checked, saved.path, "checked", step)
    _write(records, saved.path, "records", step)
    _write(new_members, saved.path, "members", step)
    _write(open_items, saved.path, "items", step)  # last: its step is the run's
    gate = saved.gate()
    return Resumed(saved, step, learned, live.select("entity_seq", "canonical_key"), gate,
                   _events(options, decided, learned, cells, review.merged_by_people(groups.join(keys, "canonical_key", "left_semi")), gate))


def _changed_cells(staged: DataFrame, plan: dict[str, dict[str, str]], learned: DataFrame, contract: Contract, sources: dict[str, DataFrame]) -> DataFrame:
    """(seq, field, before, value) of the staged cells that the new rules give another value."""
    by_word = rules.current(learned, "enum_value").select("fingerprint", F.get_json_object("action", "$.canonical_value").alias("canonical"))
    words = lookup(staging.unrecognized_enums(staged, contract), by_word, "fingerprint", "seq").filter("canonical IS NOT NULL")
    out = words.select("seq", "field", F.col("value").alias("before"), F.col("canonical").alias("value"))
    order = {name: i for i, name in enumerate(sources)}
    for rule in rules.current(learned, "date_format").collect():  # one for a source column
        source, column = rule["fingerprint"].split(":", 1)
        field = plan.get(source, {}).get(column)
        if field not in contract or source not in sources:
            continue
        read = F.get_json_object(F.lit(rule["action"]), "$.format")
        dated = sources[source].select(staging.sequence_number(order[source], F.col(ROW_NUM)).alias("seq"), dates.to_iso(F.col(f"`{column}`"), read).alias("value"))
        met = staged.select("seq", F.col(field).alias("before")).join(dated, "seq").filter(~F.col("before").eqNullSafe(F.col("value")))
        out = out.unionByName(met.select("seq", F.lit(field).alias("field"), "before", "value"))
    return out


def _findings(cells, sub_staged, sub_links, merged, checked, old, again, options: Options, contract: Contract) -> DataFrame:
    """What there is to review about the entities that changed."""
    run = options.run_id
    parts = [review.validation_findings(checked, run), review.conflict_findings(entity.sensitive_conflicts(sub_staged, sub_links, merged, contract), run)]
    if not cells.filter(F.col("field") == "date_of_birth").isEmpty():
        days = materialize(merged.select("date_of_birth").filter("date_of_birth IS NOT NULL").distinct(), "days")
        columns = ["entity_seq", "canonical_key", "first_name", "last_name", "date_of_birth"]
        same_day = old.join(again, "entity_seq", "left_anti").select(columns).unionByName(merged.select(columns)).join(days, "date_of_birth", "left_semi")
        same_day = materialize(same_day, "same_day")
        near = materialize(near_dup.near_duplicates(same_day, options.near_dup_threshold), "near_dups")
        parts.append(review.near_dup_findings(near, near_dup.near_duplicate_members(same_day, near), run))
    return review.union_all(parts)


def _items_after(found, items, decided, checked, was, members) -> tuple[DataFrame, DataFrame]:
    """(new items, all items of this step): those decided, those newly found, and those whose cause is gone."""
    group = ["run_id", "group_key"]
    new = review.items(found).join(items.select(*group), group, "left_anti")
    blank = new.withColumns({name: F.lit(None).cast(kind) for name, kind in _SAID.items()})
    about = members.select(*group, entity.canonical_key(F.col("affected_id")).alias("canonical_key"))
    theirs = about.join(was.unionByName(checked.select("canonical_key")).distinct(), "canonical_key", "left_semi").select(*group).distinct()
    stale = (items.filter((F.col("status") == "pending") & F.col("type").isin("VALIDATION_FAILED_TWICE", "SENSITIVE_FIELD_CONFLICT")).join(theirs, group, "left_semi")
             .join(found.select(*group).distinct(), group, "left_anti").join(decided.select(*group), group, "left_anti").withColumn("status", F.lit("superseded")))
    return new, decided.select(items.columns).unionByName(blank.select(items.columns)).unionByName(stale)


def _events(options: Options, decided, learned, cells, merges, gate) -> list[DataFrame]:
    def emit(df: DataFrame, stage: str, type: str, actor: str, **parts: Column) -> DataFrame:
        return ledger.events(df, run_id=options.run_id, stage=stage, type=type, actor=actor, **parts)

    answer = ledger.as_json(action=F.col("action"), value=F.col("value"), remember=F.col("remember"))
    return [
        emit(decided, "escalation", "HUMAN_RESOLVED", "human", entity_type="escalation", entity_id=F.col("group_key"), escalation_id=F.col("group_key"),
             before=F.col("proposal"), after=answer, reason=F.col("type")),
        emit(learned, "rules", "RULE_CREATED", "human", entity_type="rule", entity_id=F.col("fingerprint"), field=F.col("kind"), after=F.col("action")),
        emit(cells, "normalize", "VALUE_NORMALIZED", "rule", entity_type="row", entity_id=F.col("seq"), field=F.col("field"), before=F.col("before"), after=F.col("value")),
        emit(merges, "reconcile", "RECORDS_MERGED", "human", entity_type="record", entity_id=F.col("canonical_key"), before=F.col("merged_key")),
        emit(gate.filter("run_status = 'completed'"), "complete", "RUN_COMPLETED", "agent", entity_type="run", entity_id=options.run_id)]
