"""A whole migration as one function of sources, contract and rules; ``resume`` applies decisions to a saved one."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from tributary.contract import Contract
from tributary.operators import entity, ledger, mapping, near_dup, profile, quality, review, staging
from tributary.operators.mapping import MappingOptions
from tributary.operators.rules import current, of_client
from tributary.operators.skew import lookup
from tributary.session import materialize
from tributary.sources.readers import ROW_NUM, data_columns


@dataclass(frozen=True)
class Options:
    run_id: str = "run"
    client_id: str = "client"
    precedence: tuple[str, ...] = ()  # best source first; the given source order when empty
    mapping: MappingOptions = field(default_factory=MappingOptions)
    default_date_order: str | None = None
    near_dup_threshold: float = near_dup.DEFAULT_THRESHOLD
    forbid_conflicting_ids: bool = True
    excuse_reviewed_enums: bool = True
    max_groups: int = 20
    max_ratio: float = 0.30
    phone_region: str = "IN"
    enum_threshold: float | None = None  # similarity in percent from which an unknown enum value is its nearest word; off by default
    check_dates: bool = False
    check_phones: bool = False


@dataclass(frozen=True)
class Migration:
    """Everything a run decided, as DataFrames."""

    profiles: DataFrame
    decisions: DataFrame
    date_orders: DataFrame | None
    staged: DataFrame
    links: DataFrame
    merged: DataFrame
    checked: DataFrame
    conflicts: DataFrame
    sensitive_conflicts: DataFrame
    near_duplicates: DataFrame
    findings: DataFrame
    items: DataFrame
    members: DataFrame
    breaker: DataFrame
    gate: DataFrame
    rule_applications: DataFrame
    events: list[DataFrame]

    def deliverable(self) -> DataFrame:
        """Valid records that no pending record-level item holds back; none while the breaker halts the run."""
        halted = self.gate.filter(F.col("run_status") == "halted").select(F.lit(1).alias("_halted"))
        held = review.withheld_keys(self.items, self.members).select("canonical_key")
        ready = self.checked.filter(F.col("outcome") == "valid").join(held, "canonical_key", "left_anti")
        return ready.join(F.broadcast(halted), how="left_anti")  # one row a run

    def ledger(self, first_id: int = 1) -> DataFrame:
        return ledger.number_events(self.events, first_id=first_id)


def migrate(sources: dict[str, DataFrame], contract: Contract, rules: DataFrame | None = None,
            options: Options = Options()) -> Migration:
    """Profile, map, normalize, link, merge and check the sources, and collect what needs review.

    The accepted mapping (one entry per source column) is the only result the
    driver looks at; rows never leave the executors. Rules from earlier
    resolutions are passed in, so a re-run with more rules decides more.
    """
    run = options.run_id
    sources = {name: materialize(df, "landed") for name, df in sources.items()}  # parsed once, read column by column from here on
    if rules is not None:  # other clients' decisions say nothing about these sources
        rules = of_client(rules, options.client_id)
    precedence = list(options.precedence or sources)
    profiles = materialize(profile.profile(list(sources.values()), contract), "profiles")
    decisions = materialize(mapping.decide(profiles, contract, rules, options.mapping), "decisions")
    plan = mapping.accepted(decisions)
    orders = staging.all_date_orders(sources, plan, contract, rules)
    orders = None if orders is None else materialize(orders, "date_orders")
    staged = materialize(
        staging.stage(sources, plan, contract, rules, options.default_date_order, options.phone_region, orders, options.enum_threshold), "staged")
    links = materialize(entity.link(staged, options.forbid_conflicting_ids), "links")
    merged = materialize(entity.merge(staged, links, contract, precedence), "merged")

    unrecognized = staging.unrecognized_enums(staged, contract)
    checked = materialize(check_records(unrecognized, links, merged, contract, options), "checked")

    conflicts = entity.conflicts(staged, links, merged, contract)
    sensitive = entity.sensitive_conflicts(staged, links, merged, contract)
    groups = materialize(near_dup.near_duplicates(merged, options.near_dup_threshold), "near_dups")
    group_members = near_dup.near_duplicate_members(merged, groups)
    keys = merged.select("entity_seq", "canonical_key")
    mixed = entity.identity_conflicts(staged, links).join(keys, "entity_seq")
    parts = [
        review.mapping_findings(decisions, run),
        review.sensitive_findings(mapping.sensitive_columns(decisions, contract, rules), run, options.client_id),
        review.enum_findings(unrecognized, run, F.to_json(mapping.enum_fallback(F.col("field"), F.col("value"), contract))),
        review.conflict_findings(sensitive, run),
        review.near_dup_findings(groups, group_members, run),
        review.identity_findings(mixed, run),
        review.validation_findings(checked, run),
    ]
    if orders is not None:
        parts.append(review.date_findings(orders, run))
    found = materialize(review.union_all(parts), "findings")
    items, members = review.items(found), review.members(found)
    total = staged.agg(F.count(F.lit(1))).scalar()
    tripped = review.breaker(found, total, options.max_groups, options.max_ratio,
                             review.source_rows(staged, links, merged))
    runs = staged.sparkSession.createDataFrame([(run,)], "run_id string")
    gate = review.run_gate(runs, items, tripped)
    applications = _applications(decisions, orders, sources, plan, contract, rules)
    return Migration(
        profiles=profiles, decisions=decisions, date_orders=orders, staged=staged, links=links, merged=merged,
        checked=checked, conflicts=conflicts, sensitive_conflicts=sensitive, near_duplicates=groups, findings=found,
        items=items, members=members, breaker=tripped, gate=gate,
        rule_applications=applications,
        events=_events(run, sources, profiles, decisions, orders, applications,
                       entity.merge_events(staged, links, merged), conflicts, checked, items, gate, tripped))


def check_records(unrecognized: DataFrame, links: DataFrame, merged: DataFrame, contract: Contract, options: Options) -> DataFrame:
    """Merged entities with repairs, errors and outcome."""
    excused = merged
    if options.excuse_reviewed_enums:
        # A value that already has its own item is not reported again on the record.
        fields = unrecognized.join(links, "seq").select("entity_seq", "field").distinct()
        under_review = fields.groupBy("entity_seq").agg(F.collect_set("field").alias("_excused"))
        excused = merged.join(under_review, "entity_seq", "left")
    return quality.ladder(excused, contract, check_dates=options.check_dates, check_phones=options.check_phones,
                          excused_enums=F.col("_excused") if options.excuse_reviewed_enums else None).drop("_excused")


def _applications(decisions, orders, sources, plan, contract, rules) -> DataFrame:
    """(kind, fingerprint, cell) of every use of a rule in this run."""
    column = F.concat_ws(":", "source", "column")
    used = decisions.filter(F.col("decided_by") == "rule").select(
        F.lit("mapping").alias("kind"), column.alias("fingerprint"), F.lit(None).cast("string").alias("cell"))
    if orders is not None:
        used = used.unionByName(orders.filter(F.col("decided_by") == "rule").select(
            F.lit("date_format").alias("kind"), column.alias("fingerprint"), F.lit(None).cast("string").alias("cell")))
    if rules is not None:
        enum_rules = current(rules, "enum_value").select("fingerprint", F.lit(1).alias("_hit"))
        for name, df in sources.items():
            for source_column, target in plan.get(name, {}).items():
                if target in contract and contract[target].type == "enum":
                    cell = F.concat_ws(":", F.lit(name), F.col(ROW_NUM).cast("string"), F.lit(source_column))
                    raw = df.select(F.concat(F.lit(target + ":"), F.upper(F.col(f"`{source_column}`"))).alias("fingerprint"),
                                    cell.alias("cell"))
                    used = used.unionByName(lookup(raw, enum_rules, "fingerprint", "cell").filter("_hit = 1").select(
                        F.lit("enum_value").alias("kind"), "fingerprint", "cell"))
    return used


def _events(run, sources, profiles, decisions, orders, applications, merges, conflicts, checked, items, gate, tripped) -> list[DataFrame]:
    def emit(df, stage, type, actor="agent", **parts):
        return ledger.events(df, run_id=run, stage=stage, type=type, actor=actor, **parts)

    column = F.concat_ws(":", "source", "column")
    out = [emit(gate, "run", "RUN_STARTED", entity_type="run", entity_id=run, after=ledger.as_json(sources=F.lit(",".join(sources)))),
           emit(tripped.filter("tripped"), "escalation", "CIRCUIT_BREAKER_TRIPPED", "system", entity_type="run", entity_id=run,
                after=ledger.as_json(groups=F.col("group_count"), affected_ratio=F.col("affected_ratio"))),
           emit(gate.filter("run_status = 'completed'"), "complete", "RUN_COMPLETED", entity_type="run", entity_id=run)]
    for name, df in sources.items():
        counted = df.agg(F.count(F.lit(1)).alias("n"))
        out.append(emit(counted, "ingest", "FILE_INGESTED", entity_type="file", entity_id=name,
                        after=ledger.as_json(rows=F.col("n"), columns=F.lit(",".join(data_columns(df))))))
    out.append(emit(profiles, "profile", "COLUMN_PROFILED", entity_type="column", entity_id=column, field=F.col("column"),
                    after=ledger.as_json(total=F.col("total_count"), distinct=F.col("distinct_count"), type=F.col("inferred_type"))))
    by = decisions.filter(F.col("decided_by") == "agent")
    mapped = by.filter(F.col("decision") == "ACCEPT")
    out.append(emit(mapped, "mapping", "MAPPING_ACCEPTED", entity_type="column", entity_id=column, field=F.col("column"),
                    after=F.col("mapped_to"), score=F.col("score")))
    open_ = by.filter(F.col("decision").isin("AMBIGUOUS", "DROP", "DUPLICATE_TARGET"))
    out.append(emit(open_, "mapping", "MAPPING_PROPOSED", entity_type="column", entity_id=column, field=F.col("column"),
                    after=F.col("target_field"), score=F.col("score"), reason=F.col("decision")))
    stage_of = {"mapping": "mapping", "date_format": "normalize", "enum_value": "normalize"}
    for kind, stage in stage_of.items():
        used = applications.filter(F.col("kind") == kind)
        out.append(emit(used, stage, "RULE_APPLIED", "rule", entity_type="rule", entity_id=F.col("fingerprint"),
                        field=F.lit(kind), before=F.col("cell")))
    if orders is not None:
        settled = orders.filter((F.col("decided_by") == "agent") & (F.col("date_order") != "AMBIGUOUS"))
        out.append(emit(settled, "normalize", "DATE_FORMAT_RESOLVED", entity_type="column", entity_id=column,
                        field=F.col("column"), after=F.col("date_order")))
    out.append(emit(merges, "reconcile", "RECORDS_MERGED", entity_type="record", entity_id=F.col("canonical_key"),
                    before=F.concat_ws(":", "source", F.col("row_num").cast("string")), reason=F.col("matched_by")))
    out.append(emit(conflicts, "reconcile", "CONFLICT_RESOLVED", "rule", entity_type="field",
                    entity_id=F.concat_ws(":", "canonical_key", "field"), field=F.col("field"),
                    before=F.col("losing_value"), after=F.col("winning_value"),
                    meta_json=ledger.as_json(winner_source=F.col("winning_source"), loser_source=F.col("losing_source"))))
    fixed = checked.filter(F.size("fixes") > 0)
    out.append(emit(fixed, "validate", "AUTOFIX_APPLIED", entity_type="record", entity_id=F.col("canonical_key"),
                    reason=F.array_join("fixes", ",")))
    failed = checked.filter(F.col("outcome") == "quarantined")
    out.append(emit(failed, "validate", "VALIDATION_FAILED", entity_type="record", entity_id=F.col("canonical_key"),
                    reason=F.array_join("errors", ",")))
    out.append(emit(items, "escalation", "ESCALATION_OPENED", entity_type="escalation", entity_id=F.col("group_key"),
                    escalation_id=F.col("group_key"), reason=F.col("type"), after=F.col("affected_count")))
    return out
