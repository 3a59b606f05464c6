"""Review items: what the run could not decide, grouped; and what people decided.

A finding is one affected thing (a column, a row, a record) under a group
key. Items keep a count of what they affect; who is affected stays a table of
its own, so an item that touches a third of all rows is still one short row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tributary.contract import Contract
from tributary.operators import graph
from tributary.operators.entity import canonical_key
from tributary.operators.ledger import as_json
from tributary.operators.skew import count_keys, hot_keys, salted_join
from tributary.session import shuffled

# Item types, and which of them concern columns rather than records.
ITEM_TYPES = ("MAPPING_AMBIGUITY", "CONFIRM_SENSITIVE_MAPPINGS", "DATE_FORMAT_AMBIGUOUS", "ENUM_VALUE_AMBIGUOUS",
              "SENSITIVE_FIELD_CONFLICT", "NEAR_DUPLICATE_RECORD", "VALIDATION_FAILED_TWICE", "PUSH_REJECTED_4XX",
              "TARGET_OUTAGE_HALT", "IDENTITY_CONFLICT")
REENTERING = ("VALIDATION_FAILED_TWICE", "PUSH_REJECTED_4XX")
COLUMN_LEVEL = ("MAPPING_AMBIGUITY", "CONFIRM_SENSITIVE_MAPPINGS", "DATE_FORMAT_AMBIGUOUS", "ENUM_VALUE_AMBIGUOUS")


def findings(df: DataFrame, *, run_id: str, type: str, group_key: Column, affected: Column, context: Column,
             proposal: Column | None = None, order: Column | None = None) -> DataFrame:
    """(run_id, type, group_key, affected_id, context, proposal, seq)."""
    if type not in ITEM_TYPES:
        raise ValueError(f"unknown item type {type}")
    return df.select(
        F.lit(run_id).alias("run_id"), F.lit(type).alias("type"), group_key.alias("group_key"),
        affected.cast("string").alias("affected_id"), context.alias("context"),
        (F.lit(None).cast("string") if proposal is None else proposal).alias("proposal"),
        (F.lit(0) if order is None else order).cast("long").alias("seq"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def items(found: DataFrame) -> DataFrame:
    """One pending item per (run, group key); the first finding gives context and proposal."""
    opened = found.groupBy("run_id", "group_key").agg(
        F.min(F.struct("seq", "affected_id", "type", "context", "proposal")).alias("f"))
    affected = members(found).groupBy("run_id", "group_key").agg(F.count(F.lit(1)).alias("affected_count"))
    return (opened.join(shuffled(affected), ["run_id", "group_key"])
            .select("run_id", "group_key", F.col("f.type").alias("type"), F.lit("pending").alias("status"),
                    F.col("f.context").alias("context"), F.col("f.proposal").alias("proposal"), "affected_count"))


def members(found: DataFrame) -> DataFrame:
    """Distinct (run_id, group_key, affected_id)."""
    return found.select("run_id", "group_key", "affected_id").distinct()


# -- findings of each stage ------------------------------------------------------------------

def mapping_findings(decisions: DataFrame, run_id: str) -> DataFrame:
    unclear = decisions.filter(F.col("decision") == "AMBIGUOUS")
    return findings(
        unclear, run_id=run_id, type="MAPPING_AMBIGUITY",
        group_key=F.concat_ws("/", F.lit("column"), "source", "column"),
        affected=F.concat_ws(":", "source", "column"),
        context=as_json(file=F.col("source"), column=F.col("column"), runner_up=F.col("runner_up"), margin=F.col("margin")),
        proposal=as_json(target_field=F.col("target_field"), confidence=F.col("score")))


def sensitive_findings(columns: DataFrame, run_id: str, client_id: str) -> DataFrame:
    text = F.concat(F.col("source"), F.lit("."), F.col("column"), F.lit(" -> "), F.col("mapped_to"))
    return findings(
        columns, run_id=run_id, type="CONFIRM_SENSITIVE_MAPPINGS", group_key=F.lit(f"sensitive/{client_id}"),
        affected=text, context=as_json(first=text), proposal=as_json(answers=F.lit("approve, reject")))


def date_findings(orders: DataFrame, run_id: str) -> DataFrame:
    unclear = orders.filter(F.col("date_order") == "AMBIGUOUS")
    return findings(
        unclear, run_id=run_id, type="DATE_FORMAT_AMBIGUOUS",
        group_key=F.concat_ws("/", F.lit("dates"), "source", "column"),
        affected=F.concat_ws(":", "source", "column"),
        context=as_json(file=F.col("source"), column=F.col("column")),
        proposal=as_json(order=F.lit("DMY")))


def enum_findings(unrecognized: DataFrame, run_id: str, proposal: Column | None = None) -> DataFrame:
    raw = F.upper("value")
    return findings(
        unrecognized, run_id=run_id, type="ENUM_VALUE_AMBIGUOUS",
        group_key=F.concat(F.lit("value/"), F.col("fingerprint")),
        affected=F.concat(F.col("source"), F.lit(":row_"), F.col("row_num").cast("string")),
        context=as_json(field=F.col("field"), raw_value=raw), proposal=proposal, order=F.col("seq"))


def conflict_findings(sensitive: DataFrame, run_id: str) -> DataFrame:
    return findings(
        sensitive, run_id=run_id, type="SENSITIVE_FIELD_CONFLICT",
        group_key=F.concat_ws("/", F.lit("differs"), "canonical_key", "field"), affected=F.col("canonical_key"),
        context=as_json(field=F.col("field"), kept_source=F.col("kept_source"), kept_value=F.col("kept_value"),
                        other_source=F.col("other_source"), other_value=F.col("other_value")),
        proposal=as_json(source=F.col("kept_source"), canonical_value=F.col("kept_value")))


def near_dup_findings(groups: DataFrame, group_members: DataFrame, run_id: str) -> DataFrame:
    key = ["date_of_birth", "name_a", "name_b"]
    hot = hot_keys(groups.withColumn("n", F.col("entities_a") + F.col("entities_b")), key)
    rows = salted_join(group_members, groups, key, hot, "canonical_key")
    return findings(
        rows, run_id=run_id, type="NEAR_DUPLICATE_RECORD",
        group_key=F.concat_ws("/", F.lit("alike"), "date_of_birth", "name_a", "name_b"),
        affected=F.col("canonical_key"),
        context=as_json(name_a=F.col("name_a"), name_b=F.col("name_b"), similarity=F.col("similarity"),
                        born=F.col("date_of_birth")),
        proposal=as_json(answers=F.lit("merge, separate")))


def validation_findings(checked: DataFrame, run_id: str) -> DataFrame:
    failed = checked.filter(F.col("outcome") == "quarantined")
    only_error = F.when(F.size("errors") == 1, F.substring_index(F.col("errors")[0], ":", -1))
    return findings(
        failed, run_id=run_id, type="VALIDATION_FAILED_TWICE",
        group_key=F.concat(F.lit("fails/"), F.col("canonical_key")), affected=F.col("canonical_key"),
        context=as_json(field=only_error, errors=F.col("errors")),
        proposal=as_json(answers=F.lit("correct, reject")))


def identity_findings(conflicting: DataFrame, run_id: str) -> DataFrame:
    return findings(
        conflicting, run_id=run_id, type="IDENTITY_CONFLICT",
        group_key=F.concat_ws("/", F.lit("ids"), "canonical_key"), affected=F.col("canonical_key"),
        context=as_json(first_id=F.col("first_id"), last_id=F.col("last_id")))


# -- run control -----------------------------------------------------------------------------

def source_rows(staged: DataFrame, links: DataFrame, merged: DataFrame) -> DataFrame:
    """(affected_id, seq): the source rows behind each id a finding may name, a row or a record."""
    rows = staged.select(F.concat(F.col("source"), F.lit(":row_"), F.col("row_num").cast("string")).alias("affected_id"), "seq")
    entities = merged.select("entity_seq", F.col("canonical_key").alias("affected_id"), F.col("row_count").alias("n"))
    hot = hot_keys(entities, ["entity_seq"])
    return rows.unionByName(salted_join(links, entities.drop("n"), ["entity_seq"], hot, "seq").select("affected_id", "seq"))


def breaker(found: DataFrame, total_rows: Column, max_groups: int = 20, max_ratio: float = 0.30,
            rows_of: DataFrame | None = None) -> DataFrame:
    """Per run: group count, affected row ratio, and whether either limit is exceeded.

    ``rows_of`` (affected_id, seq) says which source rows an affected id stands
    for; without it each id counts as one row. Distinct rows are counted as set
    bits: tasks turn the numbers they meet into bitmaps of neighbouring numbers,
    and only bitmaps are shuffled.
    """
    per_group = found.groupBy("run_id", "group_key").agg(F.lit(1).alias("one"))
    groups = per_group.groupBy("run_id").agg(F.count("one").alias("group_count"))
    touched = (found.filter(~F.col("type").isin("MAPPING_AMBIGUITY", "CONFIRM_SENSITIVE_MAPPINGS", "DATE_FORMAT_AMBIGUOUS"))
               .select("run_id", "affected_id").distinct())
    if rows_of is not None:
        hot = hot_keys(count_keys(rows_of, ["affected_id"]), ["affected_id"])
        rows = distinct_numbers(salted_join(rows_of, touched, ["affected_id"], hot, "seq"), "run_id", "seq", "affected_rows")
    else:
        rows = touched.groupBy("run_id").agg(F.count(F.lit(1)).alias("affected_rows"))
    out = groups.join(rows, "run_id", "left").withColumn("affected_rows", F.coalesce("affected_rows", F.lit(0)))
    out = out.withColumn("affected_ratio", F.round(F.col("affected_rows") / total_rows, 4))
    return out.withColumn("tripped", (F.col("group_count") > max_groups) | (F.col("affected_ratio") > max_ratio))


def distinct_numbers(rows: DataFrame, by: str, number: str, name: str) -> DataFrame:
    """(by, name): how many different whole numbers, 0 or more, each group has; exact, by bitmaps of 32768 numbers."""
    n = F.col(number) + 1  # buckets count from 1
    bitmaps = rows.groupBy(by, F.bitmap_bucket_number(n).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias("_bits"))
    return bitmaps.groupBy(by).agg(F.sum(F.bitmap_count("_bits")).alias(name))


def queue_order() -> list[Column]:
    """Pending items first, newest first within a status."""
    return [F.asc("status"), F.desc("created_at"), F.asc("group_key")]


def queue(item_rows: DataFrame) -> DataFrame:
    return item_rows.orderBy(*queue_order())


def run_gate(runs: DataFrame, item_rows: DataFrame, breaker_rows: DataFrame | None = None) -> DataFrame:
    """Per run: halted when the breaker tripped, paused while an item is pending, else completed."""
    pending = item_rows.groupBy("run_id").agg(F.count_if(F.col("status") == "pending").alias("pending_items"))
    out = runs.select("run_id").join(pending, "run_id", "left") \
              .withColumn("pending_items", F.coalesce("pending_items", F.lit(0)))
    state = F.when(F.col("pending_items") > 0, "paused").otherwise("completed")
    if breaker_rows is not None:
        out = out.join(breaker_rows.select("run_id", "tripped"), "run_id", "left")
        return out.withColumn("run_status", F.when(F.coalesce("tripped", F.lit(False)), "halted").otherwise(state)).drop("tripped")
    return out.withColumn("run_status", state)


# -- decisions -------------------------------------------------------------------------------

def resolve(item_rows: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Items with their resolution columns; resolved items change status.

    resolutions: (run_id, group_key, action, field, value, remember, resolved_at)
    with action approve, correct or reject.
    """
    return (item_rows.join(shuffled(resolutions), ["run_id", "group_key"], "left")
            .withColumn("status", F.when(F.col("action").isNotNull(), "resolved").otherwise(F.col("status"))))


def apply_resolutions(canonical: DataFrame, resolved: DataFrame, item_members: DataFrame,
                      contract: Contract) -> DataFrame:
    """Overlay decided values on canonical records and set their status.

    Record-level items only: a correction sets the named field (or the field
    the item is about), an approval sets the proposed value, a rejection
    rejects the record. Records that failed checks or were refused by the
    target re-enter as ``ready``; other items leave the status alone.
    ``value = 'merge'`` on a near duplicate folds its records into one (see
    ``merge_records``). Each record gets at most one value per field.
    """
    decided = resolved.filter((F.col("status") == "resolved") & ~F.col("type").isin(*COLUMN_LEVEL))
    field = F.coalesce("field", F.get_json_object("context", "$.field"))
    chosen = F.when(F.col("action") == "correct", F.col("value")) \
              .when(F.col("action") == "approve", F.get_json_object("proposal", "$.canonical_value"))
    overlay = F.col("type") != "NEAR_DUPLICATE_RECORD"
    group, hot = ["run_id", "group_key"], hot_keys(decided, ["run_id", "group_key"], "affected_count")
    facts = (salted_join(item_members, decided, group, hot, "affected_id")
             .select("run_id", canonical_key(F.col("affected_id")).alias("canonical_key"), "group_key", "type", "action",
                     "value", F.when(overlay, field).alias("field"), F.when(overlay, chosen).alias("chosen"), "resolved_at"))
    latest = (facts.filter(F.col("field").isNotNull() & F.col("chosen").isNotNull() & F.col("field").isin(*contract.names))
              .groupBy("run_id", "canonical_key", "field")
              .agg(F.max(F.struct("resolved_at", "group_key", "chosen")).alias("v")))
    values = latest.groupBy("run_id", "canonical_key").agg(
        F.map_from_entries(F.collect_list(F.struct("field", F.col("v.chosen")))).alias("_values"))
    outcome = facts.groupBy("run_id", "canonical_key").agg(
        F.max(F.col("action") == "reject").alias("_rejected"),
        F.count_if((F.col("action") != "reject") & F.col("type").isin(*REENTERING)).alias("_accepted"))
    key = ["run_id", "canonical_key"]
    out = canonical.join(shuffled(values), key, "left").join(shuffled(outcome), key, "left")
    cells = [F.coalesce(F.element_at("_values", F.lit(n)), F.col(n)).alias(n) for n in contract.names]
    status = F.when(F.col("_rejected"), "rejected").when(F.col("_accepted") > 0, "ready").otherwise(F.col("status"))
    rest = [c for c in canonical.columns if c not in (*key, *contract.names, "status")]
    if "provenance" in rest:
        said = F.transform_values(F.coalesce("_values", F.create_map().cast("map<string,string>")), lambda k, v: F.lit("review"))
        rest[rest.index("provenance")] = F.map_concat(F.map_filter("provenance", lambda k, v: ~F.map_contains_key(said, k)), said).alias("provenance")
    overlaid = out.select(*key, *cells, status.alias("status"), *rest)
    return merge_records(overlaid, merge_groups(resolved, item_members), contract).select(*canonical.columns)


def merge_groups(resolved: DataFrame, item_members: DataFrame) -> DataFrame:
    """(run_id, canonical_key, keep): records that decisions put together, and the first key of those that hang together.

    Groups overlap: whoever merges a with b and b with c has merged all three.
    """
    group = ["run_id", "group_key"]
    decided = resolved.filter((F.col("status") == "resolved") & (F.col("type") == "NEAR_DUPLICATE_RECORD") & (F.col("value") == "merge") & (F.col("action") != "reject"))
    hot = hot_keys(decided, group, "affected_count")
    members_of = salted_join(item_members, decided.select(*group), group, hot, "affected_id").select(
        *group, F.struct("run_id", canonical_key(F.col("affected_id")).alias("canonical_key")).alias("node"))
    first = members_of.groupBy(*group).agg(F.min("node").alias("first"))
    pairs = salted_join(members_of, first, group, hot, "node").select("node", "first")
    return graph.connected(pairs, "node", "first").select("node.run_id", "node.canonical_key", F.col("group.canonical_key").alias("keep"))


def merge_records(records: DataFrame, groups: DataFrame, contract: Contract) -> DataFrame:
    """Each group's records as one: that of its first key present, whose blanks are filled from the others in the order of their keys.

    Provenance goes with the values, row counts add up; everything else is the
    first record's. Each field is one minimum, combined before the shuffle.
    """
    key = ["run_id", "canonical_key"]
    rest = [c for c in records.columns if c not in (*key, *contract.names, "provenance", "row_count")]
    placed = records.join(shuffled(groups), key, "left")
    alone = placed.filter("keep IS NULL").drop("keep")
    origin = {n: F.element_at("provenance", F.lit(n)) if "provenance" in records.columns else F.lit(None).cast("string") for n in contract.names}
    cells = [F.min(F.when(F.trim(F.col(n)) != "", F.struct("canonical_key", F.col(n).alias("value"), origin[n].alias("origin")))).alias(f"_{n}") for n in contract.names]
    counts = [F.sum("row_count").alias("row_count")] if "row_count" in records.columns else []
    folded = placed.filter("keep IS NOT NULL").groupBy("run_id", "keep").agg(
        F.min("canonical_key").alias("canonical_key"), *cells, *counts, F.min_by(F.struct(*rest), "canonical_key").alias("_rest"))
    out = [*key, *[F.col(f"_{n}.value").alias(n) for n in contract.names], *[F.col(f"_rest.{c}").alias(c) for c in rest]]
    if "provenance" in records.columns:
        known = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), F.col(f"_{n}.origin").alias("value")) for n in contract.names]), lambda e: e["value"].isNotNull())
        out.append(F.map_from_entries(known).alias("provenance"))
    if counts:
        out.append(F.col("row_count"))
    return alone.select(*records.columns).unionByName(folded.select(*out).select(*records.columns))


def merged_by_people(groups: DataFrame) -> DataFrame:
    """(run_id, canonical_key, merged_key): which record took which one up, for the ledger."""
    return groups.filter(F.col("canonical_key") != F.col("keep")).select("run_id", F.col("keep").alias("canonical_key"), F.col("canonical_key").alias("merged_key"))


def withheld_keys(item_rows: DataFrame, item_members: DataFrame) -> DataFrame:
    """Records in a pending record-level item; they are not delivered yet."""
    group = ["run_id", "group_key"]
    pending = item_rows.filter((F.col("status") == "pending") & ~F.col("type").isin(*COLUMN_LEVEL))
    hot = hot_keys(pending, group, "affected_count")
    return (salted_join(item_members, pending.select(*group), group, hot, "affected_id", "left_semi")
            .select("run_id", canonical_key(F.col("affected_id")).alias("canonical_key")).distinct())
