"""Queries over review items, resolutions and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tributary.operators import entity, mapping, near_dup, review, rules, staging
from tributary.operators.ledger import as_json
from tributary.operators.ordering import ROW, number_rows
from tributary.plans import oracle as o
from tributary.plans.migrate import Options, migrate
from tributary.plans.registry import query
from tributary.plans.resume import Resumed, SavedRun, resume, save
from tributary.plans.source_queries import export_date_orders, export_profiles
from tributary.session import materialize, scratch_path
from tributary.sources import bridge as b

RUN, CLIENT = "run_0", "client"
_WHEN = "2024-02-01 00:00:00"


def column_evidence(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(profiles, date orders) of the exports, a row per column each, written once: no rule changes them, so every run decides from them."""
    return materialize(export_profiles(spark, sf), "profiles"), materialize(export_date_orders(spark, sf), "date_orders")


def column_findings(spark, sf, learned: DataFrame | None = None, run: str = RUN, evidence: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Everything undecided about columns and enum values of the exports, with the rules learned so far."""
    profiles, orders = evidence or column_evidence(spark, sf)
    if learned is not None:
        orders = staging.with_learned_orders(orders, learned)
    decisions = materialize(mapping.decide(profiles, b.CONTRACT, learned), "decisions")
    staged = staging.stage(b.exports(spark, sf), b.MAPPINGS, b.CONTRACT, learned, default_date_order=b.DATE_ORDER, orders=orders)
    unknown = staging.unrecognized_enums(staged, b.CONTRACT)
    guess = F.to_json(mapping.enum_fallback(F.col("field"), F.col("value"), b.CONTRACT))
    return materialize(review.union_all([
        review.mapping_findings(decisions, run),
        review.sensitive_findings(mapping.sensitive_columns(decisions, b.CONTRACT, learned), run, CLIENT),
        review.date_findings(orders, run),
        review.enum_findings(unknown, run, guess)]), "findings")


def record_findings(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(findings about records, the checked canonical records)."""
    return _record_findings(*b.merged(spark, sf))


def _record_findings(rows: DataFrame, links: DataFrame, merged: DataFrame) -> tuple[DataFrame, DataFrame]:
    canonical = materialize(b.canonical(merged), "canonical")
    groups = materialize(near_dup.near_duplicates(merged), "near_dups")
    found = review.union_all([
        review.conflict_findings(entity.sensitive_conflicts(rows, links, merged, b.CONTRACT), RUN),
        review.near_dup_findings(groups, near_dup.near_duplicate_members(merged, groups), RUN),
        review.validation_findings(canonical, RUN)])
    return materialize(found, "findings"), canonical


o.block("column_findings", """
SELECT 'MAPPING_AMBIGUITY' AS type, 'column/' || source || '/' || col AS group_key, source || ':' || col AS affected_id
FROM decisions WHERE decision = 'AMBIGUOUS'
UNION ALL SELECT 'CONFIRM_SENSITIVE_MAPPINGS', 'sensitive/client', source || '.' || col || ' -> ' || mapped_to
FROM decisions WHERE decision = 'ACCEPT' AND sensitive
UNION ALL SELECT 'DATE_FORMAT_AMBIGUOUS', 'dates/' || source || '/' || "column", source || ':' || "column" FROM date_orders WHERE date_order = 'AMBIGUOUS'
UNION ALL SELECT 'ENUM_VALUE_AMBIGUOUS', 'value/' || fingerprint, source || ':row_' || row_num FROM unrecognized""",
        "decisions", "date_orders", "unrecognized")
o.block("record_findings", """
SELECT 'SENSITIVE_FIELD_CONFLICT' AS type, 'differs/' || canonical_key || '/' || field AS group_key, canonical_key AS affected_id FROM sensitive_conflicts
UNION ALL SELECT 'NEAR_DUPLICATE_RECORD', 'alike/' || date_of_birth || '/' || name_a || '/' || name_b, canonical_key
FROM near_dups JOIN persons ON block = date_of_birth AND name IN (name_a, name_b)
UNION ALL SELECT 'VALIDATION_FAILED_TWICE', 'fails/' || canonical_key, canonical_key FROM canonical WHERE outcome = 'quarantined'""",
        "sensitive_conflicts", "near_dups", "persons", "canonical")
o.block("all_findings", "SELECT * FROM column_findings UNION ALL SELECT * FROM record_findings", "column_findings", "record_findings")
_ITEMS = ("SELECT 'run_0' AS run_id, group_key, any_value(type) AS type, 'pending' AS status, "
          "count(DISTINCT affected_id) AS affected_count FROM {} GROUP BY group_key")


@query("review_items", o.with_blocks(_ITEMS.format("all_findings"), "all_findings"))
def review_items(spark, sf):
    run = migrate(b.exports(spark, sf), b.CONTRACT, options=Options(
        run_id=RUN, client_id=CLIENT, precedence=tuple(b.PRECEDENCE), default_date_order=b.DATE_ORDER, excuse_reviewed_enums=False))
    return run.items.select("run_id", "group_key", "type", "status", "affected_count")


@query("review_members", o.with_blocks(
    "SELECT DISTINCT 'run_0' AS run_id, group_key, affected_id FROM column_findings", "column_findings"))
def review_members(spark, sf):
    return review.members(column_findings(spark, sf))


@query("breaker", o.with_blocks("""
SELECT 'run_0' AS run_id, group_count, affected_rows, round(affected_rows / total::DOUBLE, 4) AS affected_ratio,
       group_count > 20 OR round(affected_rows / total::DOUBLE, 4) > 0.30 AS tripped
FROM (SELECT count(DISTINCT group_key) AS group_count FROM record_findings),
     (SELECT count(DISTINCT seq) AS affected_rows FROM record_findings JOIN merged ON canonical_key = affected_id JOIN links USING (entity_seq)),
     (SELECT count(*) AS total FROM staged)""", "record_findings", "staged", "links", "merged"))
def breaker(spark, sf):
    rows, links, merged = b.merged(spark, sf)
    found, _ = _record_findings(rows, links, merged)
    return review.breaker(found, rows.agg(F.count(F.lit(1))).scalar(), rows_of=review.source_rows(rows, links, merged))


@query("review_queue", o.with_blocks(
    "SELECT row_number() OVER (ORDER BY status, group_key) AS position, * FROM ("
    + _ITEMS.format("record_findings").replace("'pending' AS status",
                                               "CASE WHEN any_value(type) = 'SENSITIVE_FIELD_CONFLICT' THEN 'resolved' ELSE 'pending' END AS status")
    + ")", "record_findings"))
def review_queue(spark, sf):
    found, _ = record_findings(spark, sf)
    status = F.when(F.col("type") == "SENSITIVE_FIELD_CONFLICT", "resolved").otherwise(F.col("status"))
    listed = review.items(found).withColumn("status", status).withColumn("created_at", F.to_timestamp(F.lit(_WHEN)))
    numbered = number_rows(listed, review.queue_order()).withColumn("position", F.col(ROW) + 1)
    return numbered.select("position", "run_id", "group_key", "type", "status", "affected_count")


@query("run_gate", """
SELECT run_id, count(*) FILTER (WHERE type = 'ERROR') AS pending_items,
       CASE WHEN count(*) FILTER (WHERE type = 'ERROR') > 0 THEN 'paused' ELSE 'completed' END AS run_status
FROM (SELECT 'run_' || CAST(user_id % 3 AS VARCHAR) AS run_id, upper(event_type) AS type FROM events) GROUP BY run_id""")
def run_gate(spark, sf):
    ledger = b.ledger(spark, sf)
    items = ledger.select("run_id", F.when(F.col("type") == "ERROR", "pending").otherwise("resolved").alias("status"))
    return review.run_gate(ledger.select("run_id").distinct(), items)


def record_resolutions(items: DataFrame) -> DataFrame:
    """The decisions of a reviewer who treats equal cases alike."""
    field = F.get_json_object("context", "$.field")
    email, status, salary = field == "email", field == "employment_status", field == "salary"
    failed, conflict, twin = (F.col("type") == t for t in
                              ("VALIDATION_FAILED_TWICE", "SENSITIVE_FIELD_CONFLICT", "NEAR_DUPLICATE_RECORD"))
    action = (F.when(conflict, "approve").when(twin, "correct").when(failed & salary, "reject")
              .when(failed & (email | status), "correct"))
    address = F.concat(F.lower(F.replace("group_key", F.lit("fails/"), F.lit(""))), F.lit("@fixed.example.com"))
    value = F.when(twin, "merge").when(failed & email, address).when(failed & status, "On Leave")
    return items.select("run_id", "group_key", action.alias("action"), F.when(failed, field).alias("field"), value.alias("value"),
                        F.lit(True).alias("remember"), F.to_timestamp(F.lit(_WHEN)).alias("resolved_at")) \
                .filter(F.col("action").isNotNull())


# Records that merge decisions put together, closed over shared records, and the key that stays.
o.block("merge_groups", """
WITH RECURSIVE members AS MATERIALIZED (
  SELECT DISTINCT date_of_birth || '_' || name_a || '_' || name_b AS g, canonical_key AS k FROM near_dups JOIN persons ON block = date_of_birth AND name IN (name_a, name_b)),
edges AS MATERIALIZED (SELECT DISTINCT a.k AS a, b.k AS b FROM members a JOIN members b USING (g)),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT a AS canonical_key, min(b) AS keep FROM reach GROUP BY a""", "near_dups", "persons")
o.block("decided_records", """
SELECT c.canonical_key, coalesce(g.keep, c.canonical_key) AS keep, c.first_name, c.last_name, c.phone, c.department,
       CASE WHEN v.field = 'email' THEN lower(c.canonical_key) || '@fixed.example.com' ELSE c.email END AS email,
       CASE WHEN v.field = 'employment_status' THEN 'On Leave' ELSE c.employment_status END AS employment_status,
       coalesce(s.kept_value, c.salary) AS salary, c.row_count,
       CASE WHEN v.field = 'salary' THEN 'rejected' WHEN v.field IN ('email', 'employment_status') THEN 'ready' ELSE c.status END AS status
FROM canonical c
LEFT JOIN (SELECT canonical_key, CASE WHEN len(errors) = 1 THEN split_part(errors[1], ':', 2) END AS field FROM canonical WHERE outcome = 'quarantined') v
       ON v.canonical_key = c.canonical_key
LEFT JOIN (SELECT * FROM sensitive_conflicts WHERE field = 'salary') s ON s.canonical_key = c.canonical_key
LEFT JOIN merge_groups g ON g.canonical_key = c.canonical_key""", "canonical", "sensitive_conflicts", "merge_groups")


@query("apply_resolutions", o.with_blocks("""
SELECT 'run_0' AS run_id, keep AS canonical_key, """ + ", ".join(
    f"arg_min({f}, canonical_key) FILTER ({f} IS NOT NULL) AS {f}" for f in ("email", "phone", "department", "employment_status", "salary")) + """,
       arg_min(status, canonical_key) AS status, sum(row_count)::BIGINT AS row_count
FROM decided_records GROUP BY keep""", "decided_records"))
def apply_resolutions(spark, sf):
    found, canonical = record_findings(spark, sf)
    items = review.items(found)
    resolved = review.resolve(items, record_resolutions(items))
    return review.apply_resolutions(canonical, resolved, review.members(found), b.CONTRACT).select(
        "run_id", "canonical_key", "email", "phone", "department", "employment_status", "salary", "status", "row_count")


@query("human_merges", o.with_blocks(
    "SELECT 'run_0' AS run_id, keep AS canonical_key, canonical_key AS merged_key FROM merge_groups WHERE canonical_key <> keep", "merge_groups"))
def human_merges(spark, sf):
    found, _ = record_findings(spark, sf)
    items = review.items(found)
    return review.merged_by_people(review.merge_groups(review.resolve(items, record_resolutions(items)), review.members(found)))


@query("withheld_records", o.with_blocks(
    "SELECT DISTINCT 'run_0' AS run_id, regexp_replace(affected_id, '^(id|email):', '') AS canonical_key FROM record_findings", "record_findings"))
def withheld_records(spark, sf):
    found, _ = record_findings(spark, sf)
    return review.withheld_keys(review.items(found), review.members(found))


def column_resolutions(items: DataFrame) -> DataFrame:
    t, raw = F.col("type"), F.get_json_object("context", "$.raw_value")
    corrected = (F.when(t == "MAPPING_AMBIGUITY", "employee_id")
                 .when((t == "ENUM_VALUE_AMBIGUOUS") & (raw == "TECH"), "MACHINERY"))
    return items.select("run_id", "group_key", F.when(corrected.isNotNull(), "correct").otherwise("approve").alias("action"),
                        F.lit(None).cast("string").alias("field"), corrected.alias("value"), F.lit(True).alias("remember"),
                        F.to_timestamp(F.lit(_WHEN)).alias("resolved_at"))


@query("rules_synth", o.with_blocks("""
SELECT 'client' AS client_id, kind, fingerprint, action, source_item FROM (
  SELECT DISTINCT CASE type WHEN 'MAPPING_AMBIGUITY' THEN 'mapping' WHEN 'ENUM_VALUE_AMBIGUOUS' THEN 'enum_value'
                            WHEN 'DATE_FORMAT_AMBIGUOUS' THEN 'date_format' ELSE 'sensitive_mapping_confirmed' END AS kind,
         CASE type WHEN 'MAPPING_AMBIGUITY' THEN affected_id WHEN 'ENUM_VALUE_AMBIGUOUS' THEN substr(group_key, 7)
                   WHEN 'DATE_FORMAT_AMBIGUOUS' THEN affected_id ELSE 'all_sensitive' END AS fingerprint,
         CASE type WHEN 'MAPPING_AMBIGUITY' THEN '{"target_field":"employee_id"}'
                   WHEN 'ENUM_VALUE_AMBIGUOUS' THEN CASE WHEN group_key LIKE '%:TECH' THEN '{"canonical_value":"MACHINERY"}' ELSE '{"canonical_value":"On Leave"}' END
                   WHEN 'DATE_FORMAT_AMBIGUOUS' THEN '{"format":"DMY"}' ELSE '{"action":"approved"}' END AS action,
         group_key AS source_item
  FROM column_findings)""", "column_findings"))
def rules_synth(spark, sf):
    items = review.items(column_findings(spark, sf))
    made = rules.synthesize(review.resolve(items, column_resolutions(items)), CLIENT)
    return made.select("client_id", "kind", "fingerprint", "action", "source_item")


_OLD = "DATE '1998-01-01'"
_RULES = """
SELECT 'client_' || CAST(o_custkey % 3 AS VARCHAR) AS client_id,
       CASE o_orderstatus WHEN 'O' THEN 'mapping' WHEN 'F' THEN 'enum_value' ELSE 'date_format' END AS kind,
       'export:' || CAST(o_custkey AS VARCHAR) AS fingerprint,
       CASE o_orderstatus WHEN 'O' THEN '{"target_field":"' || o_orderpriority || '"}' WHEN 'F' THEN '{"canonical_value":"' || o_orderpriority || '"}'
                          ELSE '{"format":"' || o_orderpriority || '"}' END AS action,
       'item_' || CAST(o_orderkey AS VARCHAR) AS source_item, o_orderpriority <> '5-LOW' AS enabled,
       o_orderdate AS created_at, o_orderkey % 5 AS times_applied, o_orderdate < DATE '1998-01-01' AS is_old, 'r' || CAST(o_orderkey AS VARCHAR) AS rule_id
FROM orders"""
o.block("order_rules", _RULES)


def order_rules(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Rules saved before 1998 and rules saved since, made from the orders."""
    orders = b.table(spark, sf, "orders")
    kind = F.when(F.col("o_orderstatus") == "O", "mapping").when(F.col("o_orderstatus") == "F", "enum_value").otherwise("date_format")
    p = F.col("o_orderpriority")
    action = F.when(kind == "mapping", as_json(target_field=p)).when(kind == "enum_value", as_json(canonical_value=p)) \
              .otherwise(as_json(format=p))
    made = orders.select(
        F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("rule_id"),
        F.concat(F.lit("client_"), (F.col("o_custkey") % 3).cast("string")).alias("client_id"), kind.alias("kind"),
        F.concat(F.lit("export:"), F.col("o_custkey").cast("string")).alias("fingerprint"), action.alias("action"),
        F.concat(F.lit("item_"), F.col("o_orderkey").cast("string")).alias("source_item"),
        (p != "5-LOW").alias("enabled"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
        (F.col("o_orderkey") % 5).alias("times_applied"))
    is_old = F.col("created_at") < F.to_timestamp(F.lit("1998-01-01"))
    return made.filter(is_old), made.filter(~is_old)


o.block("upserted", """
SELECT client_id, kind, fingerprint, arg_max(action, (CASE WHEN is_old THEN 0 ELSE 1 END, created_at, source_item)) AS action,
       max(CASE WHEN is_old THEN 0 ELSE 1 END) = 1 OR arg_max(enabled, (CASE WHEN is_old THEN 0 ELSE 1 END, created_at, source_item)) AS enabled,
       arg_min(rule_id, (created_at, rule_id)) AS rule_id, min(created_at) AS created_at, sum(times_applied)::BIGINT AS times_applied
FROM order_rules GROUP BY client_id, kind, fingerprint""", "order_rules")


@query("rules_upsert", o.with_blocks(
    "SELECT rule_id, client_id, kind, fingerprint, action, enabled, CAST(created_at AS VARCHAR) AS created_at, times_applied FROM upserted", "upserted"))
def rules_upsert(spark, sf):
    return rules.upsert(*order_rules(spark, sf)).select(
        "rule_id", "client_id", "kind", "fingerprint", "action", "enabled", F.col("created_at").cast("string").alias("created_at"), "times_applied")


@query("rules_lookup", o.with_blocks("""
SELECT c_custkey, rule_id, action FROM customer LEFT JOIN (SELECT * FROM upserted WHERE client_id = 'client_1' AND kind = 'mapping' AND enabled) r
ON r.fingerprint = 'export:' || CAST(c_custkey AS VARCHAR)""", "upserted"))
def rules_lookup(spark, sf):
    known = rules.find(rules.upsert(*order_rules(spark, sf)), "client_1", "mapping")
    who = b.table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("export:"), F.col("c_custkey").cast("string")).alias("fingerprint"))
    return who.join(known, "fingerprint", "left").select("c_custkey", "rule_id", "action")


@query("rules_applied", o.with_blocks("""
SELECT rule_id, kind, u.fingerprint, times_applied + coalesce(n, 0) AS times_applied FROM upserted u
LEFT JOIN (SELECT 'export:' || CAST(user_id AS VARCHAR) AS fingerprint, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) a
       ON a.fingerprint = u.fingerprint AND u.kind = 'enum_value'""", "upserted"))
def rules_applied(spark, sf):
    clicks = b.table(spark, sf, "events").filter("event_type = 'click'").select(
        F.lit("enum_value").alias("kind"), F.concat(F.lit("export:"), F.col("user_id").cast("string")).alias("fingerprint"))
    return rules.count_applied(rules.upsert(*order_rules(spark, sf)), clicks).select("rule_id", "kind", "fingerprint", "times_applied")


@query("rules_listing", o.with_blocks("""
SELECT rule_id, kind, fingerprint, times_applied, enabled,
       CASE kind WHEN 'mapping' THEN 'column feeds ' || json_extract_string(action, '$.target_field')
                 WHEN 'enum_value' THEN 'value means ' || json_extract_string(action, '$.canonical_value')
                 ELSE 'dates are ' || json_extract_string(action, '$.format') END AS action_display
FROM upserted WHERE client_id = 'client_2'""", "upserted"))
def rules_listing(spark, sf):
    return rules.listing(rules.upsert(*order_rules(spark, sf)), "client_2").drop("created_at")


@query("rules_toggle", o.with_blocks("""
SELECT client_id, kind, fingerprint, CASE WHEN rule_id = (SELECT min(rule_id) FROM upserted) THEN NOT enabled ELSE enabled END AS enabled
FROM upserted""", "upserted"))
def rules_toggle(spark, sf):
    saved = materialize(rules.upsert(*order_rules(spark, sf)), "rules")
    first = saved.agg(F.min("rule_id")).first()[0]
    return rules.toggle(saved, first).select("client_id", "kind", "fingerprint", "enabled")


# What two clients decided about the same things; only the first one's sources are read.
_DECIDED = """
SELECT concat(client_id, '-', kind, '-', fingerprint) AS rule_id, client_id, kind, fingerprint, action, 'item' AS source_item, true AS enabled,
       TIMESTAMP'2024-02-01 00:00:00' AS created_at, 0L AS times_applied
FROM VALUES ('client', 'enum_value', 'employment_status:LOA', '{"canonical_value":"On Leave"}'),
            ('other', 'enum_value', 'employment_status:LOA', '{"canonical_value":"Terminated"}'),
            ('client', 'enum_value', 'department:TECH', '{"canonical_value":"MACHINERY"}'),
            ('other', 'enum_value', 'department:TECH', '{"canonical_value":"BUILDING"}'),
            ('client', 'date_format', 'src_b:doj', '{"format":"MDY"}'), ('other', 'date_format', 'src_b:doj', '{"format":"DMY"}'),
            ('client', 'mapping', 'src_c:ref', '{"target_field":"employee_id"}'), ('other', 'mapping', 'src_c:ref', '{"target_field":"manager_id"}')
     AS t(client_id, kind, fingerprint, action)"""


def clients_rules(spark) -> DataFrame:
    return rules.of_client(spark.sql(_DECIDED), CLIENT)


@query("learned_mapping", o.with_blocks("""
SELECT source, col AS "column", CASE WHEN col = 'ref' THEN 'RULE' ELSE decision END AS decision,
       CASE WHEN col = 'ref' THEN 'employee_id' ELSE mapped_to END AS mapped_to, CASE WHEN col = 'ref' THEN 'rule' ELSE 'agent' END AS decided_by
FROM decisions""", "decisions"))
def learned_mapping(spark, sf):
    return mapping.decide(export_profiles(spark, sf), b.CONTRACT, clients_rules(spark)).select(
        "source", "column", "decision", "mapped_to", "decided_by")


@query("learned_values", o.with_blocks("""
SELECT s.source, s.row_num, CASE WHEN upper(employment_status) = 'LOA' THEN 'On Leave' ELSE employment_status END AS employment_status,
       CASE WHEN upper(department) = 'TECH' THEN 'MACHINERY' ELSE department END AS department,
       CASE WHEN s.source = 'src_b' THEN strftime(try_strptime(doj, '%m/%d/%Y'), '%Y-%m-%d') ELSE hire_date END AS hire_date
FROM staged s LEFT JOIN src_b b ON s.source = 'src_b' AND b.row_num = s.row_num""", "staged", "src_b"))
def learned_values(spark, sf):
    return staging.stage(b.exports(spark, sf), b.MAPPINGS, b.CONTRACT, clients_rules(spark)).select(
        "source", "row_num", "employment_status", "department", "hire_date")


@query("run_delta", o.with_blocks("""
SELECT type, first_items, second_items, second_items - first_items AS change,
       CASE WHEN first_items > 0 THEN round(100.0 * (second_items - first_items) / first_items, 1) END AS change_pct
FROM (SELECT type, count(*) FILTER (WHERE run_id = 'run_0') AS first_items, count(*) FILTER (WHERE run_id = 'run_1') AS second_items
      FROM ledger WHERE run_id IN ('run_0', 'run_1') GROUP BY type)""", "ledger"))
def run_delta(spark, sf):
    return rules.run_delta(b.ledger(spark, sf), "run_0", "run_1")


@query("item_delta", o.with_blocks("""
SELECT type, first_items, second_items, second_items - first_items AS change, round(100.0 * (second_items - first_items) / first_items, 1) AS change_pct
FROM (SELECT type, count(DISTINCT group_key) AS first_items,
             count(DISTINCT group_key) FILTER (NOT (group_key IN ('column/src_c/ref', 'dates/src_b/doj') OR upper(group_key) IN ('VALUE/EMPLOYMENT_STATUS:LOA', 'VALUE/DEPARTMENT:TECH'))) AS second_items
      FROM column_findings GROUP BY type)""", "column_findings"))
def item_delta(spark, sf):
    """The review items of a first run and of a second one with the rules that were learned in between."""
    evidence = column_evidence(spark, sf)
    first = review.items(column_findings(spark, sf, evidence=evidence))
    second = review.items(column_findings(spark, sf, clients_rules(spark), "run_1", evidence))
    return rules.run_delta(first.unionByName(second), RUN, "run_1")


# -- a run taken up again ----------------------------------------------------------------------

# The staged rows as the remembered decisions leave them: two enum values learned, the payroll dates month first.
o.block("staged_again", """
SELECT s.* REPLACE (CASE WHEN upper(employment_status) = 'LOA' THEN 'On Leave' ELSE employment_status END AS employment_status,
                    CASE WHEN upper(department) = 'TECH' THEN 'MACHINERY' ELSE department END AS department,
                    CASE WHEN s.source = 'src_b' THEN strftime(try_strptime(b.doj, '%m/%d/%Y'), '%Y-%m-%d') ELSE hire_date END AS hire_date)
FROM staged s LEFT JOIN src_b b ON s.source = 'src_b' AND b.row_num = s.row_num""", "staged", "src_b")
for _name, _of, _more in (("merged", "staged", ("links", "identity")), ("checked", "merged", ()), ("canonical", "checked", ())):
    o.block(f"{_name}_again", o.sql_of(_name).replace(f"FROM {_of}", f"FROM {_of}_again"), f"{_of}_again", *_more)
o.block("decided_again", o.sql_of("decided_records").replace("FROM canonical c", "FROM canonical_again c").replace("c.first_name", "c.hire_date, c.first_name"),
        "canonical", "canonical_again", "sensitive_conflicts", "merge_groups")


def resumed_run(spark, sf) -> Resumed:
    """A saved run whose items, all but the one about mapping, were decided."""
    options = Options(run_id=RUN, client_id=CLIENT, precedence=tuple(b.PRECEDENCE), default_date_order=b.DATE_ORDER, excuse_reviewed_enums=False)
    exports = b.exports(spark, sf)
    run = migrate(exports, b.CONTRACT, options=options)
    saved = SavedRun(spark, scratch_path(spark, "saved"))
    save(run, saved.path, RUN)
    columns = column_resolutions(run.items.filter(F.col("type").isin("ENUM_VALUE_AMBIGUOUS", "DATE_FORMAT_AMBIGUOUS"))).join(
        run.items.select("run_id", "group_key", "type"), ["run_id", "group_key"])
    dated = F.col("type") == "DATE_FORMAT_AMBIGUOUS"
    columns = columns.withColumns({"action": F.when(dated, "correct").otherwise(F.col("action")), "value": F.when(dated, "MDY").otherwise(F.col("value"))}).drop("type")
    said = materialize(columns.unionByName(record_resolutions(run.items)), "said")
    return resume(saved, said, b.CONTRACT, exports, options)


_AGAIN = ("email", "phone", "department", "employment_status", "hire_date", "salary")


@query("resumed_records", o.with_blocks("SELECT keep AS canonical_key, " + ", ".join(
    f"arg_min({f}, canonical_key) FILTER ({f} IS NOT NULL) AS {f}" for f in _AGAIN) + """,
       arg_min(status, canonical_key) AS status, sum(row_count)::BIGINT AS row_count
FROM decided_again GROUP BY keep""", "decided_again"))
def resumed_records(spark, sf):
    return resumed_run(spark, sf).run.records().select("canonical_key", *_AGAIN, "status", "row_count")


@query("run_ledger", o.with_blocks("""
WITH items AS MATERIALIZED (SELECT DISTINCT type, group_key, affected_id FROM all_findings),
failed AS (SELECT canonical_key, CASE WHEN len(errors) = 1 THEN split_part(errors[1], ':', 2) END AS field FROM canonical WHERE outcome = 'quarantined')
SELECT 'escalation' AS stage, 'HUMAN_RESOLVED' AS type, 'human' AS actor, group_key AS entity_id, NULL AS field, NULL AS before, NULL AS after
FROM (SELECT DISTINCT type, group_key, CASE WHEN type = 'VALIDATION_FAILED_TWICE' THEN affected_id END AS k FROM items) i LEFT JOIN failed ON k = canonical_key
WHERE type IN ('ENUM_VALUE_AMBIGUOUS', 'DATE_FORMAT_AMBIGUOUS', 'SENSITIVE_FIELD_CONFLICT', 'NEAR_DUPLICATE_RECORD') OR field IN ('email', 'employment_status', 'salary')
UNION ALL SELECT DISTINCT 'rules', 'RULE_CREATED', 'human', CASE type WHEN 'ENUM_VALUE_AMBIGUOUS' THEN substr(group_key, 7) ELSE affected_id END,
       CASE type WHEN 'ENUM_VALUE_AMBIGUOUS' THEN 'enum_value' ELSE 'date_format' END, NULL, NULL
FROM items WHERE type IN ('ENUM_VALUE_AMBIGUOUS', 'DATE_FORMAT_AMBIGUOUS')
UNION ALL SELECT 'normalize', 'VALUE_NORMALIZED', 'rule', s.seq::VARCHAR, field, before, after FROM staged s JOIN staged_again a USING (seq), LATERAL (
  SELECT unnest(['department', 'employment_status', 'hire_date']) AS field, unnest([s.department, s.employment_status, s.hire_date]) AS before,
         unnest([a.department, a.employment_status, a.hire_date]) AS after) WHERE before IS DISTINCT FROM after
UNION ALL SELECT 'reconcile', 'RECORDS_MERGED', 'human', keep, NULL, canonical_key, NULL FROM merge_groups WHERE canonical_key <> keep""".replace("WITH items", "SELECT * FROM (WITH items") + ")",
    "all_findings", "canonical", "staged", "staged_again", "merge_groups"))
def run_ledger(spark, sf):
    """What a resume adds to the ledger."""
    done = resumed_run(spark, sf)
    told = F.col("type").isin("VALUE_NORMALIZED", "RECORDS_MERGED")
    return done.ledger(1).select("stage", "type", "actor", "entity_id", "field", F.when(told, F.col("before")).alias("before"), F.when(told, F.col("after")).alias("after"))
