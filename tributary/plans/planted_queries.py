"""Queries over cells that the exports do not have: every check, repair, date form, phone region, mapping outcome and guard."""

from __future__ import annotations

import json

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, functions as F

from tributary.contract import Contract
from tributary.functions import dates, text
from tributary.operators import entity, ledger, mapping, profile, quality, staging
from tributary.plans import oracle as o
from tributary.plans.registry import query
from tributary.plans.source_queries import tables_as_sources
from tributary.session import scratch_path
from tributary.sources import bridge as b, readers


def _view(spark, sf, sql: str, table: str) -> DataFrame:
    return b.view(spark, sf, sql.replace("VARCHAR", "STRING"), table)


# -- checks and repairs ------------------------------------------------------------------------

_K = "CAST(c_custkey AS VARCHAR)"
_RECORDS = f"""
SELECT {_K} AS canonical_key,
       CASE c_custkey % 5 WHEN 0 THEN 'X' || {_K} WHEN 1 THEN '' ELSE 'E' || lpad({_K}, 6, '0') END AS employee_id,
       CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 'Ada' END AS first_name, 'Smith' AS last_name,
       CASE c_custkey % 8 WHEN 0 THEN 'u' || {_K} || ' @example.com' WHEN 1 THEN ' U' || {_K} || '@ EXAMPLE .com ' WHEN 2 THEN 'u' || {_K} || '(at)example.com'
            WHEN 3 THEN 'u' || {_K} || '@example' WHEN 4 THEN '' WHEN 5 THEN 'a b' ELSE 'u' || {_K} || '@example.com' END AS email,
       CAST(NULL AS VARCHAR) AS phone, CAST(NULL AS VARCHAR) AS date_of_birth, '2020-01-01' AS hire_date,
       CASE c_custkey % 6 WHEN 0 THEN 'MILLING' ELSE c_mktsegment END AS department, CAST(NULL AS VARCHAR) AS job_title,
       CASE c_custkey % 4 WHEN 0 THEN 'boss' WHEN 1 THEN 'E12' ELSE 'E000001' END AS manager_id, 'Active' AS employment_status,
       CASE c_custkey % 7 WHEN 0 THEN 'INR 1200' WHEN 1 THEN '-5' WHEN 2 THEN 'none of it' WHEN 3 THEN '$2,500' WHEN 4 THEN 'CHF -7' ELSE '900' END AS salary
FROM customer"""
o.block("planted_records", _RECORDS)
# A space in an address and letters around an amount are mended, if what is left is an address and an amount of 0 or more.
o.block("planted_checked", f"""
SELECT * EXCLUDE (joined, amount, mends_email, mends_salary), {o.errors()} AS errors,
       array_to_string(list_filter([CASE WHEN mends_email THEN 'email' END, CASE WHEN mends_salary THEN 'salary' END], lambda x: x IS NOT NULL), ',') AS fixes
FROM (SELECT * REPLACE (CASE WHEN mends_email THEN joined ELSE email END AS email, CASE WHEN mends_salary THEN CAST(amount AS VARCHAR) || '.0' ELSE salary END AS salary)
      FROM (SELECT *, list_contains(errors_before, 'email:email') AND contains(trim(email), ' ') AND regexp_matches(joined, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') AS mends_email,
                   (list_contains(errors_before, 'number:salary') OR list_contains(errors_before, 'minimum:salary')) AND coalesce(amount, -1) >= 0 AS mends_salary
            FROM (SELECT *, {o.errors()} AS errors_before, replace(lower(trim(email)), ' ', '') AS joined, TRY_CAST(regexp_replace(salary, '[^\\d.\\-]', '', 'g') AS BIGINT) AS amount
                  FROM planted_records)))""", "planted_records")


@query("planted_errors", o.with_blocks("SELECT canonical_key, unnest(errors_before) AS error FROM planted_checked", "planted_checked"))
def planted_errors(spark, sf):
    """Every kind of error: addresses, patterns, numbers, limits, enums, missing cells."""
    records = _view(spark, sf, _RECORDS, "customer")
    return records.select("canonical_key", F.explode(quality.error_list(b.CONTRACT)).alias("error"))


@query("planted_ladder", o.with_blocks("""
SELECT canonical_key, array_to_string(errors_before, ',') AS errors_before, fixes, array_to_string(errors, ',') AS errors, email, salary,
       CASE WHEN len(errors) = 0 THEN 'valid' ELSE 'quarantined' END AS outcome FROM planted_checked""", "planted_checked"))
def planted_ladder(spark, sf):
    """Addresses and amounts that can be mended, and those that cannot."""
    made = quality.ladder(_view(spark, sf, _RECORDS, "customer"), b.CONTRACT)
    return made.select("canonical_key", F.array_join("errors_before", ",").alias("errors_before"), F.array_join("fixes", ",").alias("fixes"),
                       F.array_join("errors", ",").alias("errors"), "email", "salary", "outcome")


@query("planted_orphans", o.with_blocks("SELECT canonical_key, manager_id FROM planted_records WHERE manager_id NOT IN (SELECT employee_id FROM planted_records)", "planted_records"))
def planted_orphans(spark, sf):
    """Managers who are no employee; each is named by very many records."""
    records = _view(spark, sf, _RECORDS, "customer")
    return quality.orphan_references(records.select("canonical_key", "manager_id"), "manager_id", records.select("employee_id").distinct(), "employee_id")


# -- two ids that meet -------------------------------------------------------------------------

_MEETING = """
SELECT 's' AS source, 3 * c_custkey + part AS row_num, 3 * c_custkey + part AS seq, CASE part WHEN 1 THEN NULL ELSE 'E' || CAST(c_custkey AS VARCHAR) || CAST(part AS VARCHAR) END AS employee_id,
       CASE part WHEN 3 THEN NULL ELSE 'm' || CAST(c_custkey AS VARCHAR) || '@x.com' END AS email,
       CASE part WHEN 2 THEN 'Other' || CAST(c_custkey AS VARCHAR) ELSE 'Name' || CAST(c_custkey AS VARCHAR) END AS first_name, 'Of' AS last_name
FROM customer, (SELECT 1 AS part UNION ALL SELECT 2 UNION ALL SELECT 3) parts WHERE part < 3 OR c_custkey % 2 = 0"""


@query("meeting_ids", """SELECT 3 * c_custkey + 1 AS entity_seq, 'E' || CAST(c_custkey AS VARCHAR) || '2' AS first_id, 'E' || CAST(c_custkey AS VARCHAR) || '3' AS last_id
FROM customer WHERE c_custkey % 2 = 0""")
def meeting_ids(spark, sf):
    """A row without id has the address of one id and the name of another."""
    rows = _view(spark, sf, _MEETING, "customer").withColumn("seq", F.col("seq").cast("long"))
    return entity.identity_conflicts(rows, entity.link(rows)).select("entity_seq", "first_id", "last_id")


# -- dates and phones --------------------------------------------------------------------------

_DAY = "CAST(o_orderdate AS DATE)"
_FORMS = {"us": "%m/%d/%Y", "eu": "%d.%m.%Y", "iso": "%Y-%m-%d", "named": "%d-%b-%Y"}
_SPARK_FORMS = {"us": "MM/dd/yyyy", "eu": "dd.MM.yyyy", "iso": "yyyy-MM-dd", "named": "dd-MMM-yyyy"}


def dated_orders(spark, sf) -> DataFrame:
    """Each order's date in several notations; ``mixed`` holds two that contradict each other, ``early`` only days up to the 12th."""
    day = F.to_date("o_orderdate")
    orders = b.table(spark, sf, "orders")
    made = orders.select("o_orderkey", *[F.date_format(day, f).alias(n) for n, f in _SPARK_FORMS.items()])
    return made.withColumns({"mixed": F.when(F.col("o_orderkey") % 2 == 0, F.col("us")).otherwise(F.regexp_replace("eu", "\\.", "/")),
                             "early": F.when(F.day(F.to_date("iso")) <= 12, F.col("us"))})


@query("date_orders_of_all_kinds", "SELECT * FROM (VALUES ('us', 'MDY'), ('eu', 'DMY'), ('iso', 'YMD'), ('named', 'DMonY'), ('mixed', 'AMBIGUOUS'), ('early', 'AMBIGUOUS')) t(\"column\", date_order)"
       " WHERE (SELECT count(*) FROM orders) > 0")
def date_orders_of_all_kinds(spark, sf):
    columns = [*_SPARK_FORMS, "mixed", "early"]
    return staging.column_date_orders(dated_orders(spark, sf), "orders", columns).select("column", "date_order")


@query("dates_of_all_kinds", " UNION ALL ".join(
    f"SELECT o_orderkey, '{n}' AS \"column\", strftime({_DAY}, '{f}') AS raw, strftime({_DAY}, '%Y-%m-%d') AS iso FROM orders" for n, f in _FORMS.items()))
def dates_of_all_kinds(spark, sf):
    orders = dated_orders(spark, sf)
    known = {r["column"]: r["date_order"] for r in staging.column_date_orders(orders, "orders", list(_FORMS)).collect()}
    out = None
    for name in _FORMS:
        part = orders.select("o_orderkey", F.lit(name).alias("column"), F.col(name).alias("raw"), dates.to_iso(F.col(name), F.lit(known[name])).alias("iso"))
        out = part if out is None else out.unionByName(part)
    return out


# How numbers of each region are written, and what they are: (region, written, read).
_NUMBERS = [("US", "'(212) 555-' || {n}", "'+1212555' || {n}"), ("US", "'1 212 555 ' || {n}", "'+1212555' || {n}"), ("GB", "'020 7946 ' || {n}", "'+44207946' || {n}"),
            ("DE", "'030 12' || {n}", "'+493012' || {n}"), ("FR", "'01.23.45.' || substr({n}, 1, 2) || '.' || substr({n}, 3, 2)", "'+3312345' || {n}"),
            ("SG", "'6123 ' || {n}", "'+656123' || {n}"), ("AE", "'+971 4 123 ' || {n}", "'+9714123' || {n}"), ("AU", "'(02) 9876 ' || {n}", "'+6129876' || {n}"),
            ("IN", "'+44 20 7946 ' || {n}", "'+44207946' || {n}"), ("IN", "'12-' || {n}", "'12' || {n}")]
_LAST = "lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')"


@query("phones_of_all_regions", " UNION ALL ".join(
    f"SELECT c_custkey, {i} AS form, '{region}' AS region, {written.format(n=_LAST)} AS raw, {read.format(n=_LAST)} AS phone FROM customer" for i, (region, written, read) in enumerate(_NUMBERS)))
def phones_of_all_regions(spark, sf):
    out = None
    for i, (region, written, _) in enumerate(_NUMBERS):
        raw = _view(spark, sf, f"SELECT c_custkey, {i} AS form, '{region}' AS region, {written.format(n=_LAST)} AS raw FROM customer", "customer")
        part = raw.withColumn("phone", text.phone_e164(F.col("raw"), region))
        out = part if out is None else out.unionByName(part)
    return out


# -- mapping -----------------------------------------------------------------------------------

_VENDOR = {"Emp No": "'E' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0')", "email": "'a' || CAST(s_suppkey AS VARCHAR) || '@x.com'", "e-mail": "'b' || CAST(s_suppkey AS VARCHAR) || '@x.com'",
           "zz9": "s_name || ' as told'", "Salary": "CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR)", "ref": "'R' || CAST(s_nationkey AS VARCHAR)", "name": "'Ann B' || CAST(s_suppkey AS VARCHAR)"}
o.block("vendor_cells", " UNION ALL ".join(f"SELECT 'vendor' AS source, '{c}' AS col, {o.clean(sql)} AS val, s_suppkey + 1 AS row_num FROM supplier" for c, sql in _VENDOR.items()))
o.profile_blocks("vendor_cells", "vendor_")
o.mapping_blocks("vendor_")


@query("mapping_outcomes", o.with_blocks("""
SELECT source, col AS "column", target_field, score, CASE WHEN claim > 1 THEN 'DUPLICATE_TARGET' ELSE decision END AS decision, CASE WHEN claim = 1 THEN mapped_to END AS mapped_to
FROM (SELECT *, CASE WHEN mapped_to IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY source, mapped_to ORDER BY score DESC, col) END AS claim FROM vendor_decisions)""", "vendor_decisions"))
def mapping_outcomes(spark, sf):
    """A source whose columns are accepted, unclear, dropped, and two for one target."""
    cells = ", ".join(f"{sql} AS `{c}`" for c, sql in _VENDOR.items())
    source = readers.from_frame(_view(spark, sf, f"SELECT s_suppkey + 1 AS row_num, {cells} FROM supplier", "supplier"), "vendor", "row_num")
    return mapping.decide(profile.profile([source], b.CONTRACT), b.CONTRACT).select("source", "column", "target_field", "score", "decision", "mapped_to")


# -- guards, contracts, profile events ---------------------------------------------------------

@query("source_guards", "SELECT * FROM (VALUES ('orders', 'read'), ('orders.xlsx', 'unsupported'), ('no such table', 'missing')) t(source, outcome) WHERE (SELECT count(*) FROM orders) > 0")
def source_guards(spark, sf):
    """What reading a table, a file of another kind and a path that is not there comes to."""
    outcomes = []
    for name, path in (("orders", f"{sf}/orders.parquet"), ("orders.xlsx", f"{sf}/orders.xlsx"), ("no such table", f"{sf}/none.parquet")):
        try:
            outcomes.append((name, "read" if readers.read_source(spark, path, name).columns else "empty"))
        except ValueError:
            outcomes.append((name, "unsupported"))
        except PySparkException:
            outcomes.append((name, "missing"))
    known = spark.createDataFrame(outcomes, "source string, outcome string")
    return known.join(b.table(spark, sf, "orders").limit(1).select(F.lit(1).alias("_some")), how="left_semi")


@query("contract_table", """
SELECT 'customer_id' AS field, 0 AS ordinal, 'string' AS type, true AS required, true AS identity, '^\\d+$' AS pattern, NULL AS words
UNION ALL SELECT 'balance', 1, 'decimal', false, false, NULL, NULL
UNION ALL SELECT 'segment', 2, 'enum', true, false, NULL, string_agg(DISTINCT c_mktsegment || '=' || lower(substr(c_mktsegment, 1, 4)), ',' ORDER BY c_mktsegment || '=' || lower(substr(c_mktsegment, 1, 4))) FROM customer""")
def contract_table(spark, sf):
    """A contract whose enum words are those of the table, written as JSON, loaded, and shown as a table."""
    segments = [r["s"] for r in b.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("s")).distinct().orderBy("s").limit(1000).collect()]
    declared = {"entity": "customer", "fields": {
        "customer_id": {"type": "string", "required": True, "identity": True, "pattern": "^\\d+$"}, "balance": {"type": "decimal"},
        "segment": {"type": "enum", "required": True, "values": {s: [s[:4].lower()] for s in segments}}}}
    path = scratch_path(spark, "contract")
    spark.createDataFrame([(json.dumps(declared),)], "value string").coalesce(1).write.text(path)
    loaded = Contract.from_dict(json.loads(spark.read.text(path).first()["value"])).as_frame(spark)
    words = F.array_join(F.transform(F.array_sort(F.map_entries("values")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "+"))), ",")
    return loaded.select("field", "ordinal", "type", "required", "identity", "pattern", F.when(F.size("values") > 0, words).alias("words"))


@query("profile_events", o.with_blocks("""
SELECT 'profile' AS stage, 'COLUMN_PROFILED' AS type, 'agent' AS actor, source || ':' || col AS entity_id, col AS field,
       '{"total":' || total_count || ',"distinct":' || distinct_count || ',"type":"' || inferred_type || '"}' AS after FROM table_profiles""", "table_profiles"))
def profile_events(spark, sf):
    profiles = profile.profile(tables_as_sources(spark, sf))
    told = ledger.events(profiles, run_id="r", stage="profile", type="COLUMN_PROFILED", actor="agent", entity_type="column", entity_id=F.concat_ws(":", "source", "column"),
                         field=F.col("column"), after=ledger.as_json(total=F.col("total_count"), distinct=F.col("distinct_count"), type=F.col("inferred_type")))
    return told.select("stage", "type", "actor", "entity_id", "field", "after")
