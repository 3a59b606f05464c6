"""Queries over linking, merging, near duplicates and record checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tributary.operators import entity, near_dup, quality, reports
from tributary.plans import oracle as o
from tributary.plans.registry import query
from tributary.sources import bridge as b, readers

_FIELDS = ", ".join(b.CONTRACT.names)


@query("match_keys", o.with_blocks("SELECT source, row_num, match_key FROM identity", "identity"))
def match_keys(spark, sf):
    return b.staged(spark, sf).select("source", "row_num", entity.match_key().alias("match_key"))


@query("entity_links", o.with_blocks("SELECT seq, entity_seq, matched_by FROM links", "links"))
def entity_links(spark, sf):
    return b.linked(spark, sf)[1]


@query("merge_events", o.with_blocks("""
SELECT canonical_key, source, row_num, matched_by FROM links JOIN staged USING (seq) JOIN merged USING (entity_seq)
WHERE matched_by <> 'seed'""", "links", "staged", "merged"))
def merge_events(spark, sf):
    return entity.merge_events(*b.merged(spark, sf))


@query("merged_entities", o.with_blocks(f"SELECT canonical_key, {_FIELDS}, row_count FROM merged", "merged"))
def merged_entities(spark, sf):
    return b.merged(spark, sf)[2].select("canonical_key", *b.CONTRACT.names, "row_count")


@query("provenance", o.with_blocks(" UNION ALL ".join(
    f"SELECT canonical_key, '{f}' AS field, {f}__source AS source FROM merged WHERE {f} IS NOT NULL" for f in b.CONTRACT.names), "merged"))
def provenance(spark, sf):
    return entity.provenance(b.merged(spark, sf)[2])


@query("conflicts", o.with_blocks("""
SELECT canonical_key, field, winner_source AS winning_source, winner AS winning_value, source AS losing_source,
       value AS losing_value, row_num FROM differing WHERE NOT sensitive""", "differing"))
def conflicts(spark, sf):
    return entity.conflicts(*b.merged(spark, sf), b.CONTRACT)


@query("sensitive_conflicts", o.with_blocks("SELECT * FROM sensitive_conflicts", "sensitive_conflicts"))
def sensitive_conflicts(spark, sf):
    return entity.sensitive_conflicts(*b.merged(spark, sf), b.CONTRACT)


@query("identity_conflicts", o.with_blocks("""
SELECT entity_seq, min(employee_id) AS first_id, max(employee_id) AS last_id FROM staged JOIN links USING (seq)
GROUP BY entity_seq HAVING min(employee_id) <> max(employee_id)""", "staged", "links"))
def identity_conflicts(spark, sf):
    return entity.identity_conflicts(*b.linked(spark, sf))


@query("near_duplicates", o.with_blocks("SELECT * FROM near_dups", "near_dups"))
def near_duplicates(spark, sf):
    return near_dup.near_duplicates(b.merged(spark, sf)[2])


@query("near_duplicate_members", o.with_blocks("""
SELECT DISTINCT date_of_birth, name_a, name_b, canonical_key FROM near_dups
JOIN persons ON block = date_of_birth AND name IN (name_a, name_b)""", "near_dups", "persons"))
def near_duplicate_members(spark, sf):
    merged = b.merged(spark, sf)[2]
    return near_dup.near_duplicate_members(merged, near_dup.near_duplicates(merged))


@query("validation_errors", o.with_blocks(
    "SELECT canonical_key, unnest(errors_before) AS error FROM checked", "checked"))
def validation_errors(spark, sf):
    merged = b.merged(spark, sf)[2]
    return merged.select("canonical_key", F.explode(quality.error_list(b.CONTRACT)).alias("error"))


@query("validation_ladder", o.with_blocks("""
SELECT canonical_key, array_to_string(errors_before, ',') AS errors_before, fixes, array_to_string(errors, ',') AS errors,
       salary, email, outcome FROM canonical""", "canonical"))
def validation_ladder(spark, sf):
    return quality.ladder(b.merged(spark, sf)[2], b.CONTRACT).select(
        "canonical_key", F.array_join("errors_before", ",").alias("errors_before"), F.array_join("fixes", ",").alias("fixes"),
        F.array_join("errors", ",").alias("errors"), "salary", "email", "outcome")


_LIMITS = {"l_quantity": (5.0, 45.0), "l_discount": (None, 0.09), "l_extendedprice": (1000.0, 90000.0)}


@query("range_violations", " UNION ALL ".join(
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, '{c}' AS field, {c} AS value, '{rule}' AS rule FROM lineitem WHERE {c} {op} {v}"
    for c, (low, high) in _LIMITS.items() for v, op, rule in ((low, "<", "minimum"), (high, ">", "maximum")) if v is not None))
def range_violations(spark, sf):
    return quality.range_violations(b.table(spark, sf, "lineitem"), _LIMITS, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@query("orphan_references", o.with_blocks("""
SELECT canonical_key, manager_id FROM merged m WHERE manager_id IS NOT NULL
AND NOT EXISTS (SELECT 1 FROM merged k WHERE k.employee_id = m.manager_id)""", "merged"))
def orphan_references(spark, sf):
    merged = b.merged(spark, sf)[2].select("canonical_key", "employee_id", "manager_id")
    return quality.orphan_references(merged, "manager_id", merged, "employee_id").select("canonical_key", "manager_id")


@query("orders_without_valid_customer", """
SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal >= 0)""")
def orders_without_valid_customer(spark, sf):
    valid = b.table(spark, sf, "customer").filter("c_acctbal >= 0")
    return quality.orphan_references(b.table(spark, sf, "orders"), "o_custkey", valid, "c_custkey").select("o_orderkey", "o_custkey")


@query("date_order_violations", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CASE WHEN CAST(l_shipdate AS DATE) < CAST(o_orderdate AS DATE) THEN 'too_soon' ELSE 'in_future' END AS rule
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE CAST(l_shipdate AS DATE) < CAST(o_orderdate AS DATE) OR CAST(l_shipdate AS DATE) > DATE '2001-06-30'""")
def date_order_violations(spark, sf):
    lines = b.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    orders = b.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return quality.date_order_violations(joined, "o_orderdate", "l_shipdate", as_of=F.to_date(F.lit("2001-06-30"))) \
                  .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "rule")


@query("hired_too_young", o.with_blocks("""
SELECT canonical_key, date_of_birth, hire_date FROM merged
WHERE CAST(hire_date AS DATE) < CAST(date_of_birth AS DATE) + INTERVAL 16 YEAR""", "merged"))
def hired_too_young(spark, sf):
    return quality.date_order_violations(b.merged(spark, sf)[2], "date_of_birth", "hire_date", months=192) \
                  .select("canonical_key", "date_of_birth", "hire_date")


def _json_without_nulls(source: str) -> str:
    cells = ", ".join(f"'{c}': {o.clean(c)}" for c in o.EXPORT_COLUMNS[source])
    return f"replace(regexp_replace(CAST(to_json({{{cells}}}) AS VARCHAR), '\"[a-z_]+\":null,?', '', 'g'), ',}}', '}}')"


@query("raw_lineage", o.with_blocks("""
SELECT m.canonical_key, s.source, s.row_num, r.raw_json FROM staged s JOIN links USING (seq) JOIN merged m USING (entity_seq) JOIN (
""" + " UNION ALL ".join(f"SELECT '{s}' AS source, row_num, {_json_without_nulls(s)} AS raw_json FROM {s}" for s in b.EXPORTS)
    + ") r ON r.source = s.source AND r.row_num = s.row_num", "staged", "links", "merged", *b.EXPORTS))
def raw_lineage(spark, sf):
    landed = None
    for df in b.exports(spark, sf).values():
        part = readers.landing(df)
        landed = part if landed is None else landed.unionByName(part)
    rows, links, merged = b.merged(spark, sf)
    return reports.raw_lineage(merged, links, rows, landed)
