"""Exports derived from the benchmark tables, in SQL that reads the same everywhere.

Three "exports" describe the customers the way three systems would (a master
file, a payroll file, a legacy file with near duplicates); ``ledger`` and
``attempts`` describe the events as pipeline events and delivery attempts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tributary.contract import employee_contract
from tributary.operators import entity, staging
from tributary.session import materialize
from tributary.sources.readers import from_frame

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

def _padded(number: str, digits: int) -> str:
    """The number as text with zeros in front up to ``digits``; longer numbers are not cut."""
    return f"lpad(CAST({number} AS STRING), CAST(greatest({digits}, length(CAST({number} AS STRING))) AS INT), '0')"


_ID = _padded("c_custkey", 6)
_LETTERS = "translate(CAST(c_custkey AS STRING),'0123456789','abcdefghij')"
_FAMILY = "translate(CAST(c_nationkey AS STRING),'0123456789','abcdefghij')"
_PERSON = f"'Na' || {_LETTERS} || ' Fam' || {_FAMILY}"
_MONTH = "lpad(CAST(1 + c_custkey % 12 AS STRING),2,'0')"
_DAY = "lpad(CAST(1 + c_custkey % 28 AS STRING),2,'0')"
_BORN = "CAST(1960 + c_custkey % 40 AS STRING)"

SRC_A = f"""
SELECT c_custkey + 1 AS row_num,
       'E' || {_ID} AS emp_no,
       CASE WHEN c_custkey % 7 = 0 THEN '  NA' || upper({_LETTERS}) || '  '
            WHEN c_custkey % 7 = 1 THEN 'na' || {_LETTERS}
            ELSE 'Na' || {_LETTERS} END AS first_name,
       'Fam' || {_FAMILY} AS last_name,
       CASE WHEN c_custkey % 20 = 0 THEN ''
            WHEN c_custkey % 11 = 0 THEN '  U' || CAST(c_custkey AS STRING) || '@EXAMPLE.COM '
            ELSE 'u' || CAST(c_custkey AS STRING) || '@example.com' END AS email,
       {_DAY} || '/' || {_MONTH} || '/' || {_BORN} AS dob,
       lpad(CAST(1 + c_custkey % 27 AS STRING),2,'0') || '/' || lpad(CAST(1 + c_custkey % 11 AS STRING),2,'0')
           || '/' || CAST(2010 + c_custkey % 13 AS STRING) AS join_date,
       c_mktsegment AS dept,
       CASE WHEN c_custkey % 50 = 8 THEN 'LOA' WHEN c_custkey % 9 = 0 THEN 'resigned' ELSE 'Active' END AS status,
       CASE WHEN c_custkey < 10 THEN ''
            ELSE 'E' || {_padded("CAST(floor(c_custkey / 10.0) AS BIGINT)", 6)} END AS mgr,
       CASE WHEN c_custkey % 50 = 31 THEN 'INR ' ELSE '' END || CAST(CAST(floor(c_acctbal) AS BIGINT) AS STRING) AS salary
FROM customer"""

SRC_B = f"""
SELECT c_custkey + 1 AS row_num,
       'E' || {_ID} AS emp_id,
       {_PERSON} AS full_name,
       CASE WHEN c_custkey % 20 = 0 THEN '' ELSE 'u' || CAST(c_custkey AS STRING) || '@example.com' END AS email_address,
       CAST(CAST(floor(c_acctbal) AS BIGINT) + CASE WHEN c_custkey % 100 = 5 THEN 8000 ELSE 0 END AS STRING) AS gross_salary,
       {_MONTH} || '/' || lpad(CAST(1 + (2 * c_custkey) % 12 AS STRING),2,'0')
           || '/' || CAST(2010 + c_custkey % 13 AS STRING) AS doj
FROM customer WHERE c_custkey % 3 <> 0"""

SRC_C = f"""
SELECT 2 * c_custkey + 1 AS row_num,
       {_PERSON} AS name,
       CASE WHEN c_custkey % 40 = 0 THEN '' ELSE 'u' || CAST(c_custkey AS STRING) || '@example.com' END AS mail,
       CASE WHEN c_custkey % 2 = 0 THEN '+91 ' || CAST(9876000000 + c_custkey AS STRING)
            ELSE '0' || CAST(9876500000 + c_custkey AS STRING) END AS phone,
       {_BORN} || '-' || {_MONTH} || '-' || {_DAY} AS birth_date,
       'E' || {_ID} AS ref,
       lower(CASE WHEN c_custkey % 50 = 8 THEN 'Active' WHEN c_custkey % 9 = 0 THEN 'resigned' ELSE 'Active' END) AS status,
       lower(c_mktsegment) AS dept
FROM customer WHERE c_custkey % 4 IN (0, 1)
UNION ALL
SELECT 2 * c_custkey + 2 AS row_num,
       'Na' || {_LETTERS} || ' Fom' || {_FAMILY} AS name,
       'n' || CAST(c_custkey AS STRING) || '@consultant.org' AS mail,
       '+91 9988776655' AS phone,
       {_BORN} || '-' || {_MONTH} || '-' || {_DAY} AS birth_date,
       'E9' || {_padded("c_custkey", 5)} AS ref,
       'active' AS status, 'tech' AS dept
FROM customer WHERE c_custkey % 97 = 12"""

LEDGER = """
SELECT event_id AS id, 'run_' || CAST(user_id % 3 AS STRING) AS run_id, ts,
       CASE event_type WHEN 'view' THEN 'profile' WHEN 'signup' THEN 'mapping' WHEN 'error' THEN 'validate'
                       WHEN 'click' THEN 'reconcile' ELSE 'push' END AS stage,
       upper(event_type) AS type,
       CASE WHEN event_id % 20 = 0 THEN 'system' WHEN event_id % 10 = 1 THEN 'human'
            WHEN event_id % 5 = 2 THEN 'rule' ELSE 'agent' END AS actor,
       CAST(user_id AS STRING) AS entity_id, value AS score
FROM events"""

ATTEMPTS = """
SELECT event_id AS id, 'run_' || CAST(CAST(floor(event_id / 600.0) AS BIGINT) % 2 AS STRING) AS run_id,
       CAST(floor(event_id / 3.0) AS BIGINT) AS record_id,
       CAST(1 + event_id % 3 AS INT) AS attempt,
       CASE WHEN CAST(floor(event_id / 3.0) AS BIGINT) % 500 BETWEEN 294 AND 299 THEN 503
            WHEN event_type = 'purchase' THEN 201 WHEN event_type = 'signup' THEN 200 WHEN event_type = 'click' THEN 422
            ELSE 503 END AS http_status
FROM events"""

EXPORTS = {"src_a": SRC_A, "src_b": SRC_B, "src_c": SRC_C}

# What mapping inference accepts for the three exports; ``ref`` stays unmapped.
MAPPINGS = {
    "src_a": {"emp_no": "employee_id", "first_name": "first_name", "last_name": "last_name", "email": "email",
              "dob": "date_of_birth", "join_date": "hire_date", "dept": "department", "status": "employment_status",
              "mgr": "manager_id", "salary": "salary"},
    "src_b": {"emp_id": "employee_id", "full_name": "full_name", "email_address": "email", "gross_salary": "salary",
              "doj": "hire_date"},
    "src_c": {"name": "full_name", "mail": "email", "phone": "phone", "birth_date": "date_of_birth",
              "status": "employment_status", "dept": "department"},
}
PRECEDENCE = ["src_a", "src_c", "src_b"]
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
CONTRACT = employee_contract(r"^E\d{6,}$", {s: [] for s in SEGMENTS})
DATE_ORDER = "DMY"  # the order people chose for the ambiguous payroll dates


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str, base: str) -> DataFrame:
    """Run bridge SQL over one base table without registering any name."""
    return spark.sql(sql.replace(f"FROM {base}", "FROM {base}"), base=table(spark, sf_dir, base))


def export(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The customers are dealt out first: a small file can hold very many, and cleaning them takes longer than reading them."""
    dealt = table(spark, sf_dir, "customer").repartition("c_custkey")
    return from_frame(spark.sql(EXPORTS[name].replace("FROM customer", "FROM {customer}"), customer=dealt), name, "row_num")


def exports(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: export(spark, sf_dir, name) for name in EXPORTS}


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, LEDGER, "events")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, ATTEMPTS, "events")


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three exports as normalized contract rows."""
    return staging.stage(exports(spark, sf_dir), MAPPINGS, CONTRACT, default_date_order=DATE_ORDER)


def linked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(staged rows, links), the staged rows written once since several steps read them."""
    rows = materialize(staged(spark, sf_dir), "staged")
    return rows, entity.link(rows)


def merged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(staged rows, links, merged entities), each written once."""
    rows, links = linked(spark, sf_dir)
    links = materialize(links, "links")
    return rows, links, materialize(entity.merge(rows, links, CONTRACT, PRECEDENCE), "merged")


def canonical(merged_rows: DataFrame, run_id: str = "run_0") -> DataFrame:
    """Merged entities as stored records; status follows from the checks of the record."""
    from tributary.operators.quality import ladder
    checked = ladder(merged_rows, CONTRACT)
    return checked.withColumns({
        "run_id": F.lit(run_id), "status": F.when(F.col("outcome") == "valid", "ready").otherwise("quarantined")})
