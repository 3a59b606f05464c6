"""Writers for canonical records and for the audit ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# The column order of the record export and of the audit CSV.
RECORD_COLUMNS = ("employee_id", "first_name", "last_name", "email", "phone", "date_of_birth", "hire_date",
                  "department", "job_title", "employment_status", "salary", "push_status")
AUDIT_COLUMNS = ("id", "run_id", "ts", "stage", "type", "actor", "entity_type", "entity_id", "field",
                 "before", "after", "reason", "score")


def records_table(canonical: DataFrame) -> DataFrame:
    """The fixed 12-column projection, ordered by key; blanks instead of NULLs."""
    out = canonical.withColumns({"employee_id": F.col("canonical_key"), "push_status": F.col("status")})
    return out.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in RECORD_COLUMNS]).orderBy("employee_id")


def write_records_csv(canonical: DataFrame, path: str) -> None:
    records_table(canonical).write.option("header", True).option("emptyValue", "").mode("overwrite").csv(path)


def records_json(canonical: DataFrame, fields: list[str]) -> DataFrame:
    return canonical.select("canonical_key", "status", F.struct(*fields).alias("record")).orderBy("canonical_key")


def write_records_json(canonical: DataFrame, fields: list[str], path: str) -> None:
    records_json(canonical, fields).write.mode("overwrite").json(path)


def audit_table(ledger: DataFrame, run_id: str, columns=AUDIT_COLUMNS) -> DataFrame:
    return ledger.filter(F.col("run_id") == run_id).select(*columns).orderBy("id")


def write_audit_csv(ledger: DataFrame, run_id: str, path: str) -> None:
    audit_table(ledger, run_id).write.option("header", True).mode("overwrite").csv(path)


def write_audit_json(ledger: DataFrame, run_id: str, path: str) -> None:
    audit_table(ledger, run_id, ledger.columns).write.mode("overwrite").json(path)
