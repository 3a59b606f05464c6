"""Delivery: keys, batches, acceptance at the target, and what the attempt log means.

attempts: (id, run_id, record_id, attempt, http_status)
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from tributary.operators.ordering import CHUNK, POS, ROW, carry_in, number_rows
from tributary.operators.review import findings
from tributary.operators.skew import hot_keys, salted_join
from tributary.operators.ledger import as_json, events
from tributary.session import materialize

SUCCESS_CODES = (200, 201)
_PARTS = 64


def idempotency_key(key: Column, payload_fields: list[str]) -> Column:
    """SHA-256 of the key and the payload with sorted field names; absent fields are left out."""
    payload = F.to_json(F.struct(*[F.col(n) for n in sorted(payload_fields)]))
    return F.sha2(F.concat_ws(":", key, payload), 256)


def batches(records: DataFrame, order_by: list[str], size: int = 10) -> DataFrame:
    """Add ``batch``: consecutive groups of ``size`` records in the given order, from 0."""
    numbered = number_rows(records, order_by)
    return numbered.withColumn("batch", F.floor(F.col(ROW) / size).cast("long")).drop(CHUNK, POS, ROW)


def accept(requests: DataFrame, delivered: DataFrame | None = None, order: str = "request_seq") -> DataFrame:
    """Which requests, taken in order, are new, repeated or in conflict where employee ids are unique.

    Adds ``outcome`` and ``http_status``: created 201, already_processed 200
    (same idempotency key as the stored record), conflict 409 (the id is taken
    under another key), missing_id 400. ``delivered`` holds earlier records
    (employee_id, idempotency_key). The first request per id is found by
    aggregation; repeats meet it in a join that deals out hot ids.
    """
    holders = requests.filter(F.col("employee_id").isNotNull()).select("employee_id", "idempotency_key", F.col(order).cast("long").alias("_at"))
    if delivered is not None:  # only the ids asked for; the rest of the store is not grouped or written
        asked = holders.select("employee_id").distinct()
        held = delivered.join(asked, "employee_id", "left_semi")
        holders = holders.unionByName(held.select("employee_id", "idempotency_key", F.lit(-1).cast("long").alias("_at")))
    holders = materialize(holders.groupBy("employee_id").agg(
        F.min(F.struct("_at", "idempotency_key")).alias("_h"), F.count(F.lit(1)).alias("n")), "holders")
    hot = hot_keys(holders, ["employee_id"])
    named = salted_join(requests.filter(F.col("employee_id").isNotNull()), holders.drop("n"), ["employee_id"], hot, order)
    nameless = requests.filter(F.col("employee_id").isNull())  # kept out of the join: NULLs would share one task
    out = named.unionByName(nameless, allowMissingColumns=True)
    outcome = (F.when(F.col("employee_id").isNull(), "missing_id")
               .when(F.col("_h._at") == F.col(order), "created")
               .when(F.col("_h.idempotency_key") == F.col("idempotency_key"), "already_processed")
               .otherwise("conflict"))
    # The status code of each outcome.
    code = F.when(outcome == "created", 201).when(outcome == "already_processed", 200) \
            .when(outcome == "conflict", 409).otherwise(400)
    return out.withColumns({"outcome": outcome, "http_status": code}).select(*requests.columns, "outcome", "http_status")


def _success() -> Column:
    return F.coalesce(F.col("http_status").isin(*SUCCESS_CODES), F.lit(False))


def _rejected() -> Column:
    return F.coalesce(F.col("http_status").between(400, 499), F.lit(False))


def attempt_status(attempts: DataFrame) -> DataFrame:
    """Per (run, record): the deciding attempt and the delivery status.

    The first success or 4xx decides; without one the last failure does.
    """
    at = F.struct("attempt", "id", "http_status")
    decided = attempts.groupBy("run_id", "record_id").agg(
        F.min(F.when(_success() | _rejected(), at)).alias("end"), F.max(at).alias("last"),
        F.min("id").alias("first_id"))
    ended = F.coalesce("end", "last")
    out = decided.select("run_id", "record_id", "first_id", ended["attempt"].alias("attempts_used"),
                         ended["http_status"].alias("http_status"))
    return out.withColumn("status", F.when(_success(), "pushed").when(_rejected(), "rejected").otherwise("failed"))


def backoff(attempts: DataFrame, base: float = 0.5, max_retries: int = 3) -> DataFrame:
    """Wait before the next try of each failed attempt; NULL when there is no next try."""
    retry = ~_success() & ~_rejected() & (F.col("attempt") < max_retries)
    wait = F.lit(float(base)) * F.pow(F.lit(2.0), F.col("attempt") - 1)
    return attempts.select("id", "run_id", "record_id", "attempt", "http_status", F.when(retry, wait).alias("wait_s"))


def outage_scan(statuses: DataFrame, limit: int = 3, batch_size: int = 10) -> DataFrame:
    """Records of each run in delivery order with the count of failures since the last success.

    A success resets the count, a 4xx leaves it; every run starts anew. The
    running sums go chunk by chunk: each run's part of a chunk is scanned on
    its own, and one line for it is brought together to carry the sums over.
    """
    ordered = number_rows(statuses, ["run_id", "first_id", "record_id"])
    w = Window.partitionBy("run_id", CHUNK).orderBy(POS)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ordered.withColumn("_fails", F.count_if(F.col("status") == "failed").over(so_far))
    local = local.withColumn("_reset", F.max(F.when(F.col("status") == "pushed", F.col("_fails"))).over(so_far))
    parts = local.groupBy("run_id", CHUNK).agg(
        F.max("_fails").alias("_total"), F.max("_reset").alias("_last_reset"), F.min(ROW).alias("_from"))
    parts = carry_in(parts, F.sum("_total"), "_before", 0, "run_id")
    parts = carry_in(parts, F.max(F.col("_before") + F.col("_last_reset")), "_reset_before", 0, "run_id")
    parts = parts.withColumn("_start", F.min("_from").over(Window.partitionBy("run_id")))
    whole = local.join(parts.select("run_id", CHUNK, "_before", "_reset_before", "_start"), ["run_id", CHUNK])
    position = F.col(ROW) - F.col("_start")
    since = F.col("_before") + F.col("_fails") - F.coalesce(F.col("_before") + F.col("_reset"), F.col("_reset_before"))
    return (whole.withColumn("consecutive_failures", since)
            .withColumn("outage", (F.col("consecutive_failures") >= limit) & (F.col("status") == "failed"))
            .withColumn("position", position).withColumn("batch", F.floor(position / batch_size).cast("long"))
            .select(*statuses.columns, "position", "batch", "consecutive_failures", "outage"))


def compensate(scanned: DataFrame) -> DataFrame:
    """Final status once the first outage of a run stops that run.

    Successes of the stopped batch are rolled back; everything after the stop
    was not attempted.
    """
    stopped = stops(scanned)
    batch = F.col("stopped_batch")
    final = (F.when(F.col("position") > F.col("stopped_at"), "not_attempted")
             .when((F.col("batch") == batch) & (F.col("status") == "pushed"), "rolled_back")
             .otherwise(F.col("status")))
    # A run may hold most of the rows: its one stop goes to all of them by way of the run's parts.
    spread = F.pmod(F.col("position"), F.lit(_PARTS)).cast("int")
    copied = stopped.select("run_id", "stopped_at", "stopped_batch", F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1))).alias("_part"))
    joined = scanned.withColumn("_part", spread).join(copied, ["run_id", "_part"], "left")
    return joined.withColumn("final_status", final).select(*scanned.columns, "final_status")


def stops(scanned: DataFrame) -> DataFrame:
    """(run_id, stopped_at, stopped_batch) of the runs that an outage stops."""
    first = scanned.filter("outage").groupBy("run_id").agg(F.min(F.struct("position", "batch")).alias("s"))
    return first.select("run_id", F.col("s.position").alias("stopped_at"), F.col("s.batch").alias("stopped_batch"))


def outage_findings(scanned: DataFrame, run_id: str) -> DataFrame:
    """A finding for the run if an outage stopped it: what was rolled back or not attempted waits for a decision."""
    final = compensate(scanned.filter(F.col("run_id") == run_id))
    waiting = final.filter(F.col("final_status").isin("rolled_back", "not_attempted"))
    return findings(
        waiting, run_id=run_id, type="TARGET_OUTAGE_HALT", group_key=F.lit(f"outage/{run_id}"),
        affected=F.col("record_id"), order=F.col("position"), context=as_json(first_position=F.col("position")),
        proposal=as_json(answers=F.lit("deliver, leave")))


def rollback_set(attempts: DataFrame, run_id: str) -> DataFrame:
    return attempts.filter((F.col("run_id") == run_id) & _success()).select("run_id", "record_id").distinct()


def retry_set(statuses: DataFrame) -> DataFrame:
    return statuses.filter(F.col("status").isin("failed", "rejected"))


def suggested_id(key: Column, prefix: str = "E") -> Column:
    """A stand-in id derived from the key, the same on every run."""
    number = F.conv(F.left(F.sha2(key.cast("string"), 256), F.lit(8)), 16, 10).cast("bigint") % 8999 + 1000
    return F.concat(F.lit(prefix), number.cast("string"))


def rejected_findings(statuses: DataFrame, run_id: str, missing_id_codes: tuple[int, ...] = (400,)) -> DataFrame:
    """Review findings for rejected records; a missing id comes with a suggestion."""
    missing = F.col("http_status").isin(*missing_id_codes)
    key = F.col("record_id").cast("string")
    return findings(
        statuses.filter(F.col("status") == "rejected"), run_id=run_id, type="PUSH_REJECTED_4XX",
        group_key=F.concat(F.lit("refused/"), key), affected=key,
        context=as_json(status_code=F.col("http_status"), field=F.when(missing, F.lit("employee_id"))),
        proposal=as_json(answers=F.when(missing, F.lit("new id, reject")).otherwise(F.lit("correct, reject")),
                         canonical_value=F.when(missing, suggested_id(F.col("record_id")))))


def delivery_events(attempts: DataFrame, run_id: str, limit: int = 3, batch_size: int = 10, max_retries: int = 3) -> list[DataFrame]:
    """The run's delivery as ledger events: each attempt, each wait, how each record ended, and the batch an outage rolls back.

    What comes after the deciding attempt of a record, or after the outage, did not happen.
    """
    mine = attempts.filter(F.col("run_id") == run_id)
    final = materialize(compensate(outage_scan(attempt_status(mine), limit, batch_size)), "delivered").filter("final_status <> 'not_attempted'")
    record = F.col("record_id").cast("string")

    def emit(rows: DataFrame, type: str, actor: str = "agent", entity: Column = record, **parts) -> DataFrame:
        return events(rows, run_id=run_id, stage="push", type=type, actor=actor, entity_type="record", entity_id=entity, **parts)

    counts = final.withColumn("n", F.col("attempts_used"))
    hot = hot_keys(counts, ["record_id"])  # the attempts of a record are few, but the log does not say so
    made = salted_join(backoff(mine, max_retries=max_retries), final.select("record_id", "attempts_used"), ["record_id"], hot, "id").filter("attempt <= attempts_used")
    rolled = final.filter("final_status = 'rolled_back'").groupBy("run_id", "batch").agg(F.count(F.lit(1)).alias("n"))
    return [emit(made, "PUSH_ATTEMPT", field=F.col("attempt")),
            emit(made.filter("wait_s IS NOT NULL AND attempt < attempts_used"), "PUSH_RETRIED", field=F.col("attempt"), reason=F.concat(F.lit("HTTP "), F.col("http_status")), score=F.col("wait_s")),
            emit(final.filter("status = 'pushed'"), "PUSH_SUCCEEDED", reason=F.concat(F.lit("HTTP "), F.col("http_status"))),
            emit(final.filter("status IN ('rejected', 'failed')"), "PUSH_FAILED", reason=F.concat(F.lit("HTTP "), F.col("http_status"))),
            emit(rolled, "BATCH_ROLLED_BACK", "system", F.col("batch").cast("string"), after=F.col("n"))]


def save_canonical(valid: DataFrame, run_id: str, path: str) -> None:
    """Store a run's records as ``ready`` in the run's own partition, replacing what an earlier try left, even by nothing."""
    name = re.sub(r"""["#%'*/:=?\\{\[\]^\x00-\x1f\x7f]""", lambda m: f"%{ord(m[0]):02X}", run_id)
    valid.drop("run_id").withColumn("status", F.lit("ready")).write.mode("overwrite").parquet(f"{path.rstrip('/')}/run_id={name}")
