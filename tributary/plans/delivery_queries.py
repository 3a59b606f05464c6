"""Queries over delivery requests and the attempt log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tributary.operators import delivery, ledger, review
from tributary.plans import oracle as o
from tributary.plans.registry import query
from tributary.session import scratch_path
from tributary.sources import bridge as b
from tributary.streaming import tail

_PAYLOAD = ["o_custkey", "o_orderpriority", "o_orderstatus"]
_KEY_SQL = ("sha256(CAST({key} AS VARCHAR) || ':' || CAST(to_json({{'o_custkey': CAST(o_custkey AS VARCHAR), "
            "'o_orderpriority': o_orderpriority, 'o_orderstatus': o_orderstatus}}) AS VARCHAR))")


def _orders_as_text(spark, sf) -> DataFrame:
    return b.table(spark, sf, "orders").withColumn("o_custkey", F.col("o_custkey").cast("string"))


@query("idempotency_keys", f"SELECT o_orderkey, {_KEY_SQL.format(key='o_orderkey')} AS idempotency_key FROM orders")
def idempotency_keys(spark, sf):
    return _orders_as_text(spark, sf).select(
        "o_orderkey", delivery.idempotency_key(F.col("o_orderkey").cast("string"), _PAYLOAD).alias("idempotency_key"))


@query("delivery_batches", """
SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 10.0) AS BIGINT) AS batch FROM orders""")
def delivery_batches(spark, sf):
    return delivery.batches(b.table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"])


o.block("requests", f"""
SELECT o_orderkey AS request_seq, CASE WHEN o_orderpriority <> '5-LOW' THEN 'E' || CAST(o_custkey AS VARCHAR) END AS employee_id,
       {_KEY_SQL.format(key='o_custkey')} AS idempotency_key FROM orders""")
o.block("answers", """
SELECT r.*, CASE WHEN r.employee_id IS NULL THEN 'missing_id' WHEN h.seq = r.request_seq THEN 'created'
                 WHEN h.key = r.idempotency_key THEN 'already_processed' ELSE 'conflict' END AS outcome
FROM requests r LEFT JOIN (SELECT employee_id, min(request_seq) AS seq, arg_min(idempotency_key, request_seq) AS key
                           FROM requests WHERE employee_id IS NOT NULL GROUP BY 1) h ON h.employee_id = r.employee_id""", "requests")


def _answers(spark, sf) -> DataFrame:
    orders = _orders_as_text(spark, sf)
    requests = orders.select(
        F.col("o_orderkey").alias("request_seq"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.concat(F.lit("E"), "o_custkey")).alias("employee_id"),
        delivery.idempotency_key(F.col("o_custkey"), _PAYLOAD).alias("idempotency_key"))
    return delivery.accept(requests)


@query("delivery_dedupe", o.with_blocks("SELECT request_seq, employee_id, outcome FROM answers WHERE outcome IN ('created', 'already_processed')", "answers"))
def delivery_dedupe(spark, sf):
    return _answers(spark, sf).filter(F.col("outcome").isin("created", "already_processed")).select("request_seq", "employee_id", "outcome")


@query("key_conflicts", o.with_blocks("""
SELECT request_seq, employee_id, outcome, CASE outcome WHEN 'conflict' THEN 409 ELSE 400 END AS http_status
FROM answers WHERE outcome IN ('conflict', 'missing_id')""", "answers"))
def key_conflicts(spark, sf):
    return _answers(spark, sf).filter(F.col("outcome").isin("conflict", "missing_id")) \
                              .select("request_seq", "employee_id", "outcome", "http_status")


o.block("statuses", """
SELECT run_id, record_id, first_id, attempts_used, http_status,
       CASE WHEN http_status IN (200, 201) THEN 'pushed' WHEN http_status BETWEEN 400 AND 499 THEN 'rejected' ELSE 'failed' END AS status
FROM (SELECT run_id, record_id, min(id) AS first_id,
             coalesce(min(attempt) FILTER (WHERE http_status < 500), max(attempt)) AS attempts_used,
             coalesce(arg_min(http_status, attempt) FILTER (WHERE http_status < 500), arg_max(http_status, attempt)) AS http_status
      FROM attempts GROUP BY run_id, record_id)""", "attempts")


@query("attempt_status", o.with_blocks("SELECT * FROM statuses", "statuses"))
def attempt_status(spark, sf):
    return delivery.attempt_status(b.attempts(spark, sf))


@query("backoff", o.with_blocks("""
SELECT id, run_id, record_id, attempt, http_status, CASE WHEN http_status >= 500 AND attempt < 3 THEN 0.5 * 2 ** (attempt - 1) END::DOUBLE AS wait_s
FROM attempts""", "attempts"))
def backoff(spark, sf):
    return delivery.backoff(b.attempts(spark, sf))


o.block("scanned", """
SELECT *, status = 'failed' AND consecutive_failures >= 3 AS outage FROM (
  SELECT *, count_if(status = 'failed') OVER (PARTITION BY run_id, island ORDER BY first_id ROWS UNBOUNDED PRECEDING)::BIGINT AS consecutive_failures,
         row_number() OVER w - 1 AS position, CAST(floor((row_number() OVER w - 1) / 10.0) AS BIGINT) AS batch
  FROM (SELECT *, count_if(status = 'pushed') OVER (PARTITION BY run_id ORDER BY first_id ROWS UNBOUNDED PRECEDING) AS island FROM statuses)
  WINDOW w AS (PARTITION BY run_id ORDER BY first_id))
""", "statuses")
o.block("final_statuses", """
SELECT *, CASE WHEN position > stop_at THEN 'not_attempted' WHEN batch = stop_batch AND status = 'pushed' THEN 'rolled_back'
               ELSE status END AS final_status
FROM scanned LEFT JOIN (SELECT run_id, min(position) AS stop_at, arg_min(batch, position) AS stop_batch FROM scanned WHERE outage GROUP BY run_id)
     USING (run_id)""", "scanned")


@query("outage", o.with_blocks("SELECT run_id, record_id, status, position, batch, consecutive_failures, outage FROM scanned", "scanned"))
def outage(spark, sf):
    return delivery.outage_scan(delivery.attempt_status(b.attempts(spark, sf))).select(
        "run_id", "record_id", "status", "position", "batch", "consecutive_failures", "outage")


@query("batch_compensation", o.with_blocks("SELECT run_id, record_id, batch, final_status FROM final_statuses", "final_statuses"))
def batch_compensation(spark, sf):
    scanned = delivery.outage_scan(delivery.attempt_status(b.attempts(spark, sf)))
    return delivery.compensate(scanned).select("run_id", "record_id", "batch", "final_status")


@query("outage_items", o.with_blocks("""
SELECT 'outage/' || run_id AS group_key, 'TARGET_OUTAGE_HALT' AS type, count(*) AS affected_count
FROM final_statuses WHERE run_id = 'run_1' AND final_status IN ('rolled_back', 'not_attempted') GROUP BY run_id""", "final_statuses"))
def outage_items(spark, sf):
    scanned = delivery.outage_scan(delivery.attempt_status(b.attempts(spark, sf)))
    return review.items(delivery.outage_findings(scanned, "run_1")).select("group_key", "type", "affected_count")


@query("run_rollback", o.with_blocks(
    "SELECT DISTINCT run_id, record_id FROM attempts WHERE run_id = 'run_0' AND http_status IN (200, 201)", "attempts"))
def run_rollback(spark, sf):
    return delivery.rollback_set(b.attempts(spark, sf), "run_0")


@query("retry_set", o.with_blocks("SELECT run_id, record_id, status FROM statuses WHERE status IN ('failed', 'rejected')", "statuses"))
def retry_set(spark, sf):
    return delivery.retry_set(delivery.attempt_status(b.attempts(spark, sf))).select("run_id", "record_id", "status")


@query("rejected_items", o.with_blocks("""
SELECT 'refused/' || CAST(record_id AS VARCHAR) AS group_key, 'PUSH_REJECTED_4XX' AS type, 1::BIGINT AS affected_count,
       'E' || CAST(CAST('0x' || substr(sha256(CAST(record_id AS VARCHAR)), 1, 8) AS BIGINT) % 8999 + 1000 AS VARCHAR) AS suggested_id
FROM statuses WHERE status = 'rejected'""", "statuses"))
def rejected_items(spark, sf):
    found = delivery.rejected_findings(delivery.attempt_status(b.attempts(spark, sf)), "run_0", missing_id_codes=(422,))
    return review.items(found).select("group_key", "type", "affected_count",
                                      F.get_json_object("proposal", "$.canonical_value").alias("suggested_id"))


@query("delivery_ledger", o.with_blocks("""
WITH ends AS (SELECT * FROM final_statuses WHERE run_id = 'run_0' AND final_status <> 'not_attempted'),
made AS (SELECT a.*, e.attempts_used FROM attempts a JOIN ends e USING (run_id, record_id) WHERE a.attempt <= e.attempts_used)
SELECT 'PUSH_ATTEMPT' AS type, 'agent' AS actor, record_id::VARCHAR AS entity_id, attempt::VARCHAR AS field, NULL AS reason FROM made
UNION ALL SELECT 'PUSH_RETRIED', 'agent', record_id::VARCHAR, attempt::VARCHAR, 'HTTP ' || http_status FROM made WHERE http_status >= 500 AND attempt < 3 AND attempt < attempts_used
UNION ALL SELECT CASE status WHEN 'pushed' THEN 'PUSH_SUCCEEDED' ELSE 'PUSH_FAILED' END, 'agent', record_id::VARCHAR, NULL, 'HTTP ' || http_status FROM ends
UNION ALL SELECT DISTINCT 'BATCH_ROLLED_BACK', 'system', batch::VARCHAR, NULL, NULL FROM ends WHERE final_status = 'rolled_back'""".replace("WITH ends", "SELECT * FROM (WITH ends") + ")",
    "final_statuses", "attempts"))
def delivery_ledger(spark, sf):
    return ledger.number_events(delivery.delivery_events(b.attempts(spark, sf), "run_0")).select("type", "actor", "entity_id", "field", "reason")


@query("delivery_stream", o.with_blocks("SELECT request_seq, employee_id, outcome FROM answers", "answers"))
def delivery_stream(spark, sf):
    """All requests in four files one after the other; each is answered when it comes, from the store that the earlier ones left."""
    orders = _orders_as_text(spark, sf)
    requests = orders.select(
        F.col("o_orderkey").alias("request_seq"), F.when(F.col("o_orderpriority") != "5-LOW", F.concat(F.lit("E"), "o_custkey")).alias("employee_id"),
        delivery.idempotency_key(F.col("o_custkey"), _PAYLOAD).alias("idempotency_key"), F.col("o_orderstatus").alias("payload"))
    last = orders.agg(F.max("o_orderkey")).first()[0] or 0
    base = scratch_path(spark, "delivery")
    for part in range(4):
        mine = F.floor(F.col("request_seq") * 4 / (last + 1)) == part
        requests.filter(mine).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(requests.schema).parquet(f"{base}/in")
        tail.deliver(stream, f"{base}/store", f"{base}/answers", f"{base}/progress", parts=16).awaitTermination()
    return spark.read.parquet(f"{base}/answers").select("request_seq", "employee_id", "outcome")
