"""Queries over reports, the event ledger and its stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tributary.operators import delivery, digests, ledger as ledger_ops, mapping, profile, reports, review
from tributary.operators.search_index import SearchIndex
from tributary.plans import delivery_queries, oracle as o  # noqa: F401 (defines the attempt blocks)
from tributary.plans.registry import query
from tributary.plans.review_queries import record_findings
from tributary.plans.source_queries import tables_as_sources
from tributary.session import materialize, scratch_path
from tributary.sources import bridge as b, exports, readers
from tributary.streaming import tail

RUN = "run_0"
_TALLY = ("count(*) FILTER (WHERE actor = 'agent') AS agent, count(*) FILTER (WHERE actor = 'rule') AS rule, "
          "count(*) FILTER (WHERE actor = 'human') AS human")
_PCT = "CASE WHEN agent + rule + human > 0 THEN round(100.0 * (agent + rule) / (agent + rule + human), 1) ELSE 100.0 END AS autonomy_pct"


def _source_rows(spark, sf) -> DataFrame:
    out = None
    for name, df in b.exports(spark, sf).items():
        part = df.select(F.lit(RUN).alias("run_id"), F.lit(name).alias("source"))
        out = part if out is None else out.unionByName(part)
    return out


o.block("record_items", "SELECT group_key, any_value(type) AS type FROM record_findings GROUP BY group_key", "record_findings")


@query("run_summary", o.with_blocks("""
SELECT 'run_0' AS run_id, (SELECT count(*) FROM staged) AS source_rows_in, count(*) AS canonical_records, count_if(status = 'ready')::BIGINT AS ready,
       0::BIGINT AS pushed, 0::BIGINT AS failed, 0::BIGINT AS rejected, 0::BIGINT AS rolled_back, (SELECT count(*) FROM record_items) AS pending_review, 0::BIGINT AS resolved_by_human
FROM canonical""", "staged", "canonical", "record_items"))
def run_summary(spark, sf):
    found, canonical = record_findings(spark, sf)
    return reports.run_summary(_source_rows(spark, sf), canonical, review.items(found), RUN)


@query("delivery_summary", o.with_blocks("""
SELECT 'run_0' AS run_id, (SELECT count(*) FROM ledger WHERE run_id = 'run_0') AS source_rows_in, count(*) AS canonical_records, 0::BIGINT AS ready,
       count_if(status = 'pushed')::BIGINT AS pushed, count_if(status = 'failed')::BIGINT AS failed, count_if(status = 'rejected')::BIGINT AS rejected, 0::BIGINT AS rolled_back,
       (SELECT count(*) FROM ledger WHERE run_id = 'run_0' AND type = 'ERROR') AS pending_review,
       (SELECT count(*) FROM ledger WHERE run_id = 'run_0' AND type <> 'ERROR') AS resolved_by_human
FROM statuses WHERE run_id = 'run_0'""", "ledger", "statuses"))
def delivery_summary(spark, sf):
    from tributary.operators.delivery import attempt_status
    events = b.ledger(spark, sf)
    items = events.select("run_id", F.when(F.col("type") == "ERROR", "pending").otherwise("resolved").alias("status"))
    return reports.run_summary(events, attempt_status(b.attempts(spark, sf)), items, RUN)


@query("scoreboard", o.with_blocks(f"""
SELECT stage, agent, rule, human, {_PCT} FROM (
  SELECT stage, {_TALLY} FROM ledger WHERE run_id = 'run_0' AND actor IN ('agent', 'rule', 'human') GROUP BY ROLLUP (stage))""", "ledger"))
def scoreboard(spark, sf):
    return reports.scoreboard(b.ledger(spark, sf), RUN)


@query("stage_autonomy", o.with_blocks(f"""
SELECT stage, {_PCT} FROM (SELECT stage, {_TALLY} FROM ledger WHERE run_id = 'run_0' AND actor IN ('agent', 'rule', 'human') GROUP BY stage)""", "ledger"))
def stage_autonomy(spark, sf):
    return reports.stage_autonomy(b.ledger(spark, sf), RUN)


@query("dropped_columns", o.with_blocks(
    """SELECT source, col AS "column", decision, target_field AS best_field, score FROM table_decisions WHERE decision = 'DROP'""",
    "table_decisions"))
def dropped_columns(spark, sf):
    profiles = profile.profile(tables_as_sources(spark, sf), b.CONTRACT)
    return reports.dropped_columns(mapping.decide(profiles, b.CONTRACT))


@query("conflict_ledger", o.with_blocks("""
SELECT field, winner_source AS winning_source, source AS losing_source, count(*) AS conflicts FROM differing WHERE NOT sensitive GROUP BY ALL""", "differing"))
def conflict_ledger(spark, sf):
    from tributary.operators import entity
    lost = entity.conflicts(*b.merged(spark, sf), b.CONTRACT)
    return lost.groupBy("field", "winning_source", "losing_source").agg(F.count(F.lit(1)).alias("conflicts"))


@query("manifest", o.with_blocks("""
SELECT canonical_key, trim(concat_ws(' ', first_name, last_name)) AS name, coalesce(email, '') AS email,
       coalesce(department, '') AS department, status FROM canonical""", "canonical"))
def manifest(spark, sf):
    return reports.manifest(b.canonical(b.merged(spark, sf)[2]))


@query("record_export", o.with_blocks("SELECT canonical_key AS employee_id, " + ", ".join(
    f"coalesce({c}, '') AS {c}" for c in exports.RECORD_COLUMNS[1:-1]) + ", status AS push_status FROM canonical", "canonical"))
def record_export(spark, sf):
    return exports.records_table(b.canonical(b.merged(spark, sf)[2]))


@query("dashboard", o.with_blocks("""
SELECT 'run_0' AS run_id, (SELECT count(*) FROM staged) AS total_source_rows, (SELECT count(*) FROM ledger WHERE run_id = 'run_0' AND type = 'ERROR') AS pending_items,
       (SELECT count(DISTINCT record_id) FROM attempts WHERE run_id = 'run_0' AND http_status IN (200, 201)) AS pushed_records,
       (SELECT round(100.0 * count_if(actor IN ('agent', 'rule')) / count_if(actor IN ('agent', 'rule', 'human')), 1) FROM ledger WHERE run_id = 'run_0') AS autonomy_score
""", "staged", "ledger", "attempts"))
def dashboard(spark, sf):
    events = b.ledger(spark, sf)
    items = events.select("run_id", F.when(F.col("type") == "ERROR", "pending").otherwise("resolved").alias("status"))
    return reports.dashboard(_source_rows(spark, sf), items, b.attempts(spark, sf), events, RUN)


@query("sync_rate", o.with_blocks("""
SELECT count_if(status = 'pushed')::BIGINT AS pushed_count, count(*) AS total_count, CAST(round(100.0 * count_if(status = 'pushed') / count(*), 0) AS INT) AS sync_rate
FROM statuses""", "statuses"))
def sync_rate(spark, sf):
    from tributary.operators.delivery import attempt_status
    return reports.sync_rate(attempt_status(b.attempts(spark, sf)))


_LEDGER_COLUMNS = ["id", "run_id", "stage", "type", "actor", "entity_id", "score"]


@query("audit_top500", o.with_blocks(
    f"SELECT {', '.join(_LEDGER_COLUMNS)} FROM ledger WHERE run_id = 'run_0' AND actor = 'agent' ORDER BY id DESC LIMIT 500", "ledger"))
def audit_top500(spark, sf):
    return reports.audit_view(b.ledger(spark, sf), RUN, actor="agent").select(*_LEDGER_COLUMNS)


@query("record_json", o.with_blocks(
    "SELECT canonical_key, status, email, salary, hire_date FROM canonical", "canonical"))
def record_json(spark, sf):
    """The JSON export, written and read again."""
    path = scratch_path(spark, "record_json")
    exports.write_records_json(b.canonical(b.merged(spark, sf)[2]), ["email", "salary", "hire_date"], path)
    record = "record struct<email:string,salary:string,hire_date:string>"
    return spark.read.schema(f"canonical_key string, status string, {record}").json(path).select("canonical_key", "status", "record.*")


@query("csv_source", o.with_blocks("SELECT 'records' AS source, row_number() OVER (ORDER BY encode(canonical_key)) AS row_num, " + ", ".join(
    f"{o.clean(c)} AS {c}" for c in exports.RECORD_COLUMNS[1:-1]) + " FROM canonical", "canonical"))
def csv_source(spark, sf):
    """The CSV export, written in key order and read as a source."""
    path = scratch_path(spark, "records")
    exports.write_records_csv(b.canonical(b.merged(spark, sf)[2]), path)
    rows = readers.read_source(spark, path, "records", "csv")
    return rows.select(F.col(readers.SOURCE).alias("source"), F.col(readers.ROW_NUM).alias("row_num"), *exports.RECORD_COLUMNS[1:-1])


@query("saved_records", o.with_blocks(
    "SELECT 'run_0' AS run_id, canonical_key, 'ready' AS status FROM canonical WHERE outcome = 'valid'", "canonical"))
def saved_records(spark, sf):
    path = scratch_path(spark, "saved")
    delivery.save_canonical(b.canonical(b.merged(spark, sf)[2]).filter("outcome = 'valid'"), RUN, path)
    return spark.read.parquet(path).select("run_id", "canonical_key", "status")


@query("audit_export", o.with_blocks(f"SELECT {', '.join(_LEDGER_COLUMNS)} FROM ledger WHERE run_id = 'run_0'", "ledger"))
def audit_export(spark, sf):
    return exports.audit_table(b.ledger(spark, sf), RUN, _LEDGER_COLUMNS)


@query("audit_csv", o.with_blocks("""
SELECT row_number() OVER (ORDER BY id) AS row_num, id::VARCHAR AS id, run_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, stage, type, actor, 'user' AS entity_type, entity_id,
       lower(type) AS field, CASE WHEN actor = 'human' THEN 'said "no", then' || chr(10) || 'yes' END AS before, stage || ',' || actor AS after,
       CASE WHEN type = 'ERROR' THEN 'told' END AS reason, (id % 7)::DOUBLE::VARCHAR AS score
FROM ledger WHERE run_id = 'run_0'""", "ledger"))
def audit_csv(spark, sf):
    """The audit export with all its columns, written as CSV and read as a source; some cells hold quotes, commas and line breaks."""
    told = F.when(F.col("actor") == "human", F.concat(F.lit('said "no", then'), F.lit("\n"), F.lit("yes")))
    events = b.ledger(spark, sf).withColumns({
        "ts": F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "entity_type": F.lit("user"), "field": F.lower("type"), "before": told,
        "after": F.concat_ws(",", "stage", "actor"), "reason": F.when(F.col("type") == "ERROR", "told"), "score": (F.col("id") % 7).cast("double")})
    path = scratch_path(spark, "audit")
    exports.write_audit_csv(events, "run_0", path)
    rows = readers.read_source(spark, path, "audit", "csv", multiLine="true")
    return rows.select(F.col(readers.ROW_NUM).alias("row_num"), *exports.AUDIT_COLUMNS)


@query("event_page", o.with_blocks(
    f"SELECT {', '.join(_LEDGER_COLUMNS)} FROM ledger WHERE run_id = 'run_1' AND id > 100 ORDER BY id LIMIT 20", "ledger"))
def event_page(spark, sf):
    return ledger_ops.tail_page(b.ledger(spark, sf), "run_1", 100, 20).select(*_LEDGER_COLUMNS)


@query("record_search", o.with_blocks("""
SELECT * FROM (SELECT canonical_key, trim(concat_ws(' ', first_name, last_name)) AS name, coalesce(email, '') AS email,
       coalesce(department, '') AS department, status FROM canonical)
WHERE status <> 'pushed' AND (contains(lower(canonical_key), 'cd') OR contains(lower(name), 'cd') OR contains(lower(email), 'cd') OR contains(lower(department), 'cd'))
""", "canonical"))
def record_search(spark, sf):
    return reports.search(b.canonical(b.merged(spark, sf)[2]), " CD ", tab="other")


@query("indexed_search", o.with_blocks("""
SELECT text, canonical_key, name, email, department, status FROM (
  SELECT canonical_key, trim(concat_ws(' ', first_name, last_name)) AS name, coalesce(email, '') AS email, coalesce(department, '') AS department, status FROM canonical),
  (SELECT unnest(['cd', 'famb', '@example.com', 'E00012', 'zzz', 'nab fam']) AS text)
WHERE contains(lower(canonical_key), lower(text)) OR contains(lower(name), lower(text)) OR contains(lower(email), lower(text)) OR contains(lower(department), lower(text))
""", "canonical"))
def indexed_search(spark, sf):
    """Several texts looked for through postings; the records were taken up in two loads, the second with newer versions of some."""
    records = b.canonical(b.merged(spark, sf)[2]).select("canonical_key", "first_name", "last_name", "email", "department", "status")
    canonical = materialize(records, "canonical")  # both loads read it
    index = SearchIndex(spark, scratch_path(spark, "search"), parts=16)
    index.add(canonical.withColumn("status", F.when(F.col("status") == "ready", "old").otherwise(F.col("status"))), 1)
    index.add(canonical.filter("status = 'ready'"), 2)
    out = None
    for text in ("cd", "famb", "@example.com", "E00012", "zzz", "nab fam"):
        found = index.search(text).select(F.lit(text).alias("text"), "canonical_key", "name", "email", "department", "status")
        out = found if out is None else out.unionByName(found)
    return out


@query("latest_run", o.with_blocks("""
SELECT run_id, CAST(min(ts) AS VARCHAR) AS started_at FROM ledger GROUP BY run_id ORDER BY min(ts) DESC, run_id DESC LIMIT 1""", "ledger"))
def latest_run(spark, sf):
    runs = b.ledger(spark, sf).groupBy("run_id").agg(F.min("ts").alias("started_at"))
    return reports.latest_run(runs).select("run_id", F.col("started_at").cast("string").alias("started_at"))


@query("latest_attempt", o.with_blocks("""
SELECT o.o_orderkey, a.id AS attempt_id, a.attempt, a.http_status FROM orders o
LEFT JOIN (SELECT record_id, max(id) AS id, arg_max(attempt, id) AS attempt, arg_max(http_status, id) AS http_status FROM attempts GROUP BY record_id) a
ON a.record_id = o.o_orderkey""", "attempts"))
def latest_attempt(spark, sf):
    run = F.concat(F.lit("run_"), (F.floor(F.col("o_orderkey") / 200) % 2).cast("string"))  # the run that delivers the record
    records = b.table(spark, sf, "orders").select("o_orderkey", run.alias("run_id"))
    return reports.latest_attempt(records, b.attempts(spark, sf), "o_orderkey").drop("run_id")


@query("ledger_tail_stream", o.with_blocks(
    f"SELECT {', '.join(_LEDGER_COLUMNS)} FROM ledger WHERE run_id = 'run_2' AND id > 50", "ledger"))
def ledger_tail_stream(spark, sf):
    schema = b.table(spark, sf, "events").schema
    files = tail.read_events(spark, sf, schema, pathGlobFilter="events.parquet")
    stream = spark.sql(b.LEDGER.replace("FROM events", "FROM {events}"), events=files)
    return tail.drain(tail.after(stream, "run_2", from_id=50).select(*_LEDGER_COLUMNS))


@query("ledger_integrity", o.with_blocks("""
SELECT run_id, count(*) AS event_count, count(DISTINCT id) AS distinct_ids, min(id) AS min_id, max(id) AS max_id,
       count(*) = count(DISTINCT id) AS ids_unique, count(DISTINCT id) = max(id) - min(id) + 1 AS ids_dense FROM ledger GROUP BY run_id""", "ledger"))
def ledger_integrity(spark, sf):
    return ledger_ops.integrity(b.ledger(spark, sf))


@query("lost_events", o.with_blocks("""
SELECT run_id, id FROM ledger WHERE type = 'ERROR' AND score >= 10""", "ledger"))
def lost_events(spark, sf):
    earlier = b.ledger(spark, sf)
    later = earlier.filter((F.col("type") != "ERROR") | F.col("score").isNull() | (F.col("score") < 10))
    return ledger_ops.lost_events(earlier, later)


def _as_ledger(events: DataFrame) -> DataFrame:
    """The events of the bench with all columns of a ledger."""
    have = dict(events.dtypes)
    fields = [f.strip().split(" ") for f in ledger_ops.LEDGER_SCHEMA.split(",")]
    return events.select(*[F.col(n).cast(t).alias(n) if n in have else F.lit(None).cast(t).alias(n) for n, t in fields])


@query("lost_by_digest", o.with_blocks("SELECT run_id, id FROM ledger WHERE id % 977 = 5 OR id % 1499 = 7", "ledger"))
def lost_by_digest(spark, sf):
    """Against a later snapshot with some events changed, some gone, and others added."""
    earlier = b.ledger(spark, sf)
    later = earlier.filter("id % 1499 <> 7").withColumn("type", F.when(F.col("id") % 977 == 5, "CHANGED").otherwise(F.col("type")))
    more = earlier.withColumn("id", F.col("id") + 1_000_000_000)
    trees = [digests.tree(digests.leaves(df)) for df in (earlier, later.unionByName(more))]
    return digests.lost_events(earlier, later.unionByName(more), *trees)


def clustered_ledger(spark, sf) -> str:
    path = scratch_path(spark, "ledger")
    ledger_ops.append_clustered(_as_ledger(b.ledger(spark, sf)), path, events_per_file=500)
    return path


@query("clustered_event_page", o.with_blocks(f"SELECT {', '.join(_LEDGER_COLUMNS)}, 2 >= 1 AS few_files FROM ledger WHERE run_id = 'run_1' AND id > 100 ORDER BY id LIMIT 20", "ledger"))
def clustered_event_page(spark, sf):
    page = ledger_ops.clustered_page(spark, clustered_ledger(spark, sf), "run_1", 100, 20)
    return page.select(*_LEDGER_COLUMNS, F.lit(len(page.inputFiles()) <= 2).alias("few_files"))
