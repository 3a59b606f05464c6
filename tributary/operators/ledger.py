"""The append-only event ledger."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from tributary.operators.ordering import ROW, number_rows
from tributary.session import materialize

LEDGER_SCHEMA = (
    "id long, run_id string, ts timestamp, stage string, type string, actor string, entity_type string, "
    "entity_id string, field string, before string, after string, reason string, score double, "
    "escalation_id string, meta_json string"
)

# Event types and actors.
EVENT_TYPES = (
    "RUN_STARTED", "FILE_INGESTED", "COLUMN_PROFILED", "MAPPING_PROPOSED", "MAPPING_ACCEPTED",
    "VALUE_NORMALIZED", "DATE_FORMAT_RESOLVED", "RECORDS_MERGED", "CONFLICT_RESOLVED", "AUTOFIX_APPLIED",
    "VALIDATION_FAILED", "ESCALATION_OPENED", "HUMAN_RESOLVED", "RULE_CREATED", "RULE_APPLIED",
    "PUSH_ATTEMPT", "PUSH_SUCCEEDED", "PUSH_RETRIED", "PUSH_FAILED", "BATCH_ROLLED_BACK",
    "CIRCUIT_BREAKER_TRIPPED", "RUN_COMPLETED",
)
ACTORS = ("agent", "rule", "human", "system")
STAGES = ("run", "ingest", "profile", "mapping", "normalize", "reconcile", "validate", "escalation", "rules", "push", "complete")


def _text(value) -> Column:
    """Plain values stay text, structures become JSON."""
    if value is None:
        return F.lit(None).cast("string")
    if not isinstance(value, Column):
        return F.lit(str(value))
    return value.cast("string")


def as_json(**parts: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in parts.items()]))


def events(df: DataFrame, *, run_id: str, stage: str, type: str, actor: str, entity_type=None, entity_id=None,
           field=None, before=None, after=None, reason=None, score=None, escalation_id=None,
           meta_json=None) -> DataFrame:
    """One un-numbered event per row of ``df``; arguments are columns or plain values."""
    if type not in EVENT_TYPES or actor not in ACTORS or stage not in STAGES:
        raise ValueError(f"unknown event: {stage}/{type}/{actor}")
    number = score if isinstance(score, Column) else F.lit(score)
    return df.select(
        F.lit(run_id).alias("run_id"), F.lit(stage).alias("stage"), F.lit(type).alias("type"),
        F.lit(actor).alias("actor"), _text(entity_type).alias("entity_type"), _text(entity_id).alias("entity_id"),
        _text(field).alias("field"), _text(before).alias("before"), _text(after).alias("after"),
        _text(reason).alias("reason"), number.cast("double").alias("score"),
        _text(escalation_id).alias("escalation_id"), _text(meta_json).alias("meta_json"))


def number_events(batches: list[DataFrame], ts: Column | None = None, first_id: int = 1) -> DataFrame:
    """Union of event batches with ids in a fixed order (stage, type, entity, field, texts).

    The same events get the same ids on every run, whatever the partitioning.
    """
    all_events = batches[0]
    for b in batches[1:]:
        all_events = all_events.unionByName(b)
    stage_rank = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    content = ["type", "entity_id", "field", "before", "after", "reason", "meta_json"]
    numbered = number_rows(all_events.withColumn("_stage_rank", stage_rank), ["_stage_rank", *content])
    return numbered.select(
        (F.col(ROW) + F.lit(first_id)).alias("id"), "run_id", (ts if ts is not None else F.current_timestamp()).alias("ts"),
        "stage", "type", "actor", "entity_type", "entity_id", "field", "before", "after", "reason", "score",
        "escalation_id", "meta_json")


def append(ledger_events: DataFrame, path: str) -> None:
    """Add events to the ledger; there is no other way to write it."""
    ledger_events.write.mode("append").partitionBy("run_id").parquet(path)


_INDEX = "run_id string, file string, min_id long, max_id long, n long"


def append_clustered(ledger_events: DataFrame, path: str, events_per_file: int = 1_000_000) -> None:
    """Add events in files that each hold a range of a run's ids, and list these files with their ranges.

    The list, one row a file, lies beside the events and is written after
    them: a page is looked up there, and only the files it needs are opened.
    """
    spark = ledger_events.sparkSession
    rows = materialize(ledger_events, "events")
    files = max(1, -(-rows.count() // events_per_file))
    folder = f"{path}/load={uuid.uuid4().hex}"
    rows.repartitionByRange(files, "run_id", "id").sortWithinPartitions("run_id", "id").write.partitionBy("run_id").parquet(folder)
    written = spark.read.schema(LEDGER_SCHEMA).parquet(folder).groupBy("run_id", F.col("_metadata.file_path").alias("file")).agg(
        F.min("id").alias("min_id"), F.max("id").alias("max_id"), F.count(F.lit(1)).alias("n"))
    written.coalesce(1).write.mode("append").parquet(f"{path}/_files")


def files_of(spark, path: str) -> DataFrame:
    """(run_id, file, min_id, max_id, n): where the events of a clustered ledger lie."""
    return spark.read.schema(_INDEX).parquet(f"{path}/_files")


def clustered_page(spark, path: str, run_id: str, after_id: int, limit: int) -> DataFrame:
    """``tail_page`` of a clustered ledger, from the files that can hold the page."""
    ahead = files_of(spark, path).filter((F.col("run_id") == run_id) & (F.col("max_id") > after_id))
    sure, end = 0, None
    for r in ahead.orderBy("min_id", "file").limit(limit).collect():  # a file has an event after the id at least, so these hold a page
        # of a file that begins before the page only one event is sure to be on it, unless its ids are dense
        dense = r["n"] == r["max_id"] - r["min_id"] + 1
        sure += r["n"] if r["min_id"] > after_id else r["max_id"] - after_id if dense else 1
        end = r["max_id"] if end is None else max(end, r["max_id"])
        if sure >= limit:
            break
    chosen = [] if end is None else [r["file"] for r in ahead.filter(F.col("min_id") <= end).select("file").collect()]
    if not chosen:
        return spark.createDataFrame([], LEDGER_SCHEMA)
    events = spark.read.schema(LEDGER_SCHEMA).option("basePath", path).parquet(*chosen)
    return tail_page(events.select(*spark.createDataFrame([], LEDGER_SCHEMA).columns), run_id, after_id, limit)


def current_end(spark, path: str, run_id: str) -> int:
    """The last id of a run of a clustered ledger, 0 where it has none; no event is read."""
    return files_of(spark, path).filter(F.col("run_id") == run_id).agg(F.max("max_id")).first()[0] or 0


def read_ledger(spark, path: str) -> DataFrame:
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def integrity(ledger: DataFrame) -> DataFrame:
    """Per run: event count, distinct ids, id span, and whether the ids are unique."""
    return (ledger.groupBy("run_id")
            .agg(F.count(F.lit(1)).alias("event_count"), F.countDistinct("id").alias("distinct_ids"),
                 F.min("id").alias("min_id"), F.max("id").alias("max_id"))
            .withColumn("ids_unique", F.col("event_count") == F.col("distinct_ids"))
            .withColumn("ids_dense", F.col("distinct_ids") == F.col("max_id") - F.col("min_id") + 1))


def lost_events(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """Events of an earlier snapshot that a later one lacks or changed; empty for an append-only ledger."""
    def packed(df):
        return df.select("run_id", "id", F.xxhash64(F.to_json(F.struct(*sorted(earlier.columns)))).alias("_content"))
    return packed(earlier).join(packed(later), ["run_id", "id", "_content"], "left_anti").select("run_id", "id")


def tail_page(ledger: DataFrame, run_id: str, after_id: int, limit: int) -> DataFrame:
    """The next ``limit`` events of a run after an id, oldest first."""
    return ledger.filter((F.col("run_id") == run_id) & (F.col("id") > after_id)).orderBy("id").limit(limit)
