"""Reports over a run: summary, autonomy, dashboards, audit and record views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tributary.operators.entity import hot_entities
from tributary.operators.skew import salted_join

DECIDERS = ("agent", "rule", "human")
STATUSES = ("ready", "pushed", "failed", "rejected", "rolled_back")


def run_summary(source_rows: DataFrame, canonical: DataFrame, item_rows: DataFrame, run_id: str) -> DataFrame:
    """One row of counts for a run; all zero when the run is unknown."""
    mine = F.col("run_id") == run_id
    status = F.col("status")

    def empty_counts(name, src, *aggs):
        return src.filter(mine).agg(*aggs).withColumn("run_id", F.lit(run_id)).alias(name)
    rows = empty_counts("r", source_rows, F.count(F.lit(1)).alias("source_rows_in"))
    recs = empty_counts("c", canonical, F.count(F.lit(1)).alias("canonical_records"),
                        *[F.count_if(status == s).alias(s) for s in STATUSES])
    reviews = empty_counts("i", item_rows, F.count_if(status == "pending").alias("pending_review"),
                           F.count_if(status == "resolved").alias("resolved_by_human"))
    return rows.join(recs, "run_id").join(reviews, "run_id")


def scoreboard(ledger: DataFrame, run_id: str) -> DataFrame:
    """Decisions per stage and actor with a total row (stage NULL) and autonomy in percent."""
    mine = ledger.filter((F.col("run_id") == run_id) & F.col("actor").isin(*DECIDERS))
    stages = mine.groupBy("stage").agg(*[F.count_if(F.col("actor") == a).alias(a) for a in DECIDERS])
    total = stages.agg(*[F.coalesce(F.sum(a), F.lit(0)).alias(a) for a in DECIDERS]).withColumn("stage", F.lit(None).cast("string"))
    return with_autonomy(stages.unionByName(total))


def with_autonomy(counts: DataFrame) -> DataFrame:
    total = F.col("agent") + F.col("rule") + F.col("human")
    share = F.round(100.0 * (F.col("agent") + F.col("rule")) / total, 1)
    return counts.withColumn("autonomy_pct", F.when(total > 0, share).otherwise(100.0))


def stage_autonomy(ledger: DataFrame, run_id: str) -> DataFrame:
    return scoreboard(ledger, run_id).filter(F.col("stage").isNotNull()).select("stage", "autonomy_pct")


def dropped_columns(decisions: DataFrame) -> DataFrame:
    return decisions.filter(F.col("decision").isin("DROP", "DUPLICATE_TARGET")).select(
        "source", "column", "decision", F.col("target_field").alias("best_field"), "score")


def manifest(canonical: DataFrame) -> DataFrame:
    name = F.trim(F.concat_ws(" ", "first_name", "last_name"))
    return canonical.select(
        "canonical_key", name.alias("name"), F.coalesce("email", F.lit("")).alias("email"),
        F.coalesce("department", F.lit("")).alias("department"), "status")


def dashboard(source_rows: DataFrame, item_rows: DataFrame, attempts: DataFrame, ledger: DataFrame, run_id: str) -> DataFrame:
    """Row count, pending items, delivered records and autonomy of one run (autonomy NULL without decisions)."""
    mine = F.col("run_id") == run_id

    def one(src, *aggs):
        return src.filter(mine).agg(*aggs).withColumn("run_id", F.lit(run_id))
    delivered = F.countDistinct(F.when(F.col("http_status").isin(200, 201), F.col("record_id")))
    automatic = F.count_if(F.col("actor").isin("agent", "rule"))
    decided = F.count_if(F.col("actor").isin(*DECIDERS))
    return (one(source_rows, F.count(F.lit(1)).alias("total_source_rows"))
            .join(one(item_rows, F.count_if(F.col("status") == "pending").alias("pending_items")), "run_id")
            .join(one(attempts, delivered.alias("pushed_records")), "run_id")
            .join(one(ledger, F.when(decided > 0, F.round(100.0 * automatic / decided, 1)).alias("autonomy_score")), "run_id"))


def sync_rate(canonical: DataFrame) -> DataFrame:
    pushed, total = F.count_if(F.col("status") == "pushed"), F.count(F.lit(1))
    return canonical.agg(
        pushed.alias("pushed_count"), total.alias("total_count"),
        F.when(total > 0, F.round(100.0 * pushed / total, 0)).otherwise(0.0).cast("int").alias("sync_rate"))


def audit_view(ledger: DataFrame, run_id: str, actor: str | None = None, limit: int = 500) -> DataFrame:
    """The newest events of a run, optionally of one actor."""
    mine = ledger.filter(F.col("run_id") == run_id)
    if actor:
        mine = mine.filter(F.col("actor") == actor)
    return mine.orderBy(F.desc("id")).limit(limit)


def search(canonical: DataFrame, text: str, tab: str = "all") -> DataFrame:
    """Records whose key, name, email or department contains the text; ``tab`` is all, pushed or other."""
    return matching(manifest(canonical), text, tab)


def matching(rows: DataFrame, text: str, tab: str = "all") -> DataFrame:
    """``search`` among rows of ``manifest``."""
    q = text.strip().lower()
    hit = F.lit(not q)
    for c in ("canonical_key", "name", "email", "department"):
        hit = hit | F.contains(F.lower(c), F.lit(q))
    if tab == "pushed":
        hit = hit & (F.col("status") == "pushed")
    elif tab == "other":
        hit = hit & (F.col("status") != "pushed")
    return rows.filter(hit)


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(1)


def latest_attempt(canonical: DataFrame, attempts: DataFrame, key: Column | str = "canonical_key") -> DataFrame:
    """Each record with its newest delivery attempt, if any."""
    newest = attempts.groupBy("run_id", "record_id").agg(F.max(F.struct("id", "attempt", "http_status")).alias("a"))
    newest = newest.select("run_id", F.col("record_id").alias("_record"), F.col("a.id").alias("attempt_id"),
                           F.col("a.attempt").alias("attempt"), F.col("a.http_status").alias("http_status"))
    k = F.col(key) if isinstance(key, str) else key
    return (canonical.withColumn("_k", k).join(newest.withColumnRenamed("run_id", "_run"),
            (F.col("_k") == F.col("_record")) & (F.col("run_id") == F.col("_run")), "left").drop("_k", "_record", "_run"))


def raw_lineage(merged: DataFrame, links: DataFrame, staged: DataFrame, landed: DataFrame) -> DataFrame:
    """Every raw source row beside the canonical record it went into."""
    rows = staged.select("seq", "source", "row_num").join(links.select("seq", "entity_seq"), "seq")
    keys = merged.select("entity_seq", "canonical_key")
    return (salted_join(rows, keys, ["entity_seq"], hot_entities(merged), "seq")
            .join(landed, ["source", "row_num"]).select("canonical_key", "source", "row_num", "raw_json"))
