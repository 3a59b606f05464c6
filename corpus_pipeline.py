"""A training corpus from documents: rejected, near-copied and leaked texts go, sources are mixed, ids are written.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as a table and reads it again for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tributary.llm import decontaminate, mixing, quality, simhash, token_files
from tributary.llm.common import fold, importable, materialize, read
from tributary.llm.queries import TOKENIZER

#: No source is passed over more than twice.
REPETITION = 2.0


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    importable(spark)
    model = quality.fit(docs, read(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return quality.keep_good(docs, model, least=0.3)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id, of equal ids the first; rows without id come last.

    Ids may be missing, repeated or shared, so rows get numbers; they are
    written with them, so that every reader sees the same numbers.
    """
    importable(spark)
    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_row")
    groups = simhash.near_duplicates(rows.withColumn("_place", place), shingle=3, radius=2, key="_place")
    copies = groups.filter(F.col("_place._row") != F.col("component_id._row")).select("_place._row")
    return rows.join(materialize(copies, "copies"), "_row", "left_anti").select(docs.columns)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that overlap no benchmark item. Rows of one id and one text are judged alike, others of that id by their own text."""
    rows = docs.withColumn("_place", F.struct("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text")))
    return decontaminate.clean(rows, read(spark, sf_dir, "benchmark"), key="_place").select(docs.columns)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of smaller sources up to twice."""
    return mixing.mix(docs, mixing.Target(repetition=REPETITION)).select("row.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the id files say of each document."""
    importable(spark)
    return token_files.encode_and_read(docs, TOKENIZER, end_id=2)


STAGES = [("quality classifier", good_documents), ("SimHash near-dedup", distinct_documents), ("benchmark decontamination", clean_documents),
          ("mixing sources to target weights", mixed_documents), ("token-ID / binary output", token_ids)]

#: The classifier and the tokenizer cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
