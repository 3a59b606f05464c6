"""The ledger as a stream, and delivery requests answered as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tributary.operators.delivery import accept
from tributary.operators.keyed_store import KeyedStore
from tributary.operators.ledger import LEDGER_SCHEMA, current_end
from tributary.session import materialize, scratch_path


def read_events(spark: SparkSession, path: str, schema=LEDGER_SCHEMA, files_per_trigger: int = 100, **options) -> DataFrame:
    """New ledger files as a stream; rates are bounded by files per trigger."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
            .options(**options).parquet(path))


def after(stream: DataFrame, run_id: str | None = None, from_id: int | None = None) -> DataFrame:
    """The tail of one run past an id; the stream checkpoint keeps delivery exactly once."""
    if run_id is not None:
        stream = stream.filter(F.col("run_id") == run_id)
    return stream if from_id is None else stream.filter(F.col("id") > from_id)


def follow(spark: SparkSession, path: str, run_id: str, from_id: int | None = None, files_per_trigger: int = 100) -> DataFrame:
    """A run of a clustered ledger as a stream, after an id, or from its current end on where none is given.

    The end is that of the moment the stream is set up; a checkpoint that
    exists goes on with the end that its caller kept.
    """
    start = current_end(spark, path, run_id) if from_id is None else from_id
    return after(read_events(spark, path, files_per_trigger=files_per_trigger), run_id, start)


def drain(stream: DataFrame, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process everything available now into a parquet table and return that table."""
    spark = stream.sparkSession
    out = out or scratch_path(spark, "tail")
    checkpoint = checkpoint or out + "-progress"
    query = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def delivered_store(spark: SparkSession, path: str, parts: int = 1024) -> KeyedStore:
    """The accepted records by employee id."""
    return KeyedStore(spark, path, "employee_id", "employee_id string, idempotency_key string, payload string", parts).open()


def deliver(requests: DataFrame, store: str, answers: str, checkpoint: str, parts: int = 1024):
    """Answer a stream of delivery requests against a store of accepted records.

    requests: (request_seq, employee_id, idempotency_key, payload). A
    micro-batch reads and writes only the parts of the store that its ids fall
    in. Each writes its own slots there and its own folder of answers, so a
    batch that is retried after a failure replaces its earlier output and
    nothing is delivered twice.
    """
    held = delivered_store(requests.sparkSession, store, parts)

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        asked = materialize(batch, "requests")
        out = f"{answers}/batch_id={batch_id}"
        accept(asked, held.read(held.touched(asked), before=batch_id)).write.mode("overwrite").parquet(out)
        held.append(spark.read.parquet(out).filter(F.col("outcome") == "created"), batch_id)
        if batch_id and batch_id % held.slots == 0:
            held.vacuum(before=batch_id)  # earlier batches are committed

    return (requests.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
