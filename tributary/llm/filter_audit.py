"""How filters interact, audited over a stream of files that retracts what later files overturn.

A file's rows fail some filters by their text alone. One filter looks at the
whole table: a text fails it that a smaller id has as well. Files are read as
available-now micro-batches; the state, keyed by the text's hash, holds each
text's least id and who has it. When a smaller id arrives, the earlier holder's
mask is taken out of its part's counters and put back with the copy bit set, so
the counters are right after every batch. They are all the report needs: a row
counts by the set of filters it fails.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import permutations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tributary.llm.common import materialize, scratch_path

WORD = "[^\\x20\\x09-\\x0D]+"
COPIES = "E"
#: Micro-batches that the files present at the start are dealt to.
BATCHES = 4
#: Texts kept under one key of the state, on average, and keys in one partition of it at least: each costs files in every batch.
TEXTS_PER_KEY = 2048
KEYS_PER_PARTITION = 16

_CELL = ["part", "mask", "good", "toxic"]
_HELD = ["text", "doc_id", *_CELL]
_STATE = {"text": object, "doc_id": "int64", "part": object, "mask": "int64", "good": "int64", "toxic": "int64", "n": "int64"}
_DELTAS = "part string, mask int, good int, toxic int, n long"
_ROWS = "bucket long, settled boolean, text string, doc_id long, " + _DELTAS


def text_filters(text: Column) -> dict[str, Column]:
    """Letter -> whether the text fails: too short, repetitive, shouting, or with markup."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": n < 200, "B": 100 * distinct < 50 * n, "C": 100 * capitals > 2 * F.length(text), "D": text.rlike("[#$%&*|]")}


def judged(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], bits: dict[str, int], buckets: int) -> DataFrame:
    """(bucket, text, named, doc_id, part, mask, good, toxic) of each row: the filters its text fails, and its labels."""
    mask = sum((F.when(fails, F.lit(bits[letter])).otherwise(F.lit(0)) for letter, fails in filters.items()), F.lit(0))
    rows = docs.select(F.col("_id").alias("doc_id"), "part", mask.cast("int").alias("mask"), F.substring(F.sha2(F.col("_text").cast("binary"), 256), 1, 32).alias("text"))
    label = lambda name: F.max((F.col(name) == 1).cast("int"))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(label("quality").alias("good"), label("toxic").alias("toxic"))
    rows = rows.join(known.filter("doc_id IS NOT NULL"), "doc_id", "left")
    return rows.select(F.pmod(F.xxhash64("text"), F.lit(buckets)).alias("bucket"), "text", F.col("doc_id").isNotNull().alias("named"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"),
                       "part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def combine(copy_bit: int):
    """Rows of one Arrow batch, combined: of each text only the least id goes on to the state.

    The others are settled, whatever comes later: they fail as copies. So are
    rows without id, which are nobody's copy. However often a text stands in the
    input, its key of the state sees one row a batch and holder.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pandas()
            if rows.empty:
                continue
            rows["n"] = 1
            named = rows[rows["named"]]
            first = named["doc_id"] == named.groupby("text")["doc_id"].transform("min")
            held = named[first].groupby(["bucket", *_HELD], as_index=False)["n"].sum().assign(settled=False)
            copies = named[~first]
            rest = pd.concat([copies.assign(mask=copies["mask"] | copy_bit), rows[~rows["named"]]])
            rest = rest.groupby(_CELL, as_index=False).agg(n=("n", "sum"), bucket=("bucket", "min")).assign(text="", doc_id=0, settled=True)
            both = pd.concat([held, rest]) if len(rest) else held
            yield pa.RecordBatch.from_pandas(both[[c.split()[0] for c in _ROWS.split(", ")]], schema=pa.schema(
                [("bucket", pa.int64()), ("settled", pa.bool_()), ("text", pa.string()), ("doc_id", pa.int64()), ("part", pa.string()),
                 ("mask", pa.int32()), ("good", pa.int32()), ("toxic", pa.int32()), ("n", pa.int64())]), preserve_index=False)
    return run


def settle(held: pd.DataFrame, rows: pd.DataFrame, copy_bit: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(held, deltas) after ``rows``: who has each text's least id, and what the counters change by."""
    both = pd.concat([part.assign(new=new) for part, new in ((held, False), (rows, True)) if len(part)] or [held.assign(new=False)], ignore_index=True)
    both["new"] = both["new"].astype(bool)
    stays = both["doc_id"] == both.groupby("text")["doc_id"].transform("min")
    gone = both[~stays]
    deltas = pd.concat([both[both["new"] & stays], gone.assign(mask=gone["mask"] | copy_bit),
                        gone[~gone["new"]].assign(n=lambda r: -r["n"])])  # the retraction
    return both[stays].groupby(_HELD, as_index=False)["n"].sum(), deltas


def pack(held: pd.DataFrame) -> bytes:
    table, out = pa.Table.from_pandas(held, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def unpack(packed: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(packed).read_pandas()[list(_STATE)].astype(_STATE)


def update(copy_bit: int):
    """The stateful step of one key: its texts' holders are kept as compressed columns."""
    def run(_key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = list(_STATE)
        held = unpack(state.get[0]) if state.exists else pd.DataFrame({c: [] for c in columns}).astype(_STATE)
        found = []
        for rows in chunks:
            settled = rows["settled"].astype(bool)
            held, deltas = settle(held, rows.loc[~settled, columns].astype(_STATE), copy_bit)
            changed = pd.concat([deltas, rows[settled]])
            found.append(changed.groupby(_CELL, as_index=False)["n"].sum())
        state.update((pack(held),))
        deltas = pd.concat(found).groupby(_CELL, as_index=False)["n"].sum()
        yield deltas[deltas["n"] != 0]
    return run


def counters(spark: SparkSession, path: str, labels: DataFrame, filters=text_filters, folder: str | None = None, batches: int = BATCHES,
             key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): rows by the filters they fail; bit i stands for the i-th letter, the copy filter among them.

    ``path`` is a folder of Parquet files or one file. With ``folder`` the stream's progress and counters are
    kept there: a later call reads only files that came since (with the labels of that time), and a call after
    a failure goes on where the last one stopped. A batch writes its own part of the counters, so one that is
    run again replaces it. The state, some 40 bytes a text, is in the session's state store; where the texts of a
    partition do not fit an executor's memory, set spark.sql.streaming.stateStore.providerClass to RocksDB's.
    """
    table = spark.read.parquet(path)
    letters = sorted([*filters(F.lit("")), COPIES])
    bits = {letter: 1 << i for i, letter in enumerate(letters)}
    copy_bit = bits[COPIES]
    keep, folder = folder is not None, folder or scratch_path(spark, "audit")
    buckets = _once(spark, f"{folder}/buckets", max(1, math.ceil(table.count() / TEXTS_PER_KEY)))
    files = max(1, math.ceil(len(table.inputFiles()) / batches))
    # a pattern, also where one name is meant: a stream takes one file only so
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]")
    docs = stream.select(F.col(f"`{key}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
                         F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    rows = judged(docs, labels, filters(F.col("_text")), bits, buckets).mapInArrow(combine(copy_bit), _ROWS)
    deltas = rows.groupBy("bucket").applyInPandasWithState(update(copy_bit), _DELTAS, "held binary", "update", GroupStateTimeout.NoTimeout)

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(*_CELL).agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{folder}/deltas/batch={number}")

    partitions = "spark.sql.shuffle.partitions"
    usual = spark.conf.get(partitions)
    spark.conf.set(partitions, str(max(1, min(int(usual), buckets // KEYS_PER_PARTITION))))
    try:
        query = (deltas.writeStream.foreachBatch(write).outputMode("update").trigger(availableNow=True)
                 .option("checkpointLocation", f"{folder}/progress").start())
    finally:
        spark.conf.set(partitions, usual)
    query.awaitTermination()
    written = spark.read.schema(_DELTAS).option("ignoreMissingFiles", "true").parquet(f"{folder}/deltas") if _exists(spark, f"{folder}/deltas") else spark.createDataFrame([], _DELTAS)
    cells = written.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")).filter("n <> 0")
    return cells if keep else materialize(cells, "counters")


def report(cells: DataFrame, letters: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every order of the filters.

    cells(part, mask, n, good, toxic); bit i of a mask is the i-th letter. Whatever a row's
    order, the first filter of those it fails removes it, so of all orders each removes it equally often.
    """
    orders = ["".join(p) for p in permutations(letters)]
    bit = F.create_map(*[F.lit(v) for i, letter in enumerate(letters) for v in (letter, 1 << i)])
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 2 ** filters
    steps = parts.select("part", "cells", F.explode(F.array(*map(F.lit, orders))).alias("filter_order"))
    steps = steps.withColumn("bits", F.transform(F.sequence(F.lit(1), F.lit(len(letters))), lambda i: bit[F.substring("filter_order", i, F.lit(1))]))
    steps = steps.select("*", F.posexplode("bits").alias("at", "own")).withColumn("earlier", F.aggregate(F.slice("bits", F.lit(1), F.col("at")), F.lit(0), lambda a, b: a + b))

    def total(which, value) -> Column:
        return F.aggregate(F.filter("cells", which), F.lit(0).cast("long"), lambda a, c: a + value(c))

    own = lambda c: c["mask"].bitwiseAND(F.col("own")) != 0
    earlier = lambda c: c["mask"].bitwiseAND(F.col("earlier")) != 0
    removed = lambda c: own(c) & ~earlier(c)
    n = lambda c: c["n"]
    share = lambda c: c["n"] * F.expr(f"{len(orders)}") / F.bit_count(c["mask"])
    return steps.select("part", "filter_order", (F.col("at") + 1).alias("step"), total(lambda c: ~own(c) & ~earlier(c), n).alias("kept"), total(removed, n).alias("removed"),
                        total(lambda c: own(c) & earlier(c), n).alias("redundant"), total(lambda c: c["mask"] == F.col("own"), n).alias("unique_fails"),
                        total(removed, lambda c: c["good"]).alias("good_lost"), total(removed, lambda c: c["toxic"]).alias("toxic_lost"),
                        total(own, lambda c: share(c).cast("long")).alias("shapley"))


def audit(spark: SparkSession, path: str, labels: DataFrame, filters=text_filters, folder: str | None = None, **options) -> DataFrame:
    """The report over all files of ``path``; options are those of ``counters``.

    Null texts are empty and null parts the part "". A text is a copy if a smaller id has it; rows of one id and text are
    no copies of each other, and rows without id are neither copies nor make any. Of a document with several
    labels 1 counts. Other columns of any name do not matter; a table without rows has no parts.
    """
    letters = "".join(sorted([*filters(F.lit("")), COPIES]))
    return report(counters(spark, path, labels, filters, folder, **options), letters)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _once(spark: SparkSession, path: str, value: int) -> int:
    """The number written at ``path``; ``value``, which is written there, where there is none."""
    if not _exists(spark, path):
        spark.range(1).select(F.lit(value).alias("value")).write.parquet(path)
    return spark.read.parquet(path).first()["value"]
