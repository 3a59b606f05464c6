"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from functools import reduce
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tributary.session import materialize, scratch_path, shared_dir  # noqa: F401  (used by the operators)

CHUNK_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def importable(spark: SparkSession) -> None:
    """Let the Python workers of this machine find this package where it is; a cluster gets it by --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def text_bytes(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The kept columns and the whole text as UTF-8 bytes in ``_text``; other columns are not read."""
    return docs.select(*keep, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))


def text_chunks(batches: Iterable[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of whole rows whose ``_text`` has about ``limit`` bytes together; a longer text is a run of its own."""
    for batch in batches:
        column = batch.column("_text")
        ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
        start, before = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            part = batch.slice(start, stop - start)
            yield part, part.column("_text").to_pylist()
            start, before = stop, int(ends[stop - 1])


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def mounted(uri: str) -> str:
    """The path of a shared folder as the file system of every machine shows it.

    Memory mapping and files of one's own need a mounted folder; any other
    store is refused here instead of being written to a machine's own disk.
    """
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{uri}: model and id files need a folder that is mounted on every machine")
    return unquote(parts.path)
