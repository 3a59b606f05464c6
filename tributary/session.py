"""Where intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


# The folder, below the shared one, that the running scope writes its tables to.
_scope: ContextVar[str] = ContextVar("scope", default="tributary")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``).

    Only a local session may do without it: there a temporary folder serves.
    On a cluster a machine-local folder would be lost with its machine, so a
    missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="tributary-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{_scope.get()}/{label}-{uuid.uuid4().hex}"


@contextmanager
def run_scope(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables written inside are removed at the end, also after an error.

    Results read those tables, so what is to stay is written elsewhere before
    the end. Scopes may be nested; each removes its own tables only.
    """
    name = f"tributary/run-{uuid.uuid4().hex}"
    folder = f"{shared_dir(spark).rstrip('/')}/{name}"
    token = _scope.set(name)
    try:
        yield folder
    finally:
        _scope.reset(token)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffled(df: DataFrame) -> DataFrame:
    """A table that grows with the input: joins shuffle it, unless they ask for a broadcast, however small the planner takes it to be."""
    return df.hint("merge")


def materialize(df: DataFrame, label: str = "stage", path: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder, at ``path`` if one is given, and read it back.

    The result has no lineage to recompute when an executor is lost, and keeps
    column pruning and filter pushdown for its readers. Its files say little
    about its rows, numbers in order take a byte or two there, so it is
    ``shuffled``: the driver never collects it because it looks small.
    """
    path = path or scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return shuffled(df.sparkSession.read.schema(df.schema).parquet(path))
