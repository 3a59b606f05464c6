"""A table of records by key that grows batch by batch and is read by key.

The hash of a key says which part of the store holds it. A batch reads and
writes only the parts its own keys fall in, each part one folder, and every
batch has its own slot there, so a batch that is run again replaces what it
wrote before. After some slots a batch writes a part out whole, since it has
read it anyway; what that replaces can be removed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tributary.session import materialize

_SLOT = re.compile(r"slot=(delta|whole)-(\d+)")


@dataclass(frozen=True)
class KeyedStore:
    """``parts`` should let a part stay near a million records; it is fixed when the store is made."""

    spark: SparkSession
    path: str
    key: str
    schema: str
    parts: int = 1024
    #: Slots of a part from which on the next batch that meets it writes it out whole.
    slots: int = 16

    def open(self) -> "KeyedStore":
        """The store with the number of parts it was made with; makes it where there is none."""
        known = [int(n.split("-")[1]) for n in self._names(self.path) if n.startswith("_parts-")]
        if not known:
            self._fs().mkdirs(self._at(f"{self.path}/_parts-{self.parts}"))
        return KeyedStore(self.spark, self.path, self.key, self.schema, known[0] if known else self.parts, self.slots)

    def part(self, key: Column | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key) if key is None else key), F.lit(self.parts)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The parts that the keys of ``rows`` fall in; no more numbers than the store has parts."""
        keys = rows.filter(F.col(self.key).isNotNull())
        return sorted(r["part"] for r in keys.select(self.part().alias("part")).distinct().collect())

    def live(self, parts: list[int], before: int) -> dict[int, list[str]]:
        """The slots that hold the records of earlier batches, by part: the last whole one and all deltas after it."""
        found = {}
        for part in parts:
            slots = [(int(m[2]), m[1] == "whole", name) for name in self._names(f"{self.path}/part={part}") if (m := _SLOT.fullmatch(name))]
            slots = [s for s in slots if s[0] < before]
            last = max((n for n, whole, _ in slots if whole), default=-1)
            found[part] = [name for n, whole, name in sorted(slots) if n > last or (n == last and whole)]
        return found

    def read(self, parts: list[int], before: int) -> DataFrame:
        """Records of these parts that batches before this one wrote; no other folder is listed or read."""
        paths = [f"{self.path}/part={part}/{slot}" for part, slots in self.live(parts, before).items() for slot in slots]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def append(self, rows: DataFrame, batch: int) -> DataFrame:
        """Write new records as this batch's slots; gives them as a written table. Written again, a batch takes the place of its first try.

        A part is written by one task, a large one by as many as its size needs.
        """
        columns = self.spark.createDataFrame([], self.schema).columns
        rows = materialize(rows.select(*columns).withColumn("part", self.part()), "new_records")
        parts = [r["part"] for r in rows.select("part").distinct().collect()]
        full = [part for part, slots in self.live(parts, batch).items() if len(slots) >= self.slots]
        out = rows.withColumn("slot", F.when(F.col("part").isin(full) if full else F.lit(False), F.lit(f"whole-{batch}")).otherwise(F.lit(f"delta-{batch}")))
        if full:
            kept = self.read(full, batch).withColumn("part", self.part())
            out = out.unionByName(kept.withColumn("slot", F.lit(f"whole-{batch}")))
        (out.hint("rebalance", "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "slot").parquet(self.path))
        return rows

    def vacuum(self, before: int) -> int:
        """Remove slots that a whole one of a batch before this, which cannot be run again, has replaced; their number."""
        gone = 0
        for name in self._names(self.path):
            if not name.startswith("part="):
                continue
            keep = set(self.live([int(name[5:])], before)[int(name[5:])])
            for slot in self._names(f"{self.path}/{name}"):
                m = _SLOT.fullmatch(slot)
                if m and int(m[2]) < before and slot not in keep:
                    gone += bool(self._fs().delete(self._at(f"{self.path}/{name}/{slot}"), True))
        return gone

    def all(self) -> DataFrame:
        """Every record, for reports."""
        return self.read([int(n[5:]) for n in self._names(self.path) if n.startswith("part=")], 1 << 62)

    def _at(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._at(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        fs, at = self._fs(), self._at(path)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
