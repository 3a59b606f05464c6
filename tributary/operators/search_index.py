"""Records found by any part of a text, through postings of their letters.

Every two and three neighbouring letters of a searched field are a posting
key. A text can only be part of a field that has all keys of the text, so the
rarest of them give the candidates, and the text is looked for in those alone.
Postings and records are kept by key (``KeyedStore``): a search reads the
parts of its own posting keys and of its candidates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tributary.operators import reports
from tributary.operators.keyed_store import KeyedStore
from tributary.session import materialize

FIELDS = ("canonical_key", "name", "email", "department")
#: So many of a text's posting keys are met, the rarest.
MET = 3
_ROWS = "canonical_key string, name string, email string, department string, status string, version long"


def grams(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` letters of a text."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class SearchIndex:
    spark: SparkSession
    path: str
    parts: int = 256

    def _postings(self) -> KeyedStore:
        return KeyedStore(self.spark, f"{self.path}/postings", "gram", "gram string, field string, canonical_key string", self.parts).open()

    def _records(self) -> KeyedStore:
        return KeyedStore(self.spark, f"{self.path}/records", "canonical_key", _ROWS, self.parts).open()

    def add(self, canonical: DataFrame, version: int) -> None:
        """Take up records, or newer versions of records; a version that is added again replaces itself."""
        rows = materialize(reports.manifest(canonical).select(*[F.col(c).cast("string").alias(c) for c in (*FIELDS, "status")], F.lit(version).cast("long").alias("version")), "records")
        fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lower(f).alias("text")) for f in FIELDS]))
        texts = rows.select("canonical_key", fields.alias("f")).select("canonical_key", "f.*").filter("text IS NOT NULL")
        found = texts.select("canonical_key", "field", F.explode(F.concat(grams(F.col("text"), 2), grams(F.col("text"), 3))).alias("gram"))
        found = self._postings().append(found, version)
        found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{self.path}/counts/version={version}")
        self._records().append(rows, version)

    def rarest(self, text: str) -> list[str] | None:
        """The posting keys to meet for a text of two letters or more; none if one of its keys stands nowhere."""
        size = min(3, len(text))
        keys = sorted({text[i:i + size] for i in range(len(text) - size + 1)})
        counts = self.spark.read.schema("gram string, n long").parquet(f"{self.path}/counts")
        known = {r["gram"]: r["n"] for r in counts.filter(F.col("gram").isin(keys)).groupBy("gram").agg(F.sum("n").alias("n")).collect()}
        return None if len(known) < len(keys) else sorted(keys, key=lambda k: (known[k], k))[:MET]

    def candidates(self, keys: list[str]) -> DataFrame:
        """(canonical_key) of the records that have all these posting keys in one field."""
        store = self._postings()
        asked = self.spark.createDataFrame([(k,) for k in keys], "gram string")
        met = store.read(store.touched(asked), 1 << 62).filter(F.col("gram").isin(keys))
        both = met.groupBy("canonical_key", "field").agg(F.count_distinct("gram").alias("n"))
        return both.filter(F.col("n") == len(keys)).select("canonical_key").distinct()

    def search(self, text: str, tab: str = "all") -> DataFrame:
        """What ``reports.search`` gives for the latest versions of all records."""
        q, store = text.strip().lower(), self._records()
        if len(q) < 2:  # one letter is nearly everywhere
            return reports.matching(_latest(store.all()), text, tab)
        keys = self.rarest(q)
        if keys is None:
            return reports.matching(_latest(self.spark.createDataFrame([], _ROWS)), text, tab)
        found = materialize(self.candidates(keys), "candidates")
        near = store.read(store.touched(found), 1 << 62).join(found, "canonical_key", "left_semi")
        return reports.matching(_latest(near), text, tab)


def _latest(rows: DataFrame) -> DataFrame:
    """The last version of each record."""
    last = rows.groupBy("canonical_key").agg(F.max_by(F.struct("name", "email", "department", "status"), "version").alias("r"))
    return last.select("canonical_key", "r.*")
