import pytest
from pyspark.sql import types as T

from tributary.llm.common import importable

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("score", T.StringType()), T.StructField("_text", T.StringType()), T.StructField("epoch", T.StringType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents of (doc_id, text[, source]), with extra columns whose names operators use inside."""
    importable(spark)
    return lambda rows: spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "s", "x", "y", "z") for r in rows], DOCS)


@pytest.fixture
def words():
    """A long run of invented words, the same in every run."""
    import random
    random.seed(5)
    return lambda n, seed=0: [random.Random(seed * 100_003 + i).choice("abcdefghij") + str(random.Random(seed * 7919 + i).randrange(10 ** 6)) for i in range(n)]
