"""Values that are almost a word of a vocabulary.

Only distinct values that the vocabulary does not have are looked at, and each
meets words through what both have left after a few letters are dropped, or
through a chunk that stands unchanged (``near_dup``); nothing is compared with
a whole vocabulary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tributary.contract import Contract
from tributary.operators import near_dup

DEFAULT_THRESHOLD = 90.0


def vocabulary(contract: Contract, like: DataFrame) -> DataFrame:
    """(field, word, canonical) of all enum fields."""
    rows = [(f.name, word, canonical) for f in contract.of_type("enum") for word, canonical in f.vocabulary().items()]
    return like.sparkSession.createDataFrame(rows, "field string, word string, canonical string")


def _nodes(rows: DataFrame, value: str) -> DataFrame:
    name = F.lower(F.trim(value))
    return near_dup.nodes(rows.select(F.col("field").alias("block"), name.alias("name")).filter("block IS NOT NULL AND name <> ''"))


def closest_words(values: DataFrame, words: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """(field, value, canonical, word, similarity): the word each unknown value is most like, case aside.

    values(field, value), words(field, word, canonical). Values that the
    vocabulary has are left out, as are nulls and blanks. Of equally similar
    words with one meaning the first counts; where they mean different things
    the value is nobody's and is left out.
    """
    known = words.select("field", F.lower(F.trim("word")).alias("word"), "canonical").groupBy("field", "word").agg(F.min("canonical").alias("canonical"))
    unknown = values.select("field", F.lower(F.trim("value")).alias("value")).distinct().join(
        known.select("field", F.col("word").alias("value")), ["field", "value"], "left_anti")
    near = near_dup.similar_between(_nodes(unknown, "value"), _nodes(known, "word"), threshold)
    near = near.select(F.col("block").alias("field"), F.col("name_a").alias("value"), F.col("name_b").alias("word"), "similarity").join(known, ["field", "word"])
    best = Window.partitionBy("field", "value")  # the words near one value
    top = near.withColumn("most", F.max("similarity").over(best)).filter("similarity = most")
    top = top.groupBy("field", "value").agg(F.min(F.struct("word", "canonical")).alias("w"), F.max("most").alias("similarity"),
                                            F.count_distinct("canonical").alias("meanings"))
    return top.filter("meanings = 1").select("field", "value", "w.canonical", "w.word", "similarity")
