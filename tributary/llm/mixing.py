"""Mixing sources to target weights: shares to a power, the power bisected, weights realised as permuted passes.

A source with token share p gets weight p**a / sum(p**a). The exponent a is
bisected between 0 (all sources alike) and 1 (as they come) to meet a target
entropy or a limit on repetition. Each source then gets its budget of tokens:
whole passes over its documents, and of one more pass the documents that come
first in that pass's own permutation, taken by blocks of the permutation.
All DataFrame functions; per-source figures are rows, never collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tributary.llm.common import materialize

LEVELS, PASSES = 6, 8  # bisection steps decided by one pass over the sources, and passes
DIGITS = 3  # hexadecimal digits of a block of a permutation: at most 4096 blocks are summed up at a time
NARROWINGS = 2
BROADCAST_SOURCES = 100_000


@dataclass(frozen=True)
class Target:
    """What the exponent has to meet; exactly one of the two.

    entropy: the weights' entropy as a share of the largest possible; the
    largest exponent that reaches it is taken, 0 if none does.
    repetition: no source is passed over more often than this; the smallest
    exponent that keeps to it is taken, 1 if none does.
    """

    entropy: float | None = None
    repetition: float | None = None

    def __post_init__(self):
        if (self.entropy is None) == (self.repetition is None):
            raise ValueError("give a target entropy or a limit on repetition")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def unit(key: str, text: str) -> Column:
    """What names a document: its key, of a row without key the hash of its text."""
    return F.coalesce(F.col(f"`{key}`").cast("string"), F.concat(F.lit("-"), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"))))


def units(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(source, key, n): words of each document; rows that share source and key (of null keys: the text) are one document, a null source is the empty one."""
    return materialize(docs.groupBy(F.coalesce(F.col(f"`{source}`"), F.lit("")).alias("source"), unit(key, text).alias("key"))
                       .agg(F.sum(n_words(F.col(f"`{text}`"))).alias("n")), "units")


def exponent(sources: DataFrame, target: Target, budget: int | None = None) -> float:
    """The bisected exponent for sources(source, p): each pass over them tries all points that six steps could reach."""
    low, high = 0.0, 1.0
    count = sources.count()
    if count < 2:
        return 1.0
    for _ in range(PASSES):
        points = [low + (high - low) * i / 2 ** LEVELS for i in range(1, 2 ** LEVELS)]
        tried = sources.withColumn("a", F.explode(F.array(*map(F.lit, points))))
        power, tilt = F.pow("p", "a"), F.pow(F.col("p"), F.col("a") - 1)
        by_point = tried.groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * F.log("p")).alias("zl"), F.max(tilt).alias("most"), F.min(tilt).alias("least"),
                                          F.max("total").alias("total"))
        if target.entropy is not None:
            up = (F.log("z") - F.col("a") * F.col("zl") / F.col("z")) >= F.lit(target.entropy) * F.log(F.lit(float(count)))
        elif budget is None:
            up = F.col("most") / F.col("least") > target.repetition
        else:
            up = F.col("most") / F.col("z") * F.lit(float(budget)) / F.col("total") > target.repetition
        rising = {r["a"]: r["up"] for r in by_point.select("a", up.alias("up")).collect()}  # 63 rows
        first, last = 0, 2 ** LEVELS
        for _ in range(LEVELS):
            middle = (first + last) // 2
            if rising[points[middle - 1]]:
                first = middle
            else:
                last = middle
        low, high = low + (high - low) * first / 2 ** LEVELS, low + (high - low) * last / 2 ** LEVELS
    return round(low if target.entropy is not None else high, 9)


def plan(found: DataFrame, target: Target, budget: int | None = None) -> DataFrame:
    """(source, weight, epochs, cutoff): whole passes over each source, and the last place of one more pass that is taken.

    ``found`` is what ``units`` gives. Without ``budget`` (words in all) the
    smallest budget is taken that passes over every source at least once, so
    nothing is left out. A source without words has no row here.
    """
    sources = found.groupBy("source").agg(F.sum("n").alias("t")).filter("t > 0")
    total = sources.agg(F.sum("t").alias("total"))  # one row
    sources = materialize(sources.crossJoin(F.broadcast(total)).withColumn("p", F.col("t") / F.col("total")), "sources")
    a = exponent(sources, target, budget)
    raised = sources.withColumn("w", F.pow(F.col("p"), F.lit(a)))
    sums = raised.agg(F.sum("w").alias("z"))
    weighed = raised.crossJoin(F.broadcast(sums)).withColumn("weight", F.col("w") / F.col("z"))
    if budget is None:
        words = weighed.agg(F.max(F.col("t") / F.col("weight")).alias("budget"))
    else:
        words = sums.select(F.lit(float(budget)).alias("budget"))
    shares = (weighed.crossJoin(F.broadcast(words)).withColumn("own", F.round(F.col("weight") * F.col("budget")).cast("long"))
              .select("source", "weight", (F.col("own") / F.col("t")).cast("long").alias("epochs"), (F.col("own") % F.col("t")).alias("left")))
    shares = materialize(shares, "shares")
    return materialize(shares.join(_cutoffs(found, shares), "source", "left")
                       .select("source", "weight", "epochs", F.coalesce("cutoff", F.lit("")).alias("cutoff")), "mixture")


def small(sources: DataFrame) -> DataFrame:
    """For broadcast while it has few rows; beyond that the join shuffles, and adaptive execution splits large sources."""
    return F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources


def place(epoch: Column, key: Column) -> Column:
    """Where a document stands in the permutation of a pass."""
    return F.md5(F.concat(epoch.cast("string"), F.lit(":"), key))


def _cutoffs(found: DataFrame, shares: DataFrame) -> DataFrame:
    """(source, cutoff): the last place taken of each source's unfinished pass.

    A document is taken if the words before it are fewer than what is left.
    Sums by block find the block in which that ends, sums by smaller blocks
    narrow it down, and only that block's documents are put in order.
    """
    open_ = shares.filter("left > 0").select("source", "epochs", "left")
    placed = materialize(found.join(small(open_), "source").select("source", place(F.col("epochs"), F.col("key")).alias("h"), "n"), "placed")
    at = open_.select("source", F.lit("").alias("prefix"), "left")
    for level in range(NARROWINGS):
        at = at.withColumnRenamed("prefix", "outer_prefix")
        inside = placed.join(small(at), "source").filter(F.col("h").startswith(F.col("outer_prefix")))
        sums = inside.groupBy("source", F.substring("h", 1, DIGITS * (level + 1)).alias("prefix"), "left").agg(F.sum("n").alias("n"))
        through = F.sum("n").over(Window.partitionBy("source").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0))
        sums = sums.withColumn("before", through - F.col("n")).filter(F.col("before") < F.col("left"))
        # the last block that begins before the end
        at = sums.groupBy("source").agg(F.max(F.struct("prefix", (F.col("left") - F.col("before")).alias("left"))).alias("b")).select("source", "b.*")
        at = materialize(at, "blocks")
    inside = placed.join(small(at), "source").filter(F.col("h").startswith(F.col("prefix")))
    through = F.sum("n").over(Window.partitionBy("source").orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    return inside.withColumn("before", through - F.col("n")).filter(F.col("before") < F.col("left")).groupBy("source").agg(F.max("h").alias("cutoff"))


def realise(docs: DataFrame, mixture: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(row, epoch, place): every row of ``docs``, all its columns as one, once for each pass that takes it.

    Documents of a source without words are taken once. Rows sorted by
    (epoch, place) are the passes in their permuted order.
    """
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(f"`{source}`"), F.lit("")).alias("source"), unit(key, text).alias("key"))
    joined = rows.join(small(mixture.select("source", "epochs", "cutoff")), "source", "left")
    partial = (place(F.col("epochs"), F.col("key")) <= F.col("cutoff")).cast("long")
    counted = joined.withColumn("copies", F.coalesce(F.col("epochs") + partial, F.lit(1))).filter("copies > 0")
    taken = counted.withColumn("epoch", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))
    return taken.select("row", "epoch", place(F.col("epoch"), F.col("key")).alias("place"))


def mix(docs: DataFrame, target: Target, budget: int | None = None, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` mixed to the target weights: see ``plan`` and ``realise``. An empty table gives an empty result."""
    return realise(docs, plan(units(docs, key, text, source), target, budget), key, text, source)
