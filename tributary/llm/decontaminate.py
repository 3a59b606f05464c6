"""Benchmark decontamination by spaced seeds: hashes of some of the words of a window, blind to the others.

A mask tells which words of a window count. Windows of documents and of
benchmark items that agree under a mask meet by hash; around each hit the item
is laid over the document word by word, and the best of its stretches that are
long enough is taken, so replaced words are passed over. All DataFrame functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tributary.llm.common import materialize

#: Together they hit every passage of 13 or more words of which four fifths agree (tested for all ways to replace words).
MASKS = ("11111", "110111")
#: With these they also hit every passage of 5 to 12 words of which four fifths agree; only for items or overlaps that short.
SHORT_MASKS = ("1111", "10111", "11011", "11101")
MIN_WORDS = 13
SIMILARITY = 0.8
#: Items are looked up in blocks of about so many seeds, each broadcast (16 bytes and a few more each).
BLOCK_SEEDS = 1_000_000
MATCH, MISS = 100, -399  # a stretch scores above 0 if four fifths of its words agree


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+", " "), " "), "")


def seeds(rows: DataFrame, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """rows(w, ...) with (pos, seed) for every window and mask; shifted copies of the words stand side by side, so hashes are compiled."""
    shifted = F.arrays_zip(*[F.slice("w", k + 1, F.greatest(F.size("w"), F.lit(1))).alias(f"w{k}") for k in range(max(map(len, masks)))])
    names = [c for c in rows.columns]
    at = rows.select(*names, F.posexplode(shifted).alias("pos", "window"))
    found = []
    for number, mask in enumerate(masks):
        used = [F.col(f"window.w{k}") for k, bit in enumerate(mask) if bit == "1"]
        found.append(F.when(used[-1].isNotNull(), F.xxhash64(F.lit(number), *used)))
    return at.select(*names, "pos", F.explode(F.array(*found)).alias("seed")).filter("seed IS NOT NULL")


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
             item_text: str = "text", min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(key, item, overlap_words, matched_words, similarity): the best overlap of each contaminated document and item.

    An overlap is a stretch of the item that stands in the document with at
    ``min_words`` words (all of a shorter item), of which at least the
    share ``similarity``, 0.8 or more, agree in place. Of several the best-scored counts, then the
    longest; a shorter stretch that scores higher does not hide one that is long enough. A text is
    taken whole; null and empty texts overlap nothing, nor do items of fewer than five words, or of fewer than ``min_words`` where that is less. Rows that share a key are one document. Repeated
    items and extra columns change nothing.
    """
    if min_words < 1 or not 0.8 <= similarity <= 1:
        raise ValueError("the masks find overlaps of one word or more that agree in 0.8 or more")
    shortest = min(min_words, len(MASKS[0]))
    items = (benchmark.select(F.col(f"`{item}`").alias("item"), words(F.col(f"`{item_text}`")).alias("w"))
             .distinct().withColumn("item_no", F.xxhash64("item", "w")).withColumn("item_words", F.size("w")))
    items = materialize(items.filter(F.col("item_words") >= shortest), "items")
    least = F.least(F.lit(min_words), F.col("item_words"))
    short = items.agg(F.min(least)).first()[0]
    masks = MASKS if short is None or short >= MIN_WORDS else MASKS + SHORT_MASKS
    if shortest < 4:  # of fewer than five words all must agree
        masks += ("1" * shortest,)
    looked_up = materialize(seeds(items.select("w", "item_no", "item_words"), masks).select("seed", "item_no", "item_words", F.col("pos").alias("item_pos")).distinct(), "seeds")
    blocks = max(1, -(-looked_up.count() // BLOCK_SEEDS))
    text_rows = docs.select(F.col(f"`{key}`").alias("key"), words(F.col(f"`{text}`")).alias("w"))
    at = seeds(text_rows, masks)
    start = F.col("pos") - F.col("item_pos")
    skipped = F.greatest(F.lit(0), -start)
    hits = []
    for block in range(blocks):
        part = looked_up.filter(F.pmod(F.xxhash64("seed"), F.lit(blocks)) == block)
        met = at.join(F.broadcast(part), "seed")
        hits.append(met.select("key", "item_no", F.xxhash64("w").alias("version"), start.alias("start"), skipped.alias("skipped"),
                               F.slice("w", start + skipped + 1, F.col("item_words") - skipped).alias("piece")))
    found = reduce(DataFrame.unionByName, hits).groupBy("key", "item_no", "version", "start").agg(F.min(F.struct("skipped", "piece")).alias("hit"))
    found = materialize(found.select("key", "item_no", "hit.*"), "hits")
    laid = found.join(items, "item_no").withColumn("same", F.zip_with("piece", F.slice("w", F.col("skipped") + 1, F.size("piece")), lambda a, b: a == b))
    share = round(similarity * 10 ** 6)
    same = F.col("same")
    # the best-scored stretch may miss the share where the score is not of that share: then the one that exceeds the share most, the longest of equal ones
    best = laid.select("key", "item", "same", least.alias("least"), best_stretch(same, least).alias("s"))
    exceeds = best_stretch(same, F.col("least"), (10 ** 6 - share) * 10 ** 6 + 1, -share * 10 ** 6 + 1)
    best = best.select("key", "item", F.when(F.col("s.matched") >= F.lit(similarity) * F.col("s.words"), F.col("s")).otherwise(exceeds).alias("s")).filter("s.words > 0")
    score = F.col("s.matched") * MATCH + (F.col("s.words") - F.col("s.matched")) * MISS
    rated = best.select("key", "item", score.alias("score"), F.col("s.words").alias("overlap_words"), F.col("s.matched").alias("matched_words"))
    rated = rated.filter(F.col("matched_words") >= F.lit(similarity) * F.col("overlap_words"))
    top = rated.groupBy("key", "item").agg(F.max(F.struct("score", "overlap_words", "matched_words")).alias("t"))
    return top.select(F.col("key").alias(key), F.col("item").alias(item), "t.overlap_words", "t.matched_words",
                      (F.col("t.matched_words") / F.col("t.overlap_words")).alias("similarity"))


def best_stretch(same: Column, least: Column, match: int = MATCH, miss: int = MISS) -> Column:
    """(words, matched) of the best-scored stretch of at least ``least`` elements, 1 or more, of an array of booleans, no words if none scores above 0.

    Of equal ones the first to reach the score, as short as possible. Beside
    each element stands the one ``least`` before it: what lies before the
    shortest stretch that ends here.
    """
    gone = F.concat(F.array_repeat(F.lit(None).cast("boolean"), least), same)
    both = F.zip_with(same, F.slice(gone, F.lit(1), F.size(same)), lambda agrees, left: F.struct(agrees.alias("agrees"), left.alias("left")))
    worth = {n: F.lit(v).cast("long") for n, v in (("match", match), ("miss", miss), ("zero", 0))}
    nothing = F.struct(F.lit(0).alias("at"), *[worth["zero"].alias(n) for n in ("sum", "before", "low")], F.lit(0).alias("begun"),
                       worth["zero"].alias("score"), F.lit(0).alias("words"))

    def step(state: Column, pair: Column) -> Column:
        def value(agrees: Column) -> Column:
            return F.when(agrees, worth["match"]).otherwise(worth["miss"])

        total = state["sum"] + value(pair["agrees"])
        before = state["before"] + F.when(pair["left"].isNull(), worth["zero"]).otherwise(value(pair["left"]))
        start = state["at"] - least + 1  # of the shortest stretch that ends here
        lower = (start >= 0) & (before <= state["low"])
        low, begun = F.when(lower, before).otherwise(state["low"]), F.when(lower, start).otherwise(state["begun"])
        better = (start >= 0) & (total - low > state["score"])
        return F.struct((state["at"] + 1).alias("at"), total.alias("sum"), before.alias("before"), low.alias("low"), begun.alias("begun"),
                        F.when(better, total - low).otherwise(state["score"]).alias("score"),
                        F.when(better, state["at"] - begun + 1).otherwise(state["words"]).alias("words"))

    matched = lambda s: F.floor((s["score"] - worth["miss"] * s["words"]) / (match - miss) + 0.5).cast("int")
    return F.aggregate(both, nothing, step, lambda s: F.struct(s["words"].alias("words"), matched(s).alias("matched")))


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` that overlap no item; rows with a null key, which cannot be told apart, stay."""
    bad = overlaps(docs, benchmark, key, text, **options).select(key).distinct()
    return docs.join(bad, key, "left_anti")
