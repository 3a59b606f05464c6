"""Entities with the same birth date and almost the same name.

The search is an exact similarity join. Entities are first reduced to
distinct (birth date, sorted name) nodes, so any number of people with one
name and one birth date cost one node. Two names of lengths N >= M pass the
threshold when they share a subsequence of at least r(N, M) letters, and then

* if N - r <= 2, both contain the same text after dropping N - r and M - r
  letters: nodes meet on that remaining text, and whatever meets there at
  sufficient length is a true pair;
* otherwise the longer one is cut into chunks of a few letters. An edit spoils
  one chunk at most, so of any (edits + 1) chunks one stands unchanged in the
  shorter name, near the same place. Each name takes its rarest: those that the
  fewest names of its birth date have there. A first name that all share is
  common, so the chunks of the rest are taken.

Neither way pairs up a whole birth date, and no pair is missed. The names of
one birth date, be it a third of all rows, spread over as many hash keys as
they have remaining texts; a hash that many names meet on is dealt out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tributary.functions.similarity import indel_ratio, sorted_tokens
from tributary.operators import skew
from tributary.operators.skew import count_keys, hot_keys, salted_join
from tributary.session import materialize

DEFAULT_THRESHOLD = 90.0
MIN_THRESHOLD = 75.0  # below it a name could be cut into more pieces than it has letters
_MAX_DROPS = 2
# Letters of a chunk. Single letters serve only where names cannot be cut into enough longer chunks.
_CHUNKS = (2, 3, 4)
# Pairs that one task should compare where many names meet on one hash.
_PAIRS_PER_TASK = 100_000_000


def full_name() -> Column:
    return F.trim(F.concat_ws(" ", F.trim("first_name"), F.trim("last_name")))


def members(merged: DataFrame) -> DataFrame:
    """(block, name, canonical_key) of the entities that take part."""
    block = F.trim("date_of_birth")
    return (merged.select(block.alias("block"), full_name().alias("display_name"), "canonical_key")
            .filter((F.col("block") != "") & (F.col("display_name") != ""))
            .withColumn("name", sorted_tokens(F.col("display_name"))))


def _bag(name: Column) -> Column:
    """How often each letter stands in a name: a to z, then all others together."""
    count = [F.length(name) - F.length(F.replace(name, F.lit(x))) for x in "abcdefghijklmnopqrstuvwxyz"]
    return F.array(*count, F.length(F.regexp_replace(name, "[a-z]", "")))


def _common(bag: Column, other: Column) -> Column:
    """No fewer than the letters that two names can have in common."""
    return F.aggregate(F.zip_with(bag, other, lambda a, b: F.least(a, b)), F.lit(0), lambda a, b: a + b)


def nodes(member_rows: DataFrame) -> DataFrame:
    """One numbered row per distinct (block, name): node, block, name, len, n, bag."""
    found = member_rows.groupBy("block", "name").agg(F.count(F.lit(1)).alias("n")).withColumns({"len": F.length("name"), "bag": _bag(F.col("name"))})
    return materialize(found.withColumn("node", F.monotonically_increasing_id()), "nodes")


def _needed(n: int, m: int, t: float) -> int:
    return math.ceil(t * (n + m) / 200.0 - 1e-9)


def _partners(n: int, t: float) -> range:
    return range(max(1, math.ceil(n * t / (200.0 - t) - 1e-9)), math.floor(n * (200.0 - t) / t + 1e-9) + 1)


def _drops_by_length(t: float) -> dict[int, list[int]]:
    """How many letters a name of each length drops to meet its partners on the remaining text.

    N - r grows with N, so only lengths below 3 / (1 - t/100) take part.
    """
    if t >= 100:
        return {}
    out = {}
    for n in range(1, math.ceil((_MAX_DROPS + 1) / (1 - t / 100.0)) + _MAX_DROPS + 2):
        need = {m: _needed(n, m, t) for m in _partners(n, t)}
        out[n] = sorted({n - r for m, r in need.items() if max(n, m) - r <= _MAX_DROPS and n - r < n})
    return out


def _whole_after_two(t: float) -> list[int]:
    """Lengths of names that drop two letters for no partner but one two letters shorter, which then is the whole remaining text."""
    return [n for n, drops in _drops_by_length(t).items() if _MAX_DROPS in drops and all(
        m == n - _MAX_DROPS for m in _partners(n, t) if n - _needed(n, m, t) == _MAX_DROPS and m - _needed(n, m, t) <= _MAX_DROPS)]


def shared_needed(n: Column, m: Column, t: float) -> Column:
    """Fewest common letters for names of these lengths to reach the threshold."""
    return F.ceil(F.lit(t) * (n + m) / F.lit(200.0) - F.lit(1e-9)).cast("int")


def _partner_lengths(n: Column, t: float) -> Column:
    low = F.greatest(F.lit(1), F.ceil(n * t / (200.0 - t) - 1e-9).cast("int"))
    high = F.greatest(low, F.floor(n * (200.0 - t) / t + 1e-9).cast("int"))
    return F.sequence(low, high)


def _lengths_by_drops(t: float) -> dict[int, list[int]]:
    """The lengths of names that drop 0, 1 and 2 letters."""
    return {d: [n for n, ds in _drops_by_length(t).items() if d in ds] for d in range(_MAX_DROPS + 1)}


def _remainders(node_rows: DataFrame, t: float, lengths: dict[int, list[int]] | None = None) -> DataFrame:
    """(sig, node, len, kept): the texts a node can share with a partner, as hashes; ``lengths`` says who drops how many letters, all that serves unless given."""
    name, n = F.col("name"), F.col("len")
    lengths = _lengths_by_drops(t) if lengths is None else lengths

    def of(drops: int) -> DataFrame:
        return node_rows.filter(n.isin(*lengths[drops]) if lengths[drops] else F.lit(False))

    one = of(1).withColumn("i", F.explode(F.sequence(F.lit(1), n)))
    two = (of(2).withColumn("i", F.explode(F.sequence(F.lit(1), n - 1)))
           .withColumn("j", F.explode(F.sequence(F.col("i") + 1, n))))
    i, j = F.col("i"), F.col("j")
    texts = [
        (of(0), name),
        (one, F.concat(F.left(name, i - 1), F.substring(name, i + 1, n))),
        (two, F.concat(F.left(name, i - 1), F.substring(name, i + 1, j - i - 1), F.substring(name, j + 1, n))),
    ]
    out = None
    for drops, (rows, rest) in enumerate(texts):
        part = rows.select(F.xxhash64("block", rest).alias("sig"), "node", "len", (n - drops).alias("kept"))
        out = part if out is None else out.unionByName(part)
    return out


def _pairs_by_remainder(node_rows: DataFrame, t: float) -> DataFrame:
    """Similar pairs (node_a < node_b): what meets with enough letters kept.

    Nearly all remaining texts come from dropping two letters, and for most
    lengths only whole names are met there: those texts are looked up among the
    names and never meet each other. Nearly every other hash is met by one or
    two nodes, and those are settled by a plain aggregation; only hashes met
    more often are joined with themselves.
    """
    lengths, lone = _lengths_by_drops(t), _whole_after_two(t)
    sigs = _remainders(node_rows, t, {**lengths, _MAX_DROPS: [n for n in lengths[_MAX_DROPS] if n not in lone]})
    met = materialize(
        sigs.groupBy("sig").agg(F.min("node").alias("node_a"), F.max("node").alias("node_b"), F.min("len").alias("len_a"), F.max("len").alias("len_b"),
                                F.first("kept").alias("kept"), F.count(F.lit(1)).alias("times")).filter("node_a < node_b"), "met")
    two = met.filter((F.col("times") == 2) & (F.col("kept") >= shared_needed(F.col("len_a"), F.col("len_b"), t)))
    often = sigs.join(met.filter("times > 2").select("sig"), "sig", "left_semi").distinct()
    other = often.select("sig", *[F.col(c).alias(f"other_{c}") for c in ("node", "len", "kept")])
    hot = _hot(met.select("sig", F.col("times").alias("a"), F.col("times").alias("b")))
    need = shared_needed(F.col("len"), F.col("other_len"), t)
    crowded = salted_join(often, other, ["sig"], hot, "node").filter(
        (F.col("node") < F.col("other_node")) & (F.col("kept") == F.col("other_kept")) & (F.col("kept") >= need))
    pairs = two.select("node_a", "node_b").unionByName(crowded.select(F.col("node").alias("node_a"), F.col("other_node").alias("node_b")))
    if not lone:
        return pairs
    longer = _remainders(node_rows, t, {**dict.fromkeys(lengths, []), _MAX_DROPS: lone}).select("sig", "node")
    whole = node_rows.filter(F.col("len").isin(*[n - _MAX_DROPS for n in lone])).select(F.xxhash64("block", "name").alias("sig"), F.col("node").alias("other"))
    # a name is there once, so a text meets one at most, and a task holds its share of names by hash without sorting the texts
    within = longer.join(whole.hint("shuffle_hash"), "sig")
    return pairs.unionByName(within.select(F.least("node", "other").alias("node_a"), F.greatest("node", "other").alias("node_b")))


def _hot(met: DataFrame) -> DataFrame | None:
    """Which hashes of (sig, a, b) take more than one task, where a rows meet b others."""
    share = skew.HOT_ROWS / _PAIRS_PER_TASK
    return hot_keys(met.select("sig", (F.col("a") * F.col("b") * share).alias("n")), ["sig"])


def _shortest_far_partner(t: float) -> int:
    """Shortest name with a partner outside the reach of the remainders."""
    n = 1
    while not any(max(n, m) - _needed(n, m, t) > _MAX_DROPS for m in _partners(n, t)):
        n += 1
    return n


def _far(n: Column, m: Column, t: float) -> Column:
    """Is this pair of lengths outside the reach of the remainders?"""
    return F.greatest(n, m) - shared_needed(n, m, t) > _MAX_DROPS


def _edits(n: Column, t: float) -> Column:
    """Most edits between a name of length n and any shorter-or-equal far partner; -1 if there is none."""
    return F.aggregate(_partner_lengths(n, t), F.lit(-1), lambda acc, m: F.when(
        (m <= n) & _far(n, m, t), F.greatest(acc, n + m - F.lit(2) * shared_needed(n, m, t))).otherwise(acc))


def _reach(m: Column, t: float) -> Column:
    """How far a chunk of a longer far partner can move in a name of length m: (back, on) letters."""
    def wider(acc: Column, n: Column) -> Column:
        r = shared_needed(n, m, t)
        wide = F.struct(F.greatest(acc["back"], n - r).alias("back"), F.greatest(acc["on"], m - r).alias("on"))
        return F.when((n >= m) & _far(n, m, t), wide).otherwise(acc)

    return F.aggregate(_partner_lengths(m, t), F.struct(F.lit(-1).alias("back"), F.lit(-1).alias("on")), wider)


def _sizes(n: Column, k: Column) -> Column:
    """Chunk sizes that cut a name of length n into more than k chunks."""
    usable = F.filter(F.array(*map(F.lit, _CHUNKS)), lambda q: F.floor(n / q) > k)
    return F.when(F.size(usable) > 0, usable).otherwise(F.array(F.lit(1)))


def _single_letters(t: float) -> bool:
    """Are there lengths whose chunks must be single letters?"""
    def edits(n: int) -> int:
        return max((n + m - 2 * _needed(n, m, t) for m in _partners(n, t) if m <= n and n - _needed(n, m, t) > _MAX_DROPS), default=-1)

    return any(n // min(_CHUNKS) <= edits(n) for n in range(1, 200))


def _sig(size: str, place: str, at: str) -> Column:
    return F.xxhash64("block", size, place, F.substring("name", F.col(at), F.col(size)))


def _chunks(node_rows: DataFrame, t: float) -> DataFrame:
    """(node, len, k, q, p, sig): the chunks of names as the longer one of a far pair, in all sizes that serve."""
    n = F.col("len")
    cut = node_rows.withColumn("k", _edits(n, t)).filter("k >= 0").withColumn("q", F.explode(_sizes(n, F.col("k"))))
    cut = cut.withColumn("p", F.explode(F.sequence(F.lit(1), (n - F.col("q") + 1).cast("int"), F.col("q"))))
    return cut.select("node", "len", "k", "q", "p", _sig("q", "p", "p").alias("sig"))


def _grams(node_rows: DataFrame, t: float) -> DataFrame:
    """(partner, m, at, sig): where names as the shorter one of a far pair can show a chunk, for every place it may have come from."""
    sizes = ((1,) if _single_letters(t) else ()) + _CHUNKS
    rows = node_rows.withColumn("reach", _reach(F.col("len"), t)).filter("reach.back >= 0")
    rows = rows.withColumn("q", F.explode(F.array(*map(F.lit, sizes)))).filter("q <= len")
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("len") - F.col("q") + 1)))
    first = F.ceil(F.greatest(F.lit(0), F.col("at") - F.col("reach.on") - 1) / F.col("q"))
    last = F.floor((F.col("at") + F.col("reach.back") - 1) / F.col("q"))
    rows = rows.withColumns({"first": first, "last": last}).filter("first <= last")
    rows = rows.withColumn("i", F.explode(F.sequence("first", "last"))).withColumn("p", (F.col("i") * F.col("q") + 1).cast("int"))
    return rows.select(F.col("node").alias("partner"), F.col("len").alias("m"), "at", _sig("q", "p", "at").alias("sig"))


def _rarest(node_rows: DataFrame, t: float, shorter: DataFrame | None = None) -> DataFrame:
    """(node, len, rank, p, sig, n): of each name one chunk more than there can be edits, those that the fewest ``shorter`` names show.

    Sizes are compared by how many rows their chunks would meet; ``n`` is that number. ``rank`` counts from 0, the rarest.
    """
    counts = materialize(count_keys(_grams(node_rows if shorter is None else shorter, t), ["sig"]), "grams")
    counted = salted_join(_chunks(node_rows, t), counts, ["sig"], hot_keys(counts, ["sig"]), "node", "left")
    counted = counted.withColumn("n", F.coalesce("n", F.lit(0)))
    cut = counted.groupBy("node", "len", "q").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "p", "sig"))), F.lit(1), F.first("k") + 1).alias("kept"))
    load = F.aggregate("kept", F.lit(0).cast("long"), lambda a, c: a + c["n"])
    best = cut.groupBy("node", "len").agg(F.min_by("kept", F.struct(load, "q")).alias("kept"))
    return best.select("node", "len", F.posexplode("kept").alias("rank", "c")).select("node", "len", "rank", "c.p", "c.sig", "c.n")


def _pairs_by_chunk(longer: DataFrame, shorter: DataFrame, t: float) -> DataFrame:
    """(node, partner): candidates of names too long or too unequal for the remainders, partner being no longer than node."""
    if t >= 100:
        return longer.select("node", F.col("node").alias("partner")).limit(0)
    longer, shorter = (rows.filter(F.col("len") >= _shortest_far_partner(t)) for rows in (longer, shorter))
    chosen = materialize(_rarest(longer, t, shorter).filter("n > 0"), "chunks")
    met = chosen.groupBy("sig").agg(F.first("n").alias("a"), F.count(F.lit(1)).alias("b"))
    n, m, need = F.col("len"), F.col("m"), shared_needed(F.col("len"), F.col("m"), t)
    found = salted_join(_grams(shorter, t), chosen.drop("n"), ["sig"], _hot(met), "partner").filter(
        (m <= n) & _far(n, m, t) & (need <= m)
        # partners of this length can differ by fewer edits than others: so many of the rarest chunks and one more serve
        & (F.col("rank") <= n + m - 2 * need) & F.col("at").between(F.col("p") - (n - need), F.col("p") + (m - need)))
    return found.select("node", "partner")


def _pairs_between_by_remainder(left: DataFrame, right: DataFrame, t: float) -> DataFrame:
    """(node_a, node_b): candidates from two tables of names that share a remaining text."""
    a = _remainders(left, t)
    b = _remainders(right, t).select("sig", *[F.col(c).alias(f"other_{c}") for c in ("node", "len", "kept")])
    met = materialize(count_keys(a, ["sig"]).withColumnRenamed("n", "a").join(count_keys(b, ["sig"]).withColumnRenamed("n", "b"), "sig"), "met")
    need = shared_needed(F.col("len"), F.col("other_len"), t)
    found = salted_join(a, b, ["sig"], _hot(met), "node").filter((F.col("kept") == F.col("other_kept")) & (F.col("kept") >= need))
    return found.select(F.col("node").alias("node_a"), F.col("other_node").alias("node_b"))


def _named(met: DataFrame, left: DataFrame, right: DataFrame, t: float) -> DataFrame:
    """Pairs of one block that meet and have letters enough in common, with both names."""
    def side(rows, s):
        return rows.select(*[F.col(c).alias(f"{c}_{s}") for c in ("node", "block", "name", "len", "bag", "n")])

    pairs = met.join(side(left, "a"), "node_a").join(side(right, "b"), "node_b").filter("block_a = block_b AND name_a <> name_b")
    pairs = pairs.filter(_common(F.col("bag_a"), F.col("bag_b")) >= shared_needed(F.col("len_a"), F.col("len_b"), t))
    return pairs.select("node_a", "node_b", F.col("block_a").alias("block"), "name_a", "name_b", "n_a", "n_b")


def _checked(threshold: float) -> float:
    if not MIN_THRESHOLD <= threshold <= 100:
        raise ValueError(f"threshold must lie between {MIN_THRESHOLD} and 100")
    return threshold


def candidates(node_rows: DataFrame, t: float) -> DataFrame:
    """(node_a, node_b, block, name_a, name_b, n_a, n_b): pairs that meet and have letters enough in common; every similar pair is one."""
    far = _pairs_by_chunk(node_rows, node_rows, t).filter("node <> partner")
    far = far.select(F.least("node", "partner").alias("node_a"), F.greatest("node", "partner").alias("node_b"))
    return _named(_pairs_by_remainder(node_rows, t).unionByName(far).distinct(), node_rows, node_rows, t)


def _similar(pairs: DataFrame, t: float) -> DataFrame:
    """Pairs with their similarity, from the threshold on. As a generated column it is worked out once; a filter on it would work it out again."""
    reached = F.filter(F.array(indel_ratio(F.col("name_a"), F.col("name_b"))), lambda x: x >= t)
    return pairs.withColumn("similarity", F.explode(reached))


def similar_between(left: DataFrame, right: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """(block, name_a, name_b, similarity): names of ``left`` and different names of ``right`` of one block at or above the threshold.

    Both are tables of ``nodes``; names of one table are not compared with each other.
    """
    t = _checked(threshold)
    met = _pairs_between_by_remainder(left, right, t)
    met = met.unionByName(_pairs_by_chunk(left, right, t).select(F.col("node").alias("node_a"), F.col("partner").alias("node_b")))
    met = met.unionByName(_pairs_by_chunk(right, left, t).select(F.col("partner").alias("node_a"), F.col("node").alias("node_b")))
    return _similar(_named(met.distinct(), left, right, t), t).select("block", "name_a", "name_b", "similarity")


def similar_names(node_rows: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """(block, name_a, name_b, similarity, n_a, n_b) for distinct names of one block at or above the threshold.

    Candidates meet on 64-bit hashes; block and similarity are checked on the
    names themselves, so a chance collision cannot add a pair.
    """
    pairs = _similar(candidates(node_rows, _checked(threshold)), threshold)
    first = F.col("name_a") < F.col("name_b")
    return pairs.select(
        "block", F.least("name_a", "name_b").alias("name_a"), F.greatest("name_a", "name_b").alias("name_b"),
        "similarity", F.when(first, F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"),
        F.when(first, F.col("n_b")).otherwise(F.col("n_a")).alias("n_b"))


def near_duplicates(merged: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Groups of entities to review: two similar names, or one name held by several entities.

    (date_of_birth, name_a, name_b, similarity, entities_a, entities_b); the
    entities themselves come from ``near_duplicate_members``. A pair of rows
    stands for entities_a x entities_b pairs of entities, which are never
    listed one by one.
    """
    node_rows = nodes(members(merged))
    pairs = similar_names(node_rows, threshold).withColumnsRenamed({"n_a": "entities_a", "n_b": "entities_b"})
    same = node_rows.filter("n > 1").select(
        "block", F.col("name").alias("name_a"), F.col("name").alias("name_b"), F.lit(100.0).alias("similarity"),
        F.col("n").alias("entities_a"), F.col("n").alias("entities_b"))
    columns = [F.col("block").alias("date_of_birth"), "name_a", "name_b",
               F.round("similarity", 1).alias("similarity"), "entities_a", "entities_b"]
    return pairs.select(*columns).unionByName(same.select(*columns))


def near_duplicate_members(merged: DataFrame, groups: DataFrame) -> DataFrame:
    """(date_of_birth, name_a, name_b, canonical_key): who is in each group, one row per entity and group."""
    sides = groups.select("date_of_birth", "name_a", "name_b",
                          F.explode(F.array_distinct(F.array("name_a", "name_b"))).alias("name"))
    who = members(merged).select(F.col("block").alias("date_of_birth"), "name", "canonical_key")
    key = ["date_of_birth", "name"]
    hot = hot_keys(count_keys(who, key), key)
    return salted_join(who, sides, key, hot, "canonical_key").select("date_of_birth", "name_a", "name_b", "canonical_key")
