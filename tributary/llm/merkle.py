"""Merkle manifest of a dataset: levels kept as concatenated hex strings, in aligned blocks.

Rows hash to leaves. A group's leaves, in order, are cut in blocks of
``FAN ** HEIGHT``; a block keeps each of its levels as one string of 64 hex
digits a node. Parents are hashes of fixed-width substrings, a node's siblings
are the substrings that flank it. The roots of a group's blocks are the nodes
of the next tier, which is cut and folded alike until each group has one root;
the groups' roots are folded alike to one. All DataFrame functions; no task
holds more than a block.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tributary.llm.common import materialize
from tributary.operators.ordering import CHUNK, ROW, number_rows

FAN = 3
#: Levels that a block folds; it holds FAN ** HEIGHT nodes at most.
HEIGHT = 6
HEX = 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(columns: list[Column]) -> Column:
    """Hash of the columns: ``-`` for null, else the value's UTF-8 length, a colon and the value, so no two rows spell alike."""
    texts = [c.cast("string") for c in columns]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def parents(level: Column) -> Column:
    """The level above, from runs of FAN nodes; the last run may have fewer."""
    width = FAN * HEX
    starts = F.sequence(F.lit(1), F.length(level), F.lit(width))
    return F.array_join(F.transform(starts, lambda at: digest(F.substring(level, at, F.lit(width)))), "")


def siblings(level: Column, at: Column) -> Column:
    """(left, right): the other nodes of the run that node ``at`` of a level is in."""
    run = F.substring(level, (F.floor(at / FAN) * FAN * HEX + 1).cast("int"), F.lit(FAN * HEX))
    place = (at % FAN).cast("int")
    return let(run, lambda r: F.struct(F.substring(r, F.lit(1), place * HEX).alias("left"),
                                       F.substring(r, place * HEX + HEX + 1, F.lit(FAN * HEX)).alias("right")))


def proof_in_block(levels: Column, at: Column) -> Column:
    """Siblings of member ``at``, level by level, up to the block's root."""
    below = F.slice(levels, F.lit(1), F.size(levels) - 1)
    return F.transform(below, lambda level, k: siblings(level, F.floor(at / F.pow(F.lit(FAN), k))))


def fold(node: Column, proof: Column) -> Column:
    """The root that a node and its siblings give."""
    return F.aggregate(proof, node, lambda h, s: digest(F.concat(s["left"], h, s["right"])))


def spelled(proof: Column) -> Column:
    """The siblings of a proof as one text, level by level, from left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def blocks(nodes: DataFrame) -> DataFrame:
    """(group, block, lone, n, members, levels) of nodes(group, n, index, hash, ...).

    ``n`` is the group's number of nodes. A block that is the only one of its
    group folds until one node remains, any other HEIGHT times.
    """
    size = FAN ** HEIGHT
    member = F.struct("index", "hash", *[c for c in nodes.columns if c not in ("group", "n", "index", "hash")])
    cut = (nodes.groupBy("group", F.floor(F.col("index") / size).alias("block"))
           .agg(F.first("n").alias("n"), F.sort_array(F.collect_list(member)).alias("members")))  # at most FAN ** HEIGHT members
    cut = cut.withColumn("lone", F.col("n") <= size)
    first = F.array(F.array_join(F.transform("members", lambda m: m["hash"]), ""))
    done = lambda levels: F.col("lone") & (F.length(F.element_at(levels, -1)) <= HEX)
    levels = F.aggregate(F.sequence(F.lit(1), F.lit(HEIGHT)), first,
                         lambda have, _: F.when(done(have), have).otherwise(F.concat(have, F.array(parents(F.element_at(have, -1))))))
    return cut.withColumn("levels", levels)


def tiers(nodes: DataFrame) -> list[DataFrame]:
    """Tables of blocks, the first of ``nodes``, each next one of the block roots of the groups that have several blocks."""
    made = []
    while True:
        made.append(materialize(blocks(nodes), "blocks"))
        several = made[-1].filter(~F.col("lone"))
        if several.isEmpty():
            return made
        nodes = several.select("group", F.ceil(F.col("n") / FAN ** HEIGHT).alias("n"), F.col("block").alias("index"),
                               F.element_at("levels", -1).alias("hash"))


def group_roots(made: list[DataFrame]) -> DataFrame:
    """(group, root) of all groups."""
    return reduce(DataFrame.unionByName, [t.filter("lone").select("group", F.element_at("levels", -1).alias("root")) for t in made])


def members_with_proofs(made: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The members of the first tier with their proofs up to the top.

    tops(group, proof, ...) says how a group's root is proved; its other columns
    are handed down. A block meets what is above it by its own key, so no key
    has more than one row on either side.
    """
    handed = [c for c in tops.columns if c not in ("group", "proof")]
    above = None
    for tier in reversed(made):
        placed = tier.filter("lone").join(tops, "group")
        if above is not None:
            placed = placed.unionByName(tier.filter(~F.col("lone")).join(above, ["group", "block"]))
        own = F.transform("members", lambda m, at: F.struct(m.alias("member"), F.concat(proof_in_block(F.col("levels"), at), "proof").alias("proof")))
        rows = placed.select("group", *handed, F.explode(own).alias("m")).select("group", *handed, "m.member", "m.proof")
        if tier is not made[0]:
            above = materialize(rows.select("group", F.col("member.index").alias("block"), "proof", *handed), "proofs")
    return rows


def manifest(docs: DataFrame, presented: Mapping[str, Column] | None = None, columns: tuple[str, ...] = COLUMNS,
             group: str = "source", key: str = "doc_id") -> DataFrame:
    """(key, leaf, presented, proof, subroot, root), one row per row of ``docs``.

    ``leaf`` is the hash of ``columns``; ``presented`` the hash of the row with
    some columns replaced, as a copy under examination shows it: ``fold`` of it
    and ``proof`` equals ``root`` only if nothing was changed. Leaves of a group
    ascend by key (null first), then by hash; groups by name (null first, not
    the same as the empty name, then by their bytes). Every row is a leaf, also
    repeated ones, null and empty texts and rows without key; other columns of
    any name do not count. Of an empty table there is no row and no root.
    """
    names = {c: F.col(f"`{c}`") for c in columns}
    shown = {**names, **{c: v for c, v in (presented or {}).items() if c in names}}
    changed = reduce(lambda a, b: a | b, [~names[c].eqNullSafe(shown[c]) for c in names if c in (presented or {})], F.lit(False))
    # a null group sorts before all names, and is none of them
    group_key = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    rows = materialize(docs.select(group_key.alias("group"), F.col(f"`{key}`").alias("key"), leaf(list(names.values())).alias("hash"),
                                   F.when(changed, leaf(list(shown.values()))).alias("shown"), F.monotonically_increasing_id().alias("tie")), "leaves")
    numbered = number_rows(rows, ["group", "key", "hash", "tie"])
    # a group's first number and size, for each of its chunks: a large group has many chunks
    spans = numbered.groupBy(CHUNK, "group").agg(F.min(ROW).alias("first"), F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy("group")
    spans = materialize(spans.select(CHUNK, "group", F.min("first").over(whole).alias("first"), F.sum("rows").over(whole).alias("n")), "spans")
    leaves = numbered.join(spans, [CHUNK, "group"]).select("group", "n", (F.col(ROW) - F.col("first")).alias("index"), "hash", "key", "shown")
    made = tiers(leaves)

    roots = number_rows(materialize(group_roots(made), "roots"), ["group"])
    upper = tiers(roots.select(F.lit("").alias("group"), F.lit(roots.count()).alias("n"), F.col(ROW).alias("index"), F.col("root").alias("hash"), F.col("group").alias("name")))
    top = group_roots(upper).select("group", F.array().cast(PROOF).alias("proof"), "root")
    tops = members_with_proofs(upper, top).select(F.col("member.name").alias("group"), "proof", F.col("member.hash").alias("subroot"), "root")
    rows = members_with_proofs(made, materialize(tops, "proofs"))
    return rows.select(F.col("member.key").alias(key), F.col("member.hash").alias("leaf"), F.coalesce("member.shown", "member.hash").alias("presented"),
                       "proof", "subroot", "root")
