"""Chat formatting: the best root-to-leaf paths of reply trees, each as one conversation.

Paths are found by joining a table of pointers with itself: after round k a
row points 2**k rows up, and knows the score of all it has passed. A tree of
depth d takes log2(d) rounds; no row holds a path. From the chosen leaves the
same tables are walked back, which marks the rows of each path.

A turn is written as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and
texts ``\\`` becomes ``\\-`` and ``<|`` becomes ``<\\|`` (in roles a line break
becomes ``\\n``), so no text can be read as a control string and all can be
read back. All DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tributary.llm.common import materialize

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\-")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\-"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def paths(nodes: DataFrame, best: int | None = 1) -> DataFrame:
    """(tree, leaf, node, pos, score): the rows of the ``best`` branches of each tree (None: of all).

    ``nodes`` has tree, node, parent and score, (tree, node) unique. A row
    without parent, or whose parent is not there, is a root; every root is the
    tree of its branches, so of several roots in one tree the branches compete
    all together. A branch scores the sum of its rows' scores, a null score
    counts 0; ties go to the smallest leaf. Rows on or below a circle of
    replies have no root and are in no branch.
    """
    own = F.coalesce(F.col("score").cast("double"), F.lit(0.0))
    rows = materialize(nodes.filter("node IS NOT NULL").select("tree", "node", "parent", own.alias("score")), "nodes")
    there = rows.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    state = rows.join(there, ["tree", "parent"], "left").select(
        "tree", "node", F.when(F.col("known"), F.col("parent")).alias("up"), "score", F.lit(0).cast("long").alias("depth"))
    state = state.withColumn("depth", F.when(F.col("up").isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("long"))
    state = materialize(state, "pointers")
    most = rows.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    jumps = []
    while 2 ** len(jumps) <= most and not (moving := state.filter("up IS NOT NULL")).isEmpty():
        jumps.append(state)
        above = state.select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("score").alias("more"), F.col("depth").alias("further"))
        moved = moving.join(above, ["tree", "up"]).select("tree", "node", F.col("next").alias("up"), (F.col("score") + F.col("more")).alias("score"),
                                                         (F.col("depth") + F.col("further")).alias("depth"))
        state = materialize(state.filter("up IS NULL").unionByName(moved), "pointers")
    parents = rows.select("tree", F.col("parent").alias("node")).filter("node IS NOT NULL").distinct()
    leaves = state.filter("up IS NULL").join(parents, ["tree", "node"], "left_anti").select("tree", "node", "score", "depth")
    if best is not None:
        order = Window.partitionBy("tree").orderBy(F.desc("score"), "node")
        leaves = leaves.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best).drop("rank")
    marked = leaves.select("tree", F.col("node").alias("leaf"), "node", F.col("depth").alias("pos"), "score")
    for k in reversed(range(len(jumps))):
        jump = jumps[k].filter("up IS NOT NULL").select("tree", "node", "up")
        stay = F.struct("node", "pos")
        go = F.struct(F.col("up").alias("node"), (F.col("pos") - 2 ** k).alias("pos"))
        both = F.when(F.col("up").isNull(), F.array(stay)).otherwise(F.array(stay, go))
        marked = (marked.join(jump, ["tree", "node"], "left").select("tree", "leaf", "score", F.explode(both).alias("at"))
                  .select("tree", "leaf", "at.node", "at.pos", "score"))
    return marked


def format_paths(turns: DataFrame) -> DataFrame:
    """(tree, leaf, n_turns, formatted, loss_spans) of turns (tree, leaf, pos, role, text), a row per path.

    ``formatted`` is the whole conversation; loss_spans lists, for each
    assistant turn, its number, where the turn and where its (escaped) text
    begins and where that ends, counted in code points. A conversation is one
    value, so its own turns, and only these, meet in one task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    pieces = turns.select("tree", "leaf", "pos", (role == "assistant").alias("loss"), F.concat(F.lit(START), escape_role(role), F.lit("\n")).alias("head"),
                          escape(text).alias("body"))
    pieces = pieces.select("*", F.char_length("head").alias("h"), F.char_length("body").cast("long").alias("b"))
    before = Window.partitionBy("tree", "leaf").orderBy("pos")
    size = F.col("h") + F.col("b") + len(END)
    placed = pieces.withColumn("turn_start", F.sum(size).over(before) - size).withColumn("turn", (F.row_number().over(before) - 1).cast("long"))
    begin = F.col("turn_start") + F.col("h")
    span = F.when(F.col("loss"), F.struct("turn", "turn_start", begin.alias("start"), (begin + F.col("b")).alias("end")))
    rows = placed.select("tree", "leaf", F.struct("turn", F.concat("head", "body", F.lit(END)).alias("piece"), span.alias("span")).alias("r"))
    made = rows.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list("r")).alias("r"))
    return made.select("tree", "leaf", F.size("r").cast("long").alias("n_turns"), F.array_join(F.col("r.piece"), "").alias("formatted"),
                       F.filter(F.col("r.span"), lambda s: s.isNotNull()).alias("loss_spans"))


def read_back(formatted: Column, loss_spans: Column) -> tuple[Column, Column]:
    """(turns, loss): the turns as (role, text), and the unescaped texts under the mask, both taken from the output."""
    written = F.filter(F.split(formatted, "<\\|im_end\\|>\n"), lambda t: t != "")
    cut = F.transform(written, lambda t: F.substring(t, F.lit(len(START) + 1), F.length(t)))

    def turn(t: Column) -> Column:
        line = F.locate("\n", t)
        return F.struct(unescape_role(F.substring(t, F.lit(1), line - 1)).alias("role"), unescape(F.substring(t, line + 1, F.length(t))).alias("text"))

    def under(s: Column) -> Column:
        whole = F.element_at(written, (s["turn"] + 1).cast("int"))
        return unescape(F.substring(whole, (s["start"] - s["turn_start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))

    return F.transform(cut, turn), F.transform(loss_spans, under)


def format_trees(nodes: DataFrame, best: int | None = 1, tree: str = "tree", node: str = "node", parent: str = "parent",
                 role: str = "role", text: str = "text", score: str = "score") -> DataFrame:
    """The best branches of reply trees as conversations: (tree, leaf, score, n_turns, formatted, loss_spans).

    Of rows that share (tree, node) one stands, the smallest by parent, role,
    text and score. Null roles and texts are empty, null trees are one tree,
    rows with a null node are left out (nothing can reply to them), an empty
    table gives an empty result. See ``paths`` and ``format_paths``.
    """
    names = {"tree": tree, "node": node, "parent": parent, "role": role, "text": text, "score": score}
    rows = nodes.select(*[F.col(f"`{v}`").alias(k) for k, v in names.items()])
    # a null tree must join like any other
    rows = rows.filter("node IS NOT NULL").withColumn("tree", F.struct("tree")).groupBy("tree", "node").agg(
        F.min(F.struct("parent", "role", "text", "score")).alias("r")).select("tree", "node", "r.*")
    rows = materialize(rows, "turns")
    found = materialize(paths(rows, best), "paths")
    texts = found.drop("score").join(rows.select("tree", "node", "role", "text"), ["tree", "node"])
    done = format_paths(texts).join(found.filter(F.col("node") == F.col("leaf")).select("tree", "leaf", "score"), ["tree", "leaf"])
    return done.select(F.col("tree.tree").alias(tree), "leaf", "score", "n_turns", "formatted", "loss_spans")
