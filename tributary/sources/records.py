"""CSV records that run over several lines, read by many tasks.

A file is split among tasks by lines, but whether a line begins a record
depends on all quotes before it. So each line is a function: it says whether
the next line is inside a quoted cell, given whether it is itself. These
functions are composed per file block in any task, the few results per block
are carried through each file, and with them every line knows what it is. A
line that is a record of its own stays where it is; only lines of records that
run over several lines meet by record number.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tributary.session import materialize

#: A record of more lines than this is taken for a quote that nobody closed.
MAX_LINES = 10_000


class Dialect:
    """How cells are separated and quoted; a cell is quoted if the quote is its first character."""

    def __init__(self, sep: str = ",", quote: str = '"', escape: str = "\\"):
        if min(map(len, (sep, quote, escape))) < 1 or max(map(len, (sep, quote, escape))) > 1:
            raise ValueError("separator, quote and escape are one character each")
        s, q, e = map(re.escape, (sep, quote, escape))
        if escape == quote:
            body, end = f"[^{q}]*+(?:{q}{q}[^{q}]*+)*+", "\\z"
        else:
            body, end = f"[^{q}{e}]*+(?:{e}.[^{q}{e}]*+)*+", f"{e}?\\z"
        cell = f"(?:{q}{body}{q}[^{s}]*+|[^{q}{s}][^{s}]*+|)"
        opened = f"(?:{cell}{s})*+{q}{body}{end}"
        #: Of a line that begins outside of quotes, and of one that begins inside: does it end inside?
        self.from_outside = f"(?s)\\A{opened}"
        self.from_inside = f"(?s)\\A(?:{body}{end}|{body}{q}[^{s}]*+{s}{opened})"
        self.options = {"sep": sep, "quote": quote, "escape": escape}


def _composed(first: str, second: str, by: list[str], order: str) -> tuple[Column, Column]:
    """(settled, odd) of all rows before this one: the state is ``settled``, or the first state where it is null, turned round if ``odd``.

    ``first`` and ``second`` are the state after a row that meets state false
    and true: equal ones settle the state, others keep it or turn it round.
    """
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    settles = F.when(F.col(first) == F.col(second), F.col(first))
    turns = F.coalesce(F.count_if(F.col(first) & ~F.col(second)).over(before), F.lit(0))
    at_last = F.last(F.when(settles.isNotNull(), F.col("_turns")), ignorenulls=True).over(before)
    return turns, F.struct(F.last(settles, ignorenulls=True).over(before).alias("settled"),
                           ((F.col("_turns") - F.coalesce(at_last, F.lit(0))) % 2 == 1).alias("odd"))


def _with_state(rows: DataFrame, first: str, second: str, by: list[str], order: str, name: str) -> DataFrame:
    turns, state = _composed(first, second, by, order)
    return rows.withColumn("_turns", turns).withColumn(name, state).drop("_turns")


def _resolved(state: str, start: Column | bool) -> Column:
    settled = F.coalesce(F.col(f"{state}.settled"), start if isinstance(start, Column) else F.lit(start))
    return settled != F.col(f"{state}.odd")


def split_records(spark: SparkSession, path: str, dialect: Dialect = Dialect(), header: bool = True, max_lines: int = MAX_LINES) -> DataFrame:
    """(file, row_num, record): the records of all files of a path, numbered from 1 in file order, as text.

    Line ends inside quoted cells are line feeds, whatever the file has; empty
    lines between records are none. With ``header`` each file's first record is
    left out. A quote that is not closed by the end of its file, or within
    ``max_lines`` lines, is an error.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.regexp_replace("value", "\\r\\z", "").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mark"))
    quoted = F.instr("line", F.lit(dialect.options["quote"])) > 0
    block = ["file", "block"]
    lines = raw.withColumns({"out_of": quoted & F.col("line").rlike(dialect.from_outside), "in_to": ~quoted | F.col("line").rlike(dialect.from_inside)})
    lines = _with_state(lines, "out_of", "in_to", block, "mark", "state")
    so_far = Window.partitionBy(*block).orderBy("mark").rowsBetween(Window.unboundedPreceding, 0)
    begins = lambda start: ~_resolved("state", start) & (F.col("line") != "")
    lines = materialize(lines.withColumns({f"n{int(start)}": F.count_if(begins(start)).over(so_far) for start in (False, True)}), "lines")

    # one row per file block from here
    after = lambda start: F.when(_resolved("last.state", start), F.col("last.in_to")).otherwise(F.col("last.out_of"))
    blocks = lines.groupBy(*block).agg(F.max_by(F.struct("state", "out_of", "in_to", "n0", "n1"), "mark").alias("last"))
    blocks = blocks.select(*block, after(False).alias("b_out"), after(True).alias("b_in"), "last.n0", "last.n1")
    blocks = _with_state(blocks, "b_out", "b_in", ["file"], "block", "b_state").withColumn("start", _resolved("b_state", False))
    in_file = Window.partitionBy("file").orderBy("block")
    blocks = blocks.withColumns({"n": F.when(F.col("start"), F.col("n1")).otherwise(F.col("n0")), "first": F.row_number().over(in_file) == 1,
                                 "ends_inside": F.when(F.col("start"), F.col("b_in")).otherwise(F.col("b_out")), "last": F.lead("block").over(in_file).isNull()})
    earlier = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({"offset": F.coalesce(F.sum("n").over(earlier), F.lit(0)),
                                 "headers": F.sum(F.col("first").cast("int")).over(Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, 0))})
    blocks = materialize(blocks.withColumn("file_offset", F.first("offset").over(in_file)).drop("b_state", "b_out", "b_in", "n0", "n1", "n"), "blocks")
    torn_file = blocks.filter(F.col("last") & F.col("ends_inside")).first()
    if torn_file:
        raise ValueError(f"{torn_file['file']}: a quoted cell is not closed by the end of the file")

    inside = _resolved("state", F.col("start"))
    placed = (lines.join(blocks.select(*block, "start", "offset", "headers", "file_offset"), block)
              .withColumns({"inside": inside, "record_no": F.col("offset") + F.when(F.col("start"), F.col("n1")).otherwise(F.col("n0"))})
              .withColumn("goes_on", F.when(F.col("inside"), F.col("in_to")).otherwise(F.col("out_of")))
              .filter(F.col("inside") | (F.col("line") != "")))
    if header:
        placed = placed.filter(F.col("record_no") > F.col("file_offset") + 1)
    number = F.col("record_no") - (F.col("headers") if header else F.lit(0))
    whole = placed.filter(~F.col("inside") & ~F.col("goes_on")).select("file", number.alias("row_num"), F.col("line").alias("record"))
    torn = placed.filter(F.col("inside") | F.col("goes_on")).select("file", number.alias("row_num"), "block", "mark", "line")
    most = torn.groupBy("file", "row_num").agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", "row_num", "file")).alias("m")).first()["m"]
    if most and most["n"] > max_lines:
        raise ValueError(f"{most['file']}: record {most['row_num']} runs over {most['n']} lines; is a quote not closed?")
    glued = torn.groupBy("file", "row_num").agg(F.array_sort(F.collect_list(F.struct("block", "mark", "line"))).alias("parts"))  # at most max_lines
    return whole.unionByName(glued.select("file", "row_num", F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("record")))
