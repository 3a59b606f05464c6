"""Indel similarity (2 * LCS / total length) as a Spark expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

_WORD = 62  # bits of a long that stay clear of overflow


def chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence.

    What both texts begin and end with counts as it is, and only what differs
    between is worked on. The shorter text is held as bit masks in one long (the bit-parallel
    recurrence of Hyyrö); texts whose shorter side is longer than a word take
    the row-by-row table instead.
    """
    def between(x: Column) -> Column:
        after = _alike(x["a"], x["b"], F.right)
        return F.transform(F.array(F.struct(after.alias("after"), x["a"].alias("a"), x["b"].alias("b"))), lambda y: y["after"] + _lcs(
            F.left(y["a"], F.length(y["a"]) - y["after"]), F.left(y["b"], F.length(y["b"]) - y["after"])))[0]

    # one-element arrays bind what is used more than once to a name
    before = F.array(F.struct(_alike(a, b, F.left).alias("before"), a.alias("a"), b.alias("b")))
    return F.transform(before, lambda x: F.transform(F.array(F.struct(
        x["before"].alias("before"), F.right(x["a"], F.length(x["a"]) - x["before"]).alias("a"), F.right(x["b"], F.length(x["b"]) - x["before"]).alias("b"))),
        lambda y: y["before"] + between(y))[0])[0]


def _alike(a: Column, b: Column, side: Callable[[Column, Column], Column]) -> Column:
    """How many letters both texts have in common on one side."""
    n = F.least(F.length(a), F.length(b))
    return F.when(F.length(a).isNull() | F.length(b).isNull() | (n == 0), 0).otherwise(
        F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: side(a, i) == side(b, i))))


def _lcs(a: Column, b: Column) -> Column:
    swap = F.length(a) > F.length(b)
    short, long = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    return F.when(F.length(short) == 0, 0).when(F.length(short) <= _WORD, _lcs_bits(short, long)) \
            .otherwise(_lcs_rows(short, long))


def _lcs_bits(short: Column, long: Column) -> Column:
    letters = chars(short)
    full = F.pow(F.lit(2.0), F.length(short)).cast("long") - F.lit(1).cast("long")

    def positions(letter):
        start = F.struct(F.lit(0).cast("long").alias("mask"), F.lit(1).cast("long").alias("bit"))
        return F.aggregate(
            letters, start,
            lambda acc, x: F.struct(
                F.when(x == letter, acc["mask"].bitwiseOR(acc["bit"])).otherwise(acc["mask"]).alias("mask"),
                (acc["bit"] * F.lit(2).cast("long")).alias("bit")),
            lambda acc: acc["mask"])

    def step(v, letter):
        # the one-element array binds v & mask to a name, so it is worked out once
        return F.aggregate(
            F.array(v.bitwiseAND(positions(letter))), v,
            lambda row, u: (row + u).bitwiseOR(row - u).bitwiseAND(full))

    return F.aggregate(chars(long), full, step, lambda v: F.length(short) - F.bit_count(v))


def _lcs_rows(short: Column, long: Column) -> Column:
    letters = chars(short)
    zeros = F.transform(F.concat(F.array(F.lit("")), letters), lambda _: F.lit(0))

    def next_row(prev, letter):
        return F.aggregate(
            F.sequence(F.lit(1), F.length(short)), F.array(F.lit(0)),
            lambda row, i: F.concat(row, F.array(
                F.when(F.element_at(letters, i) == letter, F.element_at(prev, i) + 1)
                .otherwise(F.greatest(F.element_at(prev, i + 1), F.element_at(row, -1))))))

    return F.aggregate(chars(long), zeros, next_row, lambda row: F.element_at(row, -1))


def indel_ratio(a: Column, b: Column) -> Column:
    """Similarity in percent; equal texts are 100, also two empty ones."""
    total = F.length(a) + F.length(b)
    return F.when(a == b, F.lit(100.0)).otherwise(F.lit(200.0) * lcs_length(a, b) / total)


def sorted_tokens(c: Column) -> Column:
    """Lower-cased words in alphabetical order, joined by one space."""
    squeezed = F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    return F.array_join(F.array_sort(F.split(squeezed, " ")), " ")
