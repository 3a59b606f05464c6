"""SimHash near-duplicates: fingerprints, and links at a few differing bits.

Fingerprints that differ in at most r bits agree wholly in three of r + 3
groups of bits. Distinct fingerprints therefore meet in one table for each
choice of three groups. Inside a bucket they are compared bit-sliced: bit
planes are stored vertically, 64 fingerprints to a machine word, and the
distances of all of them to their s-th successors are counted at once with
carry-save bitwise counters. Words in which every distance exceeds the radius
are abandoned.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tributary.llm.common import materialize, text_bytes, text_chunks
from tributary.llm.components import components

SEED = 42
BITS = 64
PIECE = 1 << 17
CROWDED = 4096


def _hashes(words: list[bytes], shingle: int) -> list[int]:
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [digest(b" ".join(words), SEED)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = [0, *ends[:-shingle].tolist()]
    return [digest(joined[i:j], SEED) for i, j in zip(starts, (ends[shingle - 1:] - 1).tolist())]


def _set_bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _majority(hashes: list[list[int]]) -> np.ndarray:
    """Fingerprints of several texts: a bit is set if over half of the text's hashes have it."""
    total = np.zeros((len(hashes), BITS), dtype=np.int64)
    counts = np.array([len(h) for h in hashes], dtype=np.int64)
    flat = np.fromiter((x for h in hashes for x in h), dtype=np.uint64, count=int(counts.sum()))
    of = np.repeat(np.arange(len(hashes)), counts)
    for at in range(0, len(flat), PIECE):  # a very long text is counted piece by piece
        part = of[at:at + PIECE]
        first = np.flatnonzero(np.diff(part, prepend=-1))
        total[part[first]] += np.add.reduceat(_set_bits(flat[at:at + PIECE]), first, axis=0, dtype=np.int64)
    return np.packbits(2 * total > counts[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): the fingerprint of each row's whole text as a signed long.

    Words are runs of bytes other than ASCII white space, A-Z in lower case. A
    text of fewer words than ``shingle`` is one shingle; without words, or if
    null, the fingerprint is 0. Every row gives a row, repeated ones too.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches):
            found = _majority([_hashes(t.lower().split(), shingle) for t in texts])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], ["_key", "fp"])

    rows = text_bytes(docs, F.col(f"`{key}`").alias("_key"), text=text)
    return rows.mapInArrow(run, f"_key {rows.schema['_key'].dataType.simpleString()}, fp long").withColumnRenamed("_key", key)


def _widths(groups: int) -> list[tuple[int, int]]:
    """(first bit, bits) of ``groups`` nearly equal groups of the fingerprint."""
    edges = [BITS * i // groups for i in range(groups + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _mask(groups: Iterable[tuple[int, int]]) -> int:
    mask = sum(((1 << n) - 1) << at for at, n in groups)
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _planes(values: np.ndarray) -> np.ndarray:
    """The bit planes of values: one row a bit, 64 values to a word."""
    filled = np.concatenate((values, np.zeros(-len(values) % 64, dtype=np.uint64)))
    return np.packbits(np.ascontiguousarray(_set_bits(filled).T), axis=1, bitorder="little").view("<u8")


def _shifted(plane: np.ndarray, words: np.ndarray, shift: int) -> np.ndarray:
    """These words of a plane that begins ``shift`` values further on; past the end there are zeros."""
    ahead, bits = words + shift // 64, shift % 64
    low = plane[np.minimum(ahead, len(plane) - 1)] >> np.uint64(bits)
    low[ahead >= len(plane)] = 0
    if bits:
        high = plane[np.minimum(ahead + 1, len(plane) - 1)] << np.uint64(64 - bits)
        high[ahead + 1 >= len(plane)] = 0
        low |= high
    return low


def close_pairs(values: np.ndarray, same: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), i < j, with same[i] == same[j] and at most ``radius`` differing bits.

    ``same`` numbers the buckets upwards from 0, rows of one bucket together. Values are turned into bit planes once; for each
    shift s the planes are compared with themselves s rows on, 64 rows to a word and one plane at a time, shifted as words. Words
    all of whose lanes exceed the radius, or lie in no bucket of that length, drop out. When half of the rows are in buckets
    that are done with, the planes of the others are made anew.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    rows = np.arange(len(values))
    planes, shift = _planes(values), 1
    while shift < len(same):
        met = same[shift:] == same[:-shift]
        if not met.any():
            break
        lanes = np.packbits(np.concatenate((met, np.zeros(64 * planes.shape[1] - len(met), dtype=bool))), bitorder="little").view("<u8")
        words = np.flatnonzero(lanes)
        over = ~lanes[words]
        counter = np.zeros((radius.bit_length() + 1, len(words)), dtype=np.uint64)
        for bit in range(BITS):
            carry = planes[bit, words] ^ _shifted(planes[bit], words, shift)
            for level in counter:
                level ^= carry
                carry &= ~level
            over |= carry | _above(counter, radius)
            if bit % 8 == 7:
                alive = np.flatnonzero(~over)
                if len(alive) < len(words):
                    words, over, counter = words[alive], over[alive], counter[:, alive].copy()
                if not len(words):
                    break
        if len(words):
            ok = np.unpackbits((~over).astype("<u8").view(np.uint8), bitorder="little").reshape(len(words), 64)
            w, lane = np.nonzero(ok)
            hit = words[w] * 64 + lane
            found.append((rows[hit], rows[hit + shift]))
        # only buckets longer than this shift go on
        longer = np.zeros(int(same[-1]) + 1, dtype=bool)
        longer[same[:-shift][met]] = True
        keep = longer[same]
        if 2 * np.count_nonzero(keep) <= len(keep):
            values, same, rows = values[keep], same[keep], rows[keep]
            planes = _planes(values)
        shift += 1
    if not found:
        return rows[:0], rows[:0]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _above(counter: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter exceeds ``radius``, by a bitwise comparison from the highest digit."""
    more = np.zeros(counter.shape[1], dtype=np.uint64)
    equal = ~more
    for digit in range(len(counter) - 1, -1, -1):
        if radius >> digit & 1:
            equal &= counter[digit]
        else:
            more |= equal & counter[digit]
            equal &= ~counter[digit]
    return more


def links(distinct: DataFrame, radius: int = 2, crowded: int = CROWDED) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints ``fp`` with 1 to ``radius`` differing bits.

    A bucket of more than ``crowded`` fingerprints is dealt out again: its rows
    agree in three groups, so of the other bits cut in radius + 1 parts one
    part agrees as well. A fingerprint has few possible neighbours in a bucket,
    so links stay in proportion to the rows.
    """
    if not radius:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).filter(F.lit(False))
    groups = _widths(radius + 3)
    tables = []
    for chosen in combinations(range(len(groups)), 3):
        fixed = [groups[i] for i in chosen]
        rest = [(at + k, 1) for i, (at, n) in enumerate(groups) if i not in chosen for k in range(n)]
        parts = [rest[i::radius + 1] for i in range(radius + 1)]
        tables.append((_mask(fixed), [_mask([*fixed, *p]) for p in parts]))

    def key(masks: list[int]) -> Column:
        return F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])

    met = distinct.select("fp", F.explode(key([m for m, _ in tables])).alias("at")).select("fp", "at.t", "at.k")
    sizes = met.groupBy("t", "k").count()
    full = materialize(sizes.filter(F.col("count") > crowded).select("t", "k"), "crowded")
    if full.isEmpty():
        dealt = met.select("fp", F.col("t").cast("int").alias("t"), "k")
    else:
        finer = [(len(tables) + i * (radius + 1) + j, i, m) for i, (_, parts) in enumerate(tables) for j, m in enumerate(parts)]
        again = met.join(full, ["t", "k"], "left_semi").select("fp", F.col("t").alias("of"))
        fine = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, i, m in finer])
        again = again.select("fp", F.explode(F.filter(fine, lambda x: x["i"] == F.col("of"))).alias("at"))
        dealt = (met.join(full, ["t", "k"], "left_anti").select("fp", F.col("t").cast("int").alias("t"), "k")
                 .unionByName(again.select("fp", F.col("at.t").cast("int").alias("t"), F.col("at.k").alias("k"))))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), dtype=np.int64)
        for batch in batches:
            new = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)])
            held = np.concatenate((held, new), axis=1)
            change = np.flatnonzero(np.any(held[:2, 1:] != held[:2, :-1], axis=0))
            if len(change):  # the last bucket may go on in the next batch
                yield result(held[:, :change[-1] + 1])
                held = held[:, change[-1] + 1:]
        yield result(held)

    def result(rows: np.ndarray) -> pa.RecordBatch:
        bucket = np.cumsum(np.any(np.diff(rows[:2], axis=1, prepend=rows[:2, :1]) != 0, axis=0)) if rows.shape[1] else rows[0]
        i, j = close_pairs(rows[2].view(np.uint64), bucket, radius)
        ends = np.stack((rows[2][i], rows[2][j]))
        return pa.RecordBatch.from_arrays([pa.array(ends.min(axis=0)), pa.array(ends.max(axis=0))], ["a", "b"])

    dealt = dealt.select("t", "k", "fp").repartition("t", "k").sortWithinPartitions("t", "k")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id) for every row of ``docs``.

    Rows link if their fingerprints differ in at most ``radius`` bits;
    component_id is the smallest key reachable over links. Texts with one
    fingerprint are one class, so copies cost a row each, never pairs. A null
    key is no smallest key: a component of null keys alone has none. An empty
    table gives an empty result; other columns of ``docs`` are not read.
    """
    found = materialize(fingerprints(docs, shingle, key, text), "fingerprints")
    classes = materialize(found.groupBy("fp").agg(F.min(f"`{key}`").alias("least")), "classes")
    roots = components(links(classes.select("fp"), radius))
    tied = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    tied = materialize(tied, "tied")
    smallest = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(tied.join(smallest, "root").select("fp", "component_id"), "named")
    return found.join(named, "fp").select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
