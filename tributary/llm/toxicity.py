"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its words and the first letters of its words, hashed into
a fixed number of bins; what counts is whether a bin occurs. The machine adds
to a weight for every bin one for every pair of bins, the product of two short
vectors, so that what is only toxic in company is learned as well.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tributary.llm import words
from tributary.llm.common import text_bytes, text_chunks
from tributary.llm.quality import sampled

BIN_BITS = 22
PREFIX = 4
#: At most so many labelled rows of each class are read for fitting, those with the smallest hash of their id.
FIT_ROWS = 6000
#: Bins that tell the classes apart best take part; the rest have weight 0.
BINS = 4096
FACTORS = 8


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bin), each pair once: hashed words and, for longer words, hashed word beginnings."""
    found = words.split(texts, words.BY_PUNCTUATION, prefix=PREFIX)
    of = found.texts()
    long = found.lengths > PREFIX
    bins = np.concatenate((found.hashes, found.prefixes[long])) >> np.uint64(64 - BIN_BITS)
    both = np.unique(np.concatenate((of, of[long])).astype(np.uint64) << np.uint64(BIN_BITS) | bins)
    return (both >> np.uint64(BIN_BITS)).astype(np.int64), (both & np.uint64((1 << BIN_BITS) - 1)).astype(np.int64)


class Machine:
    """bias + sum of weights + sum over pairs of <v_i, v_j>, for texts as sets of bins."""

    def __init__(self, bins: np.ndarray, share: float):
        self.bins, self.bias = bins, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
        self.weights = np.zeros(len(bins))
        self.vectors = np.random.default_rng(7).normal(0, 0.01, (len(bins), FACTORS))

    def table(self) -> np.ndarray:
        """Bin -> place among the chosen bins, -1 for the others."""
        at = np.full(1 << BIN_BITS, -1, dtype=np.int32)
        at[self.bins] = np.arange(len(self.bins))
        return at

    def margins(self, n: int, text: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums = np.zeros((n, FACTORS))
        own = np.zeros(n)
        np.add.at(sums, text, self.vectors[place])
        np.add.at(own, text, self.weights[place] - (self.vectors[place] ** 2).sum(axis=1) / 2)
        return self.bias + own + (sums ** 2).sum(axis=1) / 2, sums

    def fit(self, n: int, text: np.ndarray, place: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 300, rate: float = 0.1,
            ridge: float = 2e-5) -> None:
        """Full-batch Adam on the weighted logistic loss."""
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.weights, self.vectors, np.zeros(1))]
        bias = np.array([self.bias])
        for step in range(1, rounds + 1):
            margin, sums = self.margins(n, text, place)
            slope = weight * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / weight.sum()
            by_term = slope[text]
            of_weights = np.bincount(place, by_term, len(self.weights)) + ridge * self.weights
            of_vectors = np.zeros_like(self.vectors)
            np.add.at(of_vectors, place, by_term[:, None] * (sums[text] - self.vectors[place]))
            of_vectors += ridge * self.vectors
            for at, slopes, (mean, square) in zip((self.weights, self.vectors, bias), (of_weights, of_vectors, np.array([slope.sum()])), state):
                mean += 0.1 * (slopes - mean)
                square += 0.001 * (slopes ** 2 - square)
                at -= rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8) * (0.3 if at.ndim == 2 else 1)
            self.bias = float(bias[0])


def choose(y: np.ndarray, text: np.ndarray, bins: np.ndarray, most: int = BINS) -> np.ndarray:
    """The bins whose presence tells the classes apart best, by their likelihood ratio (G²), in ascending order."""
    seen = np.stack([np.bincount(bins[y[text] == v], minlength=1 << BIN_BITS) for v in (0, 1)]).astype(float)
    size = np.array([(y == 0).sum(), (y == 1).sum()], dtype=float)[:, None]
    shares = seen.sum(axis=0) / size.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = sum(np.where(k > 0, k * np.log(k / (n * p)), 0) for n, k, p in
                   [(size, seen, shares), (size, size - seen, 1 - shares)])
    score = np.asarray(gain).sum(axis=0)
    score[seen.sum(axis=0) < 3] = 0
    best = np.argpartition(-score, min(most, len(score) - 1))[:most]
    return np.sort(best[score[best] > 4])


def learn(rows: list[tuple[bytes, int]], share: float) -> Machine:
    """Fit on sampled (text, label); rows are weighted so that label 1 has its share of all labelled rows."""
    y = np.array([v for _, v in rows], dtype=float)
    if len(set(y.tolist())) < 2:
        return Machine(np.zeros(0, dtype=np.int64), share)
    parts, at = [], 0
    while at < len(rows):  # some texts at a time
        stop, size = at, 0
        while stop < len(rows) and (stop == at or size < 1 << 20):
            size += len(rows[stop][0])
            stop += 1
        text, bins = terms([t for t, _ in rows[at:stop]])
        parts.append((text + at, bins))
        at = stop
    text, bins = (np.concatenate(p) for p in zip(*parts))
    machine = Machine(choose(y, text, bins), share)
    place = machine.table()[bins]
    text, place = text[place >= 0], place[place >= 0]
    machine.fit(len(y), text, place, y, np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())))
    return machine


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, label: str = "toxic", per_class: int = FIT_ROWS,
        key: str = "doc_id", text: str = "text") -> Machine:
    """Fit on a bounded sample (see ``quality.sampled``); a task makes the machine, whose size is fixed."""
    sample, share = sampled(docs, labels, label, learn_from, per_class, key)
    rows = text_bytes(docs, F.col(f"`{key}`").alias(key), text=text).join(F.broadcast(sample), key)  # 2 * per_class ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[bytes, int]] = []
        for batch in batches:
            found += zip(batch.column("_text").to_pylist(), batch.column("label").to_pylist())
        if found:
            m = learn(found, share)
            yield pa.RecordBatch.from_pydict({
                "bias": pa.array([m.bias]), "bins": pa.array([m.bins.tolist()], pa.list_(pa.int64())),
                "weights": pa.array([m.weights.tolist()], pa.list_(pa.float64())), "vectors": pa.array([m.vectors.ravel().tolist()], pa.list_(pa.float64()))})

    one = rows.groupBy(key, "label").agg(F.min("_text").alias("_text")).repartition(1).sortWithinPartitions(F.xxhash64(key), key)
    made = one.mapInArrow(run, "bias double, bins array<long>, weights array<double>, vectors array<double>").collect()
    machine = Machine(np.zeros(0, dtype=np.int64), share)
    if made:
        machine = Machine(np.array(made[0]["bins"], dtype=np.int64), share)
        machine.bias, machine.weights = made[0]["bias"], np.array(made[0]["weights"])
        machine.vectors = np.array(made[0]["vectors"]).reshape(-1, FACTORS)
    return machine


def scores(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) for every row of ``docs`` from its whole text; a null or empty text has no terms and gets the bias alone."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = machine.table()
        for part, texts in text_chunks(batches):
            text_no, bins = terms(texts)
            place = table[bins]
            margin, _ = machine.margins(len(texts), text_no[place >= 0], place[place >= 0])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(margin, -30, 30))))], ["_key", "score"])

    rows = text_bytes(docs, F.col(f"`{key}`").alias("_key"), text=text)
    return rows.mapInArrow(run, f"_key {rows.schema['_key'].dataType.simpleString()}, score double").withColumnRenamed("_key", key)
