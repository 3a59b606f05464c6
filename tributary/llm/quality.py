"""Quality classifier by compression: two zstandard dictionaries, one of good and one of bad labelled text.

A text is cut in blocks, all of which are compressed with either dictionary
and with none. The difference of the two sizes, normalised by their sum, tells
which kind of text it is more like; a logistic curve fitted on other labelled
texts turns it, with the plain rate of compression, into a probability.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tributary.llm.common import text_bytes, text_chunks

#: At most so many labelled rows of each class are read for fitting, those with the smallest hash of their id:
#: half of them make the dictionaries, half the curve. All other work covers every row.
FIT_ROWS = 3000
BLOCK = 4096
#: Bytes of text of each class that a dictionary is made of, whole blocks dealt evenly over the sampled texts.
DICTIONARY_TEXT = 8 << 20
DICTIONARY_BYTES = 112 << 10
LEVEL = 3


def blocks(text: bytes) -> list[bytes]:
    return [text[i:i + BLOCK] for i in range(0, len(text), BLOCK)]


class Sizes:
    """Compressed sizes of whole texts: (plain, with the bad dictionary, with the good one)."""

    def __init__(self, bad: bytes, good: bytes):
        made = [zstandard.ZstdCompressionDict(d) for d in (bad, good)]
        for d in made:
            d.precompute_compress(level=LEVEL)
        options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.compress = [zstandard.ZstdCompressor(**options).compress, *(zstandard.ZstdCompressor(dict_data=d, **options).compress for d in made)]

    def of(self, text: bytes) -> list[int]:
        cut = blocks(text)
        return [sum(len(compress(b)) for b in cut) for compress in self.compress]


def features(sizes: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """(1, difference over sum, how far the plain rate is from none), all 0 but the first for an empty text."""
    plain, bad, good = sizes.T.astype(float)
    difference = np.where(raw > 0, (bad - good) / np.maximum(bad + good, 1), 0)
    rate = np.where(raw > 0, np.log(np.maximum(plain, 1) / np.maximum(raw, 1)), 0)
    # short texts hardly compress: the rate counts beside the length, and bends
    length = np.log1p(raw)
    return np.stack([np.ones(len(raw)), difference * 10, rate, np.minimum(rate + 1.2, 0) * 3, length / 10, rate * length / 10], axis=1)


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, ridge: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step / max(1, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def make_dictionary(texts: list[bytes]) -> bytes:
    """A zstandard dictionary of blocks taken from all texts in turn; plain text where there is too little to train on."""
    cut = [blocks(t) for t in texts]
    turn = [c[i] for i in range(max(map(len, cut), default=0)) for c in cut if i < len(c)]
    ends = np.cumsum([len(b) for b in turn])
    turn = turn[:int(np.searchsorted(ends, DICTIONARY_TEXT)) + 1]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, turn, k=200, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(turn)[-DICTIONARY_BYTES:] or b"\n" * 8


class Model:
    """Two dictionaries, the curve, and the share of good rows, which an empty text gets."""

    def __init__(self, rows: list[tuple[bytes, int]], good_share: float):
        """``rows``: sampled (text, label) in a fixed order; every second row of a class fits the curve."""
        sides = {v: [t for t, label in rows if label == v] for v in (0, 1)}
        self.good_share = good_share
        self.weights = np.zeros(0)
        self.dictionaries = b"", b""
        if min(map(len, sides.values())) < 2:  # nothing to tell apart
            return
        self.dictionaries = make_dictionary(sides[0][::2]), make_dictionary(sides[1][::2])
        rest = [(t, v) for v in (0, 1) for t in sides[v][1::2] if t]
        if len({v for _, v in rest}) < 2:
            return
        sizes = Sizes(*self.dictionaries)
        y = np.array([v for _, v in rest])
        share = np.where(y == 1, good_share, 1 - good_share) / np.where(y == 1, y.mean(), 1 - y.mean())
        x = features(np.array([sizes.of(t) for t, _ in rest]), np.array([len(t) for t, _ in rest]))
        self.weights = fit_curve(x, y, share)

    def scorer(self):
        """A function (texts -> scores) for one task."""
        if not len(self.weights):
            return lambda texts: np.full(len(texts), self.good_share)
        sizes = Sizes(*self.dictionaries)

        def score(texts: list[bytes]) -> np.ndarray:
            raw = np.array([len(t) for t in texts])
            x = features(np.array([sizes.of(t) for t in texts]), raw)
            p = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
            return np.where(raw > 0, p, self.good_share)
        return score


def sampled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, key: str = "doc_id") -> tuple[DataFrame, float]:
    """(key, label) of at most ``per_class`` labelled rows of each class, and the share of label 1 among all rows learned from.

    Rows are those ``learn`` holds for; of a key with several labels the largest
    counts, null keys and labels other than 0 and 1 teach nothing. The sample is
    what has the smallest hash of the key: the same rows in every run.
    """
    known = (labels.select(F.col(f"`{key}`").alias(key), F.col(f"`{label}`").cast("int").alias("label"))
             .filter(F.col(key).isNotNull() & F.col("label").isin(0, 1) & learn).groupBy(key).agg(F.max("label").alias("label")))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    sides = [known.filter(F.col("label") == v).orderBy(F.xxhash64(key), key).limit(per_class) for v in (0, 1)]
    return sides[0].unionByName(sides[1]), counts.get(1, 0) / total if total else 0.5


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", per_class: int = FIT_ROWS,
        key: str = "doc_id", text: str = "text") -> Model:
    """Fit on a bounded sample (see ``sampled``); a task makes the model, so no text comes to the driver."""
    sample, share = sampled(docs, labels, label, learn, per_class, key)
    rows = text_bytes(docs, F.col(f"`{key}`").alias(key), text=text).join(F.broadcast(sample), key)  # 2 * per_class ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[bytes, int]] = []
        for batch in batches:
            found += zip(batch.column("_text").to_pylist(), batch.column("label").to_pylist())
        model = Model(found, share)
        yield pa.RecordBatch.from_pydict({"bad": pa.array([model.dictionaries[0]], pa.binary()), "good": pa.array([model.dictionaries[1]], pa.binary()),
                                          "weights": pa.array([model.weights.tolist()], pa.list_(pa.float64()))})

    one = rows.groupBy(key, "label").agg(F.min("_text").alias("_text")).repartition(1).sortWithinPartitions(F.xxhash64(key), key)
    made = one.mapInArrow(run, "bad binary, good binary, weights array<double>").collect()
    model = Model([], share)
    if made:
        model.dictionaries, model.weights = (bytes(made[0]["bad"]), bytes(made[0]["good"])), np.array(made[0]["weights"])
    return model


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(row, score): every row of ``docs``, all its columns as one, with the score of its whole text.

    Null and empty texts get the share of good labels. Columns of any name are kept as they are.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for part, texts in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score(texts))], schema=pa.schema([part.schema.field(0), ("score", pa.float64())]))

    rows = text_bytes(docs.select(F.struct("*").alias("row"), F.col(f"`{text}`").alias("_whole")), "row", text="_whole")
    schema = StructType([rows.schema["row"], StructField("score", DoubleType())])
    return rows.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model, least: float = 0.3, text: str = "text") -> DataFrame:
    """Rows of ``docs`` that score ``least`` or more."""
    return scored(docs, model, text).filter(F.col("score") >= least).select("row.*")
