"""Language of a text by a convolutional network over its bytes.

Filters of several widths slide over windows of a fixed number of bytes; each
reports its largest response in the window, and a softmax over these responses
gives the languages' probabilities. A text is all its windows, weighted by
their bytes. A filter over one-hot bytes is a sum of table rows, one a byte, so
learning and applying are look-ups; nothing is multiplied out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tributary.llm.common import text_bytes, text_chunks

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 24
#: Windows follow each other so that every run of the widest filter's length lies in one.
STRIDE = WINDOW - max(WIDTHS) + 1
#: Labelled rows of each language that are learned from, by the hash of their id: so many on average.
FIT_ROWS = 1500
#: Windows taken of such a text: spread over it, and one cut short, since texts can be short.
FIT_WINDOWS = 4
#: So many languages are learned at most, those with the most rows.
LANGUAGES = 256
UNKNOWN = "und"
_BLOCK = 64

#: A-Z in lower case. The byte 0 is what windows are filled up with; it adds nothing to any filter.
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[ord("A"):ord("Z") + 1] += 32


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, bytes of each that are text, first window of each text) of all texts; an empty text has an empty window."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    data = FOLDED[np.frombuffer(b"".join([*texts, bytes(WINDOW)]), dtype=np.uint8)]
    many = np.maximum(1, -(-(sizes - (WINDOW - STRIDE)) // STRIDE))
    first = np.concatenate(([0], np.cumsum(many)))
    of = np.repeat(np.arange(len(texts)), many)
    begin = (np.arange(first[-1]) - first[of]) * STRIDE
    filled = np.minimum(WINDOW, sizes[of] - begin)
    found = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[(np.cumsum(sizes) - sizes)[of] + begin]
    found[np.arange(WINDOW) >= filled[:, None]] = 0
    return found, filled, first[:-1]


def learning_windows(text: bytes, draw: int) -> list[bytes]:
    """FIT_WINDOWS windows at even distances from a drawn place on, the last one cut to a drawn length."""
    spare = max(0, len(text) - WINDOW)
    at = [(draw + i * (spare + 1) // FIT_WINDOWS) % (spare + 1) for i in range(FIT_WINDOWS)]
    cut = [text[a:a + WINDOW] for a in at]
    cut[-1] = cut[-1][:8 + draw % 56]
    return list(dict.fromkeys(cut))


class Network:
    """Tables of the filters, (width, 256, FILTERS) each, and the output layer."""

    def __init__(self, languages: list[str]):
        draw = np.random.default_rng(11)
        self.languages = languages
        self.tables = [draw.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        for t in self.tables:
            t[:, 0] = 0
        pooled = len(WIDTHS) * FILTERS
        self.bias = np.zeros(pooled, dtype=np.float32)
        self.out = draw.normal(0, 0.1, (pooled, len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), dtype=np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [*self.tables, self.bias, self.out, self.out_bias]

    def dump(self) -> bytes:
        return np.concatenate([p.ravel() for p in self.parameters()]).tobytes()

    def load(self, packed: bytes) -> None:
        flat, at = np.frombuffer(packed, dtype=np.float32), 0
        for p in self.parameters():
            p[...] = flat[at:at + p.size].reshape(p.shape)
            at += p.size

    def responses(self, x: np.ndarray, pairs: list[list[np.ndarray]] | None = None) -> Iterator[np.ndarray]:
        """Of each width the filters' responses at every place of every window: (windows, places, FILTERS)."""
        two = x[:, :-1].astype(np.intp) * 256 + x[:, 1:] if pairs else None
        for number, (width, table) in enumerate(zip(WIDTHS, self.tables)):
            places = WINDOW - width + 1
            if pairs is None:
                parts = [(table[j], x[:, j:j + places]) for j in range(width)]
            else:  # two bytes at a time
                parts = [(rows, two[:, 2 * j:2 * j + places]) for j, rows in enumerate(pairs[number])]
                if width % 2:
                    parts.append((table[-1], x[:, width - 1:width - 1 + places]))
            found = np.take(*parts[0], axis=0, mode="clip")
            for rows, at in parts[1:]:
                found += np.take(rows, at, axis=0, mode="clip")
            yield found

    def pair_tables(self) -> list[list[np.ndarray]]:
        return [[(t[j][:, None] + t[j + 1][None]).reshape(65536, FILTERS) for j in range(0, len(t) - 1, 2)] for t in self.tables]

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        score = np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias
        score = np.exp(score - score.max(axis=1, keepdims=True))
        return score / score.sum(axis=1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 12, batch: int = 128, rate: float = 0.01) -> None:
        """Adam on the log loss over shuffled batches; the step gets shorter towards the end."""
        draw = np.random.default_rng(5)
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.parameters()]
        steps = rounds * -(-len(x) // batch)
        step = 0
        for _ in range(rounds):
            order = draw.permutation(len(x))
            for at in range(0, len(x), batch):
                step += 1
                chosen = order[at:at + batch]
                for p, slope, (mean, square) in zip(self.parameters(), self.slopes(x[chosen], y[chosen]), moments):
                    mean += 0.1 * (slope - mean)
                    square += 0.001 * (slope ** 2 - square)
                    p -= rate * (1 - (step - 1) / steps) * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)

    def slopes(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """The mean log loss's derivatives; a filter's go to the bytes of its largest response."""
        best = [(r.argmax(axis=1), r) for r in self.responses(x)]
        pooled = np.concatenate([np.take_along_axis(r, a[:, None], axis=1)[:, 0] for a, r in best], axis=1)
        hidden = np.maximum(pooled + self.bias, 0)
        error = self.probabilities(pooled)
        error[np.arange(len(y)), y] -= 1
        error /= len(y)
        back = (error @ self.out.T) * (hidden > 0)
        of_tables = []
        for number, ((at, _), table) in enumerate(zip(best, self.tables)):
            own = back[:, number * FILTERS:(number + 1) * FILTERS]
            slope = np.zeros_like(table)
            for j in range(len(table)):
                place = np.take_along_axis(x, at + j, axis=1).astype(np.int64) * FILTERS + np.arange(FILTERS)
                slope[j] = np.bincount(place.ravel(), own.ravel(), 256 * FILTERS).reshape(256, FILTERS)
            slope[:, 0] = 0
            of_tables.append(slope)
        return [*of_tables, back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]

    def scorer(self):
        """A function (texts -> probabilities of the languages) for one task."""
        pairs = self.pair_tables()

        def score(texts: list[bytes]) -> np.ndarray:
            x, filled, first = windows(texts)
            found = np.empty((len(x), len(self.languages)))
            for at in range(0, len(x), _BLOCK):
                pooled = np.concatenate([r.max(axis=1) for r in self.responses(x[at:at + _BLOCK], pairs)], axis=1)
                found[at:at + _BLOCK] = self.probabilities(pooled)
            weight = np.maximum(filled, 1).astype(float)
            return np.add.reduceat(found * weight[:, None], first) / np.add.reduceat(weight, first)[:, None]
        return score


def lettered(text: Column) -> Column:
    return F.coalesce(text.rlike("\\p{L}"), F.lit(False))


def fit(docs: DataFrame, learn: Column, label: str = "lang", key: str = "doc_id", text: str = "text", per_language: int = FIT_ROWS) -> Network:
    """Learn from rows that ``learn`` holds for and whose label is not null.

    Each language gives the same number of rows, on average, those of the smallest hashes of their key, and at most FIT_WINDOWS
    windows of each: what the one fitting task reads is bounded by languages x rows x windows, whatever the table holds.
    Rows that share a key and a label count once; texts without letters teach nothing.
    """
    rows = docs.filter(F.col(f"`{label}`").isNotNull() & F.col(f"`{key}`").isNotNull() & learn)
    known = rows.groupBy(F.col(f"`{label}`").cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(LANGUAGES).collect()
    network = Network(sorted(r["label"] for r in known))
    if len(known) < 2:  # nothing to tell apart
        return network
    number = F.create_map(*[F.lit(v) for i, name in enumerate(network.languages) for v in (name, i)])
    share = F.create_map(*[F.lit(v) for r in known for v in (r["label"], per_language / r["n"])])
    own = F.col(f"`{label}`").cast("string")
    place = F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(1 << 40))
    sample = rows.filter((place / (1 << 40) < share[own]) & lettered(F.col(f"`{text}`")))
    sample = text_bytes(sample.select(place.alias("_place"), number[own].alias("_label"), F.col(f"`{text}`").alias("_whole")), "_place", "_label", text="_whole")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches):
            found = [(p, v, n, w) for p, v, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts) for n, w in enumerate(learning_windows(t, p))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["place", "label", "number", "part"])

    def learned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, labels = [], []
        for batch in batches:
            parts += batch.column("part").to_pylist()
            labels += batch.column("label").to_pylist()
        if parts:
            network.fit(windows(parts)[0], np.array(labels))
            yield pa.RecordBatch.from_arrays([pa.array([network.dump()], pa.binary())], ["packed"])

    cuts = sample.mapInArrow(cut, "place long, label int, number int, part binary").groupBy("place", "label", "number").agg(F.min("part").alias("part"))
    made = cuts.repartition(1).sortWithinPartitions("place", "label", "number").mapInArrow(learned, "packed binary").collect()
    if made:
        network.load(bytes(made[0]["packed"]))
    return network


def predict(docs: DataFrame, network: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) for every row of ``docs`` from its whole text.

    The score is the language's share of probability, the mean over all windows; of equal ones the first name counts.
    Null texts and those without a letter, and all texts if no language was learned, are UNKNOWN with score 0.
    Repeated rows and extra columns of any name change nothing.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = network.scorer()
        for part, texts in text_chunks(batches):
            p = score(texts) if network.languages else np.zeros((len(texts), 1))
            best = p.argmax(axis=1)
            usable = part.column("_usable").to_numpy(zero_copy_only=False) & bool(network.languages)
            names = [network.languages[b] if u else UNKNOWN for b, u in zip(best, usable)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(np.where(usable, np.minimum(p[np.arange(len(p)), best], 1), 0.0))],
                                             ["_key", "lang_pred", "score"])

    rows = docs.select(F.col(f"`{key}`").alias("_key"), lettered(F.col(f"`{text}`")).alias("_usable"), F.col(f"`{text}`").alias("_whole"))
    rows = text_bytes(rows, "_key", "_usable", text="_whole")
    return rows.mapInArrow(run, f"_key {rows.schema['_key'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("_key", key)
