"""Exact nearest neighbours by inner product: int8 tiles with error bounds, survivors recomputed.

Vectors are packed into blocks, each vector also as int8 codes with a scale.
Every block of queries meets every block of candidates once. In such a tile the
product of the codes gives all inner products at once, each known to within a
bound made of the two quantisation errors. What cannot be among the k best
falls out; the rest is recomputed in double precision on the original vectors
and merged into heaps of k. Nothing is lost to quantisation.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from tributary.llm.common import materialize

QUERIES, CANDIDATES = 1024, 4096  # vectors of a block
LEAST, MOST = 1e-280, 1e280  # products of two vectors' largest components between which double precision follows the bounds
SLACK = 1e-9  # rounding of the bounds themselves, relative to the lengths of the two vectors


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): vectors of doubles that are not null, not zero, and all of whose components are finite numbers."""
    v = F.col("v")
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return rows.filter(F.col("id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0))


def blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """Blocks of up to ``rows`` vectors of one length: ids, vectors, codes (int8) with scales, lengths and errors."""
    fields = "dim int, ids binary, vectors binary, codes binary, scales binary, lengths binary, errors binary"

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[int, list[float]]]] = {}
        for batch in batches:
            for i, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist()):
                some = waiting.setdefault(len(v), [])
                some.append((i, v))
                if len(some) == rows:
                    yield block(waiting.pop(len(v)))
        for some in waiting.values():
            yield block(some)

    def block(some: list[tuple[int, list[float]]]) -> pa.RecordBatch:
        x = np.array([v for _, v in some], dtype=np.float64)
        top = np.abs(x).max(axis=1)
        # a vector of tiny or huge components is scaled to 1 first, so that no length overflows
        unit = x / top[:, None]
        codes = np.rint(unit * 127).astype(np.int8)
        error = np.sqrt(((unit - codes / 127.0) ** 2).sum(axis=1)) * (1 + 1e-12)
        length = np.sqrt((unit ** 2).sum(axis=1)) * (1 + 1e-12)
        parts = [np.array([i for i, _ in some], dtype=np.int64), x, codes, top, length, error]
        return pa.RecordBatch.from_arrays([pa.array([x.shape[1]], pa.int32()), *(pa.array([p.tobytes()], pa.binary()) for p in parts)],
                                          ["dim", "ids", "vectors", "codes", "scales", "lengths", "errors"])

    return vectors.mapInArrow(pack, fields)


class Block:
    def __init__(self, dim: int, row: dict, side: str):
        def of(name: str, kind: type) -> np.ndarray:
            return np.frombuffer(row[side + name], dtype=kind)
        self.ids, self.scales, self.lengths, self.errors = of("ids", np.int64), of("scales", float), of("lengths", float), of("errors", float)
        self.x = of("vectors", float).reshape(-1, dim)
        self.codes = of("codes", np.int8).reshape(-1, dim)


def products(q: Block, c: Block) -> tuple[np.ndarray, np.ndarray]:
    """(approximate inner products of the scaled vectors, how far each may be off).

    |q.c - q'.c'| <= |q - q'||c| + |q'||c - c'|, and |q'| <= |q| + |q - q'|.
    Sums of up to 1000 products of codes are whole numbers that single
    precision holds exactly; longer vectors are multiplied in double precision.
    """
    kind = np.float32 if q.codes.shape[1] <= 1000 else np.float64
    about = (q.codes.astype(kind) @ c.codes.astype(kind).T).astype(np.float64) / (127.0 * 127.0)
    off = np.outer(q.errors, c.lengths) + np.outer(q.lengths + q.errors, c.errors) + SLACK * np.outer(q.lengths, c.lengths)
    return about, off


def survivors(q: Block, c: Block, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, candidate number, exact score) of all pairs that may be among a query's k best; floor: scores already beaten k times."""
    about, off = products(q, c)
    with np.errstate(over="ignore", under="ignore"):
        scale = np.outer(q.scales, c.scales)
        about *= scale
        off *= scale
    # where double precision may overflow or vanish, its scores do not follow the bounds: such pairs bound nothing and all survive
    wild = ~((scale > LEAST) & (scale < MOST))
    about[wild], off[wild] = 0, np.inf
    low = np.where(q.ids[:, None] == c.ids[None, :], -np.inf, about - off)  # a vector is no candidate of its own
    if low.shape[1] >= k:
        floor = np.maximum(floor, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
    i, j = np.nonzero((about + off >= floor[:, None]) & (q.ids[:, None] != c.ids[None, :]))
    exact = np.empty(len(i))
    for at in range(0, len(i), 1 << 15):
        s = slice(at, at + (1 << 15))
        with np.errstate(over="ignore", under="ignore", invalid="ignore"):
            exact[s] = np.cumsum(q.x[i[s]] * c.x[j[s]], axis=1)[:, -1]  # added in the order of the components
    return i, j, exact


def search(queries: DataFrame, candidates: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, key, score): for each query the k candidates of largest inner product, ties to the smaller key.

    A candidate with the query's own key is none. Vectors that are null, zero,
    or hold nulls or values that are not finite take no part on either side,
    nor do rows without key; only vectors of one length are compared; with
    fewer than k candidates all are returned. Of equal vectors only the k + 1
    with the smallest keys can be among the best, so of a large group of copies
    no more are compared; that is exact. Repeated keys with equal vectors count
    once. Scores are those of double precision: where components are so large
    that it overflows they are infinite, or not a number, which ranks first.
    """
    found = usable(candidates, key, vector).distinct()
    same = Window.partitionBy("v").orderBy("id")
    kept = found.withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1).select("id", "v")
    c = materialize(blocks(kept, CANDIDATES), "candidates")
    q = materialize(blocks(usable(queries, key, vector).distinct().coalesce(max(1, _tasks(candidates) // 4)), QUERIES), "queries")
    groups = max(1, min(4 * _tasks(candidates), c.count()))
    # each block of candidates is in one group; each block of queries goes to all groups
    names = ["ids", "vectors", "codes", "scales", "lengths", "errors"]
    c = c.select("dim", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int").alias("g"), *[F.col(n).alias("c_" + n) for n in names])
    q = q.select("dim", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), *[F.col(n).alias("q_" + n) for n in names])
    tiles = q.join(c.hint("shuffle_hash"), ["g", "dim"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[bool, float, int]]] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                row = {n: batch.column(n)[at].as_py() for n in batch.schema.names}
                tile(Block(row["dim"], row, "q_"), Block(row["dim"], row, "c_"), best)
                if len(best) > 1 << 16:
                    yield out(best)
                    best = {}
        yield out(best)

    def tile(q: Block, c: Block, best: dict[int, list[tuple[bool, float, int]]]) -> None:
        floor = np.array([best[i][0][1] if len(best.get(i, ())) == k else -np.inf for i in q.ids.tolist()])
        i, j, exact = survivors(q, c, k, floor)
        for a, other, score in zip(q.ids[i].tolist(), (-c.ids[j]).tolist(), exact.tolist()):
            heap = best.setdefault(a, [])
            found = (True, np.inf, other) if score != score else (False, score, other)
            if len(heap) < k:
                heapq.heappush(heap, found)
            elif found > heap[0]:
                heapq.heapreplace(heap, found)

    def out(best: dict[int, list[tuple[bool, float, int]]]) -> pa.RecordBatch:
        rows = [(q, -other, np.nan if none else score) for q, heap in best.items() for none, score, other in heap]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))],
                                          ["query_id", "id", "score"])

    near = tiles.mapInArrow(run, "query_id long, id long, score double").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

