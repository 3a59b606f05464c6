"""The Merkle manifest against a plain tree."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tributary.llm import merkle

ROWS = "doc_id long, text string, lang string, source string, n_chars long, proof string, `group` string, `hash` string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r):
    spell = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(*(spell(r[k]) for k in ("doc_id", "source", "lang", "n_chars", "text")))


def climb(nodes):
    """The root, and of each node its siblings from the bottom up."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            proofs[i].append((nodes[p // 3 * 3:p], nodes[p + 1:p // 3 * 3 + 3]))
        nodes, at = [h(*nodes[i:i + 3]) for i in range(0, len(nodes), 3)], [p // 3 for p in at]
    return nodes[0], proofs


def expected(rows, shown):
    groups = {}
    for r in rows:
        groups.setdefault((r["source"] is not None, (r["source"] or "").encode()), []).append(r)
    names = sorted(groups)
    subs, paths = [], []
    for g in names:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        root, proofs = climb([leaf(r) for r in groups[g]])
        subs.append(root)
        paths.append(proofs)
    root, above = climb(subs)
    found = []
    for i, g in enumerate(names):
        for r, path in zip(groups[g], paths[i]):
            path = path + above[i]
            node = leaf(shown(r))
            for left, right in path:
                node = h(*left, node, *right)
            found.append((r["doc_id"], leaf(r), subs[i], root, h(*(x for left, right in path for x in left + right)), node, node == root))
    return sorted(found, key=repr)


def make(n, seed=0):
    import random
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["hot"] * 6 + ["a", "é", "Z", "", None, "😀", f"s{i}"])
        rows.append(dict(doc_id=rng.choice([i, i, i, None, 7]), text=rng.choice(["x\ny", "", None, "plain", "é\n\n", "long " * 50]), lang=rng.choice(["en", None]),
                         source=source, n_chars=rng.choice([0, -5, None, 12])))
    return rows + rows[:3]


@pytest.mark.parametrize("n, height", [(0, 1), (1, 1), (2, 2), (90, 1), (300, 2), (120, 6)])
def test_manifest_is_the_plain_tree(spark, monkeypatch, n, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)  # small blocks: several tiers
    rows = make(n)[:n] if n < 3 else make(n)
    docs = spark.createDataFrame([(*(r[k] for k in ("doc_id", "text", "lang", "source", "n_chars")), "p", "g", "h") for r in rows], ROWS)
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    made = merkle.manifest(docs, {"text": F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))})
    got = made.select("doc_id", "leaf", "subroot", "root", merkle.digest(merkle.spelled(F.col("proof"))), merkle.fold(F.col("presented"), F.col("proof")).alias("folded"))

    def shown(r):
        if r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 2 or r["text"] is None:
            return r
        return {**r, "text": r["text"].replace("\n", "")}
    assert sorted(((*r, r.folded == r.root) for r in got.collect()), key=repr) == (expected(rows, shown) if rows else [])


def test_every_change_is_seen_and_order_of_rows_is_not(spark):
    rows = [(i, f"t{i}", "en", f"s{i % 3}", i) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    root = {r.root for r in merkle.manifest(docs).collect()}
    assert len(root) == 1 and {r.root for r in merkle.manifest(docs.orderBy(F.desc("text")).repartition(5)).collect()} == root
    for column, value in (("text", F.lit("t")), ("lang", F.lit(None).cast("string")), ("n_chars", F.col("n_chars") + 1)):
        got = merkle.manifest(docs, {column: F.when(F.col("doc_id") == 17, value).otherwise(F.col(column))})
        assert got.filter(merkle.fold(F.col("presented"), F.col("proof")) != F.col("root")).count() == 1
        changed = docs.withColumn(column, F.when(F.col("doc_id") == 17, value).otherwise(F.col(column)))
        assert {r.root for r in merkle.manifest(changed).collect()} != root
