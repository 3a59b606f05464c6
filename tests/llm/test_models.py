"""Classifiers by held-out accuracy, the language model against its textbook form."""

import collections
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.llm import lm_score, quality, toxicity
from tributary.llm.common import fold, importable
from tributary.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def tokens(text):
    return [w.decode() for w in (text or "").encode().lower().split()]


def textbook(texts, order):
    grams = [collections.Counter() for _ in range(order + 1)]
    for t in texts:
        w = ["<s>", *t, "</s>"]
        for i in range(1, len(w)):
            if i >= order - 1:
                grams[order][tuple(w[i - order + 1:i + 1])] += 1
            elif i >= 1:
                grams[i + 1][tuple(w[:i + 1])] += 1
    for k in range(order, 1, -1):
        for g in grams[k]:
            grams[k - 1][g[1:]] += 1
    off, totals = {}, {}
    for k in range(1, order + 1):
        n = collections.Counter(grams[k].values())
        y = n[1] / (n[1] + 2 * n[2])
        last = 3 - 4 * y * n[4] / n[3] if n[3] else 1.5
        off[k] = [0, *(min(max(d, 0.05), i + 0.95) for i, d in enumerate((1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], last)))]
        totals[k] = collections.defaultdict(lambda: [0, 0, 0, 0])
        for g, c in grams[k].items():
            totals[k][g[:-1]][0] += c
            totals[k][g[:-1]][min(c, 3)] += 1
    seen = {w for t in texts for w in [*t, "</s>"]}

    def p(g):
        lower = p(g[1:]) if len(g) > 1 else 1 / (len(seen) + 1)
        row = totals[len(g)].get(g[:-1])
        if not row:
            return lower
        c, d = grams[len(g)].get(g, 0), off[len(g)]
        return max(c - d[min(c, 3)], 0) / row[0] + sum(d[i] * row[i] for i in (1, 2, 3)) / row[0] * lower

    def score(t):
        w = ["<s>", *t, "</s>"]
        return sum(math.log10(p(tuple(w[max(0, i - order + 1):i + 1]))) for i in range(1, len(w)))
    return score


@pytest.mark.parametrize("order", [2, 3])
def test_language_model_is_modified_kneser_ney(make_docs, order):
    rng = random.Random(4)
    some = [(i, " ".join(rng.choice(["A", "b", "c", "dd", "é", "f", "g"]) + str(int(rng.expovariate(0.3))) for _ in range(rng.randrange(1, 60)))) for i in range(60)]
    some += [(60, None), (61, ""), (61, "")]
    new = [(100, "a0 b1 zz b1"), (101, None), (102, " "), (103, some[3][1]), (None, "b1")]
    model = lm_score.train(make_docs(some), order=order, shards=12)
    texts = [tokens(t) for _, t in some]
    seen = collections.Counter(w for t in texts for w in [*t, "</s>"])
    assert (model.tokens, model.distinct) == (sum(seen.values()), len(seen)) and len(model.frequent) > 1
    score = textbook(texts, order)
    for r in lm_score.scores(make_docs([*some, *new]), model).collect():
        t = tokens(dict([*some, *new])[r.doc_id])
        base = sum(math.log10((seen[w] + 0.1) / (model.tokens + 0.1 * (model.distinct + 1))) for w in [*t, "</s>"])
        assert (r.n_tokens, r.n_known) == (len(t) + 1, sum(w in seen for w in [*t, "</s>"]))
        assert abs(r.score - score(t)) < 1e-9 and abs(r.base_score - base) < 1e-9


def test_language_model_of_nothing(make_docs):
    model = lm_score.train(make_docs([]))
    assert [r.score for r in lm_score.scores(make_docs([(1, "a b"), (2, None)]), model).collect()] == [0, 0]
    assert lm_score.scores(make_docs([]), model).count() == 0


@pytest.mark.parametrize("name, label, recall", [("op5_toxicity", "toxic", 0.5), ("op6_quality_classifier", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, recall):
    rows = QUERIES[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect()
    right = {v: np.mean([r.predicted == v for r in rows if r[label] == v]) for v in (0, 1)}
    assert right[1] >= recall and right[0] >= 0.8 and all(0 <= r.score <= 1 for r in rows)


def test_pairs_of_terms_are_learned():
    rng = random.Random(2)
    rows = []
    for _ in range(1500):  # toxic only where both meet
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        w = [f"w{rng.randrange(40)}" for _ in range(8)] + ["blockhead"] * insult + ["martians"] * group
        rng.shuffle(w)
        rows.append((" ".join(w).encode(), int(insult and group)))
    machine = toxicity.learn(rows, 0.25)
    text, bins = toxicity.terms([b"w1 blockhead w2", b"w1 martians w2", b"w1 blockhead martians", b""])
    place = machine.table()[bins]
    margin, _ = machine.margins(4, text[place >= 0], place[place >= 0])
    assert margin[2] > 1 and margin[0] < -1 and margin[1] < -1 and margin[3] < 0


@pytest.mark.parametrize("operator", ["toxicity", "quality"])
def test_classifiers_without_labels_or_texts(spark, make_docs, operator):
    labels = spark.createDataFrame([(1, 1, "x"), (None, 0, "x"), (2, None, "x"), (3, 7, "x")], "doc_id long, v int, text string")
    rows = [(1, "good text"), (None, None), (2, ""), (2, ""), (4, "many words " * 60_000)]
    for docs in (make_docs(rows), make_docs([])):
        if operator == "toxicity":
            model = toxicity.fit(docs, labels, F.lit(True), label="v")
            found = toxicity.scores(docs, model)
        else:
            model = quality.fit(docs, labels, F.lit(True), label="v")
            found = quality.scored(docs, model)
            assert quality.keep_good(docs, model).columns == docs.columns
        assert found.count() == docs.count() and all(0 <= r.score <= 1 for r in found.collect())


def test_fold_is_crc32_of_the_id(spark):
    con = duckdb.connect()
    import zlib
    importable(spark)
    got = spark.range(50).select("id", fold(F.col("id"), 10).alias("f")).collect()
    con.close()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 10 for r in got)


def test_the_registered_model_counts_three_words(spark, monkeypatch):
    made = []
    train = lm_score.train
    monkeypatch.setattr(lm_score, "train", lambda *a, **b: made.append(train(*a, **b)) or made[-1])
    assert QUERIES["op7_lm_score"](spark, SF).count() > 0
    assert made[0].order >= 3 and made[0].figures[3][5] > 0  # all counts of three words
