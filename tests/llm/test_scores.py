"""Scores of the two classifiers against plain loops over terms, pairs and blocks."""

import math
import random
import re

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tributary.llm import quality, toxicity

M = (1 << 64) - 1


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ x >> 31


def hashed(word, salt):
    step, power, total = 0x9E3779B97F4A7C15 | 1, 1, 0
    for b in word:
        power = power * step & M
        total += (b + 1) * power
    return mixed(total & M ^ salt)


def bins(text):
    """The bins of a text: its words, and the first letters of the longer ones."""
    found = set()
    for word in re.findall(rb"[0-9a-z\x80-\xff]+", text.lower().encode()):
        found.add(hashed(word, len(word)) >> 64 - toxicity.BIN_BITS)
        if len(word) > toxicity.PREFIX:
            found.add(hashed(word[:toxicity.PREFIX], 0xA5A5A5A5A5A5A5A5) >> 64 - toxicity.BIN_BITS)
    return sorted(found)


def plain_score(machine, text):
    """1 / (1 + exp(-margin)), the margin with a product of vectors for every pair of bins."""
    at = {b: i for i, b in enumerate(machine.bins.tolist())}
    mine = [at[b] for b in bins(text) if b in at]
    margin = machine.bias + sum(machine.weights[i] for i in mine)
    margin += sum(float(machine.vectors[i] @ machine.vectors[j]) for n, i in enumerate(mine) for j in mine[:n])
    return 1 / (1 + math.exp(-margin))


def test_toxicity_scores_are_sums_over_all_pairs(spark, make_docs):
    rng = random.Random(3)
    some = lambda: " ".join(rng.choice(["idiot", "Idiots!", "martians", "café", "weather", "nice", "THE", "42nd", "x"]) + rng.choice(["", "", ",", "s"]) for _ in range(rng.randrange(30)))
    rows = [(i, some()) for i in range(300)]
    labels = spark.createDataFrame([(i, int("idiot" in t.lower() and "martians" in t)) for i, t in rows], "doc_id long, toxic int")
    machine = toxicity.fit(make_docs(rows), labels, F.lit(True))
    assert len(machine.bins) > 3 and np.abs(machine.vectors).max() > 0.05
    new = [*rows, (400, None), (401, ""), (402, "martians " * 20_000 + "idiot")]
    got = {r.doc_id: r.score for r in toxicity.scores(make_docs(new), machine).collect()}
    assert all(abs(got[i] - plain_score(machine, t or "")) < 1e-9 for i, t in new) and len(got) == 303


@pytest.mark.parametrize("level", [quality.LEVEL])
def test_quality_scores_are_those_of_plain_compression(spark, make_docs, level):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["the", "river", "flows", "under", "old", "bridges", "and", "quiet", "houses"]) for _ in range(rng.randrange(5, 900)))
    bad = lambda: "".join(rng.choice("!?#$zqxv0123456789 ") for _ in range(rng.randrange(20, 5000)))
    rows = [(i, good() if i % 2 else bad()) for i in range(160)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    model = quality.fit(make_docs(rows), labels, F.lit(True))
    assert len(model.weights) and all(model.dictionaries)

    def size(text, dictionary=None):
        options = {"level": level, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        if dictionary is not None:
            options["dict_data"] = zstandard.ZstdCompressionDict(dictionary)
        return sum(len(zstandard.ZstdCompressor(**options).compress(text[i:i + quality.BLOCK])) for i in range(0, len(text), quality.BLOCK))

    def plain(text):
        t = (text or "").encode()
        if not t:
            return model.good_share
        whole, worse, better = size(t), size(t, model.dictionaries[0]), size(t, model.dictionaries[1])
        rate, length = math.log(whole / len(t)), math.log1p(len(t))
        x = [1, 10 * (worse - better) / (worse + better), rate, 3 * min(rate + 1.2, 0), length / 10, rate * length / 10]
        return 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(x, model.weights))))))

    new = [*rows[:40], (500, None), (501, ""), (502, "the old river " * 4000), (503, "é")]
    got = {r["row"]["doc_id"]: r.score for r in quality.scored(make_docs(new), model).collect()}
    worst = max(abs(got[i] - plain(t)) for i, t in new)
    assert worst < 1e-6 and len(got) == 44
    assert np.mean([got[i] >= 0.5 for i, _ in rows[:40] if i % 2]) > 0.9 > np.mean([got[i] >= 0.5 for i, _ in rows[:40] if not i % 2])
