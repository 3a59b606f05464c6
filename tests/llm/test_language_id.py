"""The byte network against plain loops, its slopes against differences, its predictions against held-out labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.llm import language_id as L
from tributary.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def plain(network, text):
    """Probabilities by loops over windows, filters and places."""
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in text)
    total, weights = 0, 0
    at = 0
    while at == 0 or at + L.WINDOW - L.STRIDE < len(data):
        window = data[at:at + L.WINDOW]
        filled = window + bytes(L.WINDOW - len(window))
        pooled = []
        for width, table in zip(L.WIDTHS, network.tables):
            responses = [sum(table[j][filled[i + j]].astype(float) for j in range(width)) for i in range(L.WINDOW - width + 1)]
            pooled += np.max(responses, axis=0).tolist()
        score = np.maximum(np.array(pooled) + network.bias, 0) @ network.out.astype(float) + network.out_bias
        p = np.exp(score - score.max())
        total, weights = total + max(1, len(window)) * p / p.sum(), weights + max(1, len(window))
        at += L.STRIDE
    return total / weights


def test_scores_are_those_of_plain_loops():
    network = L.Network(["a", "b", "c"])
    network.bias += 0.05
    texts = [b"", b"x", b"The Quick", "é".encode() * 64, b"a\0b" * 50, bytes(range(256)) * 2, b"z" * L.WINDOW, b"z" * (L.WINDOW + 1), b"qw" * 250]
    got = network.scorer()(texts)
    for row, text in zip(got, texts):
        assert np.abs(row - plain(network, text)).max() < 1e-5
    again = L.Network(["a", "b", "c"])
    again.load(network.dump())
    assert np.array_equal(again.scorer()(texts), got)


def test_slopes_are_differences_of_the_loss():
    draw = np.random.default_rng(3)
    network = L.Network(["a", "b", "c"])
    for p in (network.out, network.out_bias, network.bias):
        p += draw.normal(0, 0.3, p.shape).astype(np.float32)
    x, _, _ = L.windows([bytes(draw.integers(97, 110, 90).astype(np.uint8)) for _ in range(6)])
    y = np.array([0, 1, 2, 0, 1, 2])
    network.tables = [t.astype(float) for t in network.tables]
    network.bias, network.out, network.out_bias = (p.astype(float) for p in (network.bias, network.out, network.out_bias))

    def loss():
        pooled = np.concatenate([r.max(axis=1) for r in network.responses(x)], axis=1)
        return -np.log(network.probabilities(pooled)[np.arange(len(y)), y]).mean()

    for p, slope in zip(network.parameters(), network.slopes(x, y)):
        for at in np.argsort(-np.abs(slope).ravel())[:5]:
            old = p.flat[at]
            p.flat[at] = old + 1e-6
            up = loss()
            p.flat[at] = old - 1e-6
            down = loss()
            p.flat[at] = old
            assert abs((up - down) / 2e-6 - slope.flat[at]) < 1e-5


def test_held_out_accuracy(spark):
    rows = QUERIES["op11_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000
    for held_out in (True, False):
        mine = [r for r in rows if r.held_out == held_out]
        assert sum(r.lang_pred == r.lang for r in mine) >= 0.97 * len(mine) and all(0 <= r.score <= 1 for r in mine)


@pytest.fixture(scope="module")
def labelled(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, v, "s", "k", "u", "p", 1) for i, t, v in rows],
                                     "doc_id long, text string, lang string, source string, _key string, _usable string, place string, n int")
    return make


def test_nulls_letters_long_and_repeated_texts(labelled):
    rows = [(i, ("der die das und ist " if i % 2 else "the and that is for ") * (1 + i % 5), "de" if i % 2 else "en") for i in range(200)]
    rows += [(3, "der die das", "de")] * 50 + [(None, "xyz", "fr"), (500, "no label", None), (501, None, "es"), (502, "123 !!", "it"), (503, "", "en")]
    network = L.fit(labelled(rows), F.lit(True))
    assert network.languages == ["de", "en", "es", "it"]  # a label counts as known also where its texts teach nothing
    new = [(1, None, None), (2, "", None), (2, "", None), (3, "12 -- ?", None), (None, "das und die der", "x"), (5, "THE AND FOR that is", None), (6, "und die das " * 100_000, None)]
    got = {(r.doc_id, r.lang_pred) for r in L.predict(labelled(new), network).collect()}
    assert got == {(1, "und"), (2, "und"), (3, "und"), (None, "de"), (5, "en"), (6, "de")}
    assert L.predict(labelled(new), network).filter("lang_pred = 'und' AND score <> 0").count() == 0 and L.predict(labelled(new), network).count() == 7
    assert L.predict(labelled([]), network).count() == 0


def test_one_language_and_none(labelled):
    one = L.fit(labelled([(1, "only this", "en")]), F.lit(True))
    assert [tuple(r) for r in L.predict(labelled([(1, "x", None), (2, "7", None)]), one).orderBy("doc_id").collect()] == [(1, "en", 1.0), (2, "und", 0.0)]
    none = L.fit(labelled([]), F.lit(True))
    assert [r.lang_pred for r in L.predict(labelled([(1, "x", None)]), none).collect()] == ["und"]
