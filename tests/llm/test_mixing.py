import random

import numpy as np
import pyarrow as pa
import pytest

from blobloom.llm import mixing as mx
from blobloom.llm import textvec as tv
from blobloom.llm.common import prepare


def corpus(n=600):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("aeioubcdfg") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        kind = rng.choices([0, 1, 2], [6, 2, 2])[0]
        w = [rng.choice(vocab) for _ in range(rng.randrange(20, 120))]
        if kind == 1:
            w = [x + "!!" for x in w] if i % 2 else [rng.choice(w[:3]) for _ in w]
        if kind == 2:
            for _ in range(4):
                w[rng.randrange(len(w))] = "vequ" + rng.choice(["s", "ant", "o"])
        docs.append((i, " ".join(w), kind))
        if i % 3:
            labels.append((i, 0 if kind == 1 else 1, int(kind == 2)))
    return docs, labels


def tables(spark, docs, labels):
    return prepare(spark).createDataFrame([(i, t, "q", i) for i, t, *_ in docs], "doc_id long, text string, quality string, __p long").select("doc_id", "text", "quality"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def slow_rates(n, p, target, ridge):
    """The same problem by plain projected gradient, each document with a rate of its own."""
    r = np.ones(len(n))
    every = n.sum()
    for _ in range(60_000):
        e = ((r * n) @ p - target) / every
        r = np.maximum(0, r - (p @ e + ridge * (r - 1)) / (1 + ridge))
    return r


def test_rates_match_brute_force_and_targets(spark):
    docs, labels = corpus()
    got = mx.mixed(*tables(spark, docs, labels)).orderBy("doc_id").collect()
    n = np.array([r.n_tokens for r in got], float)
    p = np.array([[r.p_good, r.p_poor, r.p_toxic] for r in got])
    assert n.tolist() == [len(t.split()) for _, t, _ in docs] and np.allclose(p.sum(1), 1)
    held = [k for k in range(len(docs)) if k % 3 == 0]
    assert np.mean([p[k].argmax() == docs[k][2] for k in held]) > 0.9
    rate = np.array([r.rate for r in got])
    target = np.array([mx.SHARES[d] for d in mx.DOMAINS]) * n.sum()
    assert np.allclose(rate, slow_rates(n, p, target, mx.RIDGE), atol=1e-3) and len(set(np.round(rate, 6))) > 50
    assert np.abs((rate * n) @ p - target).max() < 0.02 * n.sum() and rate.min() >= 0
    assert all(r.copies in (int(r.rate), int(r.rate) + 1) for r in got)


def test_edge_rows(spark):
    docs, labels = corpus(60)
    docs = docs + [(900, None, 0), (901, "", 0), (3, docs[3][1], 0), (None, "x y", 0), (902, "a!b " * 50_000, 0)]
    labels = labels + [(None, 1, 1), (1, None, 0), (2, 0, 0), (2, 1, 1), (12345, 0, 0)]
    got = mx.mixed(*tables(spark, docs, labels)).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    assert by[900].n_tokens == by[901].n_tokens == 0 and by[900].rate == by[901].rate and by[902].n_tokens == 50_000
    assert len({tuple(r) for r in got if r.doc_id == 3}) == 1


def test_no_labels_and_no_rows(spark):
    d, lab = tables(spark, corpus(20)[0], [])
    got = mx.mixed(d, lab).collect()
    assert all(r.p_good > 0.999 for r in got)
    assert mx.mixed(d.where("false"), lab).collect() == []


def test_posteriors_sum_to_one():
    m = mx.Classifier()
    rng = np.random.default_rng(1)
    m.w = rng.standard_normal(m.w.shape).astype(np.float32)
    places, forms, _ = mx.features(*tv.buffers(pa.array(["a b c", "", "x" * 500, "é! 12"])))
    p = m.posteriors(places, forms)
    assert np.allclose(p.sum(1), 1, atol=1e-12) and (p >= 0).all()
    alone = [m.posteriors([x], forms[k : k + 1])[0] for k, x in enumerate(places)]
    assert (np.array(alone) == p).all()


@pytest.mark.parametrize("text, tokens", [("", 0), (" a  b\tc ", 3)])
def test_tokens(text, tokens):
    assert mx.features(*tv.buffers(pa.array([text])))[2].tolist() == [tokens]
