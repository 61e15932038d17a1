"""The hidden Markov model against the plain recursion, and its scores on held-out texts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from llm import markov
from llm.catalog import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(model, tokens):
    """log likelihood and expected counts of one sequence, step by step."""
    k = len(model.start)
    alpha, scales = [], []
    for t, x in enumerate(tokens):
        a = (model.start if t == 0 else alpha[-1] @ model.step) * model.emit[x]
        scales.append(a.sum())
        alpha.append(a / a.sum())
    beta = [np.ones(k)]
    for x, s in zip(tokens[:0:-1], scales[:0:-1]):
        beta.insert(0, model.step @ (model.emit[x] * beta[0]) / s)
    starts, steps, emits = alpha[0] * beta[0], np.zeros((k, k)), np.zeros(model.emit.shape)
    for t, x in enumerate(tokens):
        emits[x] += alpha[t] * beta[t]
        if t:
            steps += np.outer(alpha[t - 1], model.emit[x] * beta[t]) * model.step / scales[t]
    return sum(map(math.log, scales)), starts, steps, emits


def test_pieces_equal_the_plain_recursion():
    rng = np.random.default_rng(1)
    k, n = 3, 11
    model = markov.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(n), k).T)
    lengths = [1, 2, 4, 5, 8, 9, 33, 1, 70]
    docs = [rng.integers(0, n, size) for size in lengths]
    pieces = markov.Pieces(model, np.concatenate(docs), np.concatenate([[0], np.cumsum(lengths)]), piece=4)
    each = [plain(model, d.tolist()) for d in docs]
    likelihood, _, _ = pieces.boundaries()
    assert np.allclose(likelihood, [e[0] for e in each], rtol=1e-12)
    starts, steps, emits, total = pieces.expected()
    assert np.allclose(starts, sum(e[1] for e in each)) and np.allclose(steps, sum(e[2] for e in each))
    assert np.allclose(emits, sum(e[3] for e in each)) and math.isclose(total, sum(e[0] for e in each))


def tokens_of(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [*WORD.findall(lower), None]


def plain_base(rows):
    out = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
    count = Counter(w for i, t in rows if not out(i) for w in tokens_of(t))
    n, v = sum(count.values()), len(count)
    return [
        (i, out(i), len(w := tokens_of(t)), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        for i, t in rows
    ]


@pytest.mark.parametrize("size", [1 << 13, 4 << 20])
def test_scores(spark, size):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(900, None), (901, ""), (902, " \n"), (903, "x y " * 20000), (904, "Ä ÄÄ é"), (904, "Ä ÄÄ é"), (None, "the end")]
    df = spark.createDataFrame([(i, t, 1, 2.0) for i, t in rows], "doc_id long, text string, block long, score double").repartition(3)
    got = sorted((tuple(r) for r in markov.markov_scores(df, block_bytes=size, rounds=2).collect()), key=lambda r: (r[0] is not None, *r[:1], *r[2:3]))
    want = sorted(plain_base(rows), key=lambda r: (r[0] is not None, *r[:1], *r[2:3]))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    assert all(math.isfinite(g[6]) and g[6] < 0 for g in got)


def test_odd_tables(spark):
    kind = "doc_id long, text string"
    assert markov.markov_scores(spark.createDataFrame([], kind)).count() == 0
    held = next(i for i in range(100) if markov.held_out(i))
    one = markov.markov_scores(spark.createDataFrame([(held, "a b")], kind)).collect()
    assert one[0].held_out and one[0].n_known == 0 and one[0].train_tokens == 0


def test_probabilities_add_up(spark):
    """Over all texts of one word (known or the unknown one of its class) the model gives the share of one-word texts."""
    docs = [(i, t) for i, t in enumerate(["a b a", "b b", "a", "c a", "b", "a a", "c"])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = markov.markov_scores(df, classes=4, states=2, rounds=2).collect()
    assert 0 < sum(10**r.score for r in got if r.n_tokens == 2) < 1


def test_model_beats_counts_on_held_out_texts(spark):
    got = QUERIES["op4_markov_scores"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    model, base = sum(r.score for r in got), sum(r.base_score for r in got)
    assert len(got) > 50 and model > base * 0.97  # log probabilities: nearer to 0 is better
