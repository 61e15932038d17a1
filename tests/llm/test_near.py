"""Near duplicates and components against plain versions."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from llm.common import landed  # noqa: F401
from llm.components import components, joined_parts
from llm.near_duplicates import band_keys, near_duplicates, super_minhash, without_near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def plain_components(rows, size, percent):
    sets = [(i, shingles(t, size)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in sets:
        for j, y in sets:
            if i < j and x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return Counter((i, len(x), find(i), find(i) == i) for i, x in sets)


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(5001, 5400)]
    nodes = {x for a, b in links if a != b for x in (a, b)}
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    parts = None
    for some in (links[:150], links[150:420], links[:5], links[420:]):
        parts = joined_parts(parts, spark.createDataFrame([x for x in some if x[0] != x[1]], "a long, b long"))
    assert {r.node: r.component for r in parts.collect()} == got


def test_super_minhash_is_the_sequential_algorithm():
    """Same signature as drawing each element's permutation one swap at a time, without early stopping."""
    from llm.common import mix

    rng = np.random.default_rng(3)
    slots = 24
    for n in (1, 2, 7, 60, 500):
        elements = rng.integers(0, 2**63, n).astype(np.uint64)
        best = np.full(slots, np.iinfo(np.uint64).max, np.uint64)
        for e in elements:
            p = list(range(slots))
            for level in range(slots):
                with np.errstate(over="ignore"):
                    rnd = int(mix(np.array([e + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)]))[0])
                k = level + (rnd & 0xFFFFFF) % (slots - level)
                p[level], p[k] = p[k], p[level]
                best[p[level]] = min(int(best[p[level]]), level << 40 | rnd >> 24)
        assert (super_minhash(elements, np.array([n]), slots)[0] == best).all()


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(4)
    pool = np.unique(rng.integers(0, 2**63, 1300).astype(np.uint64))
    a, b = pool[:1000], pool[200:1200]
    sig = super_minhash(np.concatenate([a, b]), np.array([1000, 1000]), 200)
    assert abs((sig[0] == sig[1]).mean() - 800 / 1200) < 0.12
    assert band_keys(sig, 40, 5).shape == (2, 40)


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_equal_brute_force(spark, size):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rng = random.Random(7)
    vocabulary = [f"v{k}" for k in range(500)]
    for base in range(6):  # groups with edits around the threshold, and chains of edits
        words = rng.choices(vocabulary, k=rng.choice([5, 12, 60, 200]))
        for k in range(25):
            other = list(words)
            for _ in range(rng.randrange(0, max(2, len(words) // 20))):
                other[rng.randrange(len(other))] = rng.choice(vocabulary)
            rows.append((1000 + base * 100 + k, " ".join(other)))
            if k % 5 == 0:
                words = other
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "One"), (5004, "one"), (5005, "a b"), (5006, "x y " * 30000), (5006, "x y " * 30000), (-1, "one")]
    df = spark.createDataFrame([(i, t, 1, 2, "k") for i, t in rows], "doc_id long, text string, n long, component long, key string")
    out = near_duplicates(df, shingle=size)
    assert Counter(tuple(r) for r in out.collect()) == plain_components(rows, size, 80)
    left = without_near_duplicates(df, shingle=size)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(r.doc_id for r in out.where("kept").collect())
    assert near_duplicates(df.limit(0)).count() == 0
