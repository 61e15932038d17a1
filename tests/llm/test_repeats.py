"""Repeated word windows and repeated byte strings against plain versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from llm import blocks
from llm.repeated_passages import repeated_passages
from llm.repeated_strings import repeated_strings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def runs(mask):
    return sum(1 for i, m in enumerate(mask) if m and (i == 0 or not mask[i - 1]))


def plain_passages(rows, window):
    first = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, words in split:
        for p in range(len(words) - window + 1):
            key = tuple(words[p : p + window])
            first[key] = min(first.get(key, (i, p)), (i, p))
    out = Counter()
    for i, words in split:
        mask = [False] * len(words)
        for p in range(len(words) - window + 1):
            if first[tuple(words[p : p + window])] < (i, p):
                mask[p : p + window] = [True] * window
        kept = " ".join(w for w, m in zip(words, mask) if not m)
        out[(i, len(words), sum(mask), runs(mask), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


@pytest.fixture(scope="module")
def rows(spark):
    given = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rng = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(60))
    for k in range(60):  # parts of one passage, cut at every length, between other words
        a = rng.randrange(40)
        cut = " ".join(passage.split()[a : a + rng.randrange(15, 30)])
        given.append((1000 + k, f"o{k} " * rng.randrange(3) + cut + f"\nq{k}" + (" " + cut if k % 7 == 0 else "")))
    given += [(2000, None), (2001, ""), (2002, " \n "), (2003, "a b " * 500), (2004, "a b " * 500), (2004, "a b " * 500), (2005, "ä" * 400), (2006, "x" + "ä" * 300), (-5, passage), (2007, "=" * 5000)]
    return given


@pytest.mark.parametrize("size", [1 << 12, 2 << 20])
def test_passages_equal_brute_force(spark, rows, size):
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, block long, key string").repartition(3)
    out = repeated_passages(df, block_bytes=size)
    got = Counter(tuple(r)[:5] for r in out.collect())
    assert got == plain_passages(rows, 20)
    assert repeated_passages(df.limit(0)).count() == 0


def test_passage_spans(spark):
    words = [f"w{k}" for k in range(30)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, "x " + " ".join(words[5:29]) + " y")], "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.removed] for r in repeated_passages(df).collect()}
    assert got == {1: [], 2: [(1, 25)]}


def test_window_hashes_and_anchors():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 3, 400).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for length in (1, 2, 5, 10, 20, 31):
        hashes = blocks.window_hashes(symbols, length)
        same = {}
        for p in range(400 - length + 1):
            assert same.setdefault(tuple(symbols[p : p + length]), hashes[p]) == hashes[p]
        assert len(set(same.values())) == len(same)
        low = [hashes[p : p + 7].min() for p in range(len(hashes) - 6)]
        assert (blocks.sliding(hashes, 7, np.minimum) == low).all()
    starts = np.array([0, 0, 150, 155, 400])
    grams = blocks.window_hashes(symbols, 5)
    inside, full = blocks.fits(starts, len(grams), 5), blocks.fits(starts, len(grams), 20)
    assert [bool(x) for x in inside] == [any(a <= p and p + 5 <= b for a, b in zip(starts, starts[1:])) for p in range(len(grams))]
    chosen = set(blocks.anchors(grams, inside, full, 16))
    expected = {p for s in np.flatnonzero(full) for p in range(s, s + 16) if grams[p] == grams[s : s + 16].min()}
    assert chosen == expected


def plain_strings(rows):
    first = {}
    coded = [(i, (t or "").encode()) for i, t in rows]
    for i, data in coded:
        for p in range(len(data) - 49):
            s = data[p : p + 50]
            first[s] = min(first.get(s, i), i)
    out = Counter()
    for i, data in coded:
        mask = bytearray(len(data))
        for p in range(len(data) - 49):
            if first[data[p : p + 50]] < i:
                mask[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, m in zip(data, mask) if not m)
        out[(i, len(data), sum(mask), runs(mask), hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("size,crowd", [(1 << 12, 50_000), (2 << 20, 50_000), (1 << 14, 0)])
def test_strings_equal_brute_force(spark, rows, size, crowd):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    more = []
    for k in range(80):  # cuts of one string at every length around 50, next to equal and other bytes
        a = rng.randrange(300)
        more.append((3000 + k, rng.choice("xyz") * rng.randrange(25) + passage[a : a + rng.randrange(40, 100)] + rng.choice("xyz") * rng.randrange(25)))
    given = [*rows, *more]
    df = spark.createDataFrame([(i, t, 1, b"k") for i, t in given], "doc_id long, text string, block long, spans binary").repartition(3)
    out = repeated_strings(df, block_bytes=size, crowd=crowd)
    got = Counter(tuple(r)[:5] for r in out.collect())
    assert got == plain_strings(given)
    assert repeated_strings(df.limit(0)).count() == 0


def test_second_round_splits_buckets_of_short_strings(spark):
    """Anchors that share 24 bytes and no 37 leave before their contexts are cut; those that share 50 stay."""
    from llm.repeated_strings import still_open

    rows = [(1, 0, 5, 7, 10, 20, False), (1, 80, 6, 7, 10, 21, False), (2, 0, 7, 7, 11, 22, False), (2, 9, 8, 7, 12, 22, True),
            (3, 0, 9, 7, 13, 23, False), (3, 5, 9, 7, 13, 24, False), (4, 0, 5, 8, 10, 20, False)]
    df = spark.createDataFrame(rows, "block long, place long, doc_id long, bucket int, ahead int, behind int, crowded boolean")
    assert sorted(tuple(r) for r in still_open(df).collect()) == [(1, 0, 7, False), (1, 80, 7, False), (2, 0, 7, False), (2, 9, 7, True)]


def test_contexts_are_packed_and_unpacked_whole():
    from llm.repeated_strings import BEFORE, GRAM, LENGTH, packed_contexts, padded, unpacked_contexts

    rng = np.random.default_rng(1)
    docs = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (0, 24, 30, 50, 60, 77, 400)]
    symbols, first = padded(np.concatenate([[0], np.cumsum([len(d) for d in docs])]), b"".join(docs))
    places = np.concatenate([np.arange(f, f + len(d) - GRAM + 1) for f, d in zip(first, docs) if len(d) >= GRAM])
    packed = packed_contexts(symbols, places)
    assert (unpacked_contexts([c.tobytes() for c in packed]) == symbols[places[:, None] + np.arange(-BEFORE, LENGTH)]).all()
