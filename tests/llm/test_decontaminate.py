"""Benchmark windows against a plain version without index, stretches or sieve."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F  # noqa: F401

from llm import decontaminate as d
from llm.common import WordHashes, shingle_hashes, words_of


def plain_print(shingles):
    bits = [0] * 64
    for s in shingles.tolist():
        for k in range(64):
            bits[k] += 1 if s >> k & 1 else -1
    return sum(1 << k for k in range(64) if bits[k] > 0)


def plain_matches(docs, items, radius=d.RADIUS, least=0.8):
    hashes, out = WordHashes(), {}
    for doc_id, text in docs:
        words = hashes.of(words_of(text or "", lower=True))
        for item_id, item in items:
            target = hashes.of(words_of(item or "", lower=True))
            if not len(words) or not len(target):
                continue
            want = shingle_hashes(target, 5)
            size = min(len(target), len(words))
            width = min(5, len(target))
            if not set(want.tolist()) & set(shingle_hashes(words, width).tolist()):
                continue  # similarity 0 everywhere
            for at in range(len(words) - size + 1):
                have = shingle_hashes(words[at : at + size], width)
                if (plain_print(have) ^ plain_print(want)).bit_count() <= radius:
                    a, b = have.tolist(), want.tolist()
                    low = sum(min(a.count(x), b.count(x)) for x in set(a))
                    near = low / (len(a) + len(b) - low)
                    if near >= least:
                        best, where, n = out.get((doc_id, item_id), (0, 0, 0))
                        out[doc_id, item_id] = (near, at, n + 1) if near > best else (best, where, n + 1)
    return out


def test_all_within_radius_are_found():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 2**64, 20, dtype=np.uint64)
    windows = []
    for p in prints.tolist():
        for flips in (0, 1, 5, 10, 15, 16, 30):
            for k in rng.choice(64, flips, replace=False).tolist():
                p ^= 1 << k
            windows.append(p)
    windows = np.array(windows, np.uint64)
    near = {(w, i) for w in range(len(windows)) for i in range(20) if int(windows[w] ^ prints[i]).bit_count() <= 15}
    assert set(d.within_radius(windows, prints, d.block_tables(prints), 15)) == near
    with pytest.raises(ValueError):
        list(d.within_radius(windows, prints, d.block_tables(prints), 16))


@pytest.mark.parametrize("query_bytes", [d.QUERY_BYTES, 400])
def test_matches_equal_brute_force(spark, query_bytes):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(80)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([1, 3, 5, 6, 12, 20, 20, 33, 50])]
    items += [(20, None), (21, ""), (22, items[6][1]), (23, "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1")]
    docs = [(0, None), (1, ""), (2, " \n"), (3, items[7][1].upper()), (3, items[7][1].upper()), (4, "w1 " * 40), (5, items[7][1][:80])]
    for k in range(40):
        words = rng.choice(items[4:9])[1].split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "other"
        docs.append((100 + k, " ".join([*rng.choices(vocabulary, k=rng.randrange(40)), *words, *rng.choices(vocabulary, k=rng.randrange(30))])))
    frame = spark.createDataFrame([(i, t, 1, 2.0) for i, t in docs], "doc_id long, text string, item_id long, similarity double")
    bench = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id long")
    got = {(r.doc_id, r.item_id): (r.similarity, r.first_word, r.n_windows) for r in d.benchmark_matches(frame, bench, query_bytes=query_bytes).collect()}
    plain = plain_matches(dict.fromkeys(docs), items)
    repeated = {k: (*v[:2], v[2] * 2) if k[0] == 3 else v for k, v in plain.items()}
    assert got == repeated and len({i for i, _ in got}) > 20
    clean = d.without_benchmark(frame, bench)
    assert clean.columns == frame.columns and {r.doc_id for r in clean.collect()} == {i for i, _ in docs} - {i for i, _ in got}
    assert d.benchmark_matches(frame.limit(0), bench).count() == 0 and d.benchmark_matches(frame, bench.limit(0)).count() == 0


def test_whole_items_are_caught(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, words_of(r.text, lower=True)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, words_of(r.text, lower=True)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    held = {(i, j) for i, words in docs for j, item in items if b" %s " % b" ".join(item) in b" %s " % b" ".join(words)}
    got = {(r.doc_id, r.item_id) for r in d.benchmark_matches(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert held and held <= got
