"""Ranked lexical search against a plain version."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from llm import ranked_search as rs

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

ODD = [
    (1, None), (2, ""), (3, " \n ! -- "), (4, "Alpha beta"), (4, "Alpha beta"), (4, "beta beta gamma"), (None, "alpha beta"), (5, "ALPHA_beta.GAMMA"),
    (6, "É é naïve 東京 tower"), (7, "alpha " * 5000 + "beta"), (8, "x" * 70_000 + " alpha"), (9, "a1 2b alpha\x7fbeta\x00gamma"), (10, "alpha beta"), (-3, "alpha beta"),
]
ITEMS = [(1, "alpha"), (2, "BETA beta gamma"), (3, None), (4, ""), (5, "nowhere"), (6, "é tower 東京"), (1, "gamma"), (None, "alpha 2b"), (7, "x" * 70_000)]


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_ranking(docs, items, k=10):
    words = [(i, Counter(terms(t))) for i, t in docs]
    held = sum(1 for _, w in words if w)
    total = sum(sum(w.values()) for _, w in words)
    df = Counter(t for _, w in words for t in w)
    query = defaultdict(set)
    for i, t in items:
        query[i] |= set(terms(t))
    out = []
    for item, wanted in query.items():
        scores = []
        for i, w in words:
            m = 10 + 90 * sum(w.values()) * held // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * held + 2) / (2 * df[t] + 1))) * (10**9 * w[t] // (1000 * w[t] + 8 * m)) for t in wanted if t in w)
            if s > 0:
                scores.append((-s, i is not None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return Counter(out)


@pytest.mark.parametrize("query_bytes", [rs.QUERY_BYTES, 2000])
def test_ranking_equals_plain(spark, query_bytes):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    index = rs.build_index(docs, segment_bytes=40_000)
    got = Counter(tuple(r) for r in rs.ranked(index, items, query_bytes=query_bytes).collect())
    assert got == plain_ranking([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_odd_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in ODD], "doc_id long, text string, term string, segment int, score string")
    items = spark.createDataFrame([(i, t, "x", 1) for i, t in ITEMS], "item_id long, text string, term string, rank int")
    for k in (2, 10):
        got = Counter(tuple(r) for r in rs.ranked(rs.build_index(docs, segment_bytes=60), items, k=k).collect())
        assert got == plain_ranking(ODD, ITEMS, k)
    assert rs.ranked(rs.build_index(docs), items.limit(0)).count() == 0
    assert rs.ranked(rs.build_index(docs.limit(0)), items).count() == 0


def test_equal_scores_rank_by_id(spark):
    rows = [((7 * i) % 101 - 50, "same words here" if i % 3 else "other") for i in range(101)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    items = spark.createDataFrame([(1, "words")], "item_id long, text string")
    got = [(r.rank, r.doc_id) for r in rs.ranked(rs.build_index(docs, segment_bytes=50), items).orderBy("rank").collect()]
    assert got == list(enumerate(sorted(i for i, t in rows if t != "other")[:10], 1))


def test_terms_across_stretches(monkeypatch):
    text = ("ab" * 40 + " c-d " + "é" * 90 + "\n") * 30
    whole = [t.encode() for t in terms(text)]
    for size in (1, 2, 7, 64, 1 << 20):
        monkeypatch.setattr(rs, "STRETCH", size)
        assert [t for some in rs.terms_of(text.encode()) for t in some] == whole


def test_merge_equals_full_scoring():
    """Any mix of short and long lists, small windows and floors that rise: the same best documents."""
    rng = np.random.default_rng(0)
    for _ in range(300):
        n, k = int(rng.integers(1, 300)), int(rng.integers(1, 6))
        best, sums = rs.Best(k), {}
        for segment in range(3):
            ids = rng.permutation(n) + 1000 * segment
            total = np.zeros(n, np.int64)
            lists = []
            for _ in range(int(rng.integers(1, 7))):
                places = np.sort(rng.choice(n, int(rng.integers(1, n + 1)), replace=False))
                adds = rng.integers(0, 9, len(places)) * int(rng.integers(1, 30))
                total[places] += adds
                lists.append(rs.Postings(places, adds, int(adds.max())))
            rs.merge(lists, ids, best, window=int(rng.integers(1, 80)), short=int(rng.integers(1, 12)))
            sums |= dict(zip(ids.tolist(), total.tolist()))
        want = sorted((-s, i) for i, s in sums.items() if s > 0)[:k]
        assert [(-s, i) for s, i in zip(best.scores.tolist(), best.ids.tolist())] == want


def test_merge_skips_what_cannot_come_in(monkeypatch):
    """Once the floor is high, a common term's list is looked up only at candidates."""
    looked = []
    n = 10_000
    common = rs.Postings(np.arange(n), np.ones(n, np.int64), 1)
    rare = rs.Postings(np.arange(0, n, 5), np.full(n // 5, 100), 100)
    best = rs.Best(3)
    best.add(np.array([90, 90, 90]), np.array([-3, -2, -1]))
    between = rs.Postings.between
    monkeypatch.setattr(rs.Postings, "between", lambda self, a, b: looked.append(len(self.places)) or between(self, a, b))
    rs.merge([common, rare], np.arange(n), best, short=10)
    assert set(looked) == {n // 5} and best.scores.tolist() == [101] * 3 and best.ids.tolist() == [0, 5, 10]


def test_length_factor_beyond_64_bits():
    assert rs.length_factor(np.array([0, 3, 10**9]), 10**11, 10**12).tolist() == [10, 10 + 27, 10 + 90 * 10**8]


def test_one_segment_at_a_time(spark, monkeypatch):
    """Whatever a task gets of texts or of the index: what readers, writers and pipes hold at once is one segment, or a thousand texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, landed, held = spark.conf.get(key), rs.landed, {}

    def noted(df, label, **options):
        held[label] = int(spark.conf.get(key))
        return landed(df, label, **options)

    monkeypatch.setattr(rs, "landed", noted)
    docs = spark.createDataFrame([(i, f"alpha beta{i} " * 9) for i in range(300)], "doc_id long, text string").coalesce(1)
    index = rs.build_index(docs, segment_bytes=500)
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in index.inputFiles()]
    assert index.count() == sum(m.num_row_groups for m in files) > 20
    got = rs.ranked(index, spark.createDataFrame([(1, "beta7 alpha")], "item_id long, text string"), k=1)
    assert [r.doc_id for r in got.collect()] == [7]
    assert held["index"] <= 1000 and held["found"] == 1 and spark.conf.get(key) == before
