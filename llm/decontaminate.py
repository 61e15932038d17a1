"""Benchmark items in documents: SimHash of item-sized windows, Hamming blocks, exact similarity."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import (
    WordHashes, arrow_rows, documents, id_and_text, landed, long_id, shingle_hashes, text_keys, texts_in, with_null_ids, without, words_of,
)
from .registry import query

BITS = 64
BLOCK_BITS = 8  # 8 blocks; a radius of 15 leaves one block within distance 1
RADIUS = 15
STRETCH = 1 << 14  # windows fingerprinted at a time
QUERY_BYTES = 4 << 20  # benchmark text held by a task at a time


def votes(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each hash, as n x 64."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int8) * 2 - 1


def packed(totals: np.ndarray) -> np.ndarray:
    """Fingerprint of each row of vote totals: bit set where the total is positive."""
    return np.packbits(totals > 0, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def window_fingerprints(shingles: np.ndarray, first: int, last: int, length: int) -> np.ndarray:
    """SimHash of ``length`` consecutive shingles from each place ``first`` <= p < ``last``."""
    sums = np.cumsum(votes(shingles[first : last - 1 + length]), axis=0, dtype=np.int32)
    sums = np.concatenate([np.zeros((1, BITS), np.int32), sums])
    return packed(sums[length:] - sums[:-length])


@dataclass
class Items:
    """Items of one window size and the index of their fingerprints."""

    ids: list[int]
    bags: list[Counter]
    prints: np.ndarray
    tables: list[dict[int, list[int]]]  # per block: value -> items whose block is within distance 1


def block_tables(prints: np.ndarray) -> list[dict[int, list[int]]]:
    tables = []
    for b in range(BITS // BLOCK_BITS):
        table: dict[int, list[int]] = defaultdict(list)
        for item, value in enumerate((prints >> np.uint64(b * BLOCK_BITS)) & np.uint64(255)):
            for near in [int(value), *(int(value) ^ (1 << k) for k in range(BLOCK_BITS))]:
                table[near].append(item)
        tables.append(dict(table))
    return tables


def within_radius(windows: np.ndarray, prints: np.ndarray, tables: list[dict[int, list[int]]], radius: int) -> Iterator[tuple[int, int]]:
    """(window, item) for all fingerprints at most ``radius`` apart.

    Of 8 blocks that differ in at most 15 bits one differs in at most 1, so
    every such pair meets in a block's table; its whole distance is counted then.
    """
    if radius >= 2 * len(tables):
        raise ValueError(f"a radius of {radius} needs more than {len(tables)} blocks")
    met: set[tuple[int, int]] = set()
    for b, table in enumerate(tables):
        values = (windows >> np.uint64(b * BLOCK_BITS)) & np.uint64(255)
        for value, items in table.items():
            at = np.flatnonzero(values == value)
            for item in items if len(at) else ():
                near = at[np.bitwise_count(windows[at] ^ prints[item]) <= radius]
                met.update((int(w), item) for w in near)
    yield from sorted(met)


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity: shingles weigh as often as they occur."""
    low = sum(min(n, b[k]) for k, n in a.items() if k in b)
    return low / (sum(a.values()) + sum(b.values()) - low)


def index_items(items: list[tuple[int, str]], shingle: int) -> tuple[dict[int, Items], dict[int, set[int]]]:
    """(items by their number of words, shingle -> numbers of words of the items that hold it)."""
    hashes = WordHashes()
    by_size: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
    sizes_of: dict[int, set[int]] = defaultdict(set)
    for item_id, text in items:
        words = hashes.of(words_of(text, lower=True))
        if not len(words):
            continue
        shingles = shingle_hashes(words, shingle)
        by_size[len(words)].append((item_id, shingles))
        for s in shingles.tolist():
            sizes_of[s].add(len(words))
    index = {}
    for size, some in by_size.items():
        prints = np.concatenate([packed(votes(s).sum(axis=0, dtype=np.int32)[None]) for _, s in some])
        index[size] = Items([i for i, _ in some], [Counter(s.tolist()) for _, s in some], prints, block_tables(prints))
    return index, dict(sizes_of)


def document_matches(
    words: np.ndarray, index: dict[int, Items], sizes_of: dict[int, set[int]], known: np.ndarray, sieve: np.ndarray,
    shingle: int, radius: int, least: float,
) -> dict[int, tuple[float, int, int]]:
    """item id -> (best similarity, its first word, number of matching windows) for one document.

    Windows that share no shingle with an item of their size have similarity 0
    and are not fingerprinted; the others all are.
    """
    found: dict[int, tuple[float, int, int]] = {}
    cache: dict[int, np.ndarray] = {}

    def shingles_of(size: int) -> np.ndarray:
        width = min(size, shingle, len(words))
        if width not in cache:
            cache[width] = shingle_hashes(words, width)
        return cache[width]

    per_size: dict[int, list[int]] = defaultdict(list)
    for width in {min(size, shingle, len(words)) for size in index}:
        own = shingles_of(width)
        maybe = np.flatnonzero(sieve[(own >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(known, own[maybe]), len(known) - 1)
        hits = maybe[known[at] == own[maybe]]
        for p in hits.tolist():
            for size in sizes_of[int(own[p])]:
                if min(size, shingle, len(words)) == width:
                    per_size[size].append(p)
    for size, hits in sorted(per_size.items()):
        items, own = index[size], shingles_of(size)
        length = min(max(1, size - shingle + 1), len(own))  # shingles of a window
        first = np.maximum(np.array(hits) - length + 1, 0)
        last = np.minimum(np.array(hits), len(own) - length)
        begin, end = None, -1
        stretches = []
        for a, b in zip(first.tolist(), last.tolist()):  # hits ascend, so stretches do
            if begin is not None and a <= end:
                end = max(end, b + 1)
            else:
                if begin is not None:
                    stretches.append((begin, end))
                begin, end = a, b + 1
        stretches.append((begin, end))
        for a, b in stretches:
            for at in range(a, b, STRETCH):
                stop = min(b, at + STRETCH)
                prints = window_fingerprints(own, at, stop, length)
                for w, item in within_radius(prints, items.prints, items.tables, radius):
                    near = similarity(Counter(own[at + w : at + w + length].tolist()), items.bags[item])
                    if near >= least:
                        best, where, n = found.get(items.ids[item], (0.0, 0, 0))
                        found[items.ids[item]] = (near, at + w, n + 1) if near > best else (best, where, n + 1)
    return found


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The best of :func:`row_matches` per document and benchmark item: doc_id, item_id, similarity, first_word, n_windows.

    Rows without id, and rows that repeat one, give the best of their matches.
    """
    best = F.max(F.struct("similarity", -F.col("first_word"))).alias("best")
    found = row_matches(docs, benchmark, **options)
    matches = found.groupBy("doc_id", "item_id").agg(best, F.sum("n_windows").alias("n_windows")).select(
        "doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.col2")).alias("first_word"), "n_windows"
    )
    return with_null_ids(matches, "doc_id", "item_id")


def row_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    shingle: int = 5,
    radius: int = RADIUS,
    least: float = 0.8,
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """One row per row of ``docs`` and benchmark item it holds: doc_id, text_key, item_id, similarity, first_word, n_windows.

    An item of n words is looked for in all windows of n words (A-Z lower-cased);
    a document of fewer words is one window. A window matches if its 64-bit
    SimHash lies within ``radius`` of the item's and the weighted Jaccard
    similarity of their ``shingle``-word shingles is ``least`` or more.

    The benchmark is the query set: it is cut into parts of about
    ``query_bytes`` and every part is sent to the tasks and run against all
    documents, so what a task holds does not grow with it.

    Null, empty and blank texts and items match nothing. Equal items match
    alike; null ids are NO_ID. Empty tables give no rows.
    """
    spark = docs.sparkSession
    items = benchmark.select(
        long_id(item_col).alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text")
    )
    items = landed(items, "items")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    parts = max(1, -(-total // query_bytes))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("n_windows", pa.int64())])
    plain = id_and_text(docs, id_col, text_col)
    found = None
    for k in range(parts):
        some = [(r.item_id, r.text) for r in items.where(part == k).collect()]
        sent = spark.sparkContext.broadcast(some)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[dict]:
            index, sizes_of = index_items(sent.value, shingle)
            known = np.sort(np.array(list(sizes_of), np.uint64))
            sieve = np.zeros(1 << 20, bool)
            sieve[(known >> np.uint64(44)).astype(np.int64)] = True
            hashes = WordHashes()
            for batch in batches:
                for ids, texts in texts_in(batch):
                    rows = []
                    for doc_id, text in zip(ids, texts):
                        words = hashes.of(words_of(text, lower=True))
                        if len(words) and index:
                            got = document_matches(words, index, sizes_of, known, sieve, shingle, radius, least)
                            rows += [(doc_id, text_keys([text])[0], item, *match) for item, match in sorted(got.items())]
                    if rows:
                        yield dict(zip(schema.names, map(list, zip(*rows))))

        got = plain.mapInArrow(arrow_rows(run, schema), "doc_id long, text_key long, item_id long, similarity double, first_word long, n_windows long")
        found = got if found is None else found.unionByName(got)
    return found


def without_benchmark(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item."""
    return without(docs, row_matches(docs, benchmark, **options), options.get("id_col", "doc_id"), options.get("text_col", "text"))


@query("op1_simhash_windows")
def op1_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return benchmark_matches(documents(spark, sf_dir), benchmark)
