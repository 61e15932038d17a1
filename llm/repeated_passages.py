"""Repeated word sequences, found by level-wise doubling.

Windows of a short length that occur once can't be part of a longer repeat. So
only windows found twice at one length are extended to twice that length, until
the wanted length is reached. The first level takes a sample of the short windows that
hits every longer window in the same place (its least hash), which keeps it to
an eighth of all places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .blocks import anchors, block_rows, fits, text_blocks, window_hashes, with_lists
from .common import WordHashes, arrow_rows, documents, signed, with_null_ids
from .registry import query


def block_words(ids: np.ndarray, starts: np.ndarray, text: bytes, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of a block, first word of each document and the end)."""
    parts = [hashes.of(text[a:b].split()) for a, b in zip(starts, starts[1:])]
    counts = np.array([len(p) for p in parts])
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(counts)])


def least_places(keys: np.ndarray, docs: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(indices of the first occurrence of each distinct key by document and place, group of each row, counts)."""
    order = np.lexsort((places, docs, keys))
    sorted_keys = keys[order]
    new = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])
    group = np.empty(len(keys), np.int64)
    group[order] = np.cumsum(new) - 1
    return order[new], group, np.bincount(group)


def repeated_keys(rows: DataFrame) -> DataFrame:
    """(block, key) of the keys that occur twice or more; ``rows``: block, key, n, one row per block and key."""
    return rows.withColumn("all", F.sum("n").over(Window.partitionBy("key"))).where("all > 1").select("block", "key")


def candidates(words: np.ndarray, starts: np.ndarray, level: int, levels: list[int], keys: np.ndarray) -> np.ndarray:
    """Places of the windows of ``levels[level]`` words that may be repeated.

    Level 0: the least of the shortest windows in every full window. Later
    levels: windows that extend, to the right or to the left, a window of the
    level before whose key is among ``keys``; at the last level all that contain one.
    """
    length, full = levels[level], levels[-1]
    n = max(0, len(words) - length + 1)
    if level == 0:
        return anchors(window_hashes(words, length), fits(starts, n, length), fits(starts, n, full), full - length + 1)
    half = levels[level - 1]
    before = candidates_of_keys(words, starts, level - 1, levels, keys)
    shifts = np.arange(0, length - half + 1) if level == len(levels) - 1 else np.array([0, length - half])
    places = np.unique((before[:, None] - shifts[None, :]).ravel())
    places = places[(places >= 0) & (places < n)]
    return places[fits(starts, n, length)[places]] if n else places[:0]


def candidates_of_keys(words: np.ndarray, starts: np.ndarray, level: int, levels: list[int], keys: np.ndarray) -> np.ndarray:
    """Places, anywhere in the block, of windows whose key is among ``keys`` (sorted)."""
    length = levels[level]
    hashes = signed(window_hashes(words, length))
    if not len(hashes) or not len(keys):
        return np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.flatnonzero((keys[at] == hashes) & fits(starts, len(hashes), length))


def level_rows(blocks: DataFrame, level: int, levels: list[int]) -> DataFrame:
    """One row per block and candidate key: block, key, n (its places), first document and place in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hashes = WordHashes()
        for block, ids, starts, text, *found in block_rows(batches, lists=1 if level else 0):
            words, first_word = block_words(ids, starts, text, hashes)
            places = candidates(words, first_word, level, levels, np.sort(found[0]) if level else np.empty(0, np.int64))
            if not len(places):
                continue
            keys = signed(window_hashes(words, levels[level]))[places]
            owner = np.searchsorted(first_word, places, side="right") - 1
            within = places - first_word[owner]
            first, _, counts = least_places(keys, ids[owner], within)
            yield {
                "block": np.full(len(first), block), "key": keys[first], "n": np.minimum(counts, 2).astype(np.int32),
                "doc_id": ids[owner[first]], "place": within[first],
            }

    schema = pa.schema([("block", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("doc_id", pa.int64()), ("place", pa.int64())])
    return blocks.mapInArrow(arrow_rows(run, schema), "block long, key long, n int, doc_id long, place long")


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, shortest: int = 5, block_bytes: int = 2 << 20
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, n_spans, kept_sha256, removed.

    A word is removed if a window of ``window`` consecutive words of its document
    covers it whose words also start earlier: in a document of smaller id, or
    earlier in the same one. ``removed`` lists the spans (first word, end), and
    ``kept_sha256`` is the digest of the other words, joined by one blank.

    Within a block a repeated window is reduced to its first place, so a passage
    in a third of all documents sends one row per block. Windows are compared by
    64-bit hashes of their words.

    Null and empty texts have no words; rows without id come before all others. Rows that repeat an id are parts of one
    document that start alike: equal ones don't remove each other's words. An empty
    table gives no rows. Only the two named columns are read.
    """
    levels = [window]
    while levels[0] % 2 == 0 and levels[0] // 2 >= shortest:
        levels.insert(0, levels[0] // 2)
    blocks = text_blocks(docs, id_col, text_col, block_bytes)
    known = blocks
    for level in range(len(levels) - 1):
        repeated = repeated_keys(level_rows(known, level, levels).select("block", "key", "n"))
        known = with_lists(blocks, repeated)
    rows = level_rows(known, len(levels) - 1, levels)
    per_key = Window.partitionBy("key")
    judged = rows.select("block", "key", "n", "doc_id", "place", F.min(F.struct("doc_id", "place")).over(per_key).alias("first"), F.sum("n").over(per_key).alias("all"))
    repeats = judged.where("all > 1").select("block", "key", F.col("first.doc_id").alias("first_doc"), F.col("first.place").alias("first_place"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hashes = WordHashes()
        for _, ids, starts, text, keys, docs_first, places_first in block_rows(batches, lists=3):
            words, first_word = block_words(ids, starts, text, hashes)
            covered = np.zeros(len(words) + 1, np.int64)
            if len(keys):
                order = np.argsort(keys)
                keys, docs_first, places_first = keys[order], docs_first[order], places_first[order]
                hit = candidates_of_keys(words, first_word, len(levels) - 1, levels, keys)
                which = np.searchsorted(keys, signed(window_hashes(words, window))[hit])
                owner = np.searchsorted(first_word, hit, side="right") - 1
                later = (ids[owner] != docs_first[which]) | (hit - first_word[owner] != places_first[which])
                np.add.at(covered, hit[later], 1)
                np.add.at(covered, hit[later] + window, -1)
            gone = np.cumsum(covered[:-1]) > 0
            out: dict[str, list] = {"doc_id": list(ids), "n_words": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "removed": []}
            for k in range(len(ids)):
                a, b = first_word[k], first_word[k + 1]
                mask = gone[a:b]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                mine = text[starts[k] : starts[k + 1]].split()
                kept = mine if not len(edges) else [w for w, g in zip(mine, mask) if not g]
                out["n_words"].append(int(b - a))
                out["n_removed"].append(int(mask.sum()))
                out["n_spans"].append(len(edges) // 2)
                out["kept_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
                out["removed"].append([{"start": int(x), "end": int(y)} for x, y in edges.reshape(-1, 2)])
            yield out

    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
        ("kept_sha256", pa.string()), ("removed", pa.list_(span)),
    ])
    kinds = "doc_id long, n_words long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>"
    return with_null_ids(with_lists(blocks, repeats).mapInArrow(arrow_rows(remove, schema), kinds))


@query("op9_doubled_windows")
def op9_doubled_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir)).drop("removed")
