"""Repeated byte strings between documents, by bucket-pointer refinement of sampled suffixes.

Suffixes fall into buckets by their first 24 bytes. Buckets are refined in rounds by the
identifiers of the buckets that their members have at other offsets; identifiers
of longer strings are made from those of shorter ones, so each is computed once
and reused.

1. The identifiers at four offsets together name all 76 bytes that a 50-byte string around the
   place can reach. Members that agree on them are settled by their least document.
2. The others are split by the identifiers 13 bytes on and 13 bytes back, which name 37 bytes each. A 50-byte string
   that holds the place holds one of the two, so a member that shares neither with another document is done.
3. What is left is split by all windows of 50 bytes around the place, the length at which refinement ends.

Only anchors enter: the least 24-byte bucket of every 50-byte window, one place in 14; a
50-byte string has the same anchor wherever it occurs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .blocks import anchors, block_rows, joined, text_blocks, window_hashes, with_lists
from .common import arrow_rows, documents, landed, mix, signed, with_null_ids
from .registry import query

LENGTH, GRAM = 50, 24
BEFORE = LENGTH - GRAM  # bytes before an anchor that a string holding it can reach
REACH = BEFORE + LENGTH
HALF = BEFORE // 2
EDGES = 2  # bytes before a packed context: how many of its places lie before the document, how many after
CROWD = 50_000  # contexts of one bucket that a task compares in memory

# One 64-bit name per byte value, and one for places outside the text.
NAMES = mix(np.arange(1, 258, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
OUTSIDE = 256


def padded(starts: np.ndarray, text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(byte values with LENGTH places outside between documents, place of each byte's document in it)."""
    n_docs = len(starts) - 1
    symbols = np.full(len(text) + (n_docs + 1) * LENGTH, OUTSIDE, np.uint16)
    raw = np.frombuffer(text, np.uint8)
    owner = np.repeat(np.arange(n_docs), np.diff(starts))
    symbols[np.arange(len(raw)) + (owner + 1) * LENGTH] = raw
    return symbols, starts[:-1] + (np.arange(n_docs) + 1) * LENGTH


def anchor_buckets(starts: np.ndarray, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every place, anchors, document of each, bucket, refined bucket); the last two as 32-bit identifiers."""
    symbols, first = padded(starts, text)
    grams = window_hashes(NAMES[symbols], GRAM)
    lengths = np.diff(starts)

    def inside(length: int) -> np.ndarray:
        edges = np.zeros(len(grams) + 1, np.int8)
        long_enough = lengths >= length
        np.add.at(edges, first[long_enough], 1)
        np.add.at(edges, first[long_enough] + lengths[long_enough] - length + 1, -1)
        return np.cumsum(edges[:-1], dtype=np.int8) > 0

    places = anchors(grams, inside(GRAM), inside(LENGTH), LENGTH - GRAM + 1)
    document = np.searchsorted(first, places, side="right") - 1
    bucket = grams[places]
    # The buckets at these four offsets together name all bytes in reach.
    first_two = joined(grams[places - BEFORE], grams[places - BEFORE + GRAM])
    refined = joined(first_two, joined(grams[places - BEFORE + 2 * GRAM], grams[places + LENGTH - GRAM]))
    return grams, places, document, (bucket >> np.uint64(32)).astype(np.uint32), (refined >> np.uint64(32)).astype(np.uint32)


def keys_of(bucket: np.ndarray, refined: np.ndarray) -> np.ndarray:
    return signed((bucket.astype(np.uint64) << np.uint64(32)) | refined)


def least_documents(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, least id of each, group of each row)."""
    distinct, group = np.unique(keys, return_inverse=True)
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(least, group, ids)
    return distinct, least, group


def first_buckets(blocks: DataFrame) -> DataFrame:
    """One row per block and refined bucket: block, bucket, refined, least doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for block, ids, starts, text in block_rows(batches):
            _, places, document, bucket, refined = anchor_buckets(starts, text)
            if len(places):
                keys, least, _ = least_documents(keys_of(bucket, refined), ids[document])
                names = keys.view(np.uint64)
                yield {
                    "block": np.full(len(keys), block), "bucket": (names >> np.uint64(32)).astype(np.uint32).view(np.int32),
                    "refined": names.astype(np.uint32).view(np.int32), "doc_id": least,
                }

    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("refined", pa.int32()), ("doc_id", pa.int64())])
    return blocks.mapInArrow(arrow_rows(run, schema), "block long, bucket int, refined int, doc_id long")


def packed_contexts(symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The bytes in reach of each anchor, n x (EDGES + REACH); places outside the document are 0 and counted in front."""
    around = symbols[places[:, None] + np.arange(-BEFORE, LENGTH)[None, :]]
    outside = around == OUTSIDE
    edges = np.stack([outside[:, :BEFORE].sum(axis=1), outside[:, BEFORE:].sum(axis=1)], axis=1)
    return np.concatenate([edges, np.where(outside, 0, around)], axis=1).astype(np.uint8)


def unpacked_contexts(contexts: list[bytes]) -> np.ndarray:
    """Symbols of packed contexts, n x REACH."""
    packed = np.frombuffer(b"".join(contexts), np.uint8).reshape(-1, EDGES + REACH)
    place = np.arange(REACH)
    outside = (place < packed[:, :1]) | (place >= REACH - packed[:, 1:EDGES])
    return np.where(outside, np.uint16(OUTSIDE), packed[:, EDGES:])


def settled_and_open(blocks: DataFrame, shared: DataFrame, crowd: int) -> DataFrame:
    """Spans settled by equal surroundings, one row per block (``spans``), and the anchors still open.

    An open row is an anchor whose document is the first with these surroundings,
    in a bucket that has others: block, place, doc_id, bucket, ahead and behind
    (its names with the bucket HALF bytes on and back), crowded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for block, ids, starts, text, keys, firsts, sizes in block_rows(batches, lists=3):
            grams, places, document, bucket, refined = anchor_buckets(starts, text)
            if not len(places):
                continue
            mine, least, group = least_documents(keys_of(bucket, refined), ids[document])
            n_others = np.zeros(len(mine), np.int64)
            if len(keys):
                at = np.searchsorted(mine, keys)
                least[at] = np.minimum(least[at], firsts)
                n_others[at] = sizes
            own = places - (document + 1) * LENGTH  # place in the text of the block
            begin, end = starts[document], starts[document + 1]
            known = least[group] < ids[document]
            spans = np.stack([np.maximum(own - BEFORE, begin), np.minimum(own + LENGTH, end)], axis=1)[known]
            still = np.flatnonzero(~known & (n_others[group] > 0))
            n = len(still) + bool(len(spans))
            if not n:
                continue
            at = places[still]
            ahead, behind = joined(grams[at], grams[at + HALF]), joined(grams[at - HALF], grams[at])
            none = [None] * bool(len(spans))
            yield {
                "block": np.full(n, block), "spans": [spans.astype("<i8").tobytes()] * len(none) + [None] * len(still),
                "place": none + own[still].tolist(), "doc_id": none + ids[document[still]].tolist(),
                "bucket": none + bucket[still].view(np.int32).tolist(),
                "ahead": none + (ahead >> np.uint64(32)).astype(np.uint32).view(np.int32).tolist(),
                "behind": none + (behind >> np.uint64(32)).astype(np.uint32).view(np.int32).tolist(),
                "crowded": none + (n_others[group[still]] > crowd).tolist(),
            }

    schema = pa.schema([
        ("block", pa.int64()), ("spans", pa.binary()), ("place", pa.int64()), ("doc_id", pa.int64()), ("bucket", pa.int32()),
        ("ahead", pa.int32()), ("behind", pa.int32()), ("crowded", pa.bool_()),
    ])
    kinds = "block long, spans binary, place long, doc_id long, bucket int, ahead int, behind int, crowded boolean"
    return with_lists(blocks, shared).mapInArrow(arrow_rows(run, schema), kinds)


def still_open(open_rows: DataFrame) -> DataFrame:
    """The open anchors that share 37 bytes, ahead or behind, with one of another document: block, place, bucket, crowded."""
    def shared(name: str) -> Column:
        alike = Window.partitionBy("bucket", name)
        return F.min("doc_id").over(alike) < F.max("doc_id").over(alike)

    dealt = open_rows.select("bucket", "ahead", "behind", "doc_id", "block", "place", "crowded").repartition("bucket")
    judged = dealt.withColumn("is_ahead", shared("ahead")).withColumn("is_behind", shared("behind"))
    return judged.where("is_ahead OR is_behind").select("block", "place", "bucket", "crowded")


def with_contexts(blocks: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (block, place, bucket, crowded) with their doc_id and context (:func:`packed_contexts`), cut from the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for block, ids, starts, text, place, bucket, crowded in block_rows(batches, lists=3):
            if not len(place):
                continue
            symbols, _ = padded(starts, text)
            document = np.searchsorted(starts, place, side="right") - 1
            contexts = packed_contexts(symbols, place + (document + 1) * LENGTH)
            yield {
                "block": np.full(len(place), block), "place": place, "doc_id": ids[document], "bucket": bucket,
                "context": [c.tobytes() for c in contexts], "crowded": np.asarray(crowded, bool),
            }

    schema = pa.schema([
        ("block", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), ("bucket", pa.int32()), ("context", pa.binary()), ("crowded", pa.bool_()),
    ])
    kinds = "block long, place long, doc_id long, bucket int, context binary, crowded boolean"
    return with_lists(blocks, rows).mapInArrow(arrow_rows(run, schema), kinds)


def context_windows(contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of the 27 windows of each context, n x 27, and which lie inside the document.

    Column o is the string that starts o places before the anchor.
    """
    symbols = unpacked_contexts(contexts)
    names = window_hashes(NAMES[symbols].ravel(), LENGTH)
    at = np.arange(len(symbols))[:, None] * REACH + BEFORE - np.arange(BEFORE + 1)[None, :]
    outside = np.concatenate([np.zeros((len(symbols), 1), np.int64), np.cumsum(symbols == OUTSIDE, axis=1)], axis=1)
    start = BEFORE - np.arange(BEFORE + 1)
    return signed(names)[at], outside[:, start + LENGTH] == outside[:, start]


def reach(seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes before, bytes after the anchor) covered by the windows marked in each row; 0, 0 if none."""
    any_seen = seen.any(axis=1)
    most = BEFORE - np.argmax(seen[:, ::-1], axis=1)
    least = np.argmax(seen, axis=1)
    return np.where(any_seen, most, 0), np.where(any_seen, LENGTH - least, 0)


def refine(open_rows: DataFrame) -> DataFrame:
    """(block, place, before, after) for anchors that share a string with an earlier document.

    All contexts of a bucket meet in one task and are compared there, some whole
    buckets at a time. Crowded buckets are not gathered: each of
    their windows is a row, and rows of equal windows are compared by a
    window function that spills.
    """
    def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if len(held) >= 4096 and held[-1]["bucket"] != row["bucket"]:
                    yield held
                    held = []
                held.append(row)
        if held:
            yield held

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for rows in whole_buckets(batches):
            names, good = context_windows([r["context"] for r in rows])
            ids = np.array([r["doc_id"] for r in rows])
            at = np.nonzero(good)
            _, least, group = least_documents(names[at], ids[at[0]])
            seen = np.zeros(good.shape, bool)
            seen[at] = least[group] < ids[at[0]]
            before, after = reach(seen)
            hit = np.flatnonzero(after)
            yield {
                "block": [rows[i]["block"] for i in hit], "place": [rows[i]["place"] for i in hit],
                "before": before[hit], "after": after[hit],
            }

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                rows = batch.slice(at, 4096).to_pylist()
                names, good = context_windows([r["context"] for r in rows])
                row, o = np.nonzero(good)
                yield {
                    "block": [rows[i]["block"] for i in row], "place": [rows[i]["place"] for i in row],
                    "doc_id": [rows[i]["doc_id"] for i in row], "o": o.astype(np.int64), "name": names[row, o],
                }

    found = pa.schema([("block", pa.int64()), ("place", pa.int64()), ("before", pa.int64()), ("after", pa.int64())])
    kinds = "block long, place long, before long, after long"
    cols = ["bucket", "block", "place", "doc_id", "context"]
    gathered = open_rows.where("NOT crowded").select(cols).repartition("bucket").sortWithinPartitions("bucket")
    compared = gathered.mapInArrow(arrow_rows(compare, found), kinds)
    rows = pa.schema([("block", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), ("o", pa.int64()), ("name", pa.int64())])
    windows = open_rows.where("crowded").select(cols).mapInArrow(arrow_rows(spread, rows), "block long, place long, doc_id long, o long, name long")
    first = F.min("doc_id").over(Window.partitionBy("name"))
    later = windows.withColumn("first", first).where("first < doc_id")
    crowded = later.groupBy("block", "place").agg(F.max("o").alias("before"), (F.lit(LENGTH) - F.min("o")).alias("after"))
    return compared.unionByName(crowded)


def repeated_strings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 2 << 20, crowd: int = CROWD
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed.

    Texts are UTF-8 bytes. A byte is removed if a string of 50 bytes of its
    document covers it that also starts in a document of smaller id; strings are
    judged on the whole input. ``removed`` lists the spans (first byte, end), and ``kept_sha256``
    is the digest of the other bytes.

    A block sends one row per refined bucket, so a passage in a third of all
    documents sends one row per block. Strings are compared by identifiers of
    64 bits in all (32 for the bucket, 32 for what surrounds it).

    Null and empty texts have no bytes; rows without id come before all others. Rows that repeat an id are one document:
    they do not remove each other's bytes. An empty table gives no rows. Only the two
    named columns are read.
    """
    blocks = text_blocks(docs, id_col, text_col, block_bytes)
    per_bucket, per_refined = Window.partitionBy("bucket"), Window.partitionBy("bucket", "refined")
    judged = first_buckets(blocks).select(
        "block", "bucket", "refined", "doc_id", F.min("doc_id").over(per_refined).alias("first"),
        F.min("refined").over(per_bucket).alias("low"), F.max("refined").over(per_bucket).alias("high"),
        F.count(F.lit(1)).over(per_bucket).alias("rows"),
    )
    key = F.expr("shiftleft(cast(bucket as long), 32) | (cast(refined as long) & 4294967295)")
    others = F.when(F.col("low") < F.col("high"), F.col("rows")).otherwise(F.lit(0))
    shared = judged.where("first < doc_id OR low < high").select("block", key.alias("key"), "first", others.alias("others"))
    judged_rows = landed(settled_and_open(blocks, shared, crowd), "strings")
    settled = judged_rows.where("spans IS NOT NULL").select("block", "spans")
    left = landed(with_contexts(blocks, still_open(judged_rows.where("spans IS NULL"))), "contexts")
    found = refine(left)
    pieces = found.groupBy("block").agg(
        F.collect_list("place").alias("place"), F.collect_list("before").alias("before"), F.collect_list("after").alias("after")
    )
    whole = blocks.join(pieces, "block", "left").join(settled, "block", "left")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            spans_column = batch.column(batch.num_columns - 1)
            for i, (_, ids, starts, text, place, before, after) in enumerate(block_rows([batch], lists=3)):
                spans = np.frombuffer(spans_column[i].as_py() or b"", "<i8").reshape(-1, 2)
                edges = np.zeros(len(text) + 1, np.int32)
                np.add.at(edges, np.concatenate([spans[:, 0], place - before]), 1)
                np.add.at(edges, np.concatenate([spans[:, 1], place + after]), -1)
                gone = np.cumsum(edges[:-1]) > 0
                out: dict[str, list] = {"doc_id": list(ids), "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "removed": []}
                for a, b in zip(starts, starts[1:]):
                    mask = gone[a:b]
                    cuts = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))).reshape(-1, 2)
                    mine = text[a:b]
                    kept = mine if not len(cuts) else np.frombuffer(mine, np.uint8)[~mask].tobytes()
                    out["n_bytes"].append(int(b - a))
                    out["n_removed"].append(int(mask.sum()))
                    out["n_spans"].append(len(cuts))
                    out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                    out["removed"].append([{"start": int(x), "end": int(y)} for x, y in cuts])
                yield out

    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
        ("kept_sha256", pa.string()), ("removed", pa.list_(span)),
    ])
    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>"
    return with_null_ids(whole.mapInArrow(arrow_rows(remove, schema), kinds))


@query("op2_bucket_pointers")
def op2_bucket_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_strings(documents(spark, sf_dir)).drop("removed")
