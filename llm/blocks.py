"""Documents packed into blocks of a few MB, kept as a bucketed table.

A block is the unit of work of operators that look at texts several times. The
table is bucketed by block, so what such an operator learns about a block is
joined to its texts without moving the texts again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import arrow_rows, id_and_text, texts_in

BLOCK_BYTES = 2 << 20
SCHEMA = pa.schema([("block", pa.int64()), ("doc_ids", pa.binary()), ("sizes", pa.binary()), ("body", pa.binary())])


def text_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Table (block, doc_ids, sizes, body): ids and byte lengths as arrays, texts compressed.

    A block holds about ``block_bytes`` bytes of text, more only if a single text
    is longer. The table lies in the warehouse, which all executors share, and
    stays there until it is dropped.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part, made = TaskContext.get().partitionId(), 0
        press = zstandard.ZstdCompressor(level=3)
        ids: list[int] = []
        texts: list[bytes] = []
        size = 0

        def full() -> dict:
            return {
                "block": [(part << 32) + made], "doc_ids": [np.array(ids, "<i8").tobytes()],
                "sizes": [np.array([len(t) for t in texts], "<i8").tobytes()], "body": [press.compress(b"".join(texts))],
            }

        for batch in batches:
            for some_ids, some in texts_in(batch, min(block_bytes, 256 << 10)):
                ids += some_ids
                texts += some
                size += sum(map(len, some))
                if size >= block_bytes:
                    yield full()
                    ids, texts, size, made = [], [], 0, made + 1
        if ids:
            yield full()

    packed = id_and_text(docs, id_col, text_col).mapInArrow(
        arrow_rows(pack, SCHEMA), "block long, doc_ids binary, sizes binary, body binary"
    )
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"text_blocks_{uuid.uuid4().hex}"
    # The bodies are compressed already.
    writer = packed.repartition(buckets, "block").write.bucketBy(buckets, "block").option("compression", "none")
    writer.format("parquet").saveAsTable(name)
    return spark.table(name)


def with_lists(blocks: DataFrame, rows: DataFrame) -> DataFrame:
    """``blocks`` plus, per further column of ``rows`` (block, ...), the list of its values (null if none)."""
    cols = [c for c in rows.columns if c != "block"]
    lists = rows.groupBy("block").agg(*[F.collect_list(c).alias(c) for c in cols])
    return blocks.join(lists, "block", "left")


def unpack(doc_ids: bytes, sizes: bytes, body: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(ids, start of each text and the end, all texts as one byte string)."""
    lengths = np.frombuffer(sizes, "<i8")
    starts = np.concatenate([[0], np.cumsum(lengths)])
    text = zstandard.ZstdDecompressor().decompress(body, max_output_size=int(starts[-1]) or 1) if starts[-1] else b""
    return np.frombuffer(doc_ids, "<i8"), starts, text


def block_rows(batches: Iterator[pa.RecordBatch], lists: int = 0) -> Iterator[tuple]:
    """(block, ids, starts, text, list columns as arrays) of each row of :func:`with_lists`."""
    for batch in batches:
        for i in range(batch.num_rows):
            packed = [batch.column(k)[i].as_py() for k in range(1, 4)]
            extra = []
            for k in range(4, 4 + lists):
                value = batch.column(k)[i]
                extra.append(value.values.to_numpy(zero_copy_only=False) if value.is_valid else np.empty(0, np.int64))
            yield int(batch.column(0)[i].as_py()), *unpack(*packed), *extra


# Spread over the 64 bits; fixed odd numbers.
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of neighbouring windows from theirs, elementwise; order matters."""
    x = left * _A
    x += right
    x ^= x >> np.uint64(32)
    x *= _B
    x ^= x >> np.uint64(29)
    return x


def window_hashes(symbols: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` symbols from each place on (as many as fit), by doubling."""
    n = len(symbols) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, size, done, total = symbols, 1, 0, None
    while True:
        if length & size:
            piece = power[done : done + n]
            total = piece if total is None else joined(total, piece)
            done += size
        if size * 2 > length:
            return total if len(total) == n else total[:n]
        power = joined(power[:-size], power[size:])
        size *= 2


def sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` (minimum or maximum) of ``width`` values from each place on."""
    size = 1
    while size * 2 <= width:
        values = best(values[:-size], values[size:]) if len(values) > size else values[:0]
        size *= 2
    rest = width - size
    return values if not rest else best(values[:-rest], values[rest:]) if len(values) > rest else values[:0]


def fits(starts: np.ndarray, n: int, length: int) -> np.ndarray:
    """For each of the first ``n`` places: does a window of ``length`` stay inside its document?"""
    good = np.zeros(n, bool)
    first = np.diff(starts) - length + 1
    places = np.zeros(n + 1, np.int64)
    ok = first > 0
    np.add.at(places, starts[:-1][ok], 1)
    np.add.at(places, np.minimum(starts[:-1][ok] + first[ok], n), -1)
    good[:] = np.cumsum(places[:-1]) > 0
    return good


def anchors(grams: np.ndarray, inside: np.ndarray, window_fits: np.ndarray, width: int) -> np.ndarray:
    """Places whose gram is least among the ``width`` grams of some window.

    ``grams``: hash per place, ``inside``: the gram lies in one document,
    ``window_fits``: a whole window (``width`` grams) starts here and lies in
    one document. Equal windows have equal anchors, so of a repeated window at
    least one gram is an anchor in every copy.
    """
    if not window_fits.any():
        return np.empty(0, np.int64)
    order = np.where(inside, grams, np.uint64(2**64 - 1))
    least = sliding(order, width, np.minimum)
    n = len(least)
    least = np.where(window_fits[:n], least, np.uint64(0))
    # The greatest minimum among the windows that hold a place: equal to its gram if it is an anchor.
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(len(order) - n, np.uint64)])
    return np.flatnonzero((sliding(padded, width, np.maximum) == order) & inside)
