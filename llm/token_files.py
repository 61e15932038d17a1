"""Token ids in flat binary files that training jobs map into memory.

A data set is a folder with, per range slice of the documents, ``<part>.bin``
(ids, little-endian unsigned 16 or 32 bits), ``<part>.idx`` (64-bit offsets of its documents
inside the part, and the end) and ``<part>.ids`` (64-bit document ids), and a
Parquet ``manifest`` with each part's ``base``: the number of ids in all parts
before it, from prefix sums.
"""

from __future__ import annotations

import re
import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from panelspark.session import scratch_path

from .common import arrow_rows, documents, long_id, small_batches, texts_in, with_null_ids
from .registry import query

END_ID = 2
KINDS = {16: "<u2", 32: "<u4"}


# A text of these characters only is cut by PIECES, the pattern of the byte-level
# pre-tokenizer written for them; other texts are cut at blanks between other characters.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
OTHER = re.compile(rf"[^\x20-\x7E\n\r\t{LETTERS}]")
PIECES = re.compile(
    rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+"
)
CUT = re.compile(r"(?<=\S)(?= \S)")
# No line feed, and no white space at either end but one leading blank.
PLAIN = re.compile(r" ?\S(?:[^\n]*\S)?")


class Encoder:
    """Ids of texts, through a bounded cache of pieces.

    Pieces are encoded independently of their neighbours, so equal pieces get
    equal ids and each is encoded once. New pieces are encoded many at a time,
    a line feed between them: it is an id of its own there and tells them apart.
    Pieces that begin or end with white space which a line feed could join are encoded singly.

    With ``special_ids`` the strings of special tokens get those tokens' ids, as
    the library has it by default; else they are ordinary text. A text that holds
    the string of any added token is encoded whole, by the library alone.
    """

    LIMIT = 600_000  # pieces kept, some 200 bytes each

    def __init__(self, path: str, dtype: str, special_ids: bool = True):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special_ids
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if special_ids or not t.special]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.dtype = np.dtype(dtype)
        self.pieces: dict[str, bytes] = {}
        self.feed = self.whole("\n")[0]

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def learn(self, new: set[str]) -> None:
        plain, odd = [], []
        for piece in new:
            (plain if PLAIN.fullmatch(piece) else odd).append(piece)
        width = self.dtype.itemsize
        for at in range(0, len(plain), 20_000):
            some = plain[at : at + 20_000]
            ids = np.array(self.whole("\n".join(some)), self.dtype)
            feeds = np.flatnonzero(ids == self.feed) * width
            if len(feeds) != len(some) - 1:
                raise AssertionError("pieces and ids don't match")
            coded = ids.tobytes()
            begins, ends = [0, *(feeds + width).tolist()], [*feeds.tolist(), len(coded)]
            self.pieces.update(zip(some, [coded[b:e] for b, e in zip(begins, ends)]))
        for piece in odd:
            self.pieces[piece] = np.array(self.whole(piece), self.dtype).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        holds = {k for k, t in enumerate(texts) if self.added and self.added.search(t)}
        cut = [(CUT.split(t) if OTHER.search(t) else PIECES.findall(t)) if t and k not in holds else [] for k, t in enumerate(texts)]
        if len(self.pieces) > self.LIMIT:
            self.pieces.clear()
        new = set().union(*cut).difference(self.pieces)
        if new:
            self.learn(new)
        return [
            np.array(self.whole(texts[k]), self.dtype).tobytes() if k in holds else b"".join(map(self.pieces.__getitem__, pieces))
            for k, pieces in enumerate(cut)
        ]


def kept_encoder(path: str, dtype: str, special_ids: bool) -> Encoder:
    """The encoder of this Python process, with the pieces that its earlier tasks have learned.

    What tasks carry with their code is made anew for each, so the encoder is kept in a module of its own.
    """
    kept = vars(sys.modules.setdefault("kept_encoders", types.ModuleType("kept_encoders")))
    key = f"{path} {dtype} {special_ids}"
    if key not in kept:
        kept[key] = Encoder(path, dtype, special_ids)
    return kept[key]


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def write_token_files(
    docs: DataFrame,
    out: str,
    tokenizer: str,
    order: list[str | Column] | None = None,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    id_bits: int = 16,
    special_ids: bool = True,
) -> DataFrame:
    """Write ``docs`` in the given order (by default by id) and return the manifest.

    Rows are range partitioned and sorted, so a part is written front to back by
    one task that holds a few MB of texts at a time. Files carry the name of the
    attempt that wrote them and only those of the attempt that succeeded are
    listed, so tasks may fail, be repeated or run twice. ``out`` must be a folder
    all executors reach (a mounted one, or any store pyarrow knows).

    A special token's string in a text is that token's id, without ``special_ids``
    ordinary text. A null or empty text is one end id. Repeated rows are written as often as
    they occur, rows without id come first. An empty table gives an empty manifest.
    """
    dtype = KINDS[id_bits]
    order = order or [id_col]
    spark = docs.sparkSession
    keys = {f"_order{k}": F.col(c) if isinstance(c, str) else c for k, c in enumerate(order)}
    rows = docs.select(
        long_id(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        *[c.alias(k) for k, c in keys.items()],
    )
    sliced = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    end = np.array([end_id], dtype).tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part = TaskContext.get().partitionId()
        name = f"{out}/part-{part:06d}-{uuid.uuid4().hex}"
        store, place = file_system(name)
        store.create_dir(place.rsplit("/", 1)[0], recursive=True)
        width, docs_written, at = len(end), 0, 0
        encoder = kept_encoder(tokenizer, dtype, special_ids)
        with store.open_output_stream(place + ".bin") as bins, store.open_output_stream(place + ".idx") as idx, store.open_output_stream(place + ".ids") as ids:
            for batch in batches:
                for some, texts in texts_in(batch, 1 << 20):
                    coded = [c + end for c in encoder.encode([t.decode() for t in texts])]
                    lengths = np.array([len(c) // width for c in coded], "<i8")
                    bins.write(b"".join(coded))
                    idx.write((at + np.cumsum(lengths) - lengths).astype("<i8").tobytes())
                    ids.write(np.array(some, "<i8").tobytes())
                    docs_written += len(some)
                    at += int(lengths.sum())
            idx.write(np.array([at], "<i8").tobytes())
        if docs_written:
            yield {"part": [part], "path": [name], "docs": [docs_written], "ids": [at]}

    schema = pa.schema([("part", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])
    listed = sliced.mapInArrow(arrow_rows(write, schema), "part long, path string, docs long, ids long")
    with small_batches(spark):
        listed.write.parquet(f"{out}/written")
    so_far = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = spark.read.schema("part long, path string, docs long, ids long").parquet(f"{out}/written")
    # One row per part, at most spark.sql.shuffle.partitions.
    based = parts.withColumns({
        "base": F.coalesce(F.sum("ids").over(so_far), F.lit(0)),
        "first_doc": F.coalesce(F.sum("docs").over(so_far), F.lit(0)),
        "id_bits": F.lit(id_bits),
    })
    based.coalesce(1).write.parquet(f"{out}/manifest")
    return open_manifest(spark, out)


MANIFEST = "part long, path string, docs long, ids long, base long, first_doc long, id_bits int"


def open_manifest(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{out}/manifest")


def mapped(path: str, dtype: str) -> np.ndarray:
    """A file as an array: memory-mapped if it is local or mounted, else read."""
    store, place = file_system(path)
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(place, dtype, "r") if store.get_file_info(place).size else np.empty(0, dtype)
    with store.open_input_file(place) as f:
        return np.frombuffer(f.read(), dtype)


def read_token_files(spark: SparkSession, out: str, bits: int | None = None) -> DataFrame:
    """Per document of a data set: doc_id, position, start, n_tokens, ids and id_bits.

    ``ids`` are bytes as stored, or with ``bits`` (at least the stored ones) ids of that width.
    """
    manifest = open_manifest(spark, out)
    spread = manifest.repartition(max(1, manifest.count()), "part")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                dtype, width = KINDS[row["id_bits"]], bits or row["id_bits"]
                if width < row["id_bits"]:
                    raise ValueError(f"ids of {row['id_bits']} bits don't fit in {width}")
                ids, idx, doc_ids = (mapped(row["path"] + s, d) for s, d in ((".bin", dtype), (".idx", "<i8"), (".ids", "<i8")))
                for at in range(0, row["docs"], 1000):
                    stop = min(at + 1000, row["docs"])
                    bounds = np.asarray(idx[at : stop + 1])
                    some, cuts = np.asarray(ids[bounds[0] : bounds[-1]]).astype(KINDS[width], copy=False), bounds - bounds[0]
                    yield {
                        "doc_id": np.asarray(doc_ids[at:stop]), "position": row["first_doc"] + np.arange(at, stop),
                        "start": row["base"] + bounds[:-1], "n_tokens": np.diff(bounds),
                        "ids": [some[a:b].tobytes() for a, b in zip(cuts, cuts[1:])],
                        "id_bits": np.full(stop - at, width, np.int32),
                    }

    schema = pa.schema([
        ("doc_id", pa.int64()), ("position", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
        ("ids", pa.binary()), ("id_bits", pa.int32()),
    ])
    kinds = "doc_id long, position long, start long, n_tokens long, ids binary, id_bits int"
    return with_null_ids(spread.mapInArrow(arrow_rows(read, schema), kinds))


def ids_crc32(ids: str, bits: str) -> Column:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers.

    An expression: a function in Python would need a second Python worker beside the one that reads the files.
    Ids of 16 bits are widened here in hexadecimal, so many of them are better read with 32.
    """
    wide = F.unhex(F.regexp_replace(F.hex(ids), "(.{4})", "$10000"))
    return F.crc32(F.when(F.col(bits) == 32, F.col(ids)).otherwise(wide))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op5_token_files")
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "tokens")
    write_token_files(documents(spark, sf_dir), out, default_tokenizer())
    return read_token_files(spark, out, bits=32).select(
        "doc_id", "start", "n_tokens", ids_crc32("ids", "id_bits").alias("ids_crc32"), "position"
    )
