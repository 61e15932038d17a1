"""What several operators share: words, hashes, scratch tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelspark.session import scratch_path

# Words are runs of anything but the six ASCII white-space characters, as a Java pattern.
SPACE_PATTERN = r"[\x20\x09-\x0D]+"

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def landed(df: DataFrame, label: str, **options: object) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: evaluated once, safe from lost executors. ``options`` are the writer's."""
    path = scratch_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.landed_at = path
    return out


def freed(*frames: DataFrame) -> None:
    """Delete the files of landed frames that nothing is read from any more; other frames are left alone."""
    for df in frames:
        if at := df.__dict__.get("landed_at"):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def little_disk(spark: SparkSession) -> Iterator[None]:
    """Inside it, an action of ``spark`` deletes its shuffle files when it ends, not when the driver collects its garbage, and tables are written with zstd."""
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Inside it, actions of ``spark`` send at most ``rows`` rows at a time to Python: a batch of texts is held by both sides of the pipe."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows if int(before) <= 0 else min(rows, int(before)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


NO_ID = -(2**63)  # stands for a null id inside operators, so rows without id come before all others


def long_id(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, doc_id (long, NO_ID for null) and text (null as empty), whatever else the table has."""
    return docs.select(long_id(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def text_key(text: str | Column = "text") -> Column:
    """64-bit hash of a text (null as empty), which tells rows apart that share an id."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def text_keys(texts: list[bytes]) -> list[int]:
    """:func:`text_key` of texts in a task."""
    keys = np.fromiter((xxhash.xxh64_intdigest(t, seed=42) for t in texts), np.uint64, len(texts))
    return signed(keys).tolist()


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose id (NO_ID for null) and text hash are in ``gone`` (doc_id, text_key); the same columns."""
    gone = landed(gone.select(F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_key")).distinct(), "gone")
    same = (F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)) == gone["_gone_id"]) & (text_key(docs[text_col]) == gone["_gone_key"])
    return docs.join(gone, same, "left_anti")


def with_null_ids(df: DataFrame, *columns: str) -> DataFrame:
    """NO_ID back to null in ``columns`` (by default doc_id)."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit(NO_ID)) for c in columns or ("doc_id",)})


def words_of(text: bytes | str, lower: bool = False) -> list[bytes]:
    """Words of a text as UTF-8. ``bytes.split`` splits at exactly \\x20 and \\x09-\\x0D and
    ``bytes.lower`` changes exactly A-Z."""
    data = text.encode() if isinstance(text, str) else text
    return (data.lower() if lower else data).split()


class WordHashes(dict):
    """word -> 64-bit hash, computed once per distinct word; bounded."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64), elementwise."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
        return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive words; of all words if there are fewer; none without words."""
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    n = len(hashes) - size + 1
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total *= _ODD
        total += hashes[k : k + n]
    return mix(total)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def arrow_rows(
    fn: Callable[[Iterator[pa.RecordBatch]], Iterable[dict[str, object]]], schema: pa.Schema
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: ``fn`` yields dicts of equally long arrays or lists; they become record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in fn(batches):
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in schema], schema=schema)

    return run


def texts_in(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[tuple[list[int], list[bytes]]]:
    """(ids, UTF-8 texts) of a batch in pieces of about ``most`` bytes; one long text may exceed it."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    texts, size = batch.column(1), 0
    some_ids: list[int] = []
    some: list[bytes] = []
    for at in range(len(ids)):
        text = texts[at].as_buffer().to_pybytes()
        some_ids.append(int(ids[at]))
        some.append(text)
        size += len(text)
        if size >= most:
            yield some_ids, some
            some_ids, some, size = [], [], 0
    if some:
        yield some_ids, some
