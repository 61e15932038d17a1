"""Sharding along a Hilbert curve over several metadata columns.

Each column is quantised to ``bits`` bits, the cell's place on the curve is its
sort key, and the sorted rows are cut into runs. Rows that are close in all
columns share a shard, so a filter on any of the columns skips most files.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from panelspark.operators.slices import SLICE, range_slices

from .common import documents
from .registry import query


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (n x dims, values below 2**bits).

    Skilling's transform (2004): undo the excess work of each level, Gray encode,
    then interleave the bits, first column first.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            inside = (x[i] & q) != 0
            swap = np.where(inside, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(inside, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[dims - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            index = (index << 1) | ((x[i] >> bit) & 1)
    return index


def category_cell(value: Column, bits: int) -> Column:
    """Equal values share a cell; null has cell 0."""
    return F.coalesce(F.pmod(F.crc32(value.cast("binary")), F.lit(1 << bits)), F.lit(0)).cast("int")


def size_cell(value: Column, bits: int) -> Column:
    """Half powers of two: a cell holds sizes that differ by at most 41 %; null and negative are 0."""
    cell = F.floor(F.log2(F.greatest(value.cast("double"), F.lit(0.0)) + 1) * 2)
    return F.least(F.coalesce(cell, F.lit(0)), F.lit((1 << bits) - 1)).cast("int")


def hilbert_shards(
    df: DataFrame, cells: dict[str, Column], id_col: str = "doc_id", shards: int = 40, bits: int = 5
) -> DataFrame:
    """Add ``curve`` (place on the curve), one ``cell_<name>`` per dimension, ``shard`` and ``slot``.

    Rows are sorted by (curve, id) and cut into ``shards`` runs whose lengths
    differ by one at most; ``slot`` numbers the rows of a shard from 0. Carry
    only metadata in ``df``: its rows are sorted and numbered, texts can be
    joined by id when files are written.

    The sort is a range partitioning on (curve, id), so a cell that holds a
    third of all rows is cut like any other. Only one count per range slice is
    ordered in one place. Nulls have cells of their own; repeated ids get
    different slots in an undefined order; an empty frame gives no rows; columns
    of ``df`` with the names added here are replaced.
    """
    if not 0 < bits * len(cells) < 63:
        raise ValueError("bits times dimensions must fit a long")

    @F.pandas_udf("long")
    def curve(*columns: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in columns], axis=1), bits))

    named = {f"cell_{name}": cell for name, cell in cells.items()}
    placed = df.withColumns(named)
    placed = placed.withColumn("curve", curve(*[F.col(c) for c in named]))
    sliced = range_slices(placed, ["curve", id_col])
    so_far = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    total = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bases = (  # one row per slice, at most spark.sql.shuffle.partitions
        sliced.groupBy(SLICE)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(SLICE, F.coalesce(F.sum("_n").over(so_far), F.lit(0)).alias("_base"), F.sum("_n").over(total).alias("_all"))
    )
    inside = Window.partitionBy(SLICE).orderBy("curve", id_col)
    ranked = sliced.withColumn("_row", F.row_number().over(inside).cast("long") - 1).join(F.broadcast(bases), SLICE)
    place = F.col("_base") + F.col("_row")
    # The first n % shards shards have one row more than the others.
    least, longer = F.expr("_all div %d" % shards), F.expr("_all %% %d" % shards)
    in_longer = place < longer * (least + 1)
    shard = F.when(in_longer, F.floor(place / (least + 1))).otherwise(
        longer + F.floor((place - longer * (least + 1)) / F.greatest(least, F.lit(1)))
    )
    ranked = ranked.withColumns({"_place": place, "_least": least, "_longer": longer}).withColumn("shard", shard.cast("int"))
    start = F.col("shard") * F.col("_least") + F.least(F.col("shard").cast("long"), F.col("_longer"))
    return ranked.withColumn("slot", (F.col("_place") - start).cast("long")).select(
        *[c for c in df.columns if c not in ("shard", "slot", "curve", *named)], *named, "curve", "shard", "slot"
    )


def shard_ranges(sharded: DataFrame) -> DataFrame:
    """Per shard its rows and the least and greatest cell of every dimension: what a reader prunes by."""
    cells = [c for c in sharded.columns if c.startswith("cell_")]
    bounds = [f(c).alias(f"{name}_{c}") for c in cells for name, f in (("least", F.min), ("greatest", F.max))]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *bounds)


def metadata(docs: DataFrame) -> DataFrame:
    """What sharding needs of each document, without its text."""
    utf8 = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", F.col("n_chars").cast("long").alias("n_chars"),
        (F.octet_length(utf8).cast("long") + 16).alias("size"), F.crc32(utf8).alias("text_crc32"),
    )


@query("op10_hilbert_shards")
def op10_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``: counts of the 40 shards are at most one apart."""
    rows = metadata(documents(spark, sf_dir))
    cells = {
        "source": category_cell(F.col("source"), 5), "lang": category_cell(F.col("lang"), 5),
        "size": size_cell(F.col("size"), 5), "n_chars": size_cell(F.col("n_chars"), 5),
    }
    sharded = hilbert_shards(rows, cells, shards=40, bits=5)
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve", "cell_source", "cell_lang", "cell_size", "cell_n_chars",
    )
