"""Row numbers, ranks and lags whose groups may be too big for one task.

A plain window sorts each group in one task. The functions here cut the sorted
rows into range slices instead, work inside every slice, and carry one summary
row per slice and key over the slice borders. Only those summaries, at most one
per slice and key, are ordered per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import pin

SLICE = "_slice"
CHUNK = 64  # periods of a key that are put in order together


def range_slices(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """Add the range partition each row falls into when sorted by ``order``.

    Range bounds come from a sample, so the result is pinned: both the
    summaries and the rows must see the same cut.
    """
    cut = df.repartitionByRange(*order).withColumn(SLICE, F.spark_partition_id())
    return pin(cut, "slices")


def number_within(df: DataFrame, keys: list[str], order: list[str], out: str = "row_number") -> DataFrame:
    """1, 2, 3, ... per ``keys`` by ``order`` (unique per key), as bigint.

    Each slice and key starts from one extra row that brings the number of rows
    in earlier slices, so a running sum does it and nothing needs to be joined.
    """
    sliced = range_slices(df, [*keys, *order])
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    start = (
        sliced.groupBy(SLICE, *keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(SLICE, *keys, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_step"), F.lit(0).alias("_row"))
    )
    rows = sliced.withColumns({"_step": F.lit(1).cast("bigint"), "_row": F.lit(1)})
    both = rows.unionByName(start, allowMissingColumns=True)
    so_far = Window.partitionBy(SLICE, *keys).orderBy("_row", *order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = both.withColumn(out, F.sum("_step").over(so_far))
    return numbered.where("_row = 1").select(*df.columns, out)


def lag_within(df: DataFrame, keys: list[str], order: str, fields: dict[str, str]) -> DataFrame:
    """For each ``out: column`` in ``fields`` the previous row's value per ``keys`` by ``order``.

    Each slice and key starts from one extra row that brings the last row of
    the slice before.
    """
    sliced = range_slices(df, [*keys, order])
    return _lag_over_pieces(sliced, SLICE, keys, order, fields).select(*df.columns, *fields)


def lag_by_chunks(df: DataFrame, keys: list[str], order: str, fields: dict[str, str], width: int = CHUNK) -> DataFrame:
    """:func:`lag_within` for an ``order`` of whole numbers, such as years or quarters.

    A piece is a key's rows in a range of ``width`` periods, at most one row each, so no sample has to find the ranges and
    nothing is written: rows are shuffled by key and range, and of each piece its last row is carried
    to the next. A key's carried rows, a ``width``-th of its periods if these are dense, are ordered together.
    ``df`` is read twice, the second time for the columns that are carried.
    """
    cut = df.withColumn(SLICE, F.col(order) - F.pmod(F.col(order), F.lit(width)))
    return _lag_over_pieces(cut, SLICE, keys, order, fields).select(*df.columns, *fields)


def _lag_over_pieces(cut: DataFrame, piece: str, keys: list[str], order: str, fields: dict[str, str]) -> DataFrame:
    """Previous row per key, where ``piece`` numbers consecutive pieces of a key in the order of ``order``."""
    picked = F.struct(*[F.col(c).alias(out) for out, c in fields.items()])
    start = (
        cut.groupBy(piece, *keys)
        .agg(F.max_by(picked, order).alias("_last"))
        .select(
            piece, *keys,
            F.lag("_last").over(Window.partitionBy(*keys).orderBy(piece)).alias("_picked"),
            F.lit(0).alias("_row"),
        )
    )
    rows = cut.withColumns({"_picked": picked, "_row": F.lit(1)})
    both = rows.unionByName(start, allowMissingColumns=True)
    before = F.lag("_picked").over(Window.partitionBy(piece, *keys).orderBy("_row", order))
    stepped = both.withColumn("_before", before).where("_row = 1")
    return stepped.select(*cut.columns, *[F.col("_before")[out].alias(out) for out in fields])


def global_rank(df: DataFrame, by: str, out: str = "rank") -> DataFrame:
    """rank() over the whole frame, largest ``by`` first, NULL last, as bigint.

    The frame is pinned and reduced to its distinct values (ties, however many,
    become one row), these are cut into range slices, and the rank of a value is
    the number of rows above it.
    """
    pinned = pin(df, "rank")
    values = pinned.groupBy(by).agg(F.count(F.lit(1)).alias("_rows"))
    sliced = range_slices(values, [F.desc_nulls_last(by)])
    # One row per slice, so at most spark.sql.shuffle.partitions rows.
    above = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    before = (
        sliced.groupBy(SLICE)
        .agg(F.sum("_rows").alias("_in_slice"))
        .select(SLICE, F.coalesce(F.sum("_in_slice").over(above), F.lit(0)).alias("_before"))
    )
    higher = Window.partitionBy(SLICE).orderBy(F.desc_nulls_last(by)).rowsBetween(Window.unboundedPreceding, -1)
    ranks = (
        sliced.withColumn("_inside", F.coalesce(F.sum("_rows").over(higher), F.lit(0)))
        .join(F.broadcast(before), SLICE)
        .select(F.col(by).alias("_value"), (F.col("_inside") + F.col("_before") + 1).cast("bigint").alias(out))
    )
    same = F.col(by).eqNullSafe(F.col("_value"))
    return pinned.join(ranks, same, "left").drop("_value")
