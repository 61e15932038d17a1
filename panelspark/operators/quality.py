"""Data checks. Each returns a frame; a check that passes returns no failures."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from .clean import literal_rows


def check_not_null(df: DataFrame, cols: Iterable[str], table: str = "") -> DataFrame:
    """(table, column, rows, failures), one row per column, from a single pass."""
    cols = list(cols)
    counts = [F.count_if(F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(cols)]
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *counts)
    lines = [
        F.struct(
            F.lit(table).alias("table"),
            F.lit(c).alias("column"),
            F.col("_rows").alias("rows"),
            F.col(f"_{i}").alias("failures"),
        )
        for i, c in enumerate(cols)
    ]
    return one.select(F.inline(F.array(*lines)))


class ObservedChecks:
    """Not-null checks that ride along with the write of what they check: no second scan.

    :meth:`watch` returns the frame to write, :meth:`results` what was seen, once all of it is written. Watch the frame as it goes
    into a write: the result tasks of a job are counted once even if one of them runs again,
    what lies below a shuffle may count twice then (a NULL is still found, and none invented).
    """

    def __init__(self) -> None:
        self._watched: list[tuple[str, list[str], Observation]] = []

    def watch(self, df: DataFrame, table: str, cols: Iterable[str]) -> DataFrame:
        cols = list(cols)
        seen = Observation(f"checks of {table}")
        self._watched.append((table, cols, seen))
        counts = [F.count_if(F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(cols)]
        return df.observe(seen, F.count(F.lit(1)).alias("_rows"), *counts)

    def results(self, spark: SparkSession) -> DataFrame:
        """(table, column, rows, failures), one row per watched column. Waits for writes that have not ended."""
        lines = []
        for table, cols, seen in self._watched:
            got = seen.get
            lines += [(table, c, got["_rows"], got[f"_{i}"]) for i, c in enumerate(cols)]
        return literal_rows(spark, lines, ("table", "column", "rows", "failures"), ("string", "string", "bigint", "bigint"))


def check_missing_series(df: DataFrame, series: str, snapshot: str) -> DataFrame:
    """Series whose newest snapshot is older than the newest of all: (series, last_seen, newest)."""
    last = df.groupBy(series).agg(F.max(snapshot).alias("last_seen"))
    newest = last.select(F.max("last_seen")).scalar()
    return last.where(F.col("last_seen") < newest).withColumn("newest", newest)


def check_unique(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*list(keys)).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def require_unique(df: DataFrame, keys: Iterable[str], what: str) -> DataFrame:
    """``df``, which raises when it is evaluated and one of ``keys`` occurs more than once.

    The check is a subquery over the keys alone, outside of what ``df`` goes
    into: an aggregate there would keep AQE from splitting a hot key.
    """
    keys = list(keys)
    copies = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies")).select(F.max("_copies")).scalar()
    complaint = F.raise_error(F.lit(f"{what} is stored twice for the same {', '.join(keys)}")).cast("boolean")
    return df.where(F.when(F.coalesce(copies, F.lit(0)) < 2, F.lit(True)).otherwise(complaint))


def check_range(df: DataFrame, col: str, low: int, high: int) -> DataFrame:
    """Values outside low..high (both inclusive), with their row count."""
    outside = (F.col(col) < low) | (F.col(col) > high)
    return df.where(outside).groupBy(col).agg(F.count(F.lit(1)).alias("rows"))
