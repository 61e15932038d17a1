"""Row totals over period columns and the pressure ratio."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.measures import percent, ratio
from .slices import global_rank


def row_total_of(cols: Iterable[str], nan_as_zero: bool = False, scale: Column | None = None) -> Column:
    """Left-to-right sum of ``cols`` with NULL as 0. NaN stays NaN unless ``nan_as_zero``.

    ``scale`` multiplies the total (figures reported in thousands or millions).
    """
    cells = []
    for c in cols:
        cell = F.nanvl(F.col(c), F.lit(None).cast("double")) if nan_as_zero else F.col(c)
        cells.append(F.coalesce(cell, F.lit(0.0)))
    total = reduce(lambda a, b: a + b, cells)
    return total if scale is None else total * scale


def row_total(df: DataFrame, cols: Iterable[str], out: str = "row_total", **options) -> DataFrame:
    return df.withColumn(out, row_total_of(cols, **options))


def row_average(
    df: DataFrame,
    cols: Iterable[str],
    out: str = "row_average",
    denominator: int | None = None,
    **options,
) -> DataFrame:
    """Row total over a fixed count, by default the number of ``cols``, present or not."""
    cols = list(cols)
    count = len(cols) if denominator is None else denominator
    return df.withColumn(out, ratio(row_total_of(cols, **options), F.lit(count).cast("double")))


def service_pressure(
    service: DataFrame,
    stock: DataFrame,
    key: str,
    payment: str,
    debt: str,
    out: str = "pressure_pct",
    rank: str = "pressure_rank",
) -> DataFrame:
    """Payments in % of the stock per entity, ranked, heaviest first.

    Both sides hold one row per ``key`` (aggregate them first). Entities without
    a stock keep a NULL ratio and rank last.
    """
    both = service.select(key, payment).join(stock.select(key, debt), key, "left")
    return global_rank(both.withColumn(out, percent(F.col(payment), F.col(debt))), out, rank)
