"""Total series, shares and change against the previous observation."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.measures import percent, percent_step
from .quality import require_unique
from .slices import lag_by_chunks, lag_within


def attach_total(
    df: DataFrame,
    keys: Iterable[str],
    series: str,
    total_code: str,
    value: str | Mapping[str, str],
    out: str = "total",
    duplicates: str = "fail",
) -> DataFrame:
    """Left-join each row to the total series' value for the same ``keys``.

    ``value`` names one column, attached as ``out``, or maps several to their
    output names. The total series is filtered before the join, so its predicate
    reaches the scan. Catalyst broadcasts that side when its size allows;
    otherwise both sides shuffle on ``keys`` and AQE splits a hot key on the
    left, against whose many rows the right holds a single one.

    A total stored twice for a key raises: as a join it would multiply the rows
    of that key, by as many copies as there are. ``duplicates="join"`` asks for
    just that.
    """
    keys = list(keys)
    names = {value: out} if isinstance(value, str) else dict(value)
    totals = df.where(F.col(series) == total_code).select(*keys, *[F.col(v).alias(o) for v, o in names.items()])
    if duplicates == "fail":
        totals = require_unique(totals, keys, f"series {total_code}")
    elif duplicates != "join":
        raise ValueError("duplicates must be 'join' or 'fail'")
    return df.join(totals, keys, "left").select(*df.columns, *names.values())


def share_of_total(df: DataFrame, value: str, total: str, out: str = "pct_of_total") -> DataFrame:
    return df.withColumn(out, percent(F.col(value), F.col(total)))


def previous_value(
    df: DataFrame,
    keys: Iterable[str],
    order: str,
    value: str,
    out: str = "prev_value",
    strict_period: bool = False,
    few_periods: bool = False,
) -> DataFrame:
    """Value of the previous observation per ``keys`` by ``order`` (unique per key).

    That is the previous row, however far back; ``strict_period`` accepts it
    only from period - 1. By default a key may have any number of rows: they are
    cut into ranges of periods where these are whole numbers (see :func:`~panelspark.operators.slices.lag_by_chunks`),
    else into range slices (:func:`~panelspark.operators.slices.lag_within`).
    ``few_periods`` says that a key has one row per period of a short list, as in
    a staged panel; one window over each key, the cheaper way, is then safe.
    """
    keys = list(keys)
    if few_periods:
        w = Window.partitionBy(*keys).orderBy(order)
        stepped = df.withColumns({out: F.lag(value).over(w), "_prev_period": F.lag(order).over(w)})
    else:
        whole = df.schema[order].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
        cut = lag_by_chunks if whole else lag_within
        stepped = cut(df, keys, order, {out: value, "_prev_period": order})
    if strict_period:
        stepped = stepped.withColumn(out, F.when(F.col("_prev_period") == F.col(order) - 1, F.col(out)))
    return stepped.drop("_prev_period")


def pct_change(
    df: DataFrame,
    keys: Iterable[str],
    order: str,
    value: str,
    out: str = "pct_change",
    previous: str | None = None,
    **options: bool,
) -> DataFrame:
    """Change in % of the previous observation; NULL on the first one and after 0.

    Pass ``previous`` if the column of previous values exists already; other
    ``options`` go to :func:`previous_value`.
    """
    if previous is not None:
        return df.withColumn(out, percent_step(F.col(value), F.col(previous)))
    stepped = previous_value(df, keys, order, value, "_prev", **options)
    return stepped.withColumn(out, percent_step(F.col(value), F.col("_prev"))).drop("_prev")
