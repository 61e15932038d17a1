"""Serving queries over the staged panel and the marts: scorecards, trends, top lists."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, functions as F

from ..functions.measures import percent, total_of
from ..operators.ratios import previous_value
from ..operators.reshape import spread_series
from ..operators.rollup import top_n
from ..operators.service import service_pressure
from .specs import ANNUAL, QUARTERLY, PanelSpec, SheetSpec

LATEST = "latest"


def at_period(df: DataFrame, period: str, at: int | str = LATEST) -> DataFrame:
    """Rows of one period, by default the latest that occurs."""
    return df.where(F.col(period) == (df.select(F.max(period)).scalar() if at == LATEST else at))


def scorecard(
    df: DataFrame,
    value: str,
    period: str,
    at: int | str = LATEST,
    by: Iterable[str] = (),
    decimals: int | None = None,
    out: str = "total",
) -> DataFrame:
    """Sum of ``value`` at one period, in total or per ``by`` (e.g. per series)."""
    return at_period(df, period, at).groupBy(*by, period).agg(total_of(F.col(value), decimals).alias(out))


def trend(
    df: DataFrame,
    group: str,
    period: str,
    value: str,
    series: str | None = None,
    code: str | None = None,
    decimals: int | None = None,
    out: str = "total",
) -> DataFrame:
    """Sum of ``value`` per group and period, of one series if ``code`` names it."""
    if code is not None:
        df = df.where(F.col(series) == code)
    return df.groupBy(group, period).agg(total_of(F.col(value), decimals).alias(out))


def slice_panel(
    df: DataFrame,
    period: str,
    entity: str,
    years: Iterable[int] | tuple[int, int] | None = None,
    entities: Iterable | None = None,
) -> DataFrame:
    """Year filter and entity filter. ``years`` is a (first, last) pair or a list of years.

    On a table partitioned by year the year filter prunes directories.
    """
    if isinstance(years, tuple):
        first, last = years
        df = df.where(F.col(period).between(first, last))
    elif years is not None:
        df = df.where(F.col(period).isin(list(years)))
    return df if entities is None else df.where(F.col(entity).isin(list(entities)))


def composition(
    df: DataFrame, entity: str, period: str, series: str, value: str, codes: Mapping[str, str]
) -> DataFrame:
    """One row per entity and period, one column per series (``codes``: code -> column)."""
    return spread_series(df, [entity, period], series, value, codes)


def top_entities(
    df: DataFrame, n: int, entity: str, period: str, series: str, value: str, code: str, at: int | str = LATEST
) -> DataFrame:
    """The ``n`` entities with the largest ``code`` at one period, ties by entity."""
    ranked_on = df.where(F.col(series) == code)
    return top_n(at_period(ranked_on, period, at).select(entity, period, value), n, value, [entity])


def top_then_track(
    df: DataFrame,
    n: int,
    entity: str,
    period: str,
    series: str,
    value: str,
    rank_on: str,
    track: str,
    since: int,
    at: int | str = LATEST,
) -> DataFrame:
    """History of series ``track``, from ``since`` on, of the top ``n`` entities on ``rank_on``.

    Catalyst knows the limit, so the size of ``n`` rows decides how they are joined.
    """
    leaders = top_entities(df, n, entity, period, series, value, rank_on, at).select(entity)
    tracked = df.where((F.col(series) == track) & (F.col(period) >= since))
    return tracked.join(leaders, entity, "left_semi").select(entity, period, value)


def share_trend(
    df: DataFrame,
    keys: Iterable[str],
    order: str,
    series: str,
    value: str,
    part: str,
    whole: str,
    few_periods: bool = False,
) -> DataFrame:
    """Share of series ``part`` in ``whole`` in %, its step, and whether it worsened (rose).

    Both series are met in one aggregate on keys + period. Periods without a
    share are left out, so a step reaches back to the previous share there is.
    ``few_periods`` is that of :func:`~panelspark.operators.ratios.previous_value`.
    """
    keys = list(keys)
    cells = spread_series(
        df.where(F.col(series).isin(part, whole)), [*keys, order], series, value, {part: "_part", whole: "_whole"}
    )
    share = cells.select(*keys, order, percent(F.col("_part"), F.col("_whole")).alias("share_pct"))
    present = share.where(F.col("share_pct").isNotNull())
    stepped = previous_value(present, keys, order, "share_pct", "_prev", few_periods=few_periods)
    delta = F.col("share_pct") - F.col("_prev")
    return stepped.select(*keys, order, "share_pct", delta.alias("delta"), (delta > 0).alias("worsening"))


def service_table(
    mart: DataFrame,
    by: Iterable[str],
    quarters: Iterable[str],
    total: str,
    decimals: int | None = None,
) -> DataFrame:
    """Quarterly sums and the total per entity, from the row-level service mart."""
    sums = [total_of(F.col(c), decimals).alias(c) for c in [*quarters, total]]
    return mart.groupBy(*list(by)).agg(*sums)


def pressure_ranking(
    payments: DataFrame,
    stocks: DataFrame,
    key: str,
    payment: str,
    debt: str,
    decimals: int | None = None,
) -> DataFrame:
    """Sum both sides per entity, then rank entities by payments in % of the stock."""
    paid = payments.groupBy(key).agg(total_of(F.col(payment), decimals).alias(payment))
    owed = stocks.groupBy(key).agg(total_of(F.col(debt), decimals).alias(debt))
    return service_pressure(paid, owed, key, payment, debt)


def mart_pressure(
    service: DataFrame, stocks: DataFrame, year: int, sheet: SheetSpec = QUARTERLY, panel: PanelSpec = ANNUAL,
    decimals: int | None = None,
) -> DataFrame:
    """Payments of the service mart in % of the stocks mart's total series in ``year``, ranked.

    The service mart must be in units (``SheetSpec.units``). On a stocks mart
    partitioned by year the filter prunes directories.
    """
    in_year = stocks.where((F.col(panel.period) == year) & (F.col(panel.series) == panel.total_series))
    owed = in_year.select(F.col(panel.entity).alias(sheet.entity), panel.value)
    return pressure_ranking(service, owed, sheet.entity, sheet.total, panel.value, decimals)
