"""Staged panels and the three marts, composed from the operators."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from ..functions.measures import cast_measure, cast_measures, percent, percent_step, period_to_int, quarter_to_int, tokens_to_null
from ..operators.clean import clean_codes, label_codes, require_present
from ..operators.quality import require_unique
from ..operators.ratios import attach_total, pct_change, previous_value, share_of_total
from ..operators.reshape import latest_snapshot, period_columns, unpivot_periods
from ..operators.rollup import rollup_by_group, rollup_listed
from ..operators.service import row_average, row_total
from .specs import ANNUAL, QUARTERLY, PanelSpec, SheetSpec


def _cleaned_wide(raw: DataFrame, spec: PanelSpec) -> DataFrame:
    """Newest snapshot, staged column names, unwanted codes removed; still wide and text."""
    newest = raw if spec.one_snapshot else latest_snapshot(raw, spec.snapshot)
    renamed = newest.withColumnsRenamed(dict(spec.renames))
    return clean_codes(renamed, spec.entity, spec.code_length, spec.exclude, spec.tokens)


def _years(wide: DataFrame, spec: PanelSpec) -> list[str]:
    years = list(spec.periods) if spec.periods is not None else period_columns(wide, spec.period_pattern)
    if not years:
        raise ValueError(f"no period column matches {spec.period_pattern}")
    return years


def stage_panel(raw: DataFrame, spec: PanelSpec = ANNUAL) -> DataFrame:
    """Long panel, one row per entity, series and year with a value. No shuffle.

    Code filters are written before the unpivot, so they run once per wide row
    and reach the scan. The strict cast therefore never sees rows they remove.
    """
    return _staged(_cleaned_wide(raw, spec), spec)


def _staged(wide: DataFrame, spec: PanelSpec) -> DataFrame:
    ids = [spec.entity, spec.name, spec.series, spec.stamp, *spec.carry]
    cells = unpivot_periods(wide, ids, _years(wide, spec), names=("_column", "_text"))
    # Strict: a value is missing exactly where its text is, so the filter need not cast.
    typed = require_present(cells, "_text", tokens=spec.tokens).select(
        spec.entity,
        spec.name,
        spec.series,
        period_to_int(F.col("_column"), spec.period_prefix).alias(spec.period),
        cast_measure(F.col("_text"), ()).alias(spec.value),
        spec.stamp,
        *spec.carry,
    )
    return label_codes(typed, spec.series, spec.labels, spec.label)


def _stocks_columns(spec: PanelSpec) -> list[str]:
    return [
        spec.entity, spec.name, spec.series, spec.label, spec.period, spec.value, spec.stamp,
        spec.total, spec.share, spec.previous, spec.change,
    ]


def stocks_mart(
    staged: DataFrame, spec: PanelSpec = ANNUAL, duplicates: str = "fail", few_periods: bool = False
) -> DataFrame:
    """Every long cell with its total, share, previous value and change.

    Works on any long panel; ``duplicates`` is that of :func:`attach_total`,
    ``few_periods`` that of :func:`~panelspark.operators.ratios.previous_value`.
    From a wide snapshot, :func:`stocks_mart_from_wide` gives the same rows with far less shuffling.
    """
    keys = [spec.entity, spec.series]
    # The label follows from the series code: put it back last, shuffle rows without it.
    cells = staged.drop(spec.label)
    # The steps come before the join, so that what they read twice is the cells alone.
    stepped = previous_value(cells, keys, spec.period, spec.value, spec.previous, few_periods=few_periods)
    changed = pct_change(stepped, keys, spec.period, spec.value, spec.change, previous=spec.previous)
    joined = attach_total(
        changed, [spec.entity, spec.period], spec.series, spec.total_series, spec.value, spec.total, duplicates
    )
    shared = share_of_total(joined, spec.value, spec.total, spec.share)
    return label_codes(shared, spec.series, spec.labels, spec.label).select(*_stocks_columns(spec))


def stocks_mart_from_wide(raw: DataFrame, spec: PanelSpec = ANNUAL, split_rows: str = "fail") -> DataFrame:
    """:func:`stocks_mart` straight from the wide snapshot.

    A wide row holds the whole history of an entity's series, so the previous
    observation is found inside the row: no window, no sort, no group that could
    grow hot. Only the total needs a join, and it joins wide rows on the entity
    instead of cells on entity and year. That needs one row per entity and
    series, which one check over their keys makes sure of: a second row raises.
    ``split_rows="merge"`` puts rows with different years together first, at the
    price of one more shuffle of wide rows, and raises where two hold the same year.
    """
    wide = _cleaned_wide(raw, spec)
    years = sorted(_years(wide, spec), key=lambda y: _period(y, spec))
    ids = [spec.entity, spec.name, spec.series, spec.stamp]
    keys = [spec.entity, spec.series]
    if split_rows == "merge":
        wide = _merged(wide.select(*ids, *years), keys, ids, years, spec)
    elif split_rows == "fail":
        wide = require_unique(wide, keys, "a wide row")
    else:
        raise ValueError("split_rows must be 'merge' or 'fail'")
    history = cast_measures(wide.select(*ids, *years), years, "_values", spec.tokens)
    rows = attach_total(history, [spec.entity], spec.series, spec.total_series, "_values", "_totals", duplicates="join")
    periods = F.array(*[F.lit(_period(y, spec)).cast("bigint") for y in years])
    # An entity without the total series has no array of totals: one NULL per year.
    no_totals = F.lit([None] * len(years)).cast("array<double>")
    zipped = F.arrays_zip(
        periods.alias("period"), F.col("_values").alias("value"), F.coalesce("_totals", no_totals).alias("total")
    )
    cells = rows.select(*ids, F.filter(zipped, lambda cell: cell["value"].isNotNull()).alias("_cells"))
    nothing = F.lit(None).cast(cells.schema["_cells"].dataType.elementType)
    shifted = F.slice(F.concat(F.array(nothing), F.col("_cells")), F.lit(1), F.size("_cells"))
    paired = F.inline(F.arrays_zip(F.col("_cells").alias("_now"), shifted.alias("_before")))
    now, before = F.col("_now"), F.col("_before")
    flat = cells.select(*ids, paired).select(
        *ids,
        now["period"].alias(spec.period),
        now["value"].alias(spec.value),
        now["total"].alias(spec.total),
        percent(now["value"], now["total"]).alias(spec.share),
        before["value"].alias(spec.previous),
        percent_step(now["value"], before["value"]).alias(spec.change),
    )
    return label_codes(flat, spec.series, spec.labels, spec.label).select(*_stocks_columns(spec))


def _merged(wide: DataFrame, keys: list[str], ids: list[str], years: list[str], spec: PanelSpec) -> DataFrame:
    """One row per key: the single text that any of its rows has for a year."""
    complaint = F.raise_error(F.lit(f"a value is stored twice for the same {', '.join(keys)} and period")).cast("string")
    texts = {y: tokens_to_null(F.col(y), spec.tokens) for y in years}
    merged = [F.when(F.count(t) > 1, complaint).otherwise(F.max(t)).alias(y) for y, t in texts.items()]
    return wide.groupBy(*keys).agg(*[F.min(c).alias(c) for c in ids if c not in keys], *merged).select(*ids, *years)


def _period(column: str, spec: PanelSpec) -> int:
    return int(column.removeprefix(spec.period_prefix))


def regional_rollup(staged: DataFrame, spec: PanelSpec = ANNUAL) -> DataFrame:
    """Entity count, sum, mean, maximum and minimum per region, series and year.

    Codes in no region are left out. Regions are code lists, see
    :func:`~panelspark.operators.rollup.rollup_listed`.
    """
    rolled = rollup_listed(
        staged, [spec.series, spec.period], spec.entity, spec.value, spec.groups, spec.group,
        decimals=spec.decimals, names=spec.rollup_names,
    )
    return _labelled_rollup(rolled, spec.group, spec)


def rollup_by_column(staged: DataFrame, group: str, spec: PanelSpec = ANNUAL) -> DataFrame:
    """The same roll-up where the group is a column already, with any number of entities."""
    rolled = rollup_by_group(
        staged, [group, spec.series, spec.period], spec.entity, spec.value,
        decimals=spec.decimals, names=spec.rollup_names,
    )
    return _labelled_rollup(rolled, group, spec)


def rollup_from_wide(raw: DataFrame, group: str, spec: PanelSpec = ANNUAL) -> DataFrame:
    """:func:`rollup_by_column` from the wide snapshot, of which ``group`` is a column.

    With one row per entity and series no entity occurs twice in a group's
    series and year, and a plain count is the distinct count: only one row per
    group and task is shuffled instead of every cell. The plan checks that over
    the keys of the wide rows and raises otherwise; :func:`rollup_by_column` on
    the staged panel takes such rows.
    """
    cleaned = require_unique(_cleaned_wide(raw, spec), [spec.entity, spec.series], "a wide row")
    staged = _staged(cleaned, replace(spec, carry=(*spec.carry, group)))
    rolled = rollup_by_group(
        staged, [group, spec.series, spec.period], spec.entity, spec.value,
        decimals=spec.decimals, names=spec.rollup_names, counted=F.count(spec.entity),
    )
    return _labelled_rollup(rolled, group, spec)


def _labelled_rollup(rolled: DataFrame, group: str, spec: PanelSpec) -> DataFrame:
    """Labels follow from the series code, so they join the groups, not the cells."""
    labelled = label_codes(rolled, spec.series, spec.labels, spec.label)
    return labelled.select(group, spec.series, spec.label, spec.period, *spec.rollup_names)


def stage_sheet(raw: DataFrame, spec: SheetSpec = QUARTERLY) -> DataFrame:
    """Newest snapshot with quarters as doubles; stays wide. Bad text becomes NULL."""
    newest = raw if spec.one_snapshot else latest_snapshot(raw, spec.snapshot)
    present = require_present(newest, *spec.required, tokens=spec.key_tokens)
    quarters = list(spec.quarters) if spec.quarters is not None else period_columns(newest, spec.quarter_pattern)
    cast = cast_measures(present.select(*spec.ids, *quarters), quarters, "_quarters", spec.tokens, strict=False)
    return cast.select(*spec.ids, *[F.col("_quarters")[i].alias(q) for i, q in enumerate(quarters)])


def service_mart(staged: DataFrame, spec: SheetSpec = QUARTERLY) -> DataFrame:
    """Row total of the summed quarters and their average over a fixed count, row by row."""
    quarters = [c for c in staged.columns if c not in spec.ids]
    base = staged.select(*spec.mart_ids, *quarters, *([F.col(spec.unit_column).alias("_unit")] if spec.units else []))
    scale = None
    if spec.units:
        factors = F.create_map(*[F.lit(x) for pair in spec.units.items() for x in pair])
        scale = F.coalesce(F.try_element_at(factors, F.col("_unit")), F.lit(1.0))
    totalled = row_average(
        row_total(base, spec.summed, spec.total, scale=scale), spec.summed, spec.average, scale=scale
    )
    return totalled.drop("_unit")


def long_quarters(staged: DataFrame, spec: SheetSpec = QUARTERLY, out: str = "quarter_no", value: str = "value") -> DataFrame:
    """One row per staged row and quarter with a figure; ``out`` orders the quarters (:func:`quarter_to_int`)."""
    quarters = [c for c in staged.columns if c not in spec.ids]
    cells = unpivot_periods(staged, spec.ids, quarters, names=("quarter", value))
    return cells.withColumn(out, quarter_to_int(F.col("quarter")))
