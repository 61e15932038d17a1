"""Names of the models and the full rebuild, in dependency order."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.align import align_union
from ..operators.clean import classify, clean_codes
from ..operators.quality import ObservedChecks, check_missing_series, check_not_null, check_range, check_unique
from ..operators.reshape import SNAPSHOT_PARTITION, latest_snapshot
from ..sources.sinks import publish_table, publish_view
from .marts import regional_rollup, service_mart, stage_panel, stage_sheet, stocks_mart_from_wide
from .specs import ANNUAL, QUARTERLY, PanelSpec, SheetSpec

RAW_ANNUAL = "raw_annual"
RAW_QUARTERLY = "raw_quarterly"
STAGED_ANNUAL = "staged_annual"
STAGED_QUARTERLY = "staged_quarterly"
MART_STOCKS = "mart_stocks"
MART_REGIONAL = "mart_regional"
MART_SERVICE = "mart_service"


def source(spark: SparkSession, name: str) -> DataFrame:
    """A landed table or view by name."""
    return spark.table(name)


model = source  # a published view or table by name


def build_annual(
    spark: SparkSession,
    spec: PanelSpec = ANNUAL,
    raw: str = RAW_ANNUAL,
    root: str | None = None,
    only: tuple[str, ...] = (MART_STOCKS, MART_REGIONAL),
    checks: ObservedChecks | None = None,
    buckets: int | None = None,
) -> dict[str, DataFrame]:
    """Staged view, stocks mart (partitioned by year, clustered) and regional mart, or ``only`` one of the two.

    With ``buckets`` the stocks mart is bucketed by entity instead of clustered: joins and aggregates per
    entity then need no shuffle of it. ``checks`` carries the not-null checks of the marts written, and
    those of the staged view, whose rows go into the regional mart.
    """
    landed = source(spark, raw)
    not_null = not_null_columns(panel=spec)
    staged = publish_view(stage_panel(landed, spec), STAGED_ANNUAL)
    built = {STAGED_ANNUAL: staged}
    if MART_STOCKS in only:
        layout = {"bucket_by": [spec.entity], "buckets": buckets} if buckets else {"cluster_by": [spec.entity, spec.series]}
        built[MART_STOCKS] = publish_table(
            stocks_mart_from_wide(landed, spec), MART_STOCKS, [spec.period], path=_below(root, MART_STOCKS),
            checks=checks, not_null=not_null[MART_STOCKS], **layout,
        )
    if MART_REGIONAL in only:
        watched = checks.watch(staged, STAGED_ANNUAL, not_null[STAGED_ANNUAL]) if checks else staged
        built[MART_REGIONAL] = publish_table(
            regional_rollup(watched, spec), MART_REGIONAL, cluster_by=[spec.group, spec.series],
            path=_below(root, MART_REGIONAL), checks=checks, not_null=not_null[MART_REGIONAL],
        )
    return built


def build_quarterly(
    spark: SparkSession,
    spec: SheetSpec = QUARTERLY,
    raw: str = RAW_QUARTERLY,
    root: str | None = None,
    checks: ObservedChecks | None = None,
    buckets: int | None = None,
) -> dict[str, DataFrame]:
    """Staged view and service mart (clustered, with ``buckets`` bucketed by entity); ``checks`` carries the checks of both."""
    not_null = not_null_columns(sheet=spec)
    staged = publish_view(stage_sheet(source(spark, raw), spec), STAGED_QUARTERLY)
    watched = checks.watch(staged, STAGED_QUARTERLY, not_null[STAGED_QUARTERLY]) if checks else staged
    layout = {"bucket_by": [spec.entity], "buckets": buckets} if buckets else {"cluster_by": [spec.entity, "source_table"]}
    return {
        STAGED_QUARTERLY: staged,
        MART_SERVICE: publish_table(
            service_mart(watched, spec), MART_SERVICE, path=_below(root, MART_SERVICE),
            checks=checks, not_null=not_null[MART_SERVICE], **layout,
        ),
    }


def not_null_columns(panel: PanelSpec = ANNUAL, sheet: SheetSpec = QUARTERLY) -> dict[str, tuple[str, ...]]:
    """table -> the columns that must never be NULL."""
    return {
        STAGED_ANNUAL: (panel.entity, panel.series, panel.period),
        STAGED_QUARTERLY: (sheet.entity, sheet.series),
        MART_STOCKS: (panel.entity, panel.period, panel.series),
        MART_REGIONAL: (panel.group, panel.period),
        MART_SERVICE: (sheet.entity,),
    }


NOT_NULL = not_null_columns()


def run_not_null_tests(
    spark: SparkSession,
    columns: Mapping[str, tuple[str, ...]] = NOT_NULL,
    lookup: Callable[[SparkSession, str], DataFrame] = model,
) -> DataFrame:
    """All not-null tests on tables and views as they are: (table, column, rows, failures).

    This reads them. A build that is given :class:`~panelspark.operators.quality.ObservedChecks` has counted already.
    """
    return align_union(check_not_null(lookup(spark, name), cols, name) for name, cols in columns.items())


def total_is_lost(spark: SparkSession, spec: PanelSpec = ANNUAL, raw: str = RAW_ANNUAL) -> bool:
    """The newest snapshot has no row of the total series, so every total and share would be NULL."""
    landed = source(spark, raw)
    newest = landed if spec.one_snapshot else latest_snapshot(landed, spec.snapshot)
    return newest.withColumnsRenamed(dict(spec.renames)).where(F.col(spec.series) == spec.total_series).isEmpty()


# First and last year an annual panel may have.
FIRST_YEAR, LAST_YEAR = 1998, 2025


def build_report(
    spark: SparkSession,
    spec: PanelSpec = ANNUAL,
    raw: str = RAW_ANNUAL,
    years: tuple[int, int] = (FIRST_YEAR, LAST_YEAR),
) -> DataFrame:
    """What is wrong or left out in the landed annual panel: (check, failures), one row per check.

    Wide rows that share entity and series, staged cells outside ``years``,
    series that the newest snapshot lost, and, of the staged panel, codes in no
    region and their cells, which the roll-up leaves out.
    """
    landed = source(spark, raw)
    newest = landed if spec.one_snapshot else latest_snapshot(landed, spec.snapshot)
    wide = newest.withColumnsRenamed(dict(spec.renames))
    cleaned = clean_codes(wide, spec.entity, spec.code_length, spec.exclude, spec.tokens)
    staged = stage_panel(landed, spec)
    placed = classify(staged.select(spec.entity), spec.entity, spec.groups, "_group", default="")
    outside = placed.where("_group = ''")
    seen = landed.withColumnsRenamed(dict(spec.renames))
    by = spec.snapshot or (SNAPSHOT_PARTITION if SNAPSHOT_PARTITION in seen.columns else spec.stamp)
    lost = check_missing_series(seen, spec.series, by)
    nothing = F.lit(0).cast("bigint")

    def line(check: str, df: DataFrame, failures) -> DataFrame:
        return df.agg(F.coalesce(failures, nothing).cast("bigint").alias("failures")).select(F.lit(check).alias("check"), "failures")

    return align_union([
        line("duplicate_keys", check_unique(cleaned, [spec.entity, spec.series]), F.count(F.lit(1))),
        line("periods_out_of_range", check_range(staged, spec.period, *years), F.sum("rows")),
        line("missing_series", lost, F.count(F.lit(1))),
        line("codes_in_no_group", outside, F.count_distinct(spec.entity)),
        line("cells_in_no_group", outside, F.count(F.lit(1))),
    ])


def _below(root: str | None, name: str) -> str | None:
    return None if root is None else f"{root.rstrip('/')}/{name}"
