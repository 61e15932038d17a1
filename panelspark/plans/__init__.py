from .build import build_annual, build_quarterly, build_report, model, source, total_is_lost
from .marts import (
    long_quarters, regional_rollup, rollup_by_column, rollup_from_wide, service_mart, stage_panel, stage_sheet, stocks_mart,
    stocks_mart_from_wide,
)
from .serve import (
    at_period, composition, mart_pressure, pressure_ranking, scorecard, service_table, share_trend, slice_panel,
    top_entities, top_then_track, trend,
)
from .specs import ANNUAL, CLEAN_SHEET, QUARTERLY, UNITS, PanelSpec, SheetSpec

__all__ = [
    "ANNUAL", "CLEAN_SHEET", "PanelSpec", "QUARTERLY", "SheetSpec", "UNITS", "at_period", "build_annual", "build_quarterly", "build_report",
    "composition", "long_quarters", "mart_pressure", "model", "pressure_ranking", "regional_rollup", "rollup_by_column", "rollup_from_wide",
    "scorecard", "service_mart", "service_table", "share_trend", "slice_panel", "source", "stage_panel", "stage_sheet", "stocks_mart",
    "stocks_mart_from_wide", "top_entities", "top_then_track", "total_is_lost", "trend",
]
