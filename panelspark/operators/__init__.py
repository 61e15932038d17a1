from .align import align_union, dedupe_names, normalize_headers, prefix_numeric_columns, stamp, stringify
from .clean import classify, clean_codes, label_codes, literal_rows, require_present
from .quality import ObservedChecks, check_missing_series, check_not_null, check_range, check_unique, require_unique
from .ratios import attach_total, pct_change, previous_value, share_of_total
from .reshape import latest_snapshot, newest_partition, period_columns, spread_series, unpivot_periods
from .rollup import merge_rollups, rollup_by_group, rollup_listed, rollup_sketch, top_n
from .service import row_average, row_total, service_pressure
from .slices import global_rank, lag_by_chunks, lag_within, number_within

__all__ = [
    "ObservedChecks", "align_union", "attach_total", "check_missing_series", "check_not_null", "check_range", "check_unique",
    "classify", "clean_codes", "dedupe_names", "global_rank", "label_codes", "lag_by_chunks", "lag_within", "latest_snapshot",
    "literal_rows", "merge_rollups", "newest_partition",
    "normalize_headers", "number_within", "pct_change", "period_columns", "prefix_numeric_columns",
    "previous_value", "require_present", "require_unique", "rollup_by_group", "rollup_listed", "rollup_sketch", "row_average", "row_total",
    "service_pressure", "share_of_total", "spread_series", "stamp", "stringify", "top_n", "unpivot_periods",
]
