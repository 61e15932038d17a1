from .measures import (
    cast_measure, cast_measures, mean_of, percent, percent_step, period_to_int, quarter_to_int, ratio, tokens_to_null, total_of,
)
from .names import header_name, normalize_identifier, unique_names

__all__ = [
    "cast_measure", "cast_measures", "header_name", "mean_of", "normalize_identifier", "percent", "percent_step",
    "period_to_int", "quarter_to_int", "ratio", "tokens_to_null", "total_of", "unique_names",
]
