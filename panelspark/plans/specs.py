"""Column names, code lists and missing-value rules of the two preset panels."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from ..operators.reshape import QUARTER_COLUMNS, YEAR_COLUMNS

# Series codes and their labels. The first is the total series.
SERIES_LABELS = {
    "DT.DOD.DECT.CD": "Total external debt stocks",
    "DT.DOD.DLXF.CD": "Long-term external debt",
    "DT.DOD.DPNG.CD": "Private nonguaranteed debt",
    "DT.DOD.MIBR.CD": "PPG IBRD loans",
    "DT.DOD.DPPG.CD": "Public and publicly guaranteed debt",
    "DT.DOD.DIMF.CD": "IMF credit",
    "DT.DOD.PVLX.CD": "Present value of external debt",
    "DT.DOD.MWBG.CD": "IBRD loans and IDA credits",
    "DT.DOD.MIDA.CD": "PPG IDA loans",
}
TOTAL_SERIES = "DT.DOD.DECT.CD"

# Three-letter codes that stand for aggregates, not countries.
AGGREGATE_CODES = (
    "LMY", "MIC", "UMC", "LMC", "LIC",
    "EAP", "ECA", "LAC", "MNA", "SAS",
    "SSA", "SSF", "HIC", "OED", "EMU",
    "ARB", "CEB", "EAR", "ECS", "HPC",
    "IBD", "IBT", "IDA", "IDX", "LDC",
    "PRE", "PSS", "PST", "TEA", "TEC",
    "TLA", "TMN", "TSA", "TSS", "WLD",
)

# Regions in order of precedence. A code listed twice belongs to the
# region that lists it first.
REGIONS = {
    "Africa": (
        "DZA", "AGO", "BEN", "BWA", "BFA", "BDI", "CMR", "CPV", "CAF", "TCD",
        "COM", "COD", "COG", "CIV", "DJI", "EGY", "GNQ", "ERI", "ETH", "GAB",
        "GMB", "GHA", "GIN", "GNB", "KEN", "LSO", "LBR", "LBY", "MDG", "MWI",
        "MLI", "MRT", "MUS", "MAR", "MOZ", "NAM", "NER", "NGA", "RWA", "STP",
        "SEN", "SLE", "SOM", "ZAF", "SSD", "SDN", "SWZ", "TZA", "TGO", "TUN",
        "UGA", "ZMB", "ZWE",
    ),
    "Latin America and Caribbean": (
        "ARG", "BOL", "BRA", "CHL", "COL", "CRI", "CUB", "DOM", "ECU", "SLV",
        "GTM", "HTI", "HND", "JAM", "MEX", "NIC", "PAN", "PRY", "PER", "TTO",
        "URY", "VEN",
    ),
    "East Asia and Pacific": (
        "CHN", "IDN", "KHM", "LAO", "MYS", "MMR", "PHL", "THA", "VNM", "PNG",
        "FJI", "MNG", "PRK", "KOR", "JPN", "HKG", "SGP", "BRN", "TLS",
    ),
    "South Asia": ("AFG", "BGD", "BTN", "IND", "MDV", "NPL", "PAK", "LKA"),
    "Europe and Central Asia": (
        "ARM", "AZE", "BLR", "GEO", "KAZ", "KGZ", "MDA", "RUS", "TJK", "TKM",
        "UKR", "UZB", "ALB", "BIH", "HRV", "MKD", "MNE", "SRB", "SVN", "POL",
        "CZE", "SVK", "HUN", "ROU", "BGR", "EST", "LVA", "LTU",
    ),
    "Middle East and North Africa": (
        "DZA", "BHR", "DJI", "EGY", "IRN", "IRQ", "JOR", "KWT", "LBN", "LBY",
        "MLT", "MAR", "OMN", "QAT", "SAU", "SYR", "TUN", "ARE", "YEM", "PSE",
    ),
}


@dataclass(frozen=True)
class PanelSpec:
    """A wide annual panel: one row per entity and series, one text column per year."""

    entity: str = "country_code"
    name: str = "country_name"
    series: str = "series_code"
    label: str = "series_description"
    period: str = "year"
    value: str = "debt_value_usd"
    stamp: str = "extracted_at"
    # landed column -> staged column
    renames: Mapping[str, str] = field(
        default_factory=lambda: {"economy": "country_code", "Country": "country_name"}
    )
    carry: tuple[str, ...] = ()  # further columns of the wide rows to keep, e.g. a group known per entity
    snapshot: str | None = None  # None: the partition column if present, else the stamp
    one_snapshot: bool = False  # the input holds one snapshot only: do not look for the newest
    period_pattern: str = YEAR_COLUMNS
    period_prefix: str = "year_"
    periods: tuple[str, ...] | None = None
    tokens: tuple[str, ...] = ("nan",)
    code_length: int | None = 3
    exclude: tuple[str, ...] = AGGREGATE_CODES
    labels: Mapping[str, str] = field(default_factory=lambda: SERIES_LABELS)
    groups: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: REGIONS)
    group: str = "region"
    total_series: str = TOTAL_SERIES
    total: str = "total_debt_usd"
    share: str = "pct_of_total_debt"
    previous: str = "prev_year_value"
    change: str = "yoy_change_pct"
    rollup_names: tuple[str, str, str, str, str] = (
        "country_count", "total_debt_usd", "avg_debt_usd", "max_debt_usd", "min_debt_usd",
    )
    decimals: int | None = None  # exact, order-independent sums with that many decimals


@dataclass(frozen=True)
class SheetSpec:
    """A wide quarterly sheet: one row per entity and series, one text column per quarter.

    With the default ``tokens`` a text 'nan' becomes NaN and makes its row total
    NaN; ``CLEAN_SHEET`` drops such tokens instead.
    """

    entity: str = "country_code"
    name: str = "country_name"
    series: str = "series_code"
    ids: tuple[str, ...] = (
        "country_name", "country_code", "series_name", "series_code",
        "scale_precision", "source_table", "sheet_name", "extracted_at",
    )
    required: tuple[str, ...] = ("country_code", "country_name", "series_code")
    quarters: tuple[str, ...] | None = ("q_2021q1", "q_2021q2", "q_2021q3", "q_2021q4", "q_2022q3")
    quarter_pattern: str = QUARTER_COLUMNS  # used when quarters is None
    summed: tuple[str, ...] = ("q_2021q1", "q_2021q2", "q_2021q3", "q_2021q4")
    mart_ids: tuple[str, ...] = (
        "country_code", "country_name", "series_name", "series_code", "source_table", "extracted_at",
    )
    total: str = "total_2021_payments"
    average: str = "avg_quarterly_payment_2021"
    tokens: tuple[str, ...] = ()
    key_tokens: tuple[str, ...] = ()
    snapshot: str | None = None
    one_snapshot: bool = False
    # unit as the sheet writes it -> factor of the row total and average; unlisted units count as 1
    units: Mapping[str, float] = field(default_factory=dict)
    unit_column: str = "scale_precision"


# Units as the sheets write them.
UNITS = {"Units": 1.0, "Thousands": 1_000.0, "Millions": 1_000_000.0, "Billions": 1_000_000_000.0}

ANNUAL = PanelSpec()
QUARTERLY = SheetSpec()
CLEAN_SHEET = SheetSpec(tokens=("nan", "..", ""), key_tokens=("nan",))
