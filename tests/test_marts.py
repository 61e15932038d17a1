"""The two preset panels, on literal frames in the landed schema."""

import math
from dataclasses import replace

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelspark.operators import attach_total, share_of_total
from panelspark.plans import (
    ANNUAL, CLEAN_SHEET, QUARTERLY, UNITS, regional_rollup, rollup_by_column, rollup_from_wide, service_mart, stage_panel,
    stage_sheet, stocks_mart, stocks_mart_from_wide,
)
from panelspark.plans.serve import composition, scorecard, share_trend, slice_panel, top_then_track, trend
from panelspark.plans.specs import AGGREGATE_CODES, REGIONS, SERIES_LABELS

TOTAL, PRIVATE = "DT.DOD.DECT.CD", "DT.DOD.DPNG.CD"
RAW = "economy string, Country string, year_2000 string, year_2001 string, year_2002 string, series_code string, extracted_at string"


def raw_annual(spark, extra=()):
    return spark.createDataFrame(
        [
            ("KEN", "Kenya", "100", "nan", "300", TOTAL, "2025-04-01"),
            ("KEN", "Kenya", "25", "50", "60", PRIVATE, "2025-04-01"),
            ("EGY", "Egypt", "0", "10", "20", TOTAL, "2025-04-01"),
            ("EGY", "Egypt", "5", None, "10", PRIVATE, "2025-04-01"),
            ("JOR", "Jordan", "8", "4", "nan", "NEW.CODE", "2025-04-01"),
            ("USA", "United States", "1", "2", "3", TOTAL, "2025-04-01"),
            ("WLD", "World", "bad text", "2", "3", TOTAL, "2025-04-01"),
            ("EU", "Union", "1", "2", "3", TOTAL, "2025-04-01"),
            ("nan", "None", "1", "2", "3", TOTAL, "2025-04-01"),
            (None, "Null", "1", "2", "3", TOTAL, "2025-04-01"),
            ("KEN", "Kenya", "7", "7", "7", TOTAL, "2025-01-01"),
            *extra,
        ],
        RAW,
    )


def test_reference_lists():
    assert len(SERIES_LABELS) == 9 and len(set(AGGREGATE_CODES)) == 35
    codes = [c for group in REGIONS.values() for c in group]
    assert [len(g) for g in REGIONS.values()] == [53, 22, 19, 8, 28, 20]
    assert len(set(codes)) == 144 and not set(codes) & set(AGGREGATE_CODES)


def test_stage_panel(spark, rows):
    staged = stage_panel(raw_annual(spark))
    assert staged.columns == [
        "country_code", "country_name", "series_code", "year", "debt_value_usd", "extracted_at", "series_description"
    ]
    assert dict(staged.dtypes)["year"] == "bigint"
    kept = rows(staged, "country_code", "series_code", "year", "debt_value_usd")
    assert kept == sorted([
        ("EGY", TOTAL, 2000, 0.0), ("EGY", TOTAL, 2001, 10.0), ("EGY", TOTAL, 2002, 20.0),
        ("EGY", PRIVATE, 2000, 5.0), ("EGY", PRIVATE, 2002, 10.0),
        ("JOR", "NEW.CODE", 2000, 8.0), ("JOR", "NEW.CODE", 2001, 4.0),
        ("KEN", TOTAL, 2000, 100.0), ("KEN", TOTAL, 2002, 300.0),
        ("KEN", PRIVATE, 2000, 25.0), ("KEN", PRIVATE, 2001, 50.0), ("KEN", PRIVATE, 2002, 60.0),
        ("USA", TOTAL, 2000, 1.0), ("USA", TOTAL, 2001, 2.0), ("USA", TOTAL, 2002, 3.0),
    ])
    labels = dict(rows(staged.select("series_code", "series_description").distinct()))
    assert labels == {TOTAL: "Total external debt stocks", PRIVATE: "Private nonguaranteed debt", "NEW.CODE": "NEW.CODE"}


def test_bad_text_raises_only_in_kept_rows(spark):
    assert stage_panel(raw_annual(spark)).count() == 15
    bad = raw_annual(spark, [("GHA", "Ghana", "None", "1", "1", TOTAL, "2025-04-01")])
    for build in (stage_panel, stocks_mart_from_wide):
        with pytest.raises(PySparkException):
            build(bad).collect()


STOCKS = [
    # country, series, year, value, total, share, previous, change
    ("EGY", TOTAL, 2000, 0.0, 0.0, None, None, None),
    ("EGY", TOTAL, 2001, 10.0, 10.0, 100.0, 0.0, None),
    ("EGY", TOTAL, 2002, 20.0, 20.0, 100.0, 10.0, 100.0),
    ("EGY", PRIVATE, 2000, 5.0, 0.0, None, None, None),
    ("EGY", PRIVATE, 2002, 10.0, 20.0, 50.0, 5.0, 100.0),
    ("JOR", "NEW.CODE", 2000, 8.0, None, None, None, None),
    ("JOR", "NEW.CODE", 2001, 4.0, None, None, 8.0, -50.0),
    ("KEN", TOTAL, 2000, 100.0, 100.0, 100.0, None, None),
    ("KEN", TOTAL, 2002, 300.0, 300.0, 100.0, 100.0, 200.0),
    ("KEN", PRIVATE, 2000, 25.0, 100.0, 25.0, None, None),
    ("KEN", PRIVATE, 2001, 50.0, None, None, 25.0, 100.0),
    ("KEN", PRIVATE, 2002, 60.0, 300.0, 20.0, 50.0, 20.0),
    ("USA", TOTAL, 2000, 1.0, 1.0, 100.0, None, None),
    ("USA", TOTAL, 2001, 2.0, 2.0, 100.0, 1.0, 100.0),
    ("USA", TOTAL, 2002, 3.0, 3.0, 100.0, 2.0, 50.0),
]


def both_marts(raw, spec=ANNUAL):
    return stocks_mart(stage_panel(raw, spec), spec), stocks_mart_from_wide(raw, spec)


def test_stocks_mart_both_ways(spark, rows):
    for mart in both_marts(raw_annual(spark)):
        assert mart.columns == [
            "country_code", "country_name", "series_code", "series_description", "year", "debt_value_usd",
            "extracted_at", "total_debt_usd", "pct_of_total_debt", "prev_year_value", "yoy_change_pct",
        ]
        got = rows(mart.drop("country_name", "series_description", "extracted_at"))
        assert got == sorted(STOCKS, key=lambda r: [(v is not None, str(v)) for v in r])


def test_total_row_stored_twice(spark):
    raw = raw_annual(spark, [("KEN", "Kenya", "1", "1", "1", TOTAL, "2025-04-01")])
    for build in (lambda: stocks_mart(stage_panel(raw)), lambda: stocks_mart_from_wide(raw)):
        with pytest.raises(PySparkException, match="stored twice"):
            build().collect()
    # as a join, each of Kenya's rows of 2000 and 2002 meets both totals
    joined = stocks_mart(stage_panel(raw), duplicates="join").where("country_code = 'KEN'")
    assert joined.where("year = 2000").count() == 6


cells = st.one_of(st.just("nan"), st.none(), st.integers(-50, 50).map(str))


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(cells, cells, cells), min_size=6, max_size=30))
def test_wide_and_long_agree(spark, rows, histories):
    series = [TOTAL, PRIVATE, "NEW.CODE"]
    data = [(f"C{i // 3:02d}", "n", *h, series[i % 3], "2025-04-01") for i, h in enumerate(histories)]
    long, wide = both_marts(spark.createDataFrame(data, RAW))
    assert rows(long) == rows(wide)


def test_shares_of_parts_sum_to_100(spark):
    data = [(c, s, float(v)) for c in "ab" for s, v in (("T", 10), ("x", 1), ("y", 2.5), ("z", 6.5))]
    df = spark.createDataFrame(data, "c string, s string, v double")
    shares = share_of_total(attach_total(df, ["c"], "s", "T", "v"), "v", "total")
    sums = shares.where("s <> 'T'").groupBy("c").agg(F.sum("pct_of_total").alias("s")).collect()
    assert all(math.isclose(r.s, 100.0) for r in sums)


def test_regional_rollup(spark, rows):
    staged = stage_panel(raw_annual(spark))
    rolled = regional_rollup(staged)
    assert rolled.columns == [
        "region", "series_code", "series_description", "year", "country_count", "total_debt_usd", "avg_debt_usd",
        "max_debt_usd", "min_debt_usd",
    ]
    private = rolled.where(F.col("series_code") == PRIVATE).drop("series_code", "series_description")
    assert rows(private) == [
        ("Africa", 2000, 2, 30.0, 15.0, 25.0, 5.0), ("Africa", 2001, 1, 50.0, 50.0, 50.0, 50.0),
        ("Africa", 2002, 2, 70.0, 35.0, 60.0, 10.0),
    ]
    # a code in no region (USA) leaves the roll-up, the twice listed one (EGY) is African
    assert {r.region for r in rolled.collect()} == {"Africa", "Middle East and North Africa"}


def test_rollup_from_wide_counts_distinct(spark, rows):
    def halves(*extra):
        return raw_annual(spark, extra).withColumn("half", F.when(F.col("economy") < "F", "a").otherwise("b"))

    staged = stage_panel(halves(), replace(ANNUAL, carry=("half",)))
    assert rows(rollup_from_wide(halves(), "half")) == rows(rollup_by_column(staged, "half"))
    # two rows of an entity and series would be counted twice
    with pytest.raises(PySparkException, match="stored twice"):
        rollup_from_wide(halves(("KEN", "Kenya", "1", "1", "1", PRIVATE, "2025-04-01")), "half").collect()


def test_split_rows_are_merged_or_raise(spark, rows):
    parts = [("GHA", "Ghana", "1", "nan", "4", PRIVATE, "2025-04-01"), ("GHA", "Ghana", None, "2", None, PRIVATE, "2025-04-01")]
    raw = raw_annual(spark, parts)
    with pytest.raises(PySparkException, match="stored twice"):
        stocks_mart_from_wide(raw).collect()
    merged = stocks_mart_from_wide(raw, split_rows="merge")
    assert rows(merged) == rows(stocks_mart(stage_panel(raw)))
    ghana = merged.where("country_code = 'GHA'").orderBy("year")
    assert [(r.year, r.prev_year_value) for r in ghana.collect()] == [(2000, None), (2001, 1.0), (2002, 2.0)]
    both = raw_annual(spark, [parts[0], parts[0]])
    with pytest.raises(PySparkException, match="value is stored twice"):
        stocks_mart_from_wide(both, split_rows="merge").collect()


def test_units_scale_the_service_mart(spark):
    spec = replace(CLEAN_SHEET, units=UNITS)
    raw = raw_quarterly(spark).withColumn(
        "scale_precision", F.when(F.col("country_code") == "KEN", F.lit("Thousands")).when(F.col("country_code") == "JOR", F.lit("odd"))
        .otherwise(F.lit("Millions")))
    got = {r.country_code: r.total_2021_payments for r in service_mart(stage_sheet(raw, spec), spec).collect()}
    assert got == {"KEN": 10e3, "EGY": 1e6, "JOR": 8.0}


def test_serving_queries(spark, rows):
    mart = stocks_mart_from_wide(raw_annual(spark))
    totals = mart.where(F.col("series_code") == TOTAL)
    assert rows(scorecard(totals, "debt_value_usd", "year")) == [(2002, 323.0)]
    assert rows(scorecard(mart, "debt_value_usd", "year", at=2001, by=["series_code"])) == [
        (TOTAL, 2001, 12.0), (PRIVATE, 2001, 50.0), ("NEW.CODE", 2001, 4.0)
    ]
    rolled = regional_rollup(stage_panel(raw_annual(spark)))
    assert rows(trend(rolled, "region", "year", "total_debt_usd", "series_code", TOTAL)) == [
        ("Africa", 2000, 100.0), ("Africa", 2001, 10.0), ("Africa", 2002, 320.0)
    ]
    spread = composition(
        mart, "country_code", "year", "series_code", "debt_value_usd", {TOTAL: "total", PRIVATE: "private"}
    )
    assert ("KEN", 2001, None, 50.0) in rows(spread)
    sliced = slice_panel(mart, "year", "country_code", [2000, 2002], ["KEN"])
    assert {(r.country_code, r.year) for r in sliced.collect()} == {("KEN", 2000), ("KEN", 2002)}
    tracked = top_then_track(
        mart, 1, "country_code", "year", "series_code", "debt_value_usd", TOTAL, PRIVATE, since=2001
    )
    assert rows(tracked) == [("KEN", 2001, 50.0), ("KEN", 2002, 60.0)]
    shares = share_trend(mart, ["country_code"], "year", "series_code", "debt_value_usd", PRIVATE, TOTAL)
    assert rows(shares) == [
        ("EGY", 2002, 50.0, None, None), ("KEN", 2000, 25.0, None, None), ("KEN", 2002, 20.0, -5.0, False)
    ]


SHEET = """country_name string, country_code string, series_name string, series_code string, scale_precision string,
q_2021q1 string, q_2021q2 string, q_2021q3 string, q_2021q4 string, q_2022q3 string, source_table string,
sheet_name string, extracted_at string"""


def raw_quarterly(spark):
    def row(name, code, quarters, stamp="2025-04-01", series="S"):
        return (name, code, "Series", series, "Units", *quarters, "table", "sheet", stamp)

    return spark.createDataFrame(
        [
            row("Kenya", "KEN", ("1", "2", "3", "4", "5")),
            row("Egypt", "EGY", ("1", "..", None, "1d", "5")),
            row("Jordan", "JOR", ("1", "nan", "3", "4", "5")),
            row("nan", "nan", ("1", "1", "1", "1", "1")),
            row(None, "XXX", ("1", "1", "1", "1", "1")),
            row("Ghana", "GHA", ("1", "1", "1", "1", "1"), series=None),
            row("Kenya", "KEN", ("9", "9", "9", "9", "9"), stamp="2025-01-01"),
        ],
        SHEET,
    )


def test_service_mart(spark):
    staged = stage_sheet(raw_quarterly(spark))
    assert staged.columns == [*QUARTERLY.ids, *QUARTERLY.quarters]
    mart = service_mart(staged)
    assert mart.columns == [
        *QUARTERLY.mart_ids, *QUARTERLY.quarters, "total_2021_payments", "avg_quarterly_payment_2021"
    ]
    got = {r.country_code: (r.total_2021_payments, r.avg_quarterly_payment_2021) for r in mart.collect()}
    assert set(got) == {"KEN", "EGY", "JOR", "nan"}  # the text 'nan' is not NULL
    assert got["KEN"] == (10.0, 2.5) and got["EGY"] == (1.0, 0.25)
    assert math.isnan(got["JOR"][0]) and math.isnan(got["JOR"][1])


def test_clean_sheet_preset(spark):
    mart = service_mart(stage_sheet(raw_quarterly(spark), CLEAN_SHEET), CLEAN_SHEET)
    got = {r.country_code: r.total_2021_payments for r in mart.collect()}
    assert got == {"KEN": 10.0, "EGY": 1.0, "JOR": 8.0}


def test_quarters_by_pattern(spark):
    staged = stage_sheet(raw_quarterly(spark), replace(QUARTERLY, quarters=None))
    assert [c for c in staged.columns if c.startswith("q_")] == sorted(QUARTERLY.quarters)
