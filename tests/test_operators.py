import logging

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelspark.operators import (
    align_union, attach_total, check_missing_series, check_not_null, check_range, check_unique, classify,
    clean_codes, dedupe_names, label_codes, latest_snapshot, merge_rollups, normalize_headers, pct_change, period_columns,
    prefix_numeric_columns, previous_value, require_present, rollup_by_group, rollup_listed, rollup_sketch, row_average,
    row_total, service_pressure, share_of_total, spread_series, stamp, stringify, top_n, unpivot_periods,
)
from panelspark.sources import load_all, observe_counts

PANEL = "country string, series string, year bigint, v double"


# ------------------------------------------------------------------ alignment


def test_stamp(spark, rows):
    df = stamp(spark.createDataFrame([("a",)], "x string"), series_code="S", extracted_at="2025-01-01")
    assert rows(df) == [("a", "S", "2025-01-01")] and df.columns == ["x", "series_code", "extracted_at"]


def test_align_union_ignores_column_order(spark, rows):
    a = spark.createDataFrame([(1, "x")], "k int, a string")
    b = spark.createDataFrame([("y", 2)], "b string, k int")
    both = align_union([a, b])
    assert rows(both, "k", "a", "b") == [(1, "x", None), (2, None, "y")]
    assert rows(align_union([b, a]), "k", "a", "b") == rows(both, "k", "a", "b")
    with pytest.raises(ValueError):
        align_union([])


def test_column_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["1998", "Country", "1999", "12a"])
    assert prefix_numeric_columns(df).columns == ["year_1998", "Country", "year_1999", "12a"]
    raw = spark.createDataFrame([(1, 2, 3, 4)], ["2021Q1 [2021Q1]", "2021Q1", "Country Name", "[x]"])
    assert normalize_headers(raw).columns == ["q_2021q1", "q_2021q1_1", "country_name", "unknown"]


def test_stringify(spark, rows):
    df = spark.createDataFrame([(1, None), (None, "b")], "a int, `b.c` string")
    assert rows(stringify(df)) == [("1", "nan"), ("nan", "b")]


def test_dedupe_names(spark, rows):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "a"), (5, None)], "i int, n string")
    assert rows(dedupe_names(df, "n", ["i"]), "i", "unique_name") == [
        (1, "a"), (2, "b"), (3, "a_1"), (4, "a_2"), (5, None)
    ]
    held = ["a", "a", "a_1", "a", "a_1", "a_1_1", "a_2"]
    taken = dedupe_names(spark.createDataFrame(list(enumerate(held)), "i int, n string"), "n", ["i"])
    got = {r.i: r.unique_name for r in taken.collect()}
    assert len(set(got.values())) == len(held)
    assert all(got[held.index(n)] == n for n in set(held)) and all(got[i].startswith(n) for i, n in enumerate(held))


def test_load_all_skips_and_warns(spark, rows, caplog):
    sources = {
        "good": lambda: spark.createDataFrame([(1,)], "a int"),
        "gone": lambda: spark.read.parquet("/no/such/path"),
        "more": lambda: spark.createDataFrame([(2,)], "b int"),
    }
    with caplog.at_level(logging.WARNING):
        assert rows(load_all(sources)) == [(None, 2), (1, None)]
    assert "gone" in caplog.text
    with pytest.raises(PySparkException):
        load_all(sources, on_error="raise")
    with pytest.raises(RuntimeError):
        load_all({"gone": sources["gone"]})


def test_observe_counts(spark):
    df, seen = observe_counts(spark.range(7))
    assert df.count() == 7 and seen.get["rows"] == 7


# ------------------------------------------------------------------ codes and filters


def test_clean_codes(spark, rows):
    df = spark.createDataFrame([("KEN",), ("nan",), (None,), ("EU",), ("WLD",), ("XKX",)], "c string")
    assert rows(clean_codes(df, "c", 3, ["WLD"])) == [("KEN",), ("XKX",)]
    listed = spark.createDataFrame([("WLD",), ("WLD",)], "code string")
    assert rows(clean_codes(df, "c", 3, listed)) == [("KEN",), ("XKX",)]


def test_require_present_keeps_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "v double")
    assert require_present(df, "v").count() == 2


def test_label_codes(spark, rows):
    df = spark.createDataFrame([("A",), ("Z",), (None,)], "c string")
    expected = [(None, None), ("A", "Alpha"), ("Z", "Z")]
    assert rows(label_codes(df, "c", {"A": "Alpha"})) == expected
    assert rows(label_codes(df, "c", {})) == [(None, None), ("A", "A"), ("Z", "Z")]
    table = spark.createDataFrame([("A", "Alpha"), ("A", "Beta")], "code string, label string")
    assert rows(label_codes(df, "c", table)) == expected


GROUPS = {"Africa": ["EGY", "KEN"], "MENA": ["EGY", "JOR"]}


def test_classify_first_match_wins(spark, rows):
    df = spark.createDataFrame([("EGY",), ("JOR",), ("USA",), (None,)], "c string")
    expected = [(None, "Other"), ("EGY", "Africa"), ("JOR", "MENA"), ("USA", "Other")]
    assert rows(classify(df, "c", GROUPS)) == expected
    table = spark.createDataFrame(
        [("EGY", "MENA", 2), ("EGY", "Africa", 1), ("KEN", "Africa", 1), ("JOR", "MENA", 2)],
        "code string, grp string, priority int",
    )
    assert rows(classify(df, "c", table)) == expected
    many = spark.range(50_000).select(F.col("id").alias("c"))
    got = classify(many, "c", {"low": range(1_001), "high": range(500, 40_000)}).groupBy("group").count()
    assert rows(got) == [("Other", 10_000), ("high", 38_999), ("low", 1_001)]
    labelled = label_codes(many.select(F.col("c").cast("string")), "c", {str(i): "known" for i in range(40_000)})
    assert labelled.where("label = 'known'").count() == 40_000


# ------------------------------------------------------------------ snapshots and shape


def test_latest_snapshot(spark, rows):
    df = spark.createDataFrame(
        [("a", "2025-01-01"), ("a", "2025-04-01"), ("a", "2025-04-01"), ("b", "2025-01-01")],
        "series string, extracted_at string",
    )
    latest = latest_snapshot(df)
    assert rows(latest) == [("a", "2025-04-01")] * 2
    assert rows(latest_snapshot(latest)) == rows(latest)
    assert rows(latest_snapshot(df, per=["series"])) == [("a", "2025-04-01")] * 2 + [("b", "2025-01-01")]


def test_unpivot(spark, rows):
    df = spark.createDataFrame([("a", "1", None), ("b", None, "nan")], "c string, year_2000 string, year_2001 string")
    assert period_columns(df) == ["year_2000", "year_2001"]
    assert rows(unpivot_periods(df, ["c"])) == [("a", "year_2000", "1"), ("b", "year_2001", "nan")]
    assert unpivot_periods(df, ["c"], keep_nulls=True).count() == 4
    assert rows(unpivot_periods(df, ["c"], ["year_2001"])) == [("b", "year_2001", "nan")]
    with pytest.raises(ValueError):
        unpivot_periods(df, ["c"], pattern="^q_")


def test_spread_undoes_unpivot(spark, rows):
    wide = spark.createDataFrame([("a", "1", "2"), ("b", None, "4")], "c string, year_2000 string, year_2001 string")
    long = unpivot_periods(wide, ["c"])
    back = spread_series(long, ["c"], "year", "value", {"year_2000": "year_2000", "year_2001": "year_2001"})
    assert rows(back) == rows(wide)


# ------------------------------------------------------------------ ratios


def test_attach_total_and_share(spark, rows):
    df = spark.createDataFrame(
        [
            ("A", "T", 2000, 10.0), ("A", "x", 2000, 4.0), ("A", "x", 2001, 5.0),
            ("B", "T", 2000, 0.0), ("B", "x", 2000, 3.0),
        ],
        PANEL,
    )
    shared = share_of_total(attach_total(df, ["country", "year"], "series", "T", "v"), "v", "total")
    assert rows(shared, "country", "series", "year", "total", "pct_of_total") == [
        ("A", "T", 2000, 10.0, 100.0), ("A", "x", 2000, 10.0, 40.0), ("A", "x", 2001, None, None),
        ("B", "T", 2000, 0.0, None), ("B", "x", 2000, 0.0, None),
    ]


def test_total_stored_twice(spark):
    df = spark.createDataFrame([("A", "T", 2000, 1.0), ("A", "T", 2000, 1.0), ("A", "x", 2000, 4.0)], PANEL)
    assert attach_total(df, ["country", "year"], "series", "T", "v", duplicates="join").count() == 6
    with pytest.raises(PySparkException, match="stored twice"):
        attach_total(df, ["country", "year"], "series", "T", "v").collect()
    without = df.where("series = 'x'")
    checked = attach_total(without, ["country", "year"], "series", "T", "v")
    assert [r.total for r in checked.collect()] == [None]


@pytest.mark.parametrize("few_periods", [False, True])
def test_previous_value(spark, rows, few_periods):
    df = spark.createDataFrame(
        [("A", "x", y, v) for y, v in [(1998, 10.0), (1999, 0.0), (2001, 5.0), (2002, -5.0), (2003, -4.0)]]
        + [("B", "x", 2001, 7.0)],
        PANEL,
    )
    keys = ["country", "series"]
    got = previous_value(df, keys, "year", "v", few_periods=few_periods)
    assert rows(got, "country", "year", "prev_value") == [
        ("A", 1998, None), ("A", 1999, 10.0), ("A", 2001, 0.0), ("A", 2002, 5.0), ("A", 2003, -5.0), ("B", 2001, None)
    ]
    strict = previous_value(df, keys, "year", "v", strict_period=True, few_periods=few_periods)
    assert rows(strict.where("year = 2001"), "country", "prev_value") == [("A", None), ("B", None)]
    change = pct_change(df, keys, "year", "v", few_periods=few_periods)
    assert rows(change, "country", "year", "pct_change") == [
        ("A", 1998, None), ("A", 1999, -100.0), ("A", 2001, None), ("A", 2002, -200.0), ("A", 2003, -20.0),
        ("B", 2001, None),
    ]


# ------------------------------------------------------------------ roll-up, service, top


ROLL = [("EGY", "s", 2000, 1.0), ("EGY", "s", 2000, 2.0), ("KEN", "s", 2000, 6.0), ("JOR", "s", 2000, 5.0), ("USA", "s", 2000, 9.0)]


def test_rollup_by_lists_equals_rollup_by_column(spark, rows):
    df = spark.createDataFrame(ROLL, PANEL)
    by = ["series", "year"]
    listed = rollup_listed(df, by, "country", "v", GROUPS)
    assert rows(listed) == [("Africa", "s", 2000, 2, 9.0, 3.0, 6.0, 1.0), ("MENA", "s", 2000, 1, 5.0, 5.0, 5.0, 5.0)]
    classified = classify(df, "country", GROUPS).where("group <> 'Other'")
    assert rows(rollup_by_group(classified, ["group", *by], "country", "v")) == rows(listed)
    assert rows(rollup_by_group(classified, ["group", *by], "country", "v", decimals=2)) == rows(listed)
    near = rollup_by_group(classified, ["group", *by], "country", "v", approximate=True)
    assert rows(near) == rows(listed)


def test_rollup_with_lists_of_any_length(spark):
    codes = {"big": [f"c{i}" for i in range(1500)], "small": [f"c{i}" for i in range(1400, 1600)]}
    df = spark.createDataFrame([(f"c{i % 1700}", 1, 1.0) for i in range(5000)], "country string, year int, v double")
    got = {r.group: (r.entity_count, r.total) for r in rollup_listed(df, ["year"], "country", "v", codes).collect()}
    assert got["big"][0] == 1500 and got["small"][0] == 100
    few = {"a": [f"c{i}" for i in range(70)], "b": [f"c{i}" for i in range(60, 200)]}
    got = {r.group: r.entity_count for r in rollup_listed(df, ["year"], "country", "v", few).collect()}
    assert got == {"a": 70, "b": 130}


def test_row_total_and_average(spark, rows):
    nan = float("nan")
    df = spark.createDataFrame(
        [(1, 1.0, 2.0, 3.0, 4.0), (2, None, 2.0, None, None), (3, None, None, None, None), (4, nan, 1.0, 1.0, 1.0)],
        "i int, a double, b double, c double, d double",
    )
    cols = ["a", "b", "c", "d"]
    got = {r.i: (r.row_total, r.row_average) for r in row_average(row_total(df, cols), cols).collect()}
    assert got[1] == (10.0, 2.5) and got[2] == (2.0, 0.5) and got[3] == (0.0, 0.0)
    assert got[4][0] != got[4][0]
    clean = {r.i: r.row_total for r in row_total(df, cols, nan_as_zero=True).collect()}
    assert clean[4] == 3.0
    scaled = {r.i: r.row_total for r in row_total(df, cols, scale=F.lit(1000.0)).collect()}
    assert scaled[1] == 10000.0
    assert row_average(df, cols, denominator=0).first().row_average is None


def test_top_n_breaks_ties(spark, rows):
    df = spark.createDataFrame([("b", 5.0), ("a", 5.0), ("c", 9.0), ("d", None)], "k string, v double")
    assert [r.k for r in top_n(df, 2, "v", ["k"]).collect()] == ["c", "a"]


def test_service_pressure(spark, rows):
    paid = spark.createDataFrame([("a", 5.0), ("b", 1.0), ("c", 2.0), ("d", 9.0)], "k string, p double")
    owed = spark.createDataFrame([("a", 10.0), ("b", 2.0), ("c", 0.0)], "k string, d double")
    assert rows(service_pressure(paid, owed, "k", "p", "d"), "k", "pressure_pct", "pressure_rank") == [
        ("a", 50.0, 1), ("b", 50.0, 1), ("c", None, 3), ("d", None, 3)
    ]


# ------------------------------------------------------------------ checks


def test_checks(spark, rows):
    df = spark.createDataFrame(
        [("A", "x", 2000, 1.0), ("A", "x", 2000, 2.0), ("B", None, 1990, 1.0), ("B", "x", None, 1.0)], PANEL
    )
    assert rows(check_not_null(df, ["country", "series", "year"], "t")) == [
        ("t", "country", 4, 0), ("t", "series", 4, 1), ("t", "year", 4, 1)
    ]
    assert rows(check_unique(df, ["country", "series", "year"])) == [("A", "x", 2000, 2)]
    assert rows(check_range(df, "year", 1998, 2025)) == [(1990, 1)]


def test_missing_series(spark, rows):
    df = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("c", "2")], "s string, snap string")
    assert rows(check_missing_series(df, "s", "snap")) == [("b", "1", "2")]


def test_rollup_sketches_merge(spark, tmp_path):
    """Stored per year, merged over years: the distinct count within its stated error, the rest exact; years added later merge too."""
    df = spark.range(60_000).select(
        (F.col("id") % 6 + 2000).alias("year"), F.when(F.col("id") % 4 == 0, F.lit("few")).otherwise(F.lit("many")).alias("g"),
        F.when(F.col("id") % 4 == 0, F.col("id") % 100).otherwise(F.col("id") % 20_000).cast("string").alias("entity"),
        (F.col("id") % 1000 / 8).alias("v"),
    )
    exact = {r.g: r for r in rollup_by_group(df, ["g"], "entity", "v").collect()}
    for part in ("year < 2004", "year >= 2004"):
        rollup_sketch(df.where(part), ["g", "year"], "entity", "v").write.mode("append").parquet(str(tmp_path / "sketches"))
    stored = spark.read.parquet(str(tmp_path / "sketches"))
    assert stored.count() == len({(r.g, r.year) for r in df.select("g", "year").distinct().collect()})
    merged = {r.g: r for r in merge_rollups(stored, ["g"]).collect()}
    assert merged["few"].entity_count == exact["few"].entity_count == 25
    assert abs(merged["many"].entity_count - exact["many"].entity_count) < 4 * 0.013 * exact["many"].entity_count
    for g, r in exact.items():
        assert (merged[g].total, merged[g].maximum, merged[g].minimum) == (r.total, r.maximum, r.minimum)
        assert abs(merged[g].average - r.average) < 1e-9
    assert merge_rollups(stored.limit(0), ["g"]).count() == 0
