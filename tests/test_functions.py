import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelspark.functions import (
    cast_measure, cast_measures, header_name, normalize_identifier, percent, percent_step, period_to_int,
    total_of, unique_names,
)

# text -> number, or None; the token 'nan' is listed
LENIENT = {
    "12.5": 12.5, " 1.5 ": 1.5, "1e3": 1000.0, "-4": -4.0, "nan": None, None: None, "..": None, "": None,
    "None": None, "1d": None, "1.5f": None, "2D ": None, "inf": math.inf, "-Infinity": -math.inf,
}


def number_frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")


def test_lenient_cast(spark):
    df = number_frame(spark, LENIENT)
    got = [r.v for r in df.select("i", cast_measure(F.col("t"), strict=False).alias("v")).orderBy("i").collect()]
    assert got == list(LENIENT.values())


def test_unlisted_nan_text_becomes_nan(spark):
    df = number_frame(spark, ["nan", "NaN"])
    got = [r.v for r in df.select(cast_measure(F.col("t"), (), strict=False).alias("v")).collect()]
    assert all(math.isnan(v) for v in got)
    # the token is matched exactly, so 'NaN' survives it
    got = [r.v for r in df.select("i", cast_measure(F.col("t")).alias("v")).orderBy("i").collect()]
    assert got[0] is None and math.isnan(got[1])


@pytest.mark.parametrize("bad", ["None", "", "..", "1d", "12x"])
@pytest.mark.parametrize("ansi", ["true", "false"])
def test_strict_cast_raises_in_either_mode(spark, bad, ansi):
    df = spark.createDataFrame([(1, "1.0", bad)], "i int, a string, b string")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(PySparkException):
            df.select(cast_measure(F.col("b"))).collect()
        with pytest.raises(PySparkException):
            cast_measures(df, ["a", "b"], "v").collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def test_many_columns_cast_like_one(spark):
    texts = list(LENIENT)
    df = spark.createDataFrame([(1, *texts)], "i int, " + ", ".join(f"c{k} string" for k in range(len(texts))))
    got = cast_measures(df, [f"c{k}" for k in range(len(texts))], "v", strict=False).first()
    assert got.i == 1 and got.v == list(LENIENT.values())
    strict = spark.createDataFrame([("1", "nan", None, "inf")], "a string, b string, c string, d string")
    assert cast_measures(strict, ["a", "b", "c", "d"], "v").first().v == [1.0, None, None, math.inf]


def test_several_tokens(spark):
    df = number_frame(spark, ["..", "", "nan", "7"])
    got = [r.v for r in df.select("i", cast_measure(F.col("t"), ("nan", "..", "")).alias("v")).orderBy("i").collect()]
    assert got == [None, None, None, 7.0]


def test_period_and_ratios(spark):
    row = spark.range(1).select(
        period_to_int(F.lit("year_2005")).alias("y"),
        percent(F.lit(1.0), F.lit(4.0)).alias("p"),
        percent(F.lit(1.0), F.lit(0.0)).alias("zero"),
        percent(F.lit(1.0), F.lit(None).cast("double")).alias("none"),
        percent_step(F.lit(-1.0), F.lit(-2.0)).alias("negative"),
    )
    assert tuple(row.first()) == (2005, 25.0, None, None, -50.0)
    assert dict(row.dtypes)["y"] == "bigint"


def test_exact_sum(spark):
    df = spark.createDataFrame([(0.1,)] * 10, "v double")
    assert df.agg(total_of(F.col("v"), 2).alias("s")).first().s == 1.0


HEADERS = {
    "2021Q1 [2021Q1]": "q_2021q1",
    "Country Name": "country_name",
    "": "unknown",
    "[x]": "unknown",
    "__A--b__": "a_b",
    "é[a] 1": "q_1",
    "a [x]b": "ab",
    "a [x\ny] b": "a_x_y_b",
    "a [x\ry] b": "a_b",
    "Scale (Precision)": "scale_precision",
    "123": "q_123",
}


def test_headers():
    assert {h: header_name(h) for h in HEADERS} == HEADERS


def test_column_form_equals_header_form(spark):
    df = spark.createDataFrame([(h,) for h in HEADERS], "h string")
    assert {r.h: r.n for r in df.select("h", normalize_identifier(F.col("h")).alias("n")).collect()} == HEADERS


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_header_is_idempotent_and_clean(text):
    name = header_name(text)
    assert header_name(name) == name
    assert name and set(name) <= set("abcdefghijklmnopqrstuvwxyz0123456789_") and not name[0].isdigit()


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"])), min_size=50, max_size=200))
def test_column_form_on_random_text(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.n for r in df.select("i", normalize_identifier(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == [header_name(t) for t in texts]


def test_unique_names():
    assert unique_names(["a", "b", "a", "a"]) == ["a", "b", "a_1", "a_2"]
    assert unique_names(["a", "a", "a_1"]) == ["a", "a_1", "a_1_1"]
    assert unique_names(["a", "a_1", "a"]) == ["a", "a_1", "a_2"]


@given(st.lists(st.sampled_from(["a", "a_1", "a_2", "a_1_1", "b"]), max_size=12))
def test_unique_names_are_unique(names):
    out = unique_names(names)
    assert len(set(out)) == len(names)
    assert all(o == n or o.startswith(n + "_") for o, n in zip(out, names))
