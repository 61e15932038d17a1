"""Column expressions for measures kept as text, ratios and reproducible sums."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


# Usual marks for "no figure". They are no numbers, so a lenient cast gives NULL for
# them anyway; looking for them first spares the exception the JVM would raise per cell.
NO_FIGURE = ("..", "", "-", "...", "None", "null", "NULL", "NA", "N/A", "n/a")


def tokens_to_null(col: Column, tokens: Iterable[str]) -> Column:
    """NULL where the text is exactly one of ``tokens`` (case matters)."""
    tokens = list(tokens)
    if not tokens:
        return col
    if len(tokens) == 1:
        return F.nullif(col, F.lit(tokens[0]))
    return F.when(~col.isin(tokens), col)


def _java_number(col: Column) -> Column:
    """Text such as '1d', '1.5f' or '0x1p3': Java reads it as a number, the warehouse dialect does not.

    The cheap look at single characters spares nearly every cell the patterns.
    """
    ends = reduce(lambda a, b: a | b, [col.endswith(c) for c in "dDfF \t\r\n"])
    hexadecimal = (F.contains(col, F.lit("x")) | F.contains(col, F.lit("X"))) & col.rlike(r"^\s*[+-]?0[xX]")
    return (ends & col.rlike(r"[0-9.][dDfF]\s*$")) | hexadecimal


def cast_measure(col: Column, tokens: Iterable[str] = ("nan",), strict: bool = True) -> Column:
    """Text to double after dropping missing-value tokens.

    ``strict`` raises on text that is no number, whatever the session's ANSI
    setting; otherwise such text becomes NULL. A text 'nan' that is not listed
    in ``tokens`` becomes NaN.
    """
    text = tokens_to_null(col, tokens if strict else (*tokens, *NO_FIGURE))
    number = F.when(_java_number(col), F.lit(None)).otherwise(text.try_cast("double"))
    if not strict:
        return number
    complaint = F.raise_error(F.concat(F.lit("not a number: '"), col, F.lit("'"))).cast("double")
    return F.coalesce(number, F.when(text.isNotNull(), complaint))


def cast_measures(
    df: DataFrame, cols: Iterable[str], out: str, tokens: Iterable[str] = ("nan",), strict: bool = True
) -> DataFrame:
    """:func:`cast_measure` for many columns at once: adds array<double> ``out``, drops ``cols``.

    Written cell by cell over an array, or as one cast of the array: one
    expression per column would make a method so long that the JVM never
    compiles it. The strict cast takes the whole array at once and goes by cell
    only in rows that need a closer look (text with a d, f or x in it; a value lost
    in the cast where the session does not raise by itself). The lenient cast
    always goes by cell, because every bad cell in an array cast costs an exception.
    """
    cols = list(cols)
    kept = [c for c in df.columns if c not in cols]
    if not strict:
        texts = F.array(*cols)
        return df.select(*kept, F.transform(texts, lambda t: cast_measure(t, tokens, strict=False)).alias(out))
    raises = df.sparkSession.conf.get("spark.sql.ansi.enabled") == "true"
    texts, kind = F.array(*[tokens_to_null(F.col(c), tokens) for c in cols]), "array<double>"
    numbers = F.col("_texts").cast(kind) if raises else F.col("_texts").try_cast(kind)
    cast = df.select(*kept, texts.alias("_texts")).select(
        "*", numbers.alias("_numbers"), F.concat_ws("|", "_texts").alias("_line")
    )
    doubtful = reduce(lambda a, b: a | b, [F.contains("_line", F.lit(c)) for c in "dDfFxX"])
    if not raises:
        doubtful = doubtful | (F.size(F.array_compact("_texts")) != F.size(F.array_compact("_numbers")))
    one_by_one = F.transform("_texts", lambda t: cast_measure(t, ()))
    return cast.select(*kept, F.when(doubtful, one_by_one).otherwise(F.col("_numbers")).alias(out))


def period_to_int(col: Column, prefix: str = "year_") -> Column:
    """'year_2005' to 2005 (bigint)."""
    return F.replace(col, F.lit(prefix), F.lit("")).cast("bigint")


def quarter_to_int(col: Column, prefix: str = "q_") -> Column:
    """'q_2021q3' to 8086 (bigint): four times the year plus 0 to 3, so quarters in a row differ by 1."""
    digits = F.replace(col, F.lit(prefix), F.lit(""))
    return (F.substring(digits, 1, 4).cast("bigint") * 4 + F.substring(digits, 6, 1).cast("bigint") - 1)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, NULL where whole is 0 or either side is NULL."""
    return F.try_divide(part, whole)


def percent(part: Column, whole: Column) -> Column:
    return ratio(part, whole) * 100


def percent_step(now: Column, before: Column) -> Column:
    """Change from ``before`` to ``now`` in % of ``before``, its sign kept."""
    return percent(now - before, before)


def total_of(col: Column, decimals: int | None = None) -> Column:
    """Sum as double.

    With ``decimals`` the sum runs on exact decimals, so it no longer depends on
    the order in which partitions arrive; a double sum does, in its last digits.
    """
    if decimals is None:
        return F.sum(col)
    return F.sum(col.cast(f"decimal(18,{decimals})")).cast("double")


def mean_of(col: Column, decimals: int | None = None) -> Column:
    if decimals is None:
        return F.avg(col)
    return total_of(col, decimals) / F.nullif(F.count(col), F.lit(0))
