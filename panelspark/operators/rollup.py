"""Roll-up of entities into groups."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.measures import mean_of, ratio, total_of
from .clean import first_listed, literal_rows

# Bits used per bigint word; the sign bit stays clear.
_WORD = 63


def rollup_by_group(
    df: DataFrame,
    by: Iterable[str],
    entity: str,
    value: str,
    decimals: int | None = None,
    approximate: bool = False,
    names: tuple[str, str, str, str, str] = ("entity_count", "total", "average", "maximum", "minimum"),
    counted: Column | None = None,
) -> DataFrame:
    """Distinct entities, sum, mean, maximum and minimum of ``value`` per ``by``.

    ``counted`` replaces the distinct count by a cheaper exact expression, where there is one.
    """
    if counted is None:
        counted = F.approx_count_distinct(entity) if approximate else F.count_distinct(entity)
    count, total, average, maximum, minimum = names
    return df.groupBy(*list(by)).agg(
        counted.cast("bigint").alias(count),
        total_of(F.col(value), decimals).alias(total),
        mean_of(F.col(value), decimals).alias(average),
        F.max(value).alias(maximum),
        F.min(value).alias(minimum),
    )


def rollup_listed(
    df: DataFrame,
    by: Iterable[str],
    entity: str,
    value: str,
    groups: Mapping[str, Iterable[str]],
    out: str = "group",
    decimals: int | None = None,
    names: tuple[str, str, str, str, str] = ("entity_count", "total", "average", "maximum", "minimum"),
) -> DataFrame:
    """Classify by ordered code lists of any length, drop unlisted codes, and roll up.

    The lists name every entity that can occur, so each code gets one bit of one
    word, and the distinct count is the number of bits set in all words. Unlike
    count(distinct), which shuffles one row per group and entity, that combines
    map-side: one row per group, word of 63 codes and task is shuffled, and then
    one per group. The lists are part of the plan and joined as a broadcast frame.
    """
    by = list(by)
    listed = [
        (code, group, i // _WORD, 1 << (i % _WORD)) for i, (code, group) in enumerate(first_listed(groups).items())
    ]
    dimension = literal_rows(df.sparkSession, listed, ("_code", "_group", "_word", "_bit"), ("string", "string", "int", "bigint"))
    grouped = df.join(F.broadcast(dimension), F.col(entity) == F.col("_code"))
    number = F.col(value) if decimals is None else F.col(value).cast(f"decimal(18,{decimals})")
    words = grouped.groupBy(F.col("_group").alias(out), *by, "_word").agg(
        F.bit_or("_bit").alias("_bits"), F.sum(number).alias("_sum"), F.count(value).alias("_n"),
        F.max(value).alias("_max"), F.min(value).alias("_min"),
    )
    count, total, average, maximum, minimum = names
    whole = F.sum("_sum").cast("double")
    return words.groupBy(out, *by).agg(
        F.sum(F.bit_count("_bits")).cast("bigint").alias(count),
        whole.alias(total),
        ratio(whole, F.sum("_n").cast("double")).alias(average),
        F.max("_max").alias(maximum),
        F.min("_min").alias(minimum),
    )


def rollup_sketch(
    df: DataFrame, by: Iterable[str], entity: str, value: str, decimals: int | None = None, precision: int = 12
) -> DataFrame:
    """Roll-up that can be rolled up again: ``by``, entities, sum, n, most, least.

    ``entities`` is a HyperLogLog sketch of the distinct entities, 2 ** ``precision`` registers whatever their number. Unlike a
    count it merges: over years, regions, or with the sketches of rows that arrive later
    (:func:`merge_rollups`). One standard error is about 0.83 / sqrt(2 ** ``precision``), 1.3 % by default;
    few entities are counted exactly.
    """
    number = F.col(value) if decimals is None else F.col(value).cast(f"decimal(18,{decimals})")
    return df.groupBy(*list(by)).agg(
        F.hll_sketch_agg(entity, precision).alias("entities"), F.sum(number).alias("sum"), F.count(value).alias("n"),
        F.max(value).alias("most"), F.min(value).alias("least"),
    )


def merge_rollups(
    sketches: DataFrame,
    by: Iterable[str],
    names: tuple[str, str, str, str, str] = ("entity_count", "total", "average", "maximum", "minimum"),
) -> DataFrame:
    """Rows of :func:`rollup_sketch` merged per ``by``, any of their keys, and read: the columns of :func:`rollup_by_group`.

    The count is the sketches' estimate; sum, mean, maximum and minimum are what the rows would give.
    """
    count, total, average, maximum, minimum = names
    whole = F.sum("sum").cast("double")
    return sketches.groupBy(*list(by)).agg(
        F.hll_sketch_estimate(F.hll_union_agg("entities")).cast("bigint").alias(count),
        whole.alias(total),
        ratio(whole, F.sum("n").cast("double")).alias(average),
        F.max("most").alias(maximum),
        F.min("least").alias(minimum),
    )


def top_n(df: DataFrame, n: int, by: str, tie_break: Iterable[str]) -> DataFrame:
    """The ``n`` rows with the largest ``by``; ``tie_break`` must make the order unique.

    Every task keeps its own n best rows, only those reach the last one.
    """
    return df.orderBy(F.desc_nulls_last(by), *list(tie_break)).limit(n)
