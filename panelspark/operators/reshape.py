"""Snapshot choice, unpivot and its opposite."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import pin

YEAR_COLUMNS = r"^year_\d{4}$"
QUARTER_COLUMNS = r"^q_\d{4}q[1-4]$"
SNAPSHOT_PARTITION = "extracted_date"


def period_columns(df: DataFrame, pattern: str = YEAR_COLUMNS) -> list[str]:
    """Columns whose name matches ``pattern``, in name order (= period order)."""
    return sorted(c for c in df.columns if re.match(pattern, c))


def latest_snapshot(df: DataFrame, by: str | None = None, per: Iterable[str] = ()) -> DataFrame:
    """Rows of the newest snapshot, all of them.

    ``by`` defaults to the partition column when the frame has it: the maximum
    then becomes a partition filter and older snapshots are never opened. With
    ``per`` the newest snapshot is chosen per key (e.g. per series), which keeps
    a series that the newest snapshot lost; the one row per key is pinned, so its
    real size decides whether it is broadcast. For a registered table
    :func:`newest_partition` finds the date without reading it.
    """
    if by is None:
        by = SNAPSHOT_PARTITION if SNAPSHOT_PARTITION in df.columns else "extracted_at"
    per = list(per)
    if not per:
        return df.where(F.col(by) == df.select(F.max(by)).scalar())
    newest = pin(df.groupBy(*per).agg(F.max(by).alias(by)), "newest")
    return df.join(newest, [*per, by], "left_semi").select(*df.columns)


def newest_partition(spark: SparkSession, table: str, column: str = SNAPSHOT_PARTITION) -> str | None:
    """Greatest value of the partition ``column`` of a registered table, as text, from the catalog's list of partitions.

    No file is opened. As a literal it prunes partitions when the plan is made, where the maximum
    over the column would be a scan of its own. Whole numbers compare as such; None without partitions.
    """
    parts = spark.sql(f"SHOW PARTITIONS {table}")
    value = F.url_decode(F.regexp_extract("partition", f"(?:^|/){re.escape(column)}=([^/]*)", 1))
    found = parts.select(value.alias("v")).where("v NOT IN ('', '__HIVE_DEFAULT_PARTITION__')")
    first = found.agg(F.max_by("v", F.struct(F.expr("try_cast(v AS decimal(38,0))"), "v")).alias("v")).first()
    return first.v


def unpivot_periods(
    df: DataFrame,
    ids: Iterable[str],
    periods: Iterable[str] | None = None,
    pattern: str = YEAR_COLUMNS,
    names: tuple[str, str] = ("year", "value"),
    keep_nulls: bool = False,
) -> DataFrame:
    """One row per id and period column; NULL cells are left out unless kept."""
    columns = list(periods) if periods is not None else period_columns(df, pattern)
    if not columns:
        raise ValueError(f"no period column matches {pattern}")
    rows = df.unpivot(list(ids), columns, *names)
    return rows if keep_nulls else rows.where(F.col(names[1]).isNotNull())


def spread_series(
    df: DataFrame,
    keys: Iterable[str],
    series: str,
    value: str,
    codes: Mapping[str, str],
) -> DataFrame:
    """One column per series code (``codes``: code -> column name), maximum per cell.

    Conditional aggregates need one shuffle on ``keys`` and combine map-side;
    ``pivot`` would shuffle on keys + series first and on keys again.
    """
    cells = [F.max(F.when(F.col(series) == code, F.col(value))).alias(name) for code, name in codes.items()]
    return df.groupBy(*list(keys)).agg(*cells)
