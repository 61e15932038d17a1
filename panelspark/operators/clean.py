"""Row filters and code lists."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import pin


def require_present(df: DataFrame, *cols: str, tokens: Iterable[str] = ()) -> DataFrame:
    """Keep rows whose ``cols`` are neither NULL nor one of the missing-value ``tokens``.

    Written as IS NOT NULL, which reaches a Parquet scan and lets NaN pass;
    ``dropna`` does neither.
    """
    tokens = list(tokens)
    for c in cols:
        df = df.where(F.col(c).isNotNull())
        if tokens:
            df = df.where(~F.col(c).isin(tokens))
    return df


def clean_codes(
    df: DataFrame,
    code: str,
    length: int | None = None,
    exclude: Iterable[str] | DataFrame = (),
    tokens: Iterable[str] = ("nan",),
) -> DataFrame:
    """Keep rows with a present code of the right length that is not excluded.

    ``exclude`` is a list of codes, or a frame whose first column holds them;
    the frame is anti-joined and Catalyst picks the join from its size.
    """
    df = require_present(df, code, tokens=tokens)
    if length is not None:
        df = df.where(F.length(code) == length)
    if isinstance(exclude, DataFrame):
        listed = exclude.select(F.col(exclude.columns[0]).alias(code))
        return df.join(listed, code, "left_anti").select(*df.columns)
    codes = list(exclude)
    return df.where(~F.col(code).isin(codes)) if codes else df


def label_codes(
    df: DataFrame,
    code: str,
    labels: Mapping[str, str] | DataFrame,
    out: str = "label",
) -> DataFrame:
    """Label for every code; an unknown code is its own label.

    ``labels`` is a mapping of any length, which is part of the plan each task
    gets anyway and is joined as a broadcast frame, or a frame (code, label). That
    is reduced to one row per code first, so a code listed twice cannot multiply
    rows, and pinned: its size on disk decides whether it is broadcast, and if it
    is not, AQE can still split a hot code.
    """
    if isinstance(labels, DataFrame):
        c, label = labels.columns[:2]
        one_each = pin(labels.groupBy(F.col(c).alias(code)).agg(F.min(label).alias("_label")), "labels")
        joined = df.join(one_each, code, "left")
        return joined.select(*df.columns, F.coalesce("_label", code).alias(out))
    joined = _join_mapping(df, code, dict(labels), "_label")
    return joined.select(*df.columns, F.coalesce("_label", code).alias(out))


def classify(
    df: DataFrame,
    code: str,
    groups: Mapping[str, Iterable] | DataFrame,
    out: str = "group",
    default: str = "Other",
) -> DataFrame:
    """Group of every code: the first group that lists it wins, else ``default``.

    ``groups`` is an ordered mapping group -> codes of any length, or a frame
    (code, group, priority) in which the lowest priority wins. The frame is reduced
    to one row per code before the join (a code in two groups would fan out) and
    pinned. Both are joined as in :func:`label_codes`.
    """
    if isinstance(groups, DataFrame):
        c, group, priority = groups.columns[:3]
        winner = groups.groupBy(F.col(c).alias(code)).agg(F.min_by(group, priority).alias("_group"))
        joined = df.join(pin(winner, "groups"), code, "left")
        return joined.select(*df.columns, F.coalesce("_group", F.lit(default)).alias(out))
    joined = _join_mapping(df, code, first_listed(groups), "_group")
    return joined.select(*df.columns, F.coalesce("_group", F.lit(default)).alias(out))


def literal_rows(spark: SparkSession, rows: Iterable[tuple], names: Iterable[str], kinds: Iterable[str]) -> DataFrame:
    """Rows given in the program as one literal of the plan; names are plain words.

    One literal however many rows, folded when the plan is optimised. ``createDataFrame`` would ship
    the rows as an RDD made by Python instead.
    """
    names = list(names)
    schema = f"array<struct<{', '.join(f'{n}: {k}' for n, k in zip(names, kinds))}>>"
    text = json.dumps([dict(zip(names, row)) for row in rows])
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(text), schema)))


def first_listed(groups: Mapping[str, Iterable]) -> dict:
    """code -> the first group that lists it."""
    first: dict = {}
    for group, codes in groups.items():
        for code in codes:
            first.setdefault(code, group)
    return first


def _join_mapping(df: DataFrame, code: str, mapping: dict, out: str) -> DataFrame:
    if not mapping:
        return df.withColumn(out, F.lit(None).cast("string"))
    kind = df.schema[code].dataType.simpleString()
    rows = literal_rows(df.sparkSession, [(str(k), v) for k, v in mapping.items() if k is not None], ("_code", out), ("string", "string"))
    rows = rows.select(F.col("_code").cast(kind).alias("_code"), out)
    return df.join(F.broadcast(rows), F.col(code) == F.col("_code"), "left").drop("_code")
