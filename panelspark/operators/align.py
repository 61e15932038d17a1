"""Stamping, header cleaning and the union of frames with different columns."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.names import header_name, unique_names
from ..session import pin
from .slices import number_within


def stamp(df: DataFrame, **constants: object) -> DataFrame:
    """Add constant columns (series code, source table, sheet name, extraction date)."""
    return df.withColumns({name: F.lit(value) for name, value in constants.items()})


def align_union(frames: Iterable[DataFrame]) -> DataFrame:
    """UNION ALL by column name; a column that a frame lacks is NULL there."""
    frames = list(frames)
    if not frames:
        raise ValueError("align_union needs at least one frame")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def prefix_numeric_columns(df: DataFrame, prefix: str = "year_") -> DataFrame:
    """Rename all-digit columns: '1998' becomes 'year_1998'."""
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c.isdigit()})


def normalize_headers(df: DataFrame) -> DataFrame:
    """Clean every column name and make the names unique."""
    return df.toDF(*unique_names(header_name(c) for c in df.columns))


def stringify(df: DataFrame, missing: str = "nan") -> DataFrame:
    """Every column as text, NULL as the text ``missing``."""
    return df.select(
        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(missing)).alias(c) for c in df.columns]
    )


def dedupe_names(df: DataFrame, name: str, order: Iterable[str], out: str = "unique_name") -> DataFrame:
    """Suffix repeats of a name held in a data column: the 2nd gets _1, the 3rd _2.

    ``order`` must be unique within a name. A name may repeat any number of
    times: see :func:`~panelspark.operators.slices.number_within`. A suffixed name
    that the column itself holds (a, a, a_1) gets _1, _2, ... once more, until all
    names are unique; those the column holds stay with their first row.
    """
    numbered = number_within(df, [name], list(order), "_nth")
    suffixed = F.concat_ws("_", F.col(name), (F.col("_nth") - 1).cast("string"))
    named = numbered.withColumns({out: F.when(F.col("_nth") > 1, suffixed).otherwise(F.col(name)), "_made": F.col("_nth") > 1})
    while True:
        named = pin(named, "names")
        taken = named.where(F.col(out).isNotNull()).groupBy(out).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        if taken.isEmpty():
            return named.select(*df.columns, out)
        # Names made above are rarely taken: only those rows are numbered again.
        clash = named.join(pin(taken.drop("_n"), "taken"), out, "left_semi")
        again = number_within(clash, [out], ["_made", name, "_nth"], "_again")
        moved = F.concat_ws("_", F.col(out), (F.col("_again") - 1).cast("string"))
        renamed = again.withColumn(out, F.when(F.col("_again") > 1, moved).otherwise(F.col(out)))
        rest = named.join(taken, out, "left_anti")
        named = rest.unionByName(renamed.drop("_again").select(*named.columns))
