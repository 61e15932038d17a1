"""Landing: from source files to a dated text snapshot."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession

from ..operators.align import stamp, stringify
from ..session import scratch_run
from ..sources.readers import load_all, read_panel, read_sheets, snapshot_report
from ..sources.sinks import write_snapshot


def land_annual(
    spark: SparkSession,
    sources: Mapping[str, str],
    root: str,
    date: str,
    fmt: str = "parquet",
    on_error: str = "skip",
    **options: str,
) -> tuple[int, list[str]]:
    """Land one file set per series code as the annual snapshot of ``date`` below ``root``.

    Each source is a wide frame (economy, Country, one column per year). Rows are
    stamped with series code and date, aligned by column name, turned to text (so a
    year that a series lacks lands as 'nan') and written clustered by series. A
    source that cannot be read is skipped with a warning; see
    ``check_missing_series``. Returns the landed row count and columns.
    """
    readers = {
        code: lambda path=path, code=code: stamp(
            read_panel(spark, path, fmt=fmt, **options), series_code=code, extracted_at=date
        )
        for code, path in sources.items()
    }
    with scratch_run(spark, "landing"):
        write_snapshot(stringify(load_all(readers, on_error, land=True)), root, date, cluster_by=["series_code"])
    return snapshot_report(spark, root, date)


def land_quarterly(
    spark: SparkSession,
    sheets: Mapping[str, str] | str,
    root: str,
    date: str,
    fmt: str = "parquet",
    on_error: str = "skip",
    **options: str,
) -> tuple[int, list[str]]:
    """Land sheet exports (``table/sheet``) as the quarterly snapshot of ``date`` below ``root``.

    ``sheets`` is one root or several by name, of which those that cannot be read
    are skipped. Small snapshots become a single file. Returns the landed row
    count and columns.
    """
    roots = {"sheets": sheets} if isinstance(sheets, str) else dict(sheets)
    readers = {
        name: lambda place=place: stamp(read_sheets(spark, place, fmt, **options), extracted_at=date)
        for name, place in roots.items()
    }
    with scratch_run(spark, "landing"):
        write_snapshot(load_all(readers, on_error, land=True), root, date, compact=True)
    return snapshot_report(spark, root, date)
