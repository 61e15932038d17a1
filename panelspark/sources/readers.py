"""Readers for landed panels, sheet exports and dated snapshots."""

from __future__ import annotations

import csv
import io
import logging
import re
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.names import header_name, unique_names
from ..operators.align import align_union, normalize_headers, prefix_numeric_columns, stringify
from ..operators.reshape import SNAPSHOT_PARTITION
from ..session import pin

log = logging.getLogger(__name__)

HEADERS_AT_ONCE = 16  # files whose schema is read at the same time


def read_panel(
    spark: SparkSession,
    path: str | list[str],
    series: Iterable[str] | None = None,
    fmt: str = "parquet",
    series_column: str = "series_code",
    **options: str,
) -> DataFrame:
    """A landed wide panel: one row per entity and series, all-digit columns as ``year_*``.

    ``series`` keeps only these codes; the filter is pushed into the scan.
    """
    df = prefix_numeric_columns(spark.read.format(fmt).options(**options).load(path))
    return df if series is None else df.where(F.col(series_column).isin(list(series)))


def _csv_headers(spark: SparkSession, paths: list[str], options: Mapping[str, str]) -> dict[str, tuple[list[str], bool]]:
    """Per file the names of its first record, and whether that record is longer than a line.

    Spark's own reader would rename repeats. Tasks find the first line of every file in one job. A line with an odd
    number of quotes goes on: of such files the first lines are fetched, twice as many until all records
    are whole, so the number of jobs depends on the longest header and not on the number of files.
    """
    quote, cut = options.get("quote", '"'), options.get("sep", options.get("delimiter", ","))
    encoded = {k: v for k, v in options.items() if k in ("encoding", "charset", "lineSep")}

    def first_lines(some: list[str], n: int) -> dict[str, list[str]]:
        lines = spark.read.options(**encoded).text(some).where("_metadata.file_block_start = 0").select(
            _file_path().alias("path"), F.struct(F.monotonically_increasing_id().alias("at"), "value").alias("line")
        )
        if n == 1:  # combines before the shuffle without a sort
            firsts = lines.groupBy("path").agg(F.array(F.min("line")).alias("lines"))
        else:
            nth = F.row_number().over(Window.partitionBy("path").orderBy("line.at"))
            firsts = lines.withColumn("nth", nth).where(F.col("nth") <= n).groupBy("path").agg(F.array_sort(F.collect_list("line")).alias("lines"))
        return {r.path: [line.value for line in r.lines] for r in firsts.collect()}

    found, some, n = {}, paths, 1
    while some:
        lines = first_lines(some, n)
        ends = {p: _record_end(x, quote, whole=len(x) < n) for p, x in lines.items()}
        for p, end in ends.items():
            if end is not None:
                text = io.StringIO("\n".join(lines[p][:end]), newline="")
                found[p] = (next(csv.reader(text, delimiter=cut, quotechar=quote or None, quoting=csv.QUOTE_MINIMAL if quote else csv.QUOTE_NONE), []), end > 1)
        some, n = [p for p, end in ends.items() if end is None], max(16, 2 * n)
    return found


def _record_end(lines: list[str], quote: str, whole: bool) -> int | None:
    """Number of lines of the first record; None if it needs more lines, of which there are none if they are the ``whole`` file."""
    quotes = 0
    for i, line in enumerate(lines):
        quotes += line.count(quote) if quote else 0
        if quotes % 2 == 0:
            return i + 1
    return len(lines) if whole else None


def _bare(path: str) -> str:
    """The path with one slash after its scheme, however many it is written with."""
    return re.sub(r"^(\w+):/+", r"\1:/", path)


def _file_path() -> Column:
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def read_sheets(
    spark: SparkSession, root: str, fmt: str = "parquet", missing: str = "nan", **options: str
) -> DataFrame:
    """Union of all sheet exports below ``root``, as text, with lineage columns.

    Sheets come as ``root/<table>/<sheet>.<fmt>`` or as a folder
    ``root/<table>/<sheet>/`` of files. Names and types of columns may differ
    between sheets and between the files of one: every file's schema is read
    (a few at a time; file names and schemas are what the driver holds of any
    scan), files of one schema share a reader, and each shape is turned to text
    by itself before all are aligned. Headers are cleaned and repeats numbered
    per shape; CSV files take them from their first line. A cell that is empty
    becomes ``missing``, a column that a file does not have stays NULL, also
    where other files of its sheet have it. ``source_table`` and ``sheet_name`` come from the path.

    The headers of all CSV files are found in one job (:func:`_csv_headers`); a quoted header may hold line breaks, and then its file
    is read record by record. Files with a schema of their own take one short job each, for the footer.
    """
    base = re.escape(unquote(root.rstrip("/").split(":", 1)[-1].lstrip("/")))
    place = rf"{base}/([^/]+)/([^/]+?)(?:/[^/]*)?(?:\.[^/.]+)?$"
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{fmt}")
    paths = sorted(p for p in listing.load(root).inputFiles() if re.search(place, unquote(p)))
    if not paths:
        raise RuntimeError(f"no {fmt} sheet below {root}")
    reader = spark.read.format(fmt).options(**options)

    paths = [unquote(p) for p in paths]
    if fmt == "csv":
        # Only text is wanted of it, so no type is guessed.
        headers = {_bare(p): x for p, x in _csv_headers(spark, paths, options).items()}
        found = [headers.get(_bare(p), ([], False)) for p in paths]
        shapes = [StructType([StructField(n, StringType()) for n in unique_names(map(header_name, names))]) for names, _ in found]
        long_header = [broken for _, broken in found]
    else:
        with ThreadPoolExecutor(HEADERS_AT_ONCE) as pool:
            shapes = list(pool.map(lambda p: reader.load(p).schema, paths))
        long_header = [False] * len(paths)
    by_shape: dict[tuple[str, bool], tuple[StructType, list[str]]] = {}
    for schema, broken, path in zip(shapes, long_header, paths):
        if schema.fields:
            by_shape.setdefault((schema.json(), broken), (schema, []))[1].append(path)
    frames = []
    for (_, broken), (schema, some) in by_shape.items():
        shaped = spark.read.format(fmt).options(**options).schema(schema)
        if fmt == "csv":
            shaped = shaped.options(header="true", **({"multiLine": "true"} if broken else {}))
        path = _file_path()
        tagged = shaped.load(some).select(
            *[F.col(f"`{c}`") for c in schema.names],
            F.regexp_extract(path, place, 1).alias("source_table"),
            F.regexp_extract(path, place, 2).alias("sheet_name"),
        )
        frames.append(stringify(normalize_headers(tagged), missing))
    return align_union(frames)


def snapshot_dates(spark: SparkSession, path: str) -> list[str]:
    """Dates of the snapshots below ``path``, oldest first, from the names of its folders."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    entries = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    names = [entry.getPath().getName() for entry in entries if entry.isDirectory()]
    return sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{SNAPSHOT_PARTITION}="))


def open_snapshots(spark: SparkSession, path: str, date: str | None = None, merge_schema: bool = True) -> DataFrame:
    """All dated snapshots below ``path``, or the one of ``date`` ('latest' for the newest).

    The date is a partition column in each case. Period columns grow over time,
    so schemas are merged over all files by default; with a ``date`` only that
    directory is listed and opened. 'latest' is the newest of the folders' names:
    no file is opened for it.
    """
    everything = spark.read.option("basePath", path)
    if date == "latest":
        dates = snapshot_dates(spark, path)
        if not dates:
            raise RuntimeError(f"no snapshot below {path}")
        date = dates[-1]
    merged = everything.option("mergeSchema", str(merge_schema).lower())
    return merged.parquet(path if date is None else f"{path.rstrip('/')}/{SNAPSHOT_PARTITION}={date}")


def register_snapshots(spark: SparkSession, name: str, path: str) -> DataFrame:
    """External table over the dated snapshots; its partitions are recovered, else it reads as empty."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.catalog.createTable(name, path, source="parquet", mergeSchema="true")
    spark.catalog.recoverPartitions(name)
    return spark.table(name)


def load_all(
    sources: Mapping[str, Callable[[], DataFrame]], on_error: str = "skip", land: bool = False
) -> DataFrame:
    """Union of all sources that can be read; one that cannot is skipped with a warning.

    Raises if none is left, or at the first failure with ``on_error="raise"``.
    Reading is lazy: what is caught are missing paths and bad schemas. With
    ``land`` each source is pinned by itself first, so one whose data cannot be
    read is skipped too. Run
    :func:`~panelspark.operators.quality.check_missing_series` on the result,
    because a skipped series is missing from everything built on it.
    """
    frames = []
    for name, read in sources.items():
        try:
            frames.append(pin(read(), "source") if land else read())
        except (PySparkException, Py4JJavaError, OSError) as error:
            if on_error != "skip":
                raise
            log.warning("skipped source %s: %s", name, error)
    if not frames:
        raise RuntimeError("no source could be loaded")
    return align_union(frames)


def observe_counts(df: DataFrame, name: str = "load") -> tuple[DataFrame, Observation]:
    """``df`` plus an observation of its row count, filled by the first action on it.

    No second pass is needed. The columns are known without an action:
    ``df.columns``. Use it on an action that evaluates the frame once, such as a
    plain write: the sampling pass of a range partitioning counts its rows too,
    and so does a task that is run again before a shuffle. Where that cannot be
    ruled out, count what was written (:func:`snapshot_report`).
    """
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def snapshot_report(spark: SparkSession, path: str, date: str) -> tuple[int, list[str]]:
    """Row count and columns of a landed snapshot. The count reads file footers, no column."""
    landed = open_snapshots(spark, path, date)
    return landed.count(), [c for c in landed.columns if c != SNAPSHOT_PARTITION]
