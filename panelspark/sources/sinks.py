"""Snapshot and table writers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from ..operators.quality import ObservedChecks
from ..operators.reshape import SNAPSHOT_PARTITION


def clustered(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Rebalanced on ``keys`` and sorted by them, so row-group statistics can skip.

    AQE splits a key with many rows over tasks and files. A range partitioning
    would evaluate everything above it twice, once for its sample.
    """
    keys = list(keys)
    return df.hint("rebalance", *keys).sortWithinPartitions(*keys)


def clustered_by_range(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Cut at quantiles of ``keys`` and sorted by them: each file holds one stretch of the keys.

    So a filter on the first keys opens the files whose minimum and maximum admit it, and no others. Rows are shuffled
    first: the sampling and the cut both read that shuffle, so what makes the rows is evaluated
    once. Within equal keys a hash of the row goes on with the order: a hot key is cut like any other stretch. AQE
    joins neighbouring stretches that are small.
    """
    keys = list(keys)
    # The filter, which keeps all rows, stays between the two shuffles, or they would be made one.
    rows = df.hint("rebalance", *keys).where(F.spark_partition_id() >= 0)
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return rows.repartitionByRange(*keys, spread).sortWithinPartitions(*keys)


def bucketed(df: DataFrame, keys: Iterable[str], buckets: int) -> DataFrame:
    """One shuffle partition per bucket of ``keys``, rebalanced: AQE splits a bucket with a hot key over several files."""
    keys = list(keys)
    return df.hint("rebalance", buckets, *keys).sortWithinPartitions(*keys)


def write_snapshot(
    df: DataFrame, path: str, date: str, compact: bool = False, cluster_by: Iterable[str] = ()
) -> None:
    """Write ``df`` as the snapshot of ``date`` (YYYY-MM-DD) below ``path``.

    Only that date's directory is replaced, so a rerun on the same day leaves one
    copy. ``compact`` rebalances the rows first: a small snapshot becomes a single
    file, a large one as many files as its size asks for; no task ever gets more
    than its share. ``cluster_by`` lays the rows out for filters on these columns,
    e.g. the series code, by which the total series is looked up later.
    """
    cluster_by = list(cluster_by)
    if cluster_by:
        df = clustered(df, cluster_by)
    elif compact:
        df = df.hint("rebalance")
    (
        df.withColumn(SNAPSHOT_PARTITION, F.lit(date).cast("date"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(SNAPSHOT_PARTITION)
        .parquet(path)
    )


def publish_view(df: DataFrame, name: str) -> DataFrame:
    """Publish as a view: evaluated on use, nothing is stored."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def publish_table(
    df: DataFrame,
    name: str,
    partition_by: Iterable[str] = (),
    cluster_by: Iterable[str] = (),
    path: str | None = None,
    bucket_by: Iterable[str] = (),
    buckets: int | None = None,
    checks: ObservedChecks | None = None,
    not_null: Iterable[str] = (),
) -> DataFrame:
    """Rebuild table ``name`` in full from ``df``.

    ``partition_by`` makes one directory per value; rows are rebalanced on it, so
    each directory gets few files and AQE splits a hot value over several tasks.
    ``cluster_by`` lays the rows out as :func:`clustered_by_range` does, so filters on its first columns skip files.
    ``bucket_by`` stores the table in ``buckets`` (by default ``spark.sql.shuffle.partitions``)
    by a hash of these columns: joins and aggregates on them read it without a shuffle,
    and a filter on a single value of them opens one bucket. A table is either clustered or bucketed.

    ``checks`` counts the rows and the NULLs of the ``not_null`` columns while they are written.
    """
    partition_by, cluster_by, bucket_by = list(partition_by), list(cluster_by), list(bucket_by)
    if cluster_by and bucket_by:
        raise ValueError("a table is clustered or bucketed, not both")
    layout = df
    if bucket_by:
        buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        layout = bucketed(df, bucket_by, buckets)
    elif cluster_by:
        layout = clustered_by_range(df, [*partition_by, *cluster_by])
    elif partition_by:
        layout = df.hint("rebalance", *partition_by)
    if checks is not None:
        layout = checks.watch(layout, name, not_null)
    writer = layout.write.mode("overwrite").format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by:
        writer = writer.bucketBy(buckets, *bucket_by).sortBy(*bucket_by)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)
