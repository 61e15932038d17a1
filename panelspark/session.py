"""Session settings and the shared folder for data that must outlive an executor."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the library is written for; anything the caller passes wins.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
}


def panel_session(app_name: str = "panelspark", master: str | None = None, **conf: str) -> SparkSession:
    """Get or create a session with DEFAULTS; ``conf`` keys use ``__`` for dots.

    On a cluster also set ``spark.sql.shuffle.partitions`` (AQE merges small
    partitions but never adds any, so start from bytes shuffled / 128 MB) and
    ``spark.checkpoint.dir`` (a folder every executor can reach).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_runs: list[str] = []  # folders of the runs that are open, innermost last


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, or below that of the run that is open."""
    base = _runs[-1] if _runs else f"{shared_folder(spark)}/panelspark"
    return f"{base}/{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch_run(spark: SparkSession, label: str = "run") -> Iterator[str]:
    """Owns what is pinned while it is open, and deletes it at the end.

    Frames that read pinned data must be evaluated (written, collected) inside.
    """
    folder = scratch_path(spark, label)
    _runs.append(folder)
    try:
        yield folder
    finally:
        _runs.remove(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def pin(df: DataFrame, label: str = "pinned") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Everything downstream sees one and the same evaluation, survives the loss of
    executors, and still gets Parquet column pruning (a checkpointed frame would not).
    Writing is a job at once. The data stay until the :func:`scratch_run` ends that
    was open, or until the folder's retention rule removes them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
