import glob
import os
from types import SimpleNamespace

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Observation, functions as F

from panelspark.operators import ObservedChecks, latest_snapshot, newest_partition
from panelspark.plans import build_annual, build_quarterly, model, scorecard, slice_panel, source
from panelspark.__main__ import main
from panelspark.plans.land import land_annual
from panelspark.plans.build import MART_STOCKS, NOT_NULL, RAW_ANNUAL, RAW_QUARTERLY, run_not_null_tests
from panelspark.session import pin, scratch_path, scratch_run, shared_folder
from panelspark.sources import (
    open_snapshots, publish_table, publish_view, read_panel, read_sheets, register_snapshots, write_snapshot,
)

from conftest import plan_of
from test_marts import raw_annual, raw_quarterly


def frame(spark, n, tag):
    return spark.range(n).select(F.col("id"), F.lit(tag).alias("tag"))


def test_rerun_replaces_only_its_own_date(spark, tmp_path, rows):
    path = str(tmp_path / "snap")
    write_snapshot(frame(spark, 3, "old"), path, "2025-01-01")
    write_snapshot(frame(spark, 5, "first"), path, "2025-04-01")
    write_snapshot(frame(spark, 4, "second"), path, "2025-04-01")
    counts = open_snapshots(spark, path).groupBy("extracted_date", "tag").count()
    assert sorted((str(d), t, n) for d, t, n in rows(counts)) == [("2025-01-01", "old", 3), ("2025-04-01", "second", 4)]
    one = open_snapshots(spark, path, "2025-01-01")
    assert one.count() == 3 and "extracted_date" in one.columns


def test_columns_may_differ_between_snapshots(spark, tmp_path):
    path = str(tmp_path / "snap")
    write_snapshot(spark.createDataFrame([("a", "1")], "k string, year_2000 string"), path, "2025-01-01")
    write_snapshot(spark.createDataFrame([("a", "2")], "k string, year_2001 string"), path, "2025-04-01")
    both = open_snapshots(spark, path)
    assert {"year_2000", "year_2001"} <= set(both.columns)
    assert latest_snapshot(both).select("year_2000", "year_2001").first() == (None, "2")


def test_compact_snapshot_is_one_file_when_small(spark, tmp_path):
    path = str(tmp_path / "snap")
    write_snapshot(frame(spark, 1000, "x").repartition(8), path, "2025-01-01", compact=True)
    assert len(glob.glob(f"{path}/extracted_date=2025-01-01/*.parquet")) == 1
    assert open_snapshots(spark, path).count() == 1000


def test_registered_snapshots_are_repaired(spark, tmp_path):
    path = str(tmp_path / "snap")
    write_snapshot(frame(spark, 3, "a"), path, "2025-01-01")
    write_snapshot(frame(spark, 4, "b"), path, "2025-04-01")
    table = register_snapshots(spark, "registered", path)
    assert table.count() == 7 and set(table.columns) == {"id", "tag", "extracted_date"}
    write_snapshot(spark.createDataFrame([(1, "c", 2.0)], "id bigint, tag string, extra double"), path, "2025-07-01")
    again = register_snapshots(spark, "registered", path)
    assert again.count() == 8 and again.where("extracted_date = '2025-07-01'").first().extra == 2.0


def test_latest_snapshot_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "snap")
    write_snapshot(frame(spark, 3, "a"), path, "2025-01-01")
    write_snapshot(frame(spark, 4, "b"), path, "2025-04-01")
    latest = latest_snapshot(open_snapshots(spark, path))
    assert latest.count() == 4
    scan = [line for line in plan_of(latest).splitlines() if "FileScan" in line][0]
    assert "PartitionFilters: [isnotnull(extracted_date" in scan and "Subquery" in scan


def test_read_panel(spark, tmp_path):
    path = str(tmp_path / "panel")
    data = spark.createDataFrame([("KEN", "S1", "1"), ("KEN", "S2", "2")], ["economy", "series_code", "2000"])
    data.write.parquet(path)
    panel = read_panel(spark, path, ["S2"])
    assert panel.columns == ["economy", "series_code", "year_2000"] and panel.count() == 1
    assert "PushedFilters: [In(series_code" in plan_of(panel) or "EqualTo(series_code" in plan_of(panel)
    json = str(tmp_path / "json")
    data.write.json(json)
    assert read_panel(spark, json, fmt="json").count() == 2


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_read_sheets(spark, tmp_path, rows, fmt):
    root = str(tmp_path / "sheets root")
    options = {"header": "true"} if fmt == "csv" else {}
    one = spark.createDataFrame([("KEN", "1"), ("EGY", None)], ["Country Code", "2021Q1 [2021Q1]"])
    two = spark.createDataFrame([("JOR", "2")], ["Country Code", "2021Q2 [2021Q2]"])
    for sheet, place in ((one, "t1/Data 1"), (two, "t1/Data 2"), (one, "t2/Data 1")):
        sheet.coalesce(1).write.format(fmt).options(**options).save(f"{root}/{place}")
    read = read_sheets(spark, root, fmt, **options)
    expected = [
        ("EGY", "nan", None, "t1", "Data 1"), ("EGY", "nan", None, "t2", "Data 1"), ("JOR", None, "2", "t1", "Data 2"),
        ("KEN", "1", None, "t1", "Data 1"), ("KEN", "1", None, "t2", "Data 1"),
    ]
    assert rows(read, "country_code", "q_2021q1", "q_2021q2", "source_table", "sheet_name") == expected
    with pytest.raises((RuntimeError, PySparkException)):
        read_sheets(spark, str(tmp_path / "nothing"), fmt)


def test_partitioned_table_prunes(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") % 4 + 2000).alias("year"))
    table = publish_table(df, "by_year", ["year"], path=str(tmp_path / "by_year"))
    assert table.count() == 100
    one = table.where("year = 2002")
    assert one.count() == 25 and "PartitionFilters: [isnotnull(year" in plan_of(one)
    assert len(glob.glob(f"{tmp_path}/by_year/year=*")) == 4
    # a rebuild replaces the table in full
    assert publish_table(df.limit(10), "by_year", ["year"], path=str(tmp_path / "by_year2")).count() == 10


def test_clustered_table_is_sorted_and_spread(spark, tmp_path):
    df = spark.range(0, 4000, 1, 8).select("id", F.when(F.col("id") % 4 < 3, F.lit("hot")).otherwise(F.lit("cold")).alias("k"))
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        table = publish_table(df, "clustered", cluster_by=["k"], path=str(tmp_path / "clustered"))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    files = table.select("k", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i"))
    per_file = {}
    for r in files.orderBy("i").collect():
        per_file.setdefault(r.f, []).append(r.k)
    assert all(ks == sorted(ks) for ks in per_file.values())
    # the hot key lies in several files, none of which holds most of it
    hot = [ks.count("hot") for ks in per_file.values()]
    assert sum(h > 0 for h in hot) > 1 and max(hot) < 2000 and sum(hot) == 3000


def file_ranges(table, key):
    """(least, greatest, rows) of ``key`` in each file."""
    per_file = table.groupBy(F.input_file_name().alias("f")).agg(F.min(key), F.max(key), F.count(F.lit(1)))
    return sorted(tuple(r)[1:] for r in per_file.collect())


def test_clustered_files_hold_stretches(spark, tmp_path, monkeypatch):
    """One entity's filter admits a tenth of the files at most, every row is made once, a hot entity is split."""
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    n = 200_000
    hot = F.col("id") % 5 == 0
    entity = F.when(hot, F.lit("E0500")).otherwise(F.format_string("E%04d", F.pmod(F.hash("id"), F.lit(1000))))
    made = Observation("made")
    df = spark.range(0, n, 1, 8).select(entity.alias("entity"), F.col("id")).observe(made, F.count(F.lit(1)).alias("rows"))
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        table = publish_table(df, "stretches", cluster_by=["entity"], path=str(tmp_path / "stretches"))
        ranges = file_ranges(table, "entity")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert made.get["rows"] == n == sum(r[2] for r in ranges)
    for wanted in ("E0003", "E0250", "E0777", "E0999"):
        assert 1 <= sum(low <= wanted <= high for low, high, _ in ranges) <= len(ranges) / 10
    hot_files = [r for r in ranges if r[0] <= "E0500" <= r[1]]
    assert len(hot_files) >= 5 and max(r[2] for r in ranges) < 3 * n / len(ranges)


def test_bucketed_table_splits_a_hot_key(spark, tmp_path):
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.rebalancePartitionsSmallPartitionFactor": "0.1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    df = spark.range(0, 40_000, 1, 8).select(F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id")).alias("k"), F.rand(1).alias("v"))
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        table = publish_table(df, "in_buckets", path=str(tmp_path / "in_buckets"), bucket_by=["k"], buckets=6)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    files = table.where("k = 7").groupBy(F.input_file_name()).count().collect()
    assert len(files) > 1 and sum(r["count"] for r in files) == 26_666 == table.where("k = 7").count()
    assert "SelectedBucketsCount: 1 out of 6" in plan_of(table.where("k = 7").groupBy("k").count())
    with pytest.raises(ValueError):
        publish_table(df, "both", bucket_by=["k"], cluster_by=["k"])


def test_checks_ride_along_with_the_write(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, None)], "k int, v string")
    checks = ObservedChecks()
    publish_table(df, "watched", path=str(tmp_path / "w"), cluster_by=["k"], checks=checks, not_null=["k", "v"])
    publish_table(df.limit(0), "watched_empty", path=str(tmp_path / "e"), checks=checks, not_null=["k"])
    assert [tuple(r) for r in checks.results(spark).collect()] == [
        ("watched", "k", 3, 1), ("watched", "v", 3, 2), ("watched_empty", "k", 0, 0)
    ]


def test_checks_of_a_build_equal_those_that_read(spark, tmp_path):
    publish_view(raw_annual(spark), RAW_ANNUAL)
    publish_view(raw_quarterly(spark), RAW_QUARTERLY)
    checks = ObservedChecks()
    build_annual(spark, root=str(tmp_path), checks=checks, buckets=3)
    build_quarterly(spark, root=str(tmp_path), checks=checks)
    seen = {tuple(r) for r in checks.results(spark).collect()}
    assert seen == {tuple(r) for r in run_not_null_tests(spark).collect()} and len(seen) == 11


def test_newest_partition_comes_from_the_catalog(spark, tmp_path):
    path = str(tmp_path / "snap")
    write_snapshot(frame(spark, 3, "a"), path, "2025-01-01")
    write_snapshot(frame(spark, 4, "b"), path, "2025-04-01")
    table = register_snapshots(spark, "dated", path)
    newest = newest_partition(spark, "dated")
    assert newest == "2025-04-01"
    latest = table.where(F.col("extracted_date") == F.lit(newest).cast("date"))
    scan = [line for line in plan_of(latest).splitlines() if "FileScan" in line][0]
    assert "Subquery" not in plan_of(latest) and "(extracted_date" in scan.split("PartitionFilters")[1] and "2025-04-01" in scan
    assert latest.count() == 4
    years = spark.range(12).select("id", (F.col("id") + 995).alias("year"), F.lit("a b/c").alias("place"))
    publish_table(years, "years", ["year", "place"], path=str(tmp_path / "years"))
    assert newest_partition(spark, "years", "year") == "1006" and newest_partition(spark, "years", "place") == "a b/c"
    publish_table(years.limit(0), "no_years", ["year"], path=str(tmp_path / "none"))
    assert newest_partition(spark, "no_years", "year") is None


def test_command_line_build_stops_without_the_total(spark, tmp_path, capsys, monkeypatch):
    for name, raw in (("a", raw_annual(spark).where("series_code <> 'DT.DOD.DECT.CD'")), ("q", raw_quarterly(spark))):
        write_snapshot(raw.where("extracted_at = '2025-04-01'"), str(tmp_path / name), "2025-04-01")
    monkeypatch.setattr("panelspark.__main__.panel_session", lambda *_: spark)
    paths = ["--annual", str(tmp_path / "a"), "--quarterly", str(tmp_path / "q"), "--output", str(tmp_path / "out")]
    assert main(paths) == 2
    assert "no row of series DT.DOD.DECT.CD" in capsys.readouterr().out and not os.path.exists(tmp_path / "out")


def test_paths_that_only_the_readers_of_spark_open(spark, tmp_path):
    """A store of another scheme: nothing here opens paths by itself."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.lake.link./data", f"file://{tmp_path}")
    root = "viewfs://lake/data"
    write_snapshot(frame(spark, 3, "a"), f"{root}/snap", "2025-01-01")
    write_snapshot(frame(spark, 4, "b"), f"{root}/snap", "2025-04-01", cluster_by=["id"])
    assert open_snapshots(spark, f"{root}/snap", "latest").count() == 4
    assert register_snapshots(spark, "in_store", f"{root}/snap").count() == 7
    table = publish_table(frame(spark, 9, "c"), "published_in_store", ["tag"], ["id"], f"{root}/table")
    assert table.where("tag = 'c'").count() == 9 and glob.glob(f"{tmp_path}/table/tag=c/*.parquet")
    spark.createDataFrame([("KEN", "1")], ["Country Code", "2021Q1"]).write.parquet(f"{root}/sheets/book/sheet 1")
    spark.createDataFrame([("EGY", "2")], ["Country Code", "2021Q2"]).write.option("header", "true").csv(f"{root}/csv/book/sheet 2")
    assert read_sheets(spark, f"{root}/sheets").select("country_code", "source_table", "sheet_name").first() == ("KEN", "book", "sheet 1")
    assert read_sheets(spark, f"{root}/csv", "csv").select("country_code", "q_2021q2", "sheet_name").first() == ("EGY", "2", "sheet 2")


def test_views_and_sources(spark):
    publish_view(spark.range(3).toDF("x"), "some_view")
    assert source(spark, "some_view").count() == 3 == model(spark, "some_view").count()


def test_full_build(spark, tmp_path, rows):
    publish_view(raw_annual(spark), RAW_ANNUAL)
    publish_view(raw_quarterly(spark), RAW_QUARTERLY)
    models = {**build_annual(spark, root=str(tmp_path)), **build_quarterly(spark, root=str(tmp_path))}
    assert {n: m.count() for n, m in models.items()} == {
        "staged_annual": 15, "mart_stocks": 15, "mart_regional": 8, "staged_quarterly": 4, "mart_service": 4,
    }
    assert glob.glob(f"{tmp_path}/{MART_STOCKS}/year=2000")
    tests = rows(run_not_null_tests(spark))
    assert len(tests) == sum(len(c) for c in NOT_NULL.values()) == 11
    assert all(failures == 0 for *_, failures in tests)


def test_landing(spark, tmp_path, caplog):
    raw = spark.createDataFrame(
        [("KEN", "Kenya", 1.5, None)], "economy string, Country string, `2000` double, `2001` double"
    )
    raw.write.parquet(str(tmp_path / "T"))
    sources = {"T": str(tmp_path / "T"), "P": str(tmp_path / "missing")}
    rows, columns = land_annual(spark, sources, str(tmp_path / "annual"), "2025-04-01")
    assert rows == 1 and set(columns) == {"economy", "Country", "year_2000", "year_2001", "series_code", "extracted_at"}
    landed = open_snapshots(spark, str(tmp_path / "annual"), "latest")
    assert landed.select("year_2000", "year_2001", "series_code", "extracted_at").first() == (
        "1.5", "nan", "T", "2025-04-01"
    )
    with pytest.raises(RuntimeError):
        land_annual(spark, {"P": str(tmp_path / "missing")}, str(tmp_path / "annual"), "2025-04-01")


def test_command_line_build(spark, tmp_path, capsys, monkeypatch):
    for name, raw in (("a", raw_annual(spark)), ("q", raw_quarterly(spark))):
        write_snapshot(raw.where("extracted_at = '2025-04-01'"), str(tmp_path / name), "2025-04-01")
    monkeypatch.setattr("panelspark.__main__.panel_session", lambda *_: spark)
    paths = ["--annual", str(tmp_path / "a"), "--quarterly", str(tmp_path / "q"), "--output", str(tmp_path / "out")]
    assert main(paths) == 0
    assert "ok mart_stocks.country_code: 0 of 15 NULL" in capsys.readouterr().out


def test_sheets_with_other_columns_types_and_repeats(spark, tmp_path, rows):
    root = str(tmp_path / "sheets")
    spark.createDataFrame([("KEN", 1.5)], "code string, `2021Q1` double").coalesce(1).write.parquet(f"{root}/t/one")
    more = spark.createDataFrame([("EGY", "..", 3)], "code string, `2021Q1` string, `2021Q2` bigint")
    more.coalesce(1).write.mode("append").parquet(f"{root}/t/one")
    spark.createDataFrame([("JOR", 2)], "code string, `2021Q1` bigint").coalesce(1).write.parquet(f"{root}/t/two")
    read = read_sheets(spark, root)
    assert rows(read, "code", "q_2021q1", "q_2021q2", "sheet_name") == [
        ("EGY", "..", "3", "one"), ("JOR", "2", None, "two"), ("KEN", "1.5", None, "one")
    ]
    (tmp_path / "csv" / "t").mkdir(parents=True)
    (tmp_path / "csv" / "t" / "s.csv").write_text('code,"2021Q1 [2021Q1]",2021Q1 [2021Q1]\nKEN,1,\n')
    (tmp_path / "csv" / "t" / "empty.csv").write_text("")
    assert rows(read_sheets(spark, str(tmp_path / "csv"), "csv"), "code", "q_2021q1", "q_2021q1_1") == [("KEN", "1", "nan")]


def test_headers_with_line_breaks(spark, tmp_path, rows):
    """As workbooks export them; a cell's own break needs ``multiLine``, the header's doesn't."""
    book = tmp_path / "csv" / "book 1+2"
    book.mkdir(parents=True)
    (book / "a.csv").write_text('"Country\nCode","2021Q1\n[2021Q1]","Say ""x"""\nKEN,1,p\nEGY,2,q\n')
    (book / "b.csv").write_text("Country Code,2021Q1\nJOR,3\n")
    (book / "long.csv").write_text('"Country Code","' + "note\n" * 40 + '"\nLBN,z\n')
    (book / "open.csv").write_text('"Country Code,x\n')
    read = read_sheets(spark, str(tmp_path / "csv"), "csv")
    assert rows(read, "country_code", "q_2021q1", "source_table", "sheet_name") == [
        ("EGY", "2", "book 1+2", "a"), ("JOR", "3", "book 1+2", "b"), ("KEN", "1", "book 1+2", "a"), ("LBN", None, "book 1+2", "long")
    ]
    assert "say_x" in "".join(read.columns) or "say" in "".join(read.columns)
    cells = tmp_path / "cells" / "book"
    cells.mkdir(parents=True)
    (cells / "a.csv").write_text('Country Code,Note\nKEN,"one\ntwo"\n')
    assert read_sheets(spark, str(tmp_path / "cells"), "csv", multiLine="true").first().note == "one\ntwo"
    (cells / "a.csv").write_text("'Country;\nCode';Note\nKEN;'x;y'\n")
    assert read_sheets(spark, str(tmp_path / "cells"), "csv", sep=";", quote="'").first().note == "x;y"


def test_headers_of_many_files_take_few_jobs(spark, tmp_path):
    context, jobs = spark.sparkContext, []
    for n in (300, 500):  # Spark lists more than 32 paths by a job
        book = tmp_path / str(n) / "book"
        book.mkdir(parents=True)
        for i in range(n):
            (book / f"s{i:03}.csv").write_text(f'"Country\nCode",v{i % 3}\nC{i},{i}\n' if i % 2 else f"Country Code,v{i % 3}\nC{i},{i}\n")
        context.setJobGroup(f"headers of {n}", "read_sheets")
        try:
            read = read_sheets(spark, str(tmp_path / str(n)), "csv")
            jobs.append(len(context.statusTracker().getJobIdsForGroup(f"headers of {n}")))
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1] < 20  # of listing, of the first lines, and of the first lines of broken headers
    assert read.count() == 500 and read.where("v0 <> 'nan'").count() == 167


def test_unreadable_data_are_skipped(spark, tmp_path, caplog):
    spark.createDataFrame([("KEN", "Kenya", 1.5)], "economy string, Country string, `2000` double").write.parquet(str(tmp_path / "good"))
    spark.createDataFrame([("KEN", "Kenya", 1.5)], "economy string, Country string, `2001` double").coalesce(1).write.parquet(str(tmp_path / "bad"))
    broken = glob.glob(f"{tmp_path}/bad/*.parquet")[0]
    data = bytearray(open(broken, "rb").read())
    data[4 : len(data) // 4] = b"\0" * (len(data) // 4 - 4)  # the footer stays readable
    open(broken, "wb").write(data)
    for crc in glob.glob(f"{tmp_path}/bad/.*.crc"):
        os.remove(crc)
    sources = {"A": str(tmp_path / "good"), "B": str(tmp_path / "bad")}
    landed, columns = land_annual(spark, sources, str(tmp_path / "annual"), "2025-04-01")
    assert landed == 1 and "year_2001" not in columns and "skipped source B" in caplog.text


def test_years_that_a_series_lacks_land_as_text(spark, tmp_path):
    for code, year in (("A", "2000"), ("B", "2001")):
        spark.createDataFrame([("KEN", "Kenya", 1.5)], f"economy string, Country string, `{year}` double").write.parquet(str(tmp_path / code))
    land_annual(spark, {c: str(tmp_path / c) for c in "AB"}, str(tmp_path / "annual"), "2025-04-01")
    landed = open_snapshots(spark, str(tmp_path / "annual"), "latest").orderBy("series_code")
    assert [(r.year_2000, r.year_2001) for r in landed.collect()] == [("1.5", "nan"), ("nan", "1.5")]


def test_served_years_prune_directories(spark, tmp_path):
    publish_view(raw_annual(spark), RAW_ANNUAL)
    stocks = build_annual(spark, root=str(tmp_path), only=(MART_STOCKS,))[MART_STOCKS]
    for part in (slice_panel(stocks, "year", "country_code", (2001, 2002), ["KEN"]), scorecard(stocks, "debt_value_usd", "year")):
        scan = [line for line in plan_of(part).splitlines() if "FileScan" in line][0]
        assert "PartitionFilters: [isnotnull(year" in scan


def test_runs_delete_what_they_pinned(spark):
    with scratch_run(spark) as folder:
        assert pin(spark.range(5)).count() == 5 and glob.glob(f"{folder}/*")
    assert not os.path.exists(folder)
    assert not scratch_path(spark, "x").startswith(folder)


def test_shared_folder_must_be_named():
    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(unset)


def test_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(shared_folder(spark))
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    assert pin(spark.range(5)).count() == 5
