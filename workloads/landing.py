"""Sources and sinks: data goes to the shared folder, is read back and returned."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from panelspark.operators import ObservedChecks, latest_snapshot, newest_partition, stringify
from panelspark.plans import (
    CLEAN_SHEET, build_annual, build_quarterly, model, service_mart, stage_panel, stage_sheet, stocks_mart_from_wide,
)
from panelspark.plans.build import (
    MART_REGIONAL, MART_SERVICE, MART_STOCKS, NOT_NULL, RAW_ANNUAL, RAW_QUARTERLY, STAGED_QUARTERLY, build_report, run_not_null_tests,
)
from panelspark.plans.land import land_annual, land_quarterly
from panelspark.session import pin, scratch_path
from panelspark.sources import (
    open_snapshots, publish_table, publish_view, read_panel, read_sheets, register_snapshots, write_snapshot,
)

from .annual import _COUNTRY_REGIONS_SQL, _ROLLUP, landed_customers
from .panels import (
    ALL, COUNTRY_PANEL, COUNTRY_STAGED_SQL, COUNTRY_STOCKS_SQL, CUSTOMER_PANEL, CUSTOMER_STAGED_SQL,
    CUSTOMER_STOCKS_SQL, EXTRACTED_AT, PRIORITY_SERIES, QUARTERS, SUPPLIER_SERVICE_SQL, SUPPLIER_SHEET,
    SUPPLIER_SHEET_SQL, YEARS, raw_country_panel, raw_customer_panel, raw_supplier_sheet, supplier_quarters,
)
from .registry import query
from .rows import _DAILY, daily_events


@query("read_panel", f"""with {CUSTOMER_STAGED_SQL}
select country_code, series_code, "year", debt_value_usd from staged where series_code in ('{ALL}', '2-HIGH')""")
def landed_panel(spark, sf_dir):
    """Landed with bare year columns; two series are read, long."""
    path = scratch_path(spark, "panel")
    raw = raw_customer_panel(spark, sf_dir)
    raw.withColumnsRenamed({f"year_{y}": str(y) for y in YEARS}).write.parquet(path)
    staged = stage_panel(read_panel(spark, path, [ALL, "2-HIGH"]), CUSTOMER_PANEL)
    return staged.select("country_code", "series_code", "year", "debt_value_usd")


@query("land_annual", f"""with {CUSTOMER_STAGED_SQL}
select country_code, country_name, series_code, "year", debt_value_usd,
       (select count(distinct k || s) from cells) landed_rows
from staged""")
def landed_series(spark, sf_dir):
    """One source per series, as it would be fetched, and one that is missing."""
    place, root = scratch_path(spark, "series"), scratch_path(spark, "annual")
    raw = raw_customer_panel(spark, sf_dir).withColumnsRenamed({f"year_{y}": str(y) for y in YEARS})
    raw.drop("extracted_at").write.partitionBy("series_code").parquet(place)
    sources = {code: f"{place}/series_code={code}" for code in (ALL, *PRIORITY_SERIES)}
    landed_rows, _ = land_annual(spark, {**sources, "lost": f"{place}/series_code=lost"}, root, EXTRACTED_AT)
    staged = stage_panel(open_snapshots(spark, root, "latest"), CUSTOMER_PANEL)
    cells = staged.select("country_code", "country_name", "series_code", "year", "debt_value_usd")
    return cells.withColumn("landed_rows", F.lit(landed_rows).cast("bigint"))


# Each flag is a workbook; a workbook has one sheet per line status. Sheets of status
# F lack the 1997 quarter.
FLAGS, STATUSES = ("A", "N", "R"), ("F", "O")


@query("read_sheets", f"""with {SUPPLIER_SHEET_SQL}
select country_code, 'flag_' || series_code[1] source_table, 'status ' || series_code[2] sheet_name,
       substr(sheet_name, 6) line, {", ".join(f"coalesce({q}, -1) {q}" for q in QUARTERS[:4])},
       case when series_code[2] = 'O' then coalesce({QUARTERS[4]}, -1) end {QUARTERS[4]}
from sheet""")
def landed_sheets(spark, sf_dir):
    read = read_sheets(spark, _exported_sheets(spark, sf_dir))
    numbers = [
        F.when(F.col(q) == "nan", F.lit(-1.0)).otherwise(F.col(q).try_cast("double")).alias(q) for q in QUARTERS
    ]
    return read.select("country_code", "source_table", "sheet_name", "line", *numbers)


@query("land_quarterly", f"""with {SUPPLIER_SHEET_SQL}
select country_code, 'flag_' || series_code[1] source_table, 'status ' || series_code[2] sheet_name,
       substr(sheet_name, 6) line, {", ".join(QUARTERS[:4])},
       case when series_code[2] = 'O' then {QUARTERS[4]} end {QUARTERS[4]}, extracted_at
from sheet""")
def landed_snapshot_of_sheets(spark, sf_dir):
    root = scratch_path(spark, "quarterly")
    land_quarterly(spark, {"good": _exported_sheets(spark, sf_dir), "lost": f"{root}/none"}, root, EXTRACTED_AT)
    ids = ("country_code", "source_table", "sheet_name", "line", "extracted_at")
    spec = replace(CLEAN_SHEET, ids=ids, required=("country_code",), quarters=QUARTERS, one_snapshot=True)
    return stage_sheet(open_snapshots(spark, root, EXTRACTED_AT), spec)


def _exported_sheets(spark, sf_dir):
    root = scratch_path(spark, "sheets")
    cells = pin(supplier_quarters(spark, sf_dir), "cells")
    for flag in FLAGS:
        for status in STATUSES:
            quarters = QUARTERS if status == "O" else QUARTERS[:4]
            headers = [F.col(q).alias(f"{q[2:].upper()} [{q[2:].upper()}]") for q in quarters]
            sheet = cells.where((F.col("l_returnflag") == flag) & (F.col("l_linestatus") == status))
            sheet.select(
                F.col("l_suppkey").alias("Country Code"), F.col("l_linenumber").alias("Line"), *headers
            ).write.parquet(f"{root}/flag_{flag}/status {status}")
    return root


def _mixed_sheets(spark, sf_dir, fmt):
    """A sheet whose second file has a further quarter, one whose column has another type, one with a repeated header."""
    root = scratch_path(spark, f"mixed-{fmt}")
    cells = pin(supplier_quarters(spark, sf_dir), "cells")
    options = {"header": "true"} if fmt == "csv" else {}

    def export(place, flag, mode="errorifexists", **columns):
        sheet = cells.where(F.col("l_returnflag") == flag)
        picked = [F.col("l_suppkey").alias("Country Code"), F.col("l_linestatus").alias("Status"), F.col("l_linenumber").alias("Line")]
        sheet = sheet.select(*picked, *[c.alias(n) for n, c in columns.items()])
        sheet.write.format(fmt).options(**options).mode(mode).save(f"{root}/{place}")

    one, two = F.col(QUARTERS[0]), F.col(QUARTERS[1])
    export("book/sheet A", "A", **{"1996Q1 [1996Q1]": one})
    export("book/sheet A", "N", "append", **{"1996Q1 [1996Q1]": one, "1996Q2": two})
    export("book/sheet R", "R", **{"1996Q1 [1996Q1]": one.cast("string"), "1996Q1": two.cast("string")})
    return root


@query("read_sheets_mixed", f"""with {SUPPLIER_SHEET_SQL},
cells as (select *, series_code[1] flag, substr(sheet_name, 6) line from sheet),
read as (
  select country_code, 'sheet A' sheet_name, series_code[2] status, line, coalesce({QUARTERS[0]}, -1) {QUARTERS[0]},
         case when flag = 'N' then coalesce({QUARTERS[1]}, -1) end {QUARTERS[1]}, cast(null as double) repeated
  from cells where flag in ('A', 'N')
  union all
  select country_code, 'sheet R', series_code[2], line, coalesce({QUARTERS[0]}, -1), null, coalesce({QUARTERS[1]}, -1)
  from cells where flag = 'R')
select 'parquet' format, * from read union all select 'csv', * from read""")
def mixed_sheets(spark, sf_dir):
    """Files of a sheet with other columns, the same column with other types, a header that repeats."""
    frames = []
    for fmt in ("parquet", "csv"):
        read = read_sheets(spark, _mixed_sheets(spark, sf_dir, fmt), fmt)
        number = lambda c: F.when(F.col(c) == "nan", F.lit(-1.0)).otherwise(F.col(c).try_cast("double"))
        frames.append(read.select(
            F.lit(fmt).alias("format"), "country_code", "sheet_name", "status", "line",
            number("q_1996q1").alias(QUARTERS[0]), number("q_1996q2").alias(QUARTERS[1]), number("q_1996q1_1").alias("repeated"),
        ))
    return frames[0].unionByName(frames[1])


def _three_landings(spark, sf_dir, compact=False):
    """All events but the last day's, then all events twice on the newest date."""
    root = scratch_path(spark, "snapshots")
    daily = daily_events(spark, sf_dir)
    earlier = daily.where(F.col("extracted_at") < daily.select(F.max("extracted_at")).scalar())
    write_snapshot(earlier, root, "2024-01-29", compact)
    write_snapshot(daily, root, "2024-01-30", compact)
    write_snapshot(daily, root, "2024-01-30", compact)
    return root


_SNAPSHOTS_SQL = f"""with {_DAILY},
landed as (
  select *, date '2024-01-29' extracted_date from daily where extracted_at < (select max(extracted_at) from daily)
  union all select *, date '2024-01-30' from daily)
select extracted_date, event_type, count(*) "rows", cast(sum(cast(value as decimal(18,2))) as double) total
from landed group by 1, 2"""


def _per_snapshot(df):
    return df.groupBy("extracted_date", "event_type").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total")
    )


@query("write_snapshot", _SNAPSHOTS_SQL)
def snapshot_rerun(spark, sf_dir):
    return _per_snapshot(open_snapshots(spark, _three_landings(spark, sf_dir)))


@query("write_snapshot_compact", _SNAPSHOTS_SQL)
def snapshot_rerun_compact(spark, sf_dir):
    return _per_snapshot(open_snapshots(spark, _three_landings(spark, sf_dir, compact=True)))


@query("register_snapshots", _SNAPSHOTS_SQL)
def external_table(spark, sf_dir):
    return _per_snapshot(register_snapshots(spark, "landed_events", _three_landings(spark, sf_dir)))


@query("register_snapshots_latest", f"""with {_DAILY}
select event_type, count(*) "rows", cast(sum(cast(value as decimal(18,2))) as double) total from daily group by 1""")
def newest_of_external_table(spark, sf_dir):
    """The date comes from the catalog's partitions and is a literal in the plan."""
    table = register_snapshots(spark, "landed_events_dated", _three_landings(spark, sf_dir))
    newest = table.where(F.col("extracted_date") == F.lit(newest_partition(spark, "landed_events_dated")).cast("date"))
    return _per_snapshot(newest).drop("extracted_date")


@query("open_snapshots", f"with {_DAILY} select * from daily")
def newest_snapshot(spark, sf_dir):
    """The newest partition is found and read alone."""
    newest = latest_snapshot(open_snapshots(spark, _three_landings(spark, sf_dir)))
    return newest.drop("extracted_date")


@query("publish_view", f"with {CUSTOMER_STAGED_SQL} select * from staged")
def staged_view(spark, sf_dir):
    return publish_view(stage_panel(raw_customer_panel(spark, sf_dir), CUSTOMER_PANEL), "staged_customers")


@query("publish_table_partitioned", f"with {CUSTOMER_STOCKS_SQL} select * from stocks")
def stocks_by_year(spark, sf_dir):
    mart = stocks_mart_from_wide(landed_customers(spark, sf_dir), CUSTOMER_PANEL)
    table = publish_table(mart, "stocks_by_year", ["year"], path=scratch_path(spark, "stocks_by_year"))
    return table.withColumn("year", F.col("year").cast("bigint"))


@query("publish_table_clustered", f"with {SUPPLIER_SERVICE_SQL} select * from service")
def service_clustered(spark, sf_dir):
    mart = service_mart(stage_sheet(raw_supplier_sheet(spark, sf_dir), SUPPLIER_SHEET), SUPPLIER_SHEET)
    return publish_table(
        mart, "service_clustered", cluster_by=["country_code", "source_table"], path=scratch_path(spark, "service")
    )


def _build_annual(spark, sf_dir, *only, **options):
    """Two landed snapshots, then the staged view and the annual marts asked for below a new root."""
    root = scratch_path(spark, "warehouse")
    landed = f"{root}/landed_annual"
    write_snapshot(stringify(raw_country_panel(spark, sf_dir, 2000, "2000-12-31")), landed, "2000-12-31")
    write_snapshot(stringify(raw_country_panel(spark, sf_dir)), landed, EXTRACTED_AT)
    publish_view(open_snapshots(spark, landed), RAW_ANNUAL)
    return build_annual(spark, replace(COUNTRY_PANEL, one_snapshot=False), root=f"{root}/marts", only=only, **options)


def _build_quarterly(spark, sf_dir, **options):
    """A landed snapshot, then the staged view and the service mart below a new root."""
    root = scratch_path(spark, "warehouse")
    landed = f"{root}/landed_quarterly"
    write_snapshot(stringify(raw_supplier_sheet(spark, sf_dir)), landed, EXTRACTED_AT)
    publish_view(open_snapshots(spark, landed), RAW_QUARTERLY)
    return build_quarterly(spark, replace(SUPPLIER_SHEET, one_snapshot=False), root=f"{root}/marts", **options)


@query("build_stocks", f"with {COUNTRY_STOCKS_SQL} select * from stocks")
def built_stocks(spark, sf_dir):
    _build_annual(spark, sf_dir, MART_STOCKS)
    return model(spark, MART_STOCKS)


@query("build_stocks_bucketed", f"with {COUNTRY_STOCKS_SQL} select * from stocks")
def built_stocks_in_buckets(spark, sf_dir):
    _build_annual(spark, sf_dir, MART_STOCKS, buckets=4)
    return model(spark, MART_STOCKS)


@query("not_null_tests_reading", f"""with {SUPPLIER_SERVICE_SQL}
select unnest(['staged_quarterly', 'staged_quarterly', 'mart_service']) "table",
       unnest(['country_code', 'series_code', 'country_code']) "column",
       unnest([(select count(*) from sheet), (select count(*) from sheet), (select count(*) from service)]) "rows", cast(0 as bigint) failures""")
def quarterly_not_null_tests(spark, sf_dir):
    """On a published table and a view, read for it."""
    _build_quarterly(spark, sf_dir)
    return run_not_null_tests(spark, {t: NOT_NULL[t] for t in (STAGED_QUARTERLY, MART_SERVICE)})


@query("build_regional", f"""with {COUNTRY_STAGED_SQL}, {_COUNTRY_REGIONS_SQL}
select region, series_code, series_description, "year", {_ROLLUP}
from placed where region <> 'Other' group by 1, 2, 3, 4""")
def built_regional(spark, sf_dir):
    _build_annual(spark, sf_dir, MART_REGIONAL)
    return model(spark, MART_REGIONAL)


@query("build_service", f"with {SUPPLIER_SERVICE_SQL} select * from service")
def built_service(spark, sf_dir):
    _build_quarterly(spark, sf_dir)
    return model(spark, MART_SERVICE)


@query("not_null_tests", f"""with {COUNTRY_STOCKS_SQL}, {_COUNTRY_REGIONS_SQL}, {SUPPLIER_SERVICE_SQL},
rolled as (select 1 from placed where region <> 'Other' group by region, series_code, "year"),
sizes as (
  select 'staged_annual' "table", count(*) n, ['country_code', 'series_code', 'year'] cols from staged
  union all select 'staged_quarterly', count(*), ['country_code', 'series_code'] from sheet
  union all select 'mart_stocks', count(*), ['country_code', 'year', 'series_code'] from stocks
  union all select 'mart_regional', count(*), ['region', 'year'] from rolled
  union all select 'mart_service', count(*), ['country_code'] from service)
select "table", unnest(cols) "column", n "rows", cast(0 as bigint) failures from sizes""")
def all_not_null_tests(spark, sf_dir):
    """Counted while the marts are written."""
    checks = ObservedChecks()
    _build_annual(spark, sf_dir, MART_STOCKS, MART_REGIONAL, checks=checks)
    _build_quarterly(spark, sf_dir, checks=checks)
    return checks.results(spark)


@query("build_report", f"""with {COUNTRY_STAGED_SQL}, {_COUNTRY_REGIONS_SQL}
select 'duplicate_keys' "check", (select count(distinct (country_code, series_code)) from staged where series_code = 'DT.DOD.DPPG.CD') failures
union all select 'periods_out_of_range', (select count(*) * 1 from (
  select * from staged union all select * from staged where series_code = 'DT.DOD.DPPG.CD') where "year" < 1996 or "year" > 2000)
union all select 'missing_series', 1
union all select 'codes_in_no_group', (select count(distinct country_code) from placed where region = 'Other')
union all select 'cells_in_no_group', (select count(*) from (
  select * from placed union all select * from placed where series_code = 'DT.DOD.DPPG.CD') where region = 'Other')""")
def reported_failures(spark, sf_dir):
    """One series is landed twice, years reach past the range, one series is only in the older snapshot."""
    landed = scratch_path(spark, "reported")
    raw = pin(raw_country_panel(spark, sf_dir), "countries")
    write_snapshot(stringify(raw.withColumn("series_code", F.lit("LOST"))), landed, "2000-12-31")
    write_snapshot(stringify(raw.union(raw.where(F.col("series_code") == "DT.DOD.DPPG.CD"))), landed, EXTRACTED_AT)
    publish_view(open_snapshots(spark, landed), RAW_ANNUAL)
    return build_report(spark, replace(COUNTRY_PANEL, one_snapshot=False), years=(1996, 2000))
