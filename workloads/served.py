"""The report's questions, asked of the published marts."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from panelspark.operators import newest_partition
from panelspark.plans import (
    UNITS, composition, mart_pressure, scorecard, service_mart, service_table, slice_panel, stage_sheet, top_entities,
    top_then_track, trend,
)
from panelspark.plans.build import MART_REGIONAL, MART_SERVICE, MART_STOCKS
from panelspark.session import scratch_path
from panelspark.sources import publish_table

from .annual import _COUNTRY_REGIONS_SQL
from .landing import _build_annual, _build_quarterly
from .panels import (
    COUNTRY_STAGED_SQL, COUNTRY_STOCKS_SQL, NATION_CODES, QUARTERS, SUPPLIER_SERVICE_SQL, SUPPLIER_SHEET, raw_supplier_sheet,
)
from .registry import query, table

TOTAL, PUBLIC, PRIVATE = "DT.DOD.DECT.CD", "DT.DOD.DPPG.CD", "DT.DOD.DPNG.CD"
_SUM = "cast(sum(cast(debt_value_usd as decimal(18,2))) as double)"


def published_stocks(spark, sf_dir, **options):
    return _build_annual(spark, sf_dir, MART_STOCKS, **options)[MART_STOCKS]


@query("served_scorecard", f"""with {COUNTRY_STOCKS_SQL}
select "year", {_SUM} total from stocks where series_code = '{TOTAL}' and "year" = 2000 group by 1""")
def total_of_a_year(spark, sf_dir):
    stocks = published_stocks(spark, sf_dir).where(F.col("series_code") == TOTAL)
    return scorecard(stocks, "debt_value_usd", "year", at=2000, decimals=2).withColumn("year", F.col("year").cast("bigint"))


@query("served_series_scorecard", f"""with {COUNTRY_STOCKS_SQL}
select series_code, "year", {_SUM} total from stocks where "year" = (select max("year") from stocks) group by 1, 2""")
def newest_per_series(spark, sf_dir):
    """The newest year is the name of a partition; only its directory is opened."""
    stocks = published_stocks(spark, sf_dir)
    newest = int(newest_partition(spark, MART_STOCKS, "year"))
    card = scorecard(stocks, "debt_value_usd", "year", at=newest, by=["series_code"], decimals=2)
    return card.withColumn("year", F.col("year").cast("bigint"))


@query("served_trend", f"""with {COUNTRY_STAGED_SQL}, {_COUNTRY_REGIONS_SQL}
select region, "year", {_SUM} total from placed where region <> 'Other' and series_code = '{TOTAL}' group by 1, 2""")
def regional_lines(spark, sf_dir):
    regional = _build_annual(spark, sf_dir, MART_REGIONAL)[MART_REGIONAL]
    return trend(regional, "region", "year", "total_debt_usd", "series_code", TOTAL, decimals=2)


@query("served_top_n", f"""with {COUNTRY_STOCKS_SQL}
select country_code, "year", debt_value_usd from stocks where series_code = '{TOTAL}' and "year" = 1999
order by debt_value_usd desc, country_code limit 5""")
def five_largest(spark, sf_dir):
    top = top_entities(published_stocks(spark, sf_dir), 5, "country_code", "year", "series_code", "debt_value_usd", TOTAL, at=1999)
    return top.withColumn("year", F.col("year").cast("bigint"))


_TRACKED_SQL = f"""with {COUNTRY_STOCKS_SQL},
leaders as (
  select country_code from stocks where series_code = '{TOTAL}' and "year" = 2000
  order by debt_value_usd desc, country_code limit 3)
select country_code, "year", debt_value_usd from stocks join leaders using (country_code)
where series_code = '{PRIVATE}' and "year" >= 1997"""


@query("served_top_then_track_bucketed", _TRACKED_SQL)
def tracked_leaders_in_buckets(spark, sf_dir):
    """The tracked side of the join is read in buckets, without a shuffle."""
    return tracked_leaders(spark, sf_dir, buckets=4)


@query("served_top_then_track", _TRACKED_SQL)
def tracked_leaders(spark, sf_dir, **options):
    tracked = top_then_track(
        published_stocks(spark, sf_dir, **options), 3, "country_code", "year", "series_code", "debt_value_usd",
        rank_on=TOTAL, track=PRIVATE, since=1997, at=2000,
    )
    return tracked.withColumn("year", F.col("year").cast("bigint"))


@query("served_composition", f"""with {COUNTRY_STOCKS_SQL}
select country_code, "year", max(case when series_code = '{PUBLIC}' then debt_value_usd end) public,
       max(case when series_code = '{PRIVATE}' then debt_value_usd end) private
from stocks group by 1, 2""")
def public_and_private(spark, sf_dir):
    codes = {PUBLIC: "public", PRIVATE: "private"}
    spread = composition(published_stocks(spark, sf_dir), "country_code", "year", "series_code", "debt_value_usd", codes)
    return spread.withColumn("year", F.col("year").cast("bigint"))


@query("served_slice", f"""with {COUNTRY_STOCKS_SQL}
select country_code, series_code, "year", debt_value_usd, pct_of_total_debt, yoy_change_pct from stocks
where "year" between 1996 and 1999 and country_code in ('KEN', 'BRA', 'IND')""")
def some_years_and_countries(spark, sf_dir):
    """The year filter prunes directories of the published table."""
    part = slice_panel(published_stocks(spark, sf_dir), "year", "country_code", (1996, 1999), ["KEN", "BRA", "IND"])
    return part.select(
        "country_code", "series_code", F.col("year").cast("bigint").alias("year"), "debt_value_usd",
        "pct_of_total_debt", "yoy_change_pct",
    )


@query("served_service_table", f"""with {SUPPLIER_SERVICE_SQL}
select country_code, country_name, {", ".join(f"cast(sum(cast({c} as decimal(18,2))) as double) {c}" for c in (*QUARTERS, "total_1996_payments"))}
from service group by 1, 2""")
def payments_per_supplier(spark, sf_dir):
    mart = _build_quarterly(spark, sf_dir)[MART_SERVICE]
    return service_table(mart, ["country_code", "country_name"], QUARTERS, "total_1996_payments", decimals=2)


_CODES = ", ".join(f"'{c}'" for c in NATION_CODES)


_PRESSURE_SQL = f"""with {COUNTRY_STOCKS_SQL}, {SUPPLIER_SERVICE_SQL},
paid as (
  select list_extract([{_CODES}], s_nationkey + 1) country_code,
         cast(sum(cast(total_1996_payments * 1000 as decimal(18,2))) as double) total_1996_payments
  from service join supplier on cast(s_suppkey as varchar) = country_code group by 1),
owed as (select country_code, debt_value_usd from stocks where series_code = '{TOTAL}' and "year" = 1996)
select country_code, total_1996_payments, debt_value_usd,
       total_1996_payments / nullif(debt_value_usd, 0) * 100 pressure_pct,
       cast(rank() over (order by total_1996_payments / nullif(debt_value_usd, 0) * 100 desc nulls last) as bigint) pressure_rank
from paid left join owed using (country_code)"""


@query("mart_pressure_bucketed", _PRESSURE_SQL)
def pressure_of_bucketed_marts(spark, sf_dir):
    """Both marts in as many buckets by country: sums and join need no shuffle."""
    return pressure_of_marts(spark, sf_dir, {"bucket_by": ["country_code"], "buckets": 4}, buckets=4)


@query("mart_pressure", _PRESSURE_SQL)
def pressure_of_marts(spark, sf_dir, layout=None, **options):
    """Sheets in thousands, by the supplier's country, against the total series of the published stocks mart."""
    raw = raw_supplier_sheet(spark, sf_dir).withColumn("scale_precision", F.lit("Thousands"))
    code = F.element_at(F.array(*[F.lit(c) for c in NATION_CODES]), F.col("s_nationkey") + 1)
    homes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("country_code"), code.alias("_code"))
    raw = raw.join(homes, "country_code").withColumn("country_code", F.col("_code")).drop("_code")
    spec = replace(SUPPLIER_SHEET, units=UNITS)
    service = publish_table(
        service_mart(stage_sheet(raw, spec), spec), "service_of_countries",
        path=scratch_path(spark, "service_of_countries"), **(layout or {"cluster_by": ["country_code"]}),
    )
    return mart_pressure(service, published_stocks(spark, sf_dir, **options), 1996, spec, decimals=2)
