"""Annual panel: staging, stocks, roll-ups and the serving queries on them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from panelspark.functions import cast_measure, period_to_int
from panelspark.operators import (
    attach_total, check_range, check_unique, classify, merge_rollups, pct_change, previous_value, require_present,
    rollup_sketch, share_of_total, unpivot_periods,
)
from panelspark.plans import (
    composition, regional_rollup, rollup_by_column, rollup_from_wide, scorecard, share_trend, slice_panel,
    stage_panel, stocks_mart, stocks_mart_from_wide, top_entities, top_then_track, trend,
)
from panelspark.session import pin

from .panels import (
    ALL, COUNTRY_PANEL, COUNTRY_STAGED_SQL, COUNTRY_STOCKS_SQL, CUSTOMER_PANEL, CUSTOMER_STAGED_SQL,
    CUSTOMER_STOCKS_SQL, YEARS, customer_regions, raw_country_panel, raw_customer_panel, sql_list,
)
from .registry import query

CELL = ["country_code", "series_code", "year"]
HISTORY = ["country_code", "series_code"]


def landed_customers(spark, sf_dir):
    """The wide panel written once, as a landed snapshot is."""
    return pin(raw_customer_panel(spark, sf_dir), "customers")


def landed_countries(spark, sf_dir):
    return pin(raw_country_panel(spark, sf_dir), "countries")


def staged_customers(spark, sf_dir):
    """Long, straight from the orders: for queries that read it once."""
    return stage_panel(raw_customer_panel(spark, sf_dir), CUSTOMER_PANEL)


def staged_landed_customers(spark, sf_dir):
    """Long, from the landed panel: for queries that read it several times."""
    return stage_panel(landed_customers(spark, sf_dir), CUSTOMER_PANEL)


def staged_countries(spark, sf_dir):
    return stage_panel(raw_country_panel(spark, sf_dir), COUNTRY_PANEL)


@query("unpivot_panel", f"""with {CUSTOMER_STAGED_SQL}
select country_code, country_name, series_code, "year", debt_value_usd from staged""")
def unpivot_panel(spark, sf_dir):
    raw = raw_customer_panel(spark, sf_dir)
    cells = unpivot_periods(raw, ["economy", "Country", "series_code"], names=("_column", "_text"))
    typed = cells.select(
        F.col("economy").alias("country_code"),
        F.col("Country").alias("country_name"),
        "series_code",
        period_to_int(F.col("_column")).alias("year"),
        cast_measure(F.col("_text")).alias("debt_value_usd"),
    )
    return require_present(typed, "debt_value_usd")


@query("stage_panel", f"with {COUNTRY_STAGED_SQL} select * from staged")
def stage_country_panel(spark, sf_dir):
    return staged_countries(spark, sf_dir)


@query("stocks_mart", f"with {CUSTOMER_STOCKS_SQL} select * from stocks")
def stocks_from_wide(spark, sf_dir):
    return stocks_mart_from_wide(landed_customers(spark, sf_dir), CUSTOMER_PANEL)


@query("stocks_mart_long", f"with {CUSTOMER_STOCKS_SQL} select * from stocks")
def stocks_from_long(spark, sf_dir):
    return stocks_mart(staged_landed_customers(spark, sf_dir), CUSTOMER_PANEL)


@query("stocks_mart_split_rows", f"with {CUSTOMER_STOCKS_SQL} select * from stocks")
def stocks_from_split_rows(spark, sf_dir):
    """Each entity and series has two wide rows, one with the even years and one with the odd."""
    landed = landed_customers(spark, sf_dir)
    halves = [
        landed.withColumns({f"year_{y}": F.lit("nan") for y in YEARS if y % 2 == rest}) for rest in (0, 1)
    ]
    return stocks_mart_from_wide(halves[0].union(halves[1]), CUSTOMER_PANEL, split_rows="merge")


@query("stocks_mart_countries", f"with {COUNTRY_STOCKS_SQL} select * from stocks")
def stocks_of_countries(spark, sf_dir):
    return stocks_mart_from_wide(landed_countries(spark, sf_dir), COUNTRY_PANEL)


_ROLLUP = """count(distinct country_code) country_count,
  cast(sum(cast(debt_value_usd as decimal(18,2))) as double) total_debt_usd,
  cast(sum(cast(debt_value_usd as decimal(18,2))) as double) / count(debt_value_usd) avg_debt_usd,
  max(debt_value_usd) max_debt_usd, min(debt_value_usd) min_debt_usd"""

_CUSTOMER_REGIONS_SQL = """
regions as (
  select cast(c_custkey as varchar) country_code, r_name region
  from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)
"""


@query("regional_rollup", f"""with {CUSTOMER_STAGED_SQL}, {_CUSTOMER_REGIONS_SQL}
select region, series_code, series_description, "year", {_ROLLUP}
from staged join regions using (country_code) group by 1, 2, 3, 4""")
def customer_rollup(spark, sf_dir):
    """Regions are joined to the wide rows, before these become many cells."""
    raw = classify(raw_customer_panel(spark, sf_dir), "economy", customer_regions(spark, sf_dir), "region")
    staged = stage_panel(raw.where(F.col("region") != "Other"), replace(CUSTOMER_PANEL, carry=("region",)))
    return rollup_by_column(staged, "region", CUSTOMER_PANEL)


@query("regional_rollup_from_wide", f"""with {CUSTOMER_STAGED_SQL}, {_CUSTOMER_REGIONS_SQL}
select region, series_code, series_description, "year", {_ROLLUP}
from staged join regions using (country_code) group by 1, 2, 3, 4""")
def customer_rollup_from_wide(spark, sf_dir):
    landed = landed_customers(spark, sf_dir)
    raw = classify(landed, "economy", customer_regions(spark, sf_dir), "region")
    return rollup_from_wide(raw.where(F.col("region") != "Other"), "region", CUSTOMER_PANEL)


@query("merge_rollups", f"""with {CUSTOMER_STAGED_SQL}, {_CUSTOMER_REGIONS_SQL}
select region, {_ROLLUP.replace("count(distinct country_code) country_count,", "")}, count(distinct country_code) exact_count, true close
from staged join regions using (country_code) group by 1""")
def customer_rollup_merged(spark, sf_dir):
    """Stored per region, series and year, then merged over series and years; the estimate is within four standard errors."""
    raw = classify(landed_customers(spark, sf_dir), "economy", customer_regions(spark, sf_dir), "region")
    staged = stage_panel(raw.where(F.col("region") != "Other"), replace(CUSTOMER_PANEL, carry=("region",)))
    stored = pin(rollup_sketch(staged, ["region", "series_code", "year"], "country_code", "debt_value_usd", decimals=2), "sketches")
    merged = merge_rollups(stored, ["region"], CUSTOMER_PANEL.rollup_names)
    exact = staged.groupBy("region").agg(F.count_distinct("country_code").alias("exact_count"))
    count = CUSTOMER_PANEL.rollup_names[0]
    joined = merged.join(exact, "region")
    close = F.abs(F.col(count) - F.col("exact_count")) <= 4 * 0.013 * F.col("exact_count")
    return joined.withColumn("close", close).drop(count)


_REGION_CASE = " ".join(
    f"when country_code in ({sql_list(codes)}) then '{region}'" for region, codes in COUNTRY_PANEL.groups.items()
)
_COUNTRY_REGIONS_SQL = f"""placed as (
  select *, case {_REGION_CASE} else 'Other' end region from staged)"""


@query("regional_rollup_countries", f"""with {COUNTRY_STAGED_SQL}, {_COUNTRY_REGIONS_SQL}
select region, series_code, series_description, "year", {_ROLLUP}
from placed where region <> 'Other' group by 1, 2, 3, 4""")
def country_rollup(spark, sf_dir):
    return regional_rollup(staged_countries(spark, sf_dir), COUNTRY_PANEL)


@query("attach_total", f"""with {CUSTOMER_STOCKS_SQL}
select country_code, series_code, "year", debt_value_usd, total_debt_usd from stocks""")
def attach_total_by_join(spark, sf_dir):
    cells = staged_landed_customers(spark, sf_dir).select(*CELL, "debt_value_usd")
    return attach_total(
        cells, ["country_code", "year"], "series_code", ALL, "debt_value_usd", "total_debt_usd", duplicates="join"
    )


@query("share_of_total", f"""with {CUSTOMER_STOCKS_SQL}
select country_code, series_code, "year", debt_value_usd, total_debt_usd, pct_of_total_debt from stocks""")
def share_of_checked_total(spark, sf_dir):
    cells = staged_landed_customers(spark, sf_dir).select(*CELL, "debt_value_usd")
    totals = attach_total(cells, ["country_code", "year"], "series_code", ALL, "debt_value_usd", "total_debt_usd")
    return share_of_total(totals, "debt_value_usd", "total_debt_usd", "pct_of_total_debt")


@query("previous_value", f"""with {CUSTOMER_STOCKS_SQL}
select country_code, series_code, "year", debt_value_usd, prev_year_value from stocks""")
def previous_observation(spark, sf_dir):
    cells = staged_customers(spark, sf_dir).select(*CELL, "debt_value_usd")
    return previous_value(cells, HISTORY, "year", "debt_value_usd", "prev_year_value", few_periods=True)


@query("previous_value_strict", f"""with {CUSTOMER_STAGED_SQL}
select country_code, series_code, "year", debt_value_usd,
  case when lag("year") over w = "year" - 1 then lag(debt_value_usd) over w end prev_year_value
from staged window w as (partition by country_code, series_code order by "year")""")
def previous_year_only(spark, sf_dir):
    cells = staged_customers(spark, sf_dir).select(*CELL, "debt_value_usd")
    return previous_value(
        cells, HISTORY, "year", "debt_value_usd", "prev_year_value", strict_period=True, few_periods=True
    )


@query("pct_change", f"""with {CUSTOMER_STOCKS_SQL}
select country_code, series_code, "year", debt_value_usd, yoy_change_pct from stocks""")
def change_on_previous(spark, sf_dir):
    cells = staged_customers(spark, sf_dir).select(*CELL, "debt_value_usd")
    return pct_change(cells, HISTORY, "year", "debt_value_usd", "yoy_change_pct", few_periods=True)


_SUM = "cast(sum(cast(debt_value_usd as decimal(18,2))) as double)"


@query("scorecard", f"""with {CUSTOMER_STAGED_SQL}
select "year", {_SUM} total from staged
where series_code = '{ALL}' and "year" = (select max("year") from staged where series_code = '{ALL}') group by 1""")
def global_scorecard(spark, sf_dir):
    totals = staged_landed_customers(spark, sf_dir).where(F.col("series_code") == ALL)
    return scorecard(totals, "debt_value_usd", "year", decimals=2)


@query("series_scorecard", f"""with {CUSTOMER_STAGED_SQL}
select series_code, "year", {_SUM} total from staged
where "year" = (select max("year") from staged) group by 1, 2""")
def scorecard_by_series(spark, sf_dir):
    return scorecard(staged_landed_customers(spark, sf_dir), "debt_value_usd", "year", by=["series_code"], decimals=2)


@query("trend", f"""with {CUSTOMER_STAGED_SQL}, {_CUSTOMER_REGIONS_SQL}
select region, "year", {_SUM} total from staged join regions using (country_code)
where series_code = '{ALL}' group by 1, 2""")
def regional_trend(spark, sf_dir):
    rollup = customer_rollup(spark, sf_dir)
    return trend(rollup, "region", "year", "total_debt_usd", "series_code", ALL, decimals=2)


@query("top_n", f"""with {CUSTOMER_STAGED_SQL}
select country_code, "year", debt_value_usd from staged
where series_code = '{ALL}' and "year" = (select max("year") from staged where series_code = '{ALL}')
order by debt_value_usd desc, country_code limit 20""")
def top_twenty(spark, sf_dir):
    staged = staged_landed_customers(spark, sf_dir)
    return top_entities(staged, 20, "country_code", "year", "series_code", "debt_value_usd", ALL)


@query("top_then_track", f"""with {CUSTOMER_STAGED_SQL},
leaders as (
  select country_code from staged where series_code = '{ALL}' and "year" = 2000
  order by debt_value_usd desc, country_code limit 10)
select country_code, "year", debt_value_usd from staged join leaders using (country_code)
where series_code = '2-HIGH' and "year" >= 1997""")
def track_leaders(spark, sf_dir):
    return top_then_track(
        staged_landed_customers(spark, sf_dir), 10, "country_code", "year", "series_code", "debt_value_usd",
        rank_on=ALL, track="2-HIGH", since=1997, at=2000,
    )


# Column of each order priority in the composition.
PRIORITY_COLUMNS = {
    "1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "not_specified", "5-LOW": "low",
}
_COMPOSED = ", ".join(
    f"max(case when series_code = '{code}' then debt_value_usd end) {name}" for code, name in PRIORITY_COLUMNS.items()
)


@query("composition", f"""with {CUSTOMER_STAGED_SQL}
select country_code, "year", {_COMPOSED} from staged group by 1, 2""")
def composition_by_priority(spark, sf_dir):
    staged = staged_customers(spark, sf_dir)
    return composition(staged, "country_code", "year", "series_code", "debt_value_usd", PRIORITY_COLUMNS)


@query("share_trend", f"""with {CUSTOMER_STAGED_SQL},
wide as (
  select country_code, "year", max(case when series_code = '1-URGENT' then debt_value_usd end) p,
         max(case when series_code = '{ALL}' then debt_value_usd end) t
  from staged group by 1, 2),
shares as (select country_code, "year", p / nullif(t, 0) * 100 share_pct from wide where p / nullif(t, 0) is not null)
select country_code, "year", share_pct, share_pct - lag(share_pct) over w delta,
       share_pct - lag(share_pct) over w > 0 worsening
from shares window w as (partition by country_code order by "year")""")
def urgent_share(spark, sf_dir):
    staged = staged_customers(spark, sf_dir)
    return share_trend(staged, ["country_code"], "year", "series_code", "debt_value_usd", "1-URGENT", ALL)


@query("slice", f"""with {COUNTRY_STOCKS_SQL}
select * from stocks where "year" between 1996 and 1999 and country_code in ('KEN', 'BRA', 'IND')""")
def slice_countries(spark, sf_dir):
    mart = stocks_of_countries(spark, sf_dir)
    return slice_panel(mart, "year", "country_code", years=(1996, 1999), entities=["KEN", "BRA", "IND"])


@query("check_unique", f"""with {CUSTOMER_STAGED_SQL},
doubled as (select * from staged union all select * from staged where series_code = '2-HIGH')
select country_code, series_code, "year", count(*) "rows" from doubled group by 1, 2, 3 having count(*) > 1""")
def doubled_cells(spark, sf_dir):
    staged = staged_landed_customers(spark, sf_dir)
    return check_unique(staged.union(staged.where(F.col("series_code") == "2-HIGH")), CELL)


@query("check_range", f"""with {CUSTOMER_STAGED_SQL}
select "year", count(*) "rows" from staged where "year" < 1996 or "year" > 2000 group by 1""")
def years_out_of_range(spark, sf_dir):
    return check_range(staged_customers(spark, sf_dir), "year", 1996, 2000)
