"""Quarterly sheet: staging, service mart and the pressure ranking."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from panelspark.operators import global_rank
from panelspark.plans import (
    CLEAN_SHEET, long_quarters, pressure_ranking, service_mart, service_table, share_trend, stage_sheet,
)
from panelspark.session import pin

from .panels import (
    QUARTERS, SUPPLIER_SERVICE_SQL, SUPPLIER_SHEET, SUPPLIER_SHEET_SQL, every_quarter, price,
    raw_supplier_sheet,
)
from .registry import query, table

CLEAN_SUPPLIER_SHEET = replace(SUPPLIER_SHEET, tokens=CLEAN_SHEET.tokens, key_tokens=CLEAN_SHEET.key_tokens)


@query("stage_sheet", f"with {SUPPLIER_SHEET_SQL} select * from sheet")
def staged_sheet(spark, sf_dir):
    return stage_sheet(raw_supplier_sheet(spark, sf_dir), SUPPLIER_SHEET)


@query("service_mart", f"with {SUPPLIER_SERVICE_SQL} select * from service")
def service_rows(spark, sf_dir):
    return service_mart(staged_sheet(spark, sf_dir), SUPPLIER_SHEET)


@query("service_mart_clean", f"with {SUPPLIER_SERVICE_SQL} select * from service")
def service_rows_without_tokens(spark, sf_dir):
    raw = raw_supplier_sheet(spark, sf_dir, missing="nan")
    return service_mart(stage_sheet(raw, CLEAN_SUPPLIER_SHEET), CLEAN_SUPPLIER_SHEET)


_COMPLETE = " and ".join(f"{q} is not null" for q in QUARTERS[:4])


@query("service_mart_nan", f"""with {SUPPLIER_SERVICE_SQL}
select country_code, series_code, not ({_COMPLETE}) total_is_nan,
       case when {_COMPLETE} then total_1996_payments end finite_total from service""")
def service_rows_with_nan(spark, sf_dir):
    """A missing quarter landed as the text 'nan' becomes NaN and so does its row total."""
    raw = raw_supplier_sheet(spark, sf_dir, missing="nan")
    mart = service_mart(stage_sheet(raw, SUPPLIER_SHEET), SUPPLIER_SHEET)
    total = F.col("total_1996_payments")
    return mart.select(
        "country_code", "series_code", F.isnan(total).alias("total_is_nan"),
        F.when(~F.isnan(total), total).alias("finite_total"),
    )


_SUMS = ", ".join(
    f"cast(sum(cast({c} as decimal(18,2))) as double) {c}" for c in [*QUARTERS, "total_1996_payments"]
)


@query("service_table", f"""with {SUPPLIER_SERVICE_SQL}
select country_code, country_name, {_SUMS} from service group by 1, 2""")
def service_by_supplier(spark, sf_dir):
    return service_table(
        service_rows(spark, sf_dir), ["country_code", "country_name"], QUARTERS, "total_1996_payments", decimals=2
    )


@query("service_pressure", """
with paid as (
  select s_nationkey nation, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) payments
  from lineitem join supplier on s_suppkey = l_suppkey group by 1),
owed as (
  select c_nationkey nation, cast(sum(cast(o_totalprice as decimal(18,2))) as double) debt
  from orders join customer on c_custkey = o_custkey group by 1)
select nation, payments, debt, payments / nullif(debt, 0) * 100 pressure_pct,
       cast(rank() over (order by payments / nullif(debt, 0) * 100 desc nulls last) as bigint) pressure_rank
from paid left join owed using (nation)""")
def nation_pressure(spark, sf_dir):
    """Sums per supplier and per customer come first, so the joins see one row per key."""
    lines, orders, suppliers, customers = (
        table(spark, sf_dir, t) for t in ("lineitem", "orders", "supplier", "customer")
    )
    per_supplier = lines.groupBy("l_suppkey").agg(F.sum(price("l_extendedprice")).alias("payments"))
    per_customer = orders.groupBy("o_custkey").agg(F.sum(price("o_totalprice")).alias("debt"))
    payments = per_supplier.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    stocks = per_customer.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return pressure_ranking(
        payments.select(F.col("s_nationkey").alias("nation"), "payments"),
        stocks.select(F.col("c_nationkey").alias("nation"), "debt"),
        "nation", "payments", "debt", decimals=2,
    )


@query("stage_sheet_every_quarter", """
select s_name country_name, cast(l_suppkey as varchar) country_code, l_returnflag || l_linestatus series_code,
       'line ' || l_linenumber sheet_name, 'q_' || year(l_shipdate) || 'q' || quarter(l_shipdate) AS "quarter",
       cast(year(l_shipdate) * 4 + quarter(l_shipdate) - 1 as bigint) quarter_no,
       cast(sum(cast(l_extendedprice as decimal(18,2))) as double) "value"
from lineitem join supplier on s_suppkey = l_suppkey group by 1, 2, 3, 4, 5, 6""")
def every_quarter_long(spark, sf_dir):
    """All quarters the lines have, found by their pattern."""
    raw = raw_supplier_sheet(spark, sf_dir, quarters=every_quarter(spark, sf_dir))
    spec = replace(CLEAN_SUPPLIER_SHEET, quarters=None)
    long = long_quarters(stage_sheet(raw, spec), spec)
    return long.select("country_name", "country_code", "series_code", "sheet_name", "quarter", "quarter_no", "value")


@query("foreign_currency_share", """
with cells as (
  select l_suppkey, l_returnflag || l_linestatus s, year(l_shipdate) * 4 + quarter(l_shipdate) - 1 q,
         sum(cast(l_extendedprice as decimal(18,2))) v
  from lineitem group by 1, 2, 3, l_linenumber),
wide as (
  select l_suppkey, q, max(case when s = 'RF' then cast(v as double) end) p, max(case when s = 'AF' then cast(v as double) end) t
  from cells group by 1, 2),
shares as (select *, p / nullif(t, 0) * 100 share_pct from wide where p / nullif(t, 0) is not null)
select cast(l_suppkey as varchar) country_code, cast(q as bigint) quarter_no, share_pct,
       share_pct - lag(share_pct) over w delta, share_pct - lag(share_pct) over w > 0 worsening
from shares window w as (partition by l_suppkey order by q)""")
def share_per_quarter(spark, sf_dir):
    """From the sheet to long quarters to the trend of one series' share in another."""
    raw = raw_supplier_sheet(spark, sf_dir, quarters=every_quarter(spark, sf_dir))
    spec = replace(CLEAN_SUPPLIER_SHEET, quarters=None)
    long = pin(long_quarters(stage_sheet(raw, spec), spec), "quarters")
    return share_trend(long, ["country_code"], "quarter_no", "series_code", "value", "RF", "AF")


@query("global_rank", """
select o_custkey, orders, cast(rank() over (order by orders desc) as bigint) "rank"
from (select o_custkey, count(*) orders from orders group by 1)""")
def customers_ranked(spark, sf_dir):
    """Order counts have many ties."""
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))
    return global_rank(counts, "orders")
