"""Panels in the landed shape, derived from the order and line tables.

Each builder is a Spark job; the SQL constants state the same cells directly in
long form, so an error in the wide detour cannot hide on both sides.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelspark.plans.specs import ANNUAL, QUARTERLY, PanelSpec, SheetSpec

from .registry import table

YEARS = range(1995, 2002)
EXTRACTED_AT = "2001-12-31"
ALL = "ALL"

# ------------------------------------------------------------- annual, by customer

CUSTOMER_LABELS = {ALL: "All priorities", "1-URGENT": "Urgent", "2-HIGH": "High"}
CUSTOMER_PANEL: PanelSpec = replace(
    ANNUAL, code_length=None, exclude=(), labels=CUSTOMER_LABELS, total_series=ALL, groups={}, decimals=2,
    one_snapshot=True,
)

# ------------------------------------------------------------- annual, by country

# Country code of each nation key. One is listed in two regions
# (EGY), two in none (USA, TUR), two stand for aggregates, one is too short and
# one is the missing-value token.
NATION_CODES = (
    "KEN", "NGA", "EGY", "ZAF", "BRA",
    "MEX", "ARG", "CHN", "VNM", "IDN",
    "IND", "PAK", "LKA", "TUR", "UKR",
    "POL", "JOR", "LBN", "IRQ", "USA",
    "WLD", "SSA", "EU", "nan", "PER",
)
# Series code of each order priority.
PRIORITY_SERIES = {
    "1-URGENT": "DT.DOD.DPPG.CD",
    "2-HIGH": "DT.DOD.DPNG.CD",
    "3-MEDIUM": "DT.DOD.DLXF.CD",
    "4-NOT SPECIFIED": "DT.DOD.DIMF.CD",
    "5-LOW": "DT.DOD.XTRA.CD",
}
COUNTRY_PANEL: PanelSpec = replace(ANNUAL, decimals=2, one_snapshot=True)


def price(name: str) -> Column:
    return F.col(name).cast("decimal(18,2)")


def cents(name: str) -> Column:
    """Whole cents: their sums stay exact and are far cheaper than decimal sums."""
    return F.round(F.col(name) * 100).cast("bigint")


def amount(total_cents: Column) -> Column:
    return (total_cents.cast("decimal(20,0)") / 100).cast("decimal(20,2)")


def _yearly(value: Column, when: Column) -> dict[str, Column]:
    """One conditional sum per year."""
    return {f"year_{y}": F.sum(F.when(when == y, value)) for y in YEARS}


def _as_text(names) -> list[Column]:
    return [F.coalesce(amount(F.col(n)).cast("string"), F.lit("nan")).alias(n) for n in names]


def raw_customer_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """economy = customer, series = order priority plus ALL, cell = ordered amount of a year.

    One aggregate over grouping sets makes both the series and their total; the
    customer's name is joined to the aggregated rows.
    """
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderdate", "o_totalprice")
    cells = _yearly(cents("o_totalprice"), F.year("o_orderdate"))
    series = F.when(F.grouping("o_orderpriority") == 1, F.lit(ALL)).otherwise(F.col("o_orderpriority"))
    sums = orders.groupingSets(
        [["o_custkey", "o_orderpriority"], ["o_custkey"]], "o_custkey", "o_orderpriority"
    ).agg(series.alias("series_code"), *[c.alias(n) for n, c in cells.items()])
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return sums.join(names, "o_custkey").select(
        F.col("o_custkey").cast("string").alias("economy"),
        F.col("c_name").alias("Country"),
        *_as_text(cells),
        "series_code",
        F.lit(EXTRACTED_AT).alias("extracted_at"),
    )


def raw_country_panel(
    spark: SparkSession, sf_dir: str, through: int = YEARS[-1], stamp: str = EXTRACTED_AT
) -> DataFrame:
    """economy = country code of the customer's nation, series codes and schema of the annual preset.

    Orders are summed per customer first, so the join and the second sum see one
    row per customer and priority. ``through`` leaves out later years, as an
    earlier extraction would have.
    """
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderdate", "o_totalprice")
    cells = {n: c for n, c in _yearly(cents("o_totalprice"), F.year("o_orderdate")).items() if int(n[-4:]) <= through}
    per_customer = orders.groupBy("o_custkey", "o_orderpriority").agg(*[c.alias(n) for n, c in cells.items()])
    homes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    code = F.element_at(F.array(*[F.lit(c) for c in NATION_CODES]), F.col("c_nationkey") + 1)
    series = F.when(F.grouping("o_orderpriority") == 1, F.lit(ANNUAL.total_series))
    for priority, series_code in PRIORITY_SERIES.items():
        series = series.when(F.col("o_orderpriority") == priority, F.lit(series_code))
    sums = (
        per_customer.join(homes, "o_custkey")
        .groupingSets([["c_nationkey", "o_orderpriority"], ["c_nationkey"]], "c_nationkey", "o_orderpriority")
        .agg(series.alias("series_code"), *[F.sum(n).alias(n) for n in cells])
    )
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return sums.join(names, "c_nationkey").select(
        code.alias("economy"),
        F.col("n_name").alias("Country"),
        *_as_text(cells),
        "series_code",
        F.lit(stamp).alias("extracted_at"),
    )


def customer_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, group, priority): region of every customer."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return (
        c.join(n, c.c_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(F.col("c_custkey").cast("string").alias("code"), F.col("r_name").alias("group"), F.lit(1).alias("priority"))
    )


_SERIES_CASE = " ".join(f"when '{p}' then '{s}'" for p, s in PRIORITY_SERIES.items())
_CUSTOMER_LABEL_CASE = " ".join(f"when '{c}' then '{t}'" for c, t in CUSTOMER_LABELS.items())
_SERIES_LABEL_CASE = " ".join(f"when '{c}' then '{t}'" for c, t in ANNUAL.labels.items())


def sql_list(codes) -> str:
    return ", ".join(f"'{c}'" for c in codes)


# staged(country_code, country_name, series_code, year, debt_value_usd, extracted_at, series_description)
CUSTOMER_STAGED_SQL = f"""
spend as (
  select o_custkey k, o_orderpriority s, year(o_orderdate) y, sum(cast(o_totalprice as decimal(18,2))) v
  from orders group by 1, 2, 3),
cells as (
  select k, s, y, v from spend
  union all
  select k, '{ALL}', y, sum(v) from spend group by k, y),
staged as (
  select cast(c_custkey as varchar) country_code, c_name country_name, s series_code, cast(y as bigint) "year",
         cast(v as double) debt_value_usd, '{EXTRACTED_AT}' extracted_at,
         case s {_CUSTOMER_LABEL_CASE} else s end series_description
  from cells join customer on c_custkey = k)
"""

COUNTRY_STAGED_SQL = f"""
spend as (
  select c_nationkey k, o_orderpriority s, year(o_orderdate) y, sum(cast(o_totalprice as decimal(18,2))) v
  from orders join customer on c_custkey = o_custkey group by 1, 2, 3),
cells as (
  select k, case s {_SERIES_CASE} end s, y, v from spend
  union all
  select k, '{ANNUAL.total_series}', y, sum(v) from spend group by k, y),
coded as (
  select list_extract([{sql_list(NATION_CODES)}], k + 1) country_code, n_name country_name, s series_code,
         cast(y as bigint) "year", cast(v as double) debt_value_usd, '{EXTRACTED_AT}' extracted_at,
         case s {_SERIES_LABEL_CASE} else s end series_description
  from cells join nation on n_nationkey = k),
staged as (
  select * from coded
  where country_code <> 'nan' and length(country_code) = 3 and country_code not in ({sql_list(ANNUAL.exclude)}))
"""

# stocks: the stocks mart over any staged()
STOCKS_SQL = """
stocks as (
  select b.country_code, b.country_name, b.series_code, b.series_description, b."year", b.debt_value_usd,
         b.extracted_at, t.debt_value_usd total_debt_usd,
         b.debt_value_usd / nullif(t.debt_value_usd, 0) * 100 pct_of_total_debt,
         lag(b.debt_value_usd) over w prev_year_value,
         (b.debt_value_usd - lag(b.debt_value_usd) over w) / nullif(lag(b.debt_value_usd) over w, 0) * 100 yoy_change_pct
  from staged b left join staged t
    on t.country_code = b.country_code and t."year" = b."year" and t.series_code = '{total}'
  window w as (partition by b.country_code, b.series_code order by b."year"))
"""
CUSTOMER_STOCKS_SQL = CUSTOMER_STAGED_SQL + "," + STOCKS_SQL.format(total=ALL)
COUNTRY_STOCKS_SQL = COUNTRY_STAGED_SQL + "," + STOCKS_SQL.format(total=ANNUAL.total_series)

# ------------------------------------------------------------- quarterly, by supplier

QUARTERS = ("q_1996q1", "q_1996q2", "q_1996q3", "q_1996q4", "q_1997q3")
SUPPLIER_SHEET: SheetSpec = replace(
    QUARTERLY, quarters=QUARTERS, summed=QUARTERS[:4],
    total="total_1996_payments", average="avg_quarterly_payment_1996",
    one_snapshot=True,
)


def every_quarter(spark: SparkSession, sf_dir: str) -> list[str]:
    """Columns of all quarters that the lines have."""
    shipped = table(spark, sf_dir, "lineitem").select(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b")).first()
    return [f"q_{y}q{q}" for y in range(shipped.a.year, shipped.b.year + 1) for q in range(1, 5)]


def supplier_quarters(spark: SparkSession, sf_dir: str, quarters=QUARTERS) -> DataFrame:
    """Line amounts per supplier, flag, status and line number, one decimal column per quarter, NULL where none."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_returnflag", "l_linestatus", "l_linenumber", "l_extendedprice", "l_shipdate"
    )
    quarter = F.year("l_shipdate") * 10 + F.quarter("l_shipdate")
    cells = [F.sum(F.when(F.col("_q") == int(q[2:6] + q[-1]), cents("l_extendedprice"))).alias(q) for q in quarters]
    sums = (
        lines.withColumn("_q", quarter)
        .groupBy("l_suppkey", "l_returnflag", "l_linestatus", "l_linenumber")
        .agg(*cells)
    )
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return sums.withColumns({q: amount(F.col(q)) for q in quarters}).join(names, "l_suppkey")


def raw_supplier_sheet(spark: SparkSession, sf_dir: str, missing: str = "..", quarters=QUARTERS) -> DataFrame:
    """The landed quarterly schema: one row per supplier, flag + status (series) and line number (sheet)."""
    return supplier_quarters(spark, sf_dir, quarters).select(
        F.col("s_name").alias("country_name"),
        F.col("l_suppkey").cast("string").alias("country_code"),
        F.concat(F.lit("Lines "), F.col("l_returnflag"), F.col("l_linestatus")).alias("series_name"),
        F.concat("l_returnflag", "l_linestatus").alias("series_code"),
        F.lit("Units").alias("scale_precision"),
        *[F.coalesce(F.col(q).cast("string"), F.lit(missing)).alias(q) for q in quarters],
        F.lit("lineitem").alias("source_table"),
        F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("sheet_name"),
        F.lit(EXTRACTED_AT).alias("extracted_at"),
    )


_QUARTER_CELLS = ", ".join(
    f"cast(sum(case when year(l_shipdate) = {q[2:6]} and quarter(l_shipdate) = {q[-1]} "
    f"then cast(l_extendedprice as decimal(18,2)) end) as double) {q}"
    for q in QUARTERS
)
# sheet: the staged quarterly sheet; missing quarters are NULL
SUPPLIER_SHEET_SQL = f"""
sums as (
  select l_suppkey, l_returnflag, l_linestatus, l_linenumber, {_QUARTER_CELLS}
  from lineitem group by 1, 2, 3, 4),
sheet as (
  select s_name country_name, cast(l_suppkey as varchar) country_code,
         'Lines ' || l_returnflag || l_linestatus series_name, l_returnflag || l_linestatus series_code,
         'Units' scale_precision, 'lineitem' source_table, 'line ' || l_linenumber sheet_name,
         '{EXTRACTED_AT}' extracted_at, {", ".join(QUARTERS)}
  from sums join supplier on s_suppkey = l_suppkey)
"""
_FOUR = " + ".join(f"coalesce({q}, 0)" for q in QUARTERS[:4])
# service: the service mart
SUPPLIER_SERVICE_SQL = SUPPLIER_SHEET_SQL + f""",
service as (
  select country_code, country_name, series_name, series_code, source_table, extracted_at,
         {", ".join(QUARTERS)}, {_FOUR} total_1996_payments, ({_FOUR}) / 4 avg_quarterly_payment_1996
  from sheet)
"""
