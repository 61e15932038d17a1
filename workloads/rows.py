"""Row-level operators on the given tables: codes, headers, unions, snapshots, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions import normalize_identifier
from panelspark.operators import (
    align_union, check_missing_series, check_not_null, classify, clean_codes, dedupe_names, label_codes,
    latest_snapshot, number_within, prefix_numeric_columns, previous_value, stamp, stringify,
)
from panelspark.session import scratch_path
from panelspark.sources import load_all, observe_counts

from .panels import YEARS, price
from .registry import query, table


@query("clean_codes", """
select c_custkey, c_name, c_mktsegment from customer
where c_mktsegment is not null and c_mktsegment <> 'nan' and length(c_mktsegment) = 9
  and c_mktsegment not in ('MACHINERY')""")
def nine_letter_segments(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return clean_codes(customers, "c_mktsegment", length=9, exclude=["MACHINERY"])


@query("clean_codes_by_table", """
select o_orderkey, o_custkey from orders
where o_custkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING')""")
def orders_outside_building(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    excluded = customers.where(F.col("c_mktsegment") == "BUILDING").select("c_custkey")
    return clean_codes(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", exclude=excluded, tokens=()
    )


# Two overlapping lists: 4 and 5 belong to A, which comes first.
GROUPS = {"A": range(0, 6), "B": range(4, 9)}
_GROUPED_SQL = """
select "group", count(*) customers, cast(sum(cast(c_acctbal as decimal(18,2))) as double) balance
from (select case when c_nationkey in (0, 1, 2, 3, 4, 5) then 'A' when c_nationkey in (4, 5, 6, 7, 8) then 'B'
             else 'Other' end "group", c_acctbal from customer)
where "group" <> 'Other' group by 1"""


def _per_group(classified):
    return (
        classified.where(F.col("group") != "Other")
        .groupBy("group")
        .agg(F.count(F.lit(1)).alias("customers"), F.sum(price("c_acctbal")).cast("double").alias("balance"))
    )


@query("classify_groups", _GROUPED_SQL)
def groups_by_lists(spark, sf_dir):
    return _per_group(classify(table(spark, sf_dir, "customer"), "c_nationkey", GROUPS))


@query("classify_groups_dim", _GROUPED_SQL)
def groups_by_dimension(spark, sf_dir):
    """The same lists as a table (code, group, priority) made from the nations."""
    nations = table(spark, sf_dir, "nation")
    lists = [
        nations.where(F.col("n_nationkey").isin(list(codes))).select(
            F.col("n_nationkey").alias("code"), F.lit(name).alias("group"), F.lit(i).alias("priority")
        )
        for i, (name, codes) in enumerate(GROUPS.items())
    ]
    return _per_group(classify(table(spark, sf_dir, "customer"), "c_nationkey", align_union(lists)))


LABELS = {"1-URGENT": "Urgent", "2-HIGH": "High"}
_LABEL_SQL = """
select o_orderkey, o_orderpriority,
       case o_orderpriority when '1-URGENT' then 'Urgent' when '2-HIGH' then 'High' else o_orderpriority end label
from orders"""


@query("label_codes", _LABEL_SQL)
def priority_labels(spark, sf_dir):
    return label_codes(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", LABELS)


@query("label_codes_dim", """
select o_orderkey, o_custkey, coalesce(c_name, cast(o_custkey as varchar)) label
from orders left join (select * from customer where c_acctbal >= 0) on c_custkey = o_custkey""")
def labels_from_table(spark, sf_dir):
    known = table(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").cast("string"), "c_name")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("code"))
    return label_codes(orders, "code", known).select("o_orderkey", F.col("code").cast("bigint").alias("o_custkey"), "label")


@query("stringify", """
select cast(c_custkey as varchar) c_custkey, cast(cast(c_acctbal as decimal(18,2)) as varchar) c_acctbal,
       coalesce(nullif(c_mktsegment, 'BUILDING'), 'nan') c_mktsegment
from customer""")
def customers_as_text(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", price("c_acctbal").alias("c_acctbal"),
        F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("c_mktsegment"),
    )
    return stringify(customers)


@query("stamp", """
select *, 'orders' source_table, 'sheet one' sheet_name, '2001-12-31' extracted_at
from (select o_orderkey, o_custkey from orders)""")
def stamped_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return stamp(orders, source_table="orders", sheet_name="sheet one", extracted_at="2001-12-31")


_YEAR_SUMS = ", ".join(
    f"cast(sum(case when year(o_orderdate) = {y} then cast(o_totalprice as decimal(18,2)) end) as double) year_{y}"
    for y in YEARS
)


@query("prefix_numeric_columns", f"select o_custkey, {_YEAR_SUMS} from orders group by 1")
def yearly_columns(spark, sf_dir):
    sums = [
        F.sum(F.when(F.year("o_orderdate") == y, price("o_totalprice"))).cast("double").alias(str(y)) for y in YEARS
    ]
    return prefix_numeric_columns(table(spark, sf_dir, "orders").groupBy("o_custkey").agg(*sums))


@query("align_union", """
select o_custkey, o_orderpriority, cast(null as bigint) l_suppkey, cast(null as integer) l_linenumber from orders
union all
select null, null, l_suppkey, l_linenumber from lineitem""")
def orders_and_lines(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber")
    return align_union([orders, lines])


_SPACE_RE2 = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


@query("normalize_identifier", rf"""
with bare as (select doc_id, regexp_replace(text, '{_SPACE_RE2}*\[[^\n]*?\]', '', 'g') t from documents),
joined as (select doc_id, lower(trim(regexp_replace(t, '[^A-Za-z0-9]+', '_', 'g'), '_')) t from bare)
select doc_id, case when t = '' then 'unknown' when regexp_matches(t, '^[0-9]') then 'q_' || t else t end name
from joined""")
def texts_as_identifiers(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return documents.select("doc_id", normalize_identifier(F.col("text")).alias("name"))


@query("dedupe_names", """
select doc_id, lang, case when k > 1 then lang || '_' || (k - 1) else lang end unique_name
from (select doc_id, lang, row_number() over (partition by lang order by doc_id) k from documents)""")
def unique_languages(spark, sf_dir):
    return dedupe_names(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", ["doc_id"])


@query("number_within", """
select event_id, event_type, row_number() over (partition by event_type order by ts, event_id) nth from events""")
def numbered_events(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return number_within(events, ["event_type"], ["ts", "event_id"], "nth").drop("ts")


@query("previous_value_long", """
select event_id, event_type, value, lag(value) over (partition by event_type order by event_id) prev_value from events""")
def previous_event(spark, sf_dir):
    """Five keys hold all events: each history is cut into range slices."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return previous_value(events, ["event_type"], "event_id", "value")


def daily_events(spark, sf_dir):
    """Events as snapshots, one per day, stamped with the day as text."""
    events = table(spark, sf_dir, "events")
    return events.select("event_id", "event_type", "value", F.date_format("ts", "yyyy-MM-dd").alias("extracted_at"))


_DAILY = "daily as (select event_id, event_type, value, strftime(ts, '%Y-%m-%d') extracted_at from events)"


@query("latest_snapshot", f"""with {_DAILY}
select * from daily where extracted_at = (select max(extracted_at) from daily)""")
def last_day(spark, sf_dir):
    return latest_snapshot(daily_events(spark, sf_dir), "extracted_at")


@query("latest_snapshot_per_series", f"""with {_DAILY},
kept as (select * from daily where not (event_type = 'error' and extracted_at = (select max(extracted_at) from daily)))
select k.* from kept k join (select event_type, max(extracted_at) extracted_at from kept group by 1)
using (event_type, extracted_at)""")
def last_day_per_type(spark, sf_dir):
    return latest_snapshot(_lost_errors(spark, sf_dir), "extracted_at", per=["event_type"])


def _lost_errors(spark, sf_dir):
    """Daily events whose last snapshot lost one series."""
    daily = daily_events(spark, sf_dir)
    newest = daily.select(F.max("extracted_at")).scalar()
    return daily.where(~((F.col("event_type") == "error") & (F.col("extracted_at") == newest)))


@query("check_missing_series", f"""with {_DAILY},
kept as (select * from daily where not (event_type = 'error' and extracted_at = (select max(extracted_at) from daily))),
seen as (select event_type, max(extracted_at) last_seen from kept group by 1)
select event_type, last_seen, (select max(last_seen) from seen) newest from seen
where last_seen < (select max(last_seen) from seen)""")
def lost_series(spark, sf_dir):
    return check_missing_series(_lost_errors(spark, sf_dir), "event_type", "extracted_at")


@query("check_not_null", """
select 'orders' "table", 'o_custkey' "column", count(*) "rows", count(*) - count(o_custkey) failures from orders
union all
select 'orders', 'o_orderpriority', count(*), count(*) - count(nullif(o_orderpriority, '5-LOW')) from orders""")
def null_counts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("o_orderpriority")
    )
    return check_not_null(orders, ["o_custkey", "o_orderpriority"], "orders")


_LOADED = {"orders": ("o_orderkey", "o_totalprice"), "lineitem": ("l_orderkey", "l_extendedprice")}
_LOADED_SQL = " union all ".join(
    f"select '{name}' source_table, count(*) \"rows\", cast(sum(cast({v} as decimal(18,2))) as double) amount from {name}"
    for name, (_, v) in _LOADED.items()
)


@query("load_all", _LOADED_SQL)
def load_what_exists(spark, sf_dir):
    """One of three sources does not exist and is skipped."""

    def reader(name, key, value):
        return lambda: stamp(
            table(spark, sf_dir, name).select(F.col(key).alias("key"), price(value).alias("amount")), source_table=name
        )

    sources = {name: reader(name, *columns) for name, columns in _LOADED.items()}
    sources["missing"] = reader("no_such_table", "key", "amount")
    loaded = load_all(sources)
    return loaded.groupBy("source_table").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("amount").cast("double").alias("amount")
    )


@query("observe_counts", """
select o_orderpriority, count(*) orders, (select count(*) from orders) loaded_rows from orders group by 1""")
def observed_orders(spark, sf_dir):
    """The row count of the load comes out of the pass that lands it."""
    orders, seen = observe_counts(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "orders")
    path = scratch_path(spark, "observed")
    orders.write.parquet(path)
    counts = spark.read.parquet(path).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"))
    return counts.withColumn("loaded_rows", F.lit(seen.get["rows"]).cast("bigint"))
