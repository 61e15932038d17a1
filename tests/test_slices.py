"""Groups cut into range slices, against brute force; one key holds a third of all rows and more."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from panelspark.operators import global_rank, lag_by_chunks, lag_within, number_within
from panelspark.operators.slices import SLICE, range_slices

N = 3000


@pytest.fixture(scope="module", autouse=True)
def real_slices(spark):
    """Small frames would be coalesced into a single slice, and nothing would be tested."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    keys = ["hot"] * (N // 2) + [None] * (N // 6) + [f"k{i % 40}" for i in range(N - N // 2 - N // 6)]
    order = rng.sample(range(10 * N), N)
    data = [(k, o, None if rng.random() < 0.2 else float(rng.randrange(50))) for k, o in zip(keys, order)]
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "k string, o bigint, v double").repartition(5)


def per_key(data):
    groups = {}
    for k, o, v in sorted(data, key=lambda r: r[1]):
        groups.setdefault(k, []).append((o, v))
    return groups


def test_hot_key_is_spread_over_slices(skewed):
    _, df = skewed
    sliced = range_slices(df, ["k", "o"])
    sizes = {r[SLICE]: r["count"] for r in sliced.groupBy(SLICE).count().collect()}
    assert len(sizes) > 1 and max(sizes.values()) < 0.6 * N
    assert sliced.where("k = 'hot'").select(SLICE).distinct().count() > 1


def test_number_within(skewed):
    data, df = skewed
    got = {(r.k, r.o): r.row_number for r in number_within(df, ["k"], ["o"]).collect()}
    expected = {(k, o): i for k, rows in per_key(data).items() for i, (o, _) in enumerate(rows, 1)}
    assert got == expected


@pytest.mark.parametrize("lag, options", [(lag_within, {}), (lag_by_chunks, {}), (lag_by_chunks, {"width": 1}), (lag_by_chunks, {"width": 5000})])
def test_lag_within(skewed, lag, options):
    data, df = skewed
    data = [(k, o - 9000, v) for k, o, v in data]  # periods may be negative
    df = df.withColumn("o", F.col("o") - 9000)
    got = {(r.k, r.o): (r.pv, r.po) for r in lag(df, ["k"], "o", {"pv": "v", "po": "o"}, **options).collect()}
    expected = {}
    for k, rows in per_key(data).items():
        before = (None, None)
        for o, v in rows:
            expected[k, o] = before
            before = (v, o)
    assert got == expected


def test_chunks_spread_a_hot_key_and_write_nothing(spark, skewed):
    """A hot key is dealt by its ranges of periods; only one row of each is ordered with the key's others."""
    _, df = skewed
    plan = plan_of(lag_by_chunks(df, ["k"], "o", {"pv": "v"}))
    assert "FileScan" not in plan and "rangepartitioning" not in plan
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert sum("_slice" in line for line in shuffles) == len(shuffles) - 1
    assert df.where("k = 'hot'").select((F.col("o") / 64).cast("int")).distinct().count() > 200


def test_global_rank_with_ties_and_nulls(skewed):
    data, df = skewed
    values = [v for _, _, v in data]
    got = {(r.k, r.o): r["rank"] for r in global_rank(df, "v").collect()}
    present = sum(v is not None for v in values)
    rank_of = {v: 1 + sum(w is not None and w > v for w in values) for v in set(values) if v is not None}
    rank_of[None] = present + 1
    assert got == {(k, o): rank_of[v] for k, o, v in data}


def test_global_rank_when_one_value_is_everywhere(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, F.lit(9.0)).otherwise(F.lit(1.0)).alias("v"))
    got = global_rank(df, "v")
    assert {tuple(r) for r in got.select("v", "rank").distinct().collect()} == {(9.0, 1), (1.0, 168)}
    assert got.count() == 500
