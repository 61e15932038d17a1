"""Mixing sources to target weights by Pfair scheduling.

The rows of each source form blocks. A source of weight w gets block i at the
earliest in time slot floor(i / w) (release) and at the latest in the slot before
ceil((i + 1) / w) (deadline); earliest deadline first fills the slots. At any
time a source has then had less than one block more or less than its share.

Weights are exact fractions p / q, so the schedule repeats after q slots, the
frame. Frames of at most ``ticks`` slots are scheduled once on the driver
and every block looks its slot up there. Longer frames are scheduled by one task,
slot by slot, as far as the input's blocks reach: weights are never rounded. Equal
weights are scheduled like any others; their frame has one slot per source.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import arrow_rows, documents, landed
from .registry import query

TICKS = 1000
MOST = 2**62  # stands for block and slot counts beyond 64 bits, which no input reaches


def whole_ticks(weights: Mapping[str, float], ticks: int = TICKS) -> dict[str, int]:
    """Weights rounded to ticks that add up to ``ticks``: largest remainders, at least one tick each, ties by name.

    For callers who want a short frame; :func:`mix_sources` does not round.
    """
    names = sorted(weights)
    if len(names) > ticks:
        raise ValueError(f"{len(names)} sources need a frame of at least as many ticks")
    if any(not weights[s] > 0 for s in names):
        raise ValueError("weights must be positive")
    total = sum(Fraction(weights[s]) for s in names)
    exact = {s: Fraction(weights[s]) / total * ticks for s in names}
    got = {s: max(1, int(exact[s])) for s in names}
    for s in sorted(names, key=lambda s: (int(exact[s]) - exact[s], s)):
        if sum(got.values()) >= ticks:
            break
        got[s] += 1
    while sum(got.values()) > ticks:  # sources lifted to one tick: the largest gives
        got[max(names, key=lambda s: (got[s] - exact[s] if got[s] > 1 else Fraction(-ticks), s))] -= 1
    return got


def exact_weights(weights: Mapping[str, float]) -> tuple[dict[str, int], int]:
    """Blocks per frame of each source, and the frame's slots: the weights' shares as whole numbers over one denominator.

    A float counts as the decimal fraction it is written as: 0.1 is 1/10.
    """
    if any(not weights[s] > 0 for s in weights):
        raise ValueError("weights must be positive")
    given = {s: Fraction(str(w)) if isinstance(w, float) else Fraction(w) for s, w in weights.items()}
    total = sum(given.values())
    shares = {s: w / total for s, w in given.items()}
    frame = math.lcm(*(w.denominator for w in shares.values()))
    return {s: int(w * frame) for s, w in shares.items()}, frame


def slots_in_order(blocks_of: Mapping[str, int], frame: int) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, block, release, deadline, slot) of all slots, without end: earliest deadline first, ties by source."""
    waiting = [(0, s, 0) for s in sorted(blocks_of)]
    ready: list[tuple[int, str, int, int]] = []
    slot = 0
    while True:
        while waiting and waiting[0][0] <= slot:
            release, source, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * frame // blocks_of[source]), source, i, release))
        deadline, source, i, release = heapq.heappop(ready)
        if slot >= deadline:
            raise AssertionError("a Pfair schedule misses no deadline")
        yield source, i, release, deadline, slot
        heapq.heappush(waiting, ((i + 1) * frame // blocks_of[source], source, i + 1))
        slot += 1


def frame_schedule(ticks_of: Mapping[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(source, block, release, deadline, slot) of one frame, earliest deadline first, ties by source."""
    frame = sum(ticks_of.values())
    return list(islice(slots_in_order(ticks_of, frame), frame)) if frame else []


SCHEDULE = "mix_source string, _nth long, _release long, _deadline long, _slot long"


def long_schedule(spark: SparkSession, blocks_of: Mapping[str, int], frame: int, needed: Mapping[str, int]) -> DataFrame:
    """The places of the first ``needed`` blocks of each source, at most one frame, written by one task a batch at a time."""
    left = {s: min(needed.get(s, 0), n) for s, n in blocks_of.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for _ in batches:
            todo, some = sum(left.values()), []
            for at in slots_in_order(blocks_of, frame) if todo else ():
                if at[1] < left[at[0]]:
                    some.append(at)
                    todo -= 1
                if some and (not todo or len(some) == 50_000):
                    yield dict(zip(schema.names, zip(*some)))
                    some = []
                if not todo:
                    break

    schema = pa.schema([("mix_source", pa.string()), *((c, pa.int64()) for c in ("_nth", "_release", "_deadline", "_slot"))])
    return landed(spark.range(0, 1, 1, 1).mapInArrow(arrow_rows(place, schema), SCHEDULE), "schedule")


def source_names(df: DataFrame, source: str = "source") -> list[str]:
    name = F.coalesce(F.col(source).cast("string"), F.lit(""))
    return [r["s"] for r in df.select(name.alias("s")).distinct().collect()]


def mix_sources(
    df: DataFrame,
    weights: Mapping[str, float] | None = None,
    source: str = "source",
    id_col: str = "doc_id",
    block_rows: int = 64,
    ticks: int = TICKS,
    digits: int = 3,
) -> DataFrame:
    """Add ``mix_source``, ``block``, ``release``, ``deadline``, ``slot`` and ``position_in_block``.

    Sorted by (slot, position_in_block) the rows are the mixture. Every row has a
    place. Inside a source rows come in the order of md5(id), then id, and each
    ``block_rows`` of them are a block. ``weights`` maps sources to target
    weights, by default equal for all; a source that is not named raises. Once a
    source has run out, its slots stay empty, so the others go on in proportion.
    Weights are kept exactly: up to any slot a source has had less than one block
    more or less than its share. A frame longer than ``ticks`` slots (with equal weights: more
    sources than that) needs ``spark.checkpoint.dir`` and one step per slot that the input reaches.

    A source is numbered over ``16 ** digits`` buckets of md5(id): one count per
    bucket is summed up, rows are numbered inside their bucket, so a source with
    a third of all rows is spread like the others. Null counts as the source
    ''. Repeated ids get different places in an undefined order; an empty frame
    gives no rows; columns of ``df`` with the names added here are replaced.
    """
    added = ["mix_source", "block", "release", "deadline", "slot", "position_in_block"]
    spark = df.sparkSession
    named = weights if weights is not None else dict.fromkeys(source_names(df, source), 1)
    blocks_of, frame = exact_weights(named)
    sources = spark.createDataFrame(
        [(s, min(n, MOST)) for s, n in blocks_of.items()], "mix_source string, _per_frame long"
    )

    clean = df.drop(*[c for c in added if c in df.columns])
    order = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    rows = clean.withColumns({
        "mix_source": F.coalesce(F.col(source).cast("string"), F.lit("")),
        "_order": order, "_bucket": F.substring(order, 1, digits),
    })
    counts = rows.groupBy("mix_source", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("mix_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("mix_source", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("mix_source", "_bucket").orderBy("_order", id_col)
    numbered = (
        rows.withColumn("_row", F.row_number().over(inside).cast("long") - 1)
        .join(bases, ["mix_source", "_bucket"])
        .withColumn("_place", F.col("_base") + F.col("_row"))
        .withColumns({
            "block": F.floor(F.col("_place") / block_rows).cast("long"),
            "position_in_block": F.pmod("_place", F.lit(block_rows)).cast("int"),
        })
    )
    known = numbered.join(sources, "mix_source", "left").withColumn(
        "_per_frame",
        F.when(F.col("_per_frame").isNull(), F.raise_error(F.concat(F.lit("no weight for source "), "mix_source")).cast("long"))
        .otherwise(F.col("_per_frame")),
    )
    framed = known.withColumns({
        "_frame": F.floor(F.col("block") / F.col("_per_frame")).cast("long"),
        "_nth": F.pmod("block", "_per_frame").cast("long"),
    })
    if frame <= ticks:
        placed = framed.join(F.broadcast(spark.createDataFrame(frame_schedule(blocks_of), SCHEDULE)), ["mix_source", "_nth"])
    else:
        totals = counts.groupBy("mix_source").agg(F.ceil(F.sum("_n") / block_rows).alias("n")).collect()
        placed = framed.join(long_schedule(spark, blocks_of, frame, {r["mix_source"]: r["n"] for r in totals}), ["mix_source", "_nth"])
    start: Column = F.col("_frame") * F.lit(min(frame, MOST))
    return placed.select(
        *clean.columns, "mix_source", "block",
        (start + F.col("_release")).alias("release"), (start + F.col("_deadline")).alias("deadline"),
        (start + F.col("_slot")).alias("slot"), "position_in_block",
    )


def in_mixed_order(df: DataFrame, id_col: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """``df`` sorted as the mixture has it; the same rows and columns.

    Ids and sources are mixed alone; texts move twice, to meet their places and to be sorted. Rows that
    repeat an id and a source take the first of their places.
    """
    keys = df.select(F.col(id_col).alias("_id"), F.col(source).alias("_source"))
    mixed = mix_sources(keys, source="_source", id_col="_id", **options)
    places = landed(mixed.groupBy("_id", "_source").agg(F.min(F.struct("slot", "position_in_block")).alias("_at")), "places")
    same = F.col(id_col).eqNullSafe(F.col("_id")) & F.col(source).eqNullSafe(F.col("_source"))
    # Joined the same way at every size: places grow with the rows.
    return df.join(places.hint("merge"), same).orderBy("_at").select(*df.columns)


# Equal weights: a frame has one slot per source, block i of a source is released at slot i * n and due before
# (i + 1) * n, and of the n blocks of a frame, all due alike, the first by name goes first.
MIX_SQL = """
WITH
  d AS (SELECT doc_id, coalesce(source, '') AS mix_source,
               row_number() OVER (PARTITION BY coalesce(source, '')
                                  ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS place
        FROM documents),
  s AS (SELECT mix_source, row_number() OVER (ORDER BY mix_source) - 1 AS k, count(*) OVER () AS n
        FROM (SELECT DISTINCT mix_source FROM d))
SELECT doc_id, mix_source, place // 64 AS block, place // 64 * n AS release, (place // 64 + 1) * n AS deadline,
       place // 64 * n + k AS slot, CAST(place % 64 AS INTEGER) AS position_in_block
FROM d JOIN s USING (mix_source)
"""


@query("op6_pfair_mix", MIX_SQL)
def op6_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal weights for all sources, blocks of 64 documents; slots are those of the schedule."""
    rows = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "source")
    return mix_sources(rows).select("doc_id", "mix_source", "block", "release", "deadline", "slot", "position_in_block")
