"""Near-duplicate embeddings by counting collisions of one-dimensional projections.

The difference of two unit vectors, projected on a random direction with normal
entries, is normal with their distance as deviation. So how often two vectors
come within a window of each other, over many projections, is binomial, and a
pair at the wanted cosine exceeds a known count with known probability.

Counting all pairs would be quadratic. Projections are therefore also combined in tables of cells: a
cell is a range of each of several projections. Pairs are counted where they share a
cell, in enough tables that a pair at the threshold shares one with known
probability. What is counted are sketches of a byte per projection; vectors are
looked up only for members of pairs that pass the count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import arrow_rows, landed, long_id, mix, signed, with_null_ids
from .components import components
from .registry import query
from .whitening import usable

MISS = 1e-6  # of a pair at the threshold, over all steps
COUNTED = 32  # projections that are counted
REACH = 2.5  # half a window, in deviations of a pair at the threshold
RANGE = 10.0  # width of a cell's ranges, in the same deviations
OCCUPANCY = 64  # vectors of a label that share a cell, if they lie in all directions
STEPS = 16  # sketch steps in a deviation of unit vectors
BLOCK = 1024  # members of a cell compared in one go
SEED = 20


# ---- probabilities ----------------------------------------------------------


def same_range(width: float, deviation: float) -> float:
    """Probability that two values whose difference is normal fall into one range of ``width`` with a random offset."""
    z = width / deviation
    return math.erf(z / math.sqrt(2)) - math.sqrt(2 / math.pi) / z * (1 - math.exp(-z * z / 2))


def least_count(n: int, p: float, miss: float) -> int:
    """Greatest count that a binomial (n, p) falls below with probability ``miss`` at most."""
    below = 0.0
    for count in range(n + 1):
        below += math.comb(n, count) * p**count * (1 - p) ** (n - count)
        if below > miss:
            return count
    return n


@dataclass
class Plan:
    """Projections and thresholds for vectors of which ``largest`` share a label."""

    cosine: float
    per_table: int
    tables: int
    counted: int
    reach: int  # half a window in sketch steps
    least: int  # collisions from which a pair is verified

    @property
    def distance(self) -> float:
        return math.sqrt(2 - 2 * self.cosine)


def plan(largest: int, cosine: float, miss: float = MISS, counted: int = COUNTED) -> Plan:
    """More projections per cell the more vectors there are, and as many tables as recall then needs."""
    distance = math.sqrt(2 - 2 * cosine)
    near, far = same_range(RANGE * distance, distance), same_range(RANGE * distance, math.sqrt(2))
    per_table = max(1, math.ceil(math.log(max(largest, 1) / OCCUPANCY) / -math.log(far)))
    tables = math.ceil(math.log(miss / 2) / math.log(1 - near**per_table))
    collide = math.erf(REACH / math.sqrt(2))
    # Rounding to steps moves a difference by one at most.
    return Plan(cosine, per_table, tables, counted, math.ceil(REACH * distance * STEPS) + 1, least_count(counted, collide, miss / 2))


# ---- vectors to cells and sketches ------------------------------------------


def directions(dims: int, p: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(projections as columns: of all tables, then the counted ones; offset of each table's ranges)."""
    rng = np.random.default_rng([SEED, dims])
    cells = p.tables * p.per_table
    return rng.standard_normal((dims, cells + p.counted)), rng.random(cells) * RANGE * p.distance


def matrix(lists: pa.Array, rows: int) -> np.ndarray:
    """Lists of one length as rows of doubles."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1).astype(np.float64)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; those of entries so large or small that squares would leave the doubles too."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def described(classes: DataFrame, p: Plan) -> DataFrame:
    """``classes`` (node, label_key, first, n, h1, h2, embedding) plus cells (a hash per table) and sketch."""
    entry = classes.schema["embedding"].dataType.elementType.simpleString()  # float or double

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            columns = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            lengths = np.diff(columns["embedding"].offsets.to_numpy())
            for dims in np.unique(lengths):
                where, offsets = directions(int(dims), p)
                places = np.flatnonzero(lengths == dims)
                for at in np.array_split(places, -(-len(places) // 4096)):
                    some = {name: c.take(pa.array(at)) for name, c in columns.items()}
                    h = unit(matrix(some["embedding"], len(at))) @ where
                    ranges = np.floor((h[:, : len(offsets)] + offsets) / (RANGE * p.distance)).astype(np.int64)
                    ranges = ranges.view(np.uint64).reshape(len(at), p.tables, p.per_table)
                    labels = some["label_key"].to_numpy(zero_copy_only=False).view(np.uint64)
                    keys = mix(labels[:, None] + mix(np.arange(1, p.tables + 1, dtype=np.uint64) + np.uint64(dims << 20))[None, :])
                    for k in range(p.per_table):
                        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + ranges[:, :, k])
                    sketch = np.clip(np.rint(h[:, len(offsets) :] * STEPS), -127, 127).astype(np.int8)
                    yield some | {"cells": list(signed(keys)), "sketch": [s.tobytes() for s in sketch]}

    schema = pa.schema([
        ("node", pa.int64()), ("label_key", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()),
        ("embedding", pa.list_(pa.float32() if entry == "float" else pa.float64())), ("cells", pa.list_(pa.int64())), ("sketch", pa.binary()),
    ])
    kinds = f"node long, label_key long, first long, n long, h1 long, h2 long, embedding array<{entry}>, cells array<long>, sketch binary"
    plain = classes.select("node", "label_key", "first", "n", "h1", "h2", "embedding")
    return plain.mapInArrow(arrow_rows(run, schema), kinds)


# ---- counting ---------------------------------------------------------------


def collisions(a: np.ndarray, b: np.ndarray, reach: int) -> np.ndarray:
    """How many projections of each row of ``a`` and each of ``b`` are within ``reach``; a projection per column.

    Every projection of ``b`` is sorted; the window around a value of ``a`` is a
    stretch of it, added at its first place and taken off behind its last.
    """
    counts = np.zeros((len(a), len(b)), np.int16)
    rows = np.arange(len(a))
    for j in range(a.shape[1]):
        order = np.argsort(b[:, j], kind="stable")
        line = b[order, j].astype(np.int16)
        centre = a[:, j].astype(np.int16)
        edges = np.zeros((len(a), len(b) + 1), np.int8)
        edges[rows, np.searchsorted(line, centre - reach, "left")] += 1
        edges[rows, np.searchsorted(line, centre + reach, "right")] -= 1
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        counts += np.cumsum(edges[:, :-1], axis=1, dtype=np.int8)[:, back]
    return counts


def passing(sketches: np.ndarray, sides: np.ndarray, p: Plan) -> np.ndarray:
    """Pairs of a group that pass the count, as a symmetric table of booleans.

    A group is a cell, or two blocks of a crowded one (``sides`` 0 and 1), of which only
    pairs across are looked at.
    """
    good = collisions(sketches, sketches, p.reach) >= p.least
    np.fill_diagonal(good, False)
    if sides.any():
        good &= sides[:, None] != sides[None, :]
    return good


def parts_of(good: np.ndarray) -> np.ndarray:
    """Least member of each member's component."""
    label = np.arange(len(good))
    while True:
        around = np.where(good, label[None, :], len(good)).min(axis=1, initial=len(good))
        new = np.minimum(label, around)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows that share the first ``keys`` columns, from batches in which they follow each other."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        changes = np.zeros(max(batch.num_rows - 1, 0), bool)
        for c in columns:
            changes |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            key = tuple(int(c[a]) for c in columns)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def together(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a key in one partition, one after another."""
    return df.repartition(*keys).sortWithinPartitions(*keys)


def numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def sketch_rows(table: pa.Table) -> np.ndarray:
    data = table.column("sketch").to_pylist()
    return np.frombuffer(b"".join(data), np.int8).reshape(len(data), -1)


def candidates(members: DataFrame, p: Plan) -> DataFrame:
    """(cell, pair, part, node, side) of the members that pass the count with another; ``members``: cell, pair, node, side, sketch.

    ``part`` tells apart the components of a group, so that each is verified by itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for group in groups(batches, 2):
            if group.num_rows < 2:
                continue
            sides = numbers(group, "side")
            good = passing(sketch_rows(group), sides, p)
            some = np.flatnonzero(good.any(axis=1))
            if len(some):
                part = parts_of(good[np.ix_(some, some)])
                nodes = numbers(group, "node")[some]
                yield {
                    "cell": numbers(group, "cell")[some], "pair": numbers(group, "pair")[some],
                    "part": nodes[part], "node": nodes, "side": sides[some],
                }

    schema = pa.schema([("cell", pa.int64()), ("pair", pa.int64()), ("part", pa.int64()), ("node", pa.int64()), ("side", pa.int32())])
    return together(members, "cell", "pair").mapInArrow(arrow_rows(run, schema), "cell long, pair long, part long, node long, side int")


def matrix_of_longs(lists: pa.Array, rows: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def alike(group: pa.Table, cosine: float) -> np.ndarray:
    """Pairs of one label and length with at least this cosine; cells are hashes, so others may have met."""
    vectors, labels = group.column("embedding").combine_chunks(), numbers(group, "label_key")
    lengths = np.diff(vectors.offsets.to_numpy())
    good = labels[:, None] == labels[None, :]
    for dims in np.unique(lengths):
        at = np.flatnonzero(lengths == dims)
        x = matrix(vectors.take(pa.array(at)), len(at))
        x = x / np.abs(x).max(axis=1, keepdims=True)
        norms = np.sqrt((x * x).sum(axis=1))
        good[np.ix_(at, at)] &= (x @ x.T) / (norms[:, None] * norms[None, :]) >= cosine
        good[np.ix_(at, np.flatnonzero(lengths != dims))] = False
    return good


def verified(found: DataFrame, p: Plan) -> DataFrame:
    """(node, links, to) from candidates with their vectors: rows linked to the node's, and a node of less or the same number that links connect.

    A pair that shares several cells is counted in the table of the first: cells
    and counts are the same wherever the pair meets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for group in groups(batches, 3):
            good = passing(sketch_rows(group), numbers(group, "side"), p) & alike(group, p.cosine)
            if not good.any():
                continue
            nodes, copies, cell = numbers(group, "node"), numbers(group, "n"), int(numbers(group, "cell")[0])
            cells = matrix_of_longs(group.column("cells").combine_chunks(), len(nodes))
            own = good.copy()
            for t in range(int(np.flatnonzero(cells[0] == cell)[0])):
                own &= cells[:, t][:, None] != cells[:, t][None, :]
            yield {"node": nodes, "links": (own * copies[None, :]).sum(axis=1), "to": nodes[parts_of(good)]}

    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("to", pa.int64())])
    return together(found, "cell", "pair", "part").mapInArrow(arrow_rows(run, schema), "node long, links long, to long")


def vector_duplicates(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98, miss: float = MISS
) -> DataFrame:
    """One row per row of ``df``: vec_id, n_links, component_id, kept.

    Rows are linked if their labels are equal and not null and the cosine of their vectors, in double precision, is
    ``cosine`` or more. ``n_links`` counts the other rows linked directly, ``component_id`` is the
    least id that links reach and ``kept`` tells whether the row has that one.

    Equal vectors of a label are one class, which stands for all its rows. A pair at the threshold is missed with
    probability ``miss`` (:func:`plan`), a closer one hardly ever; no pair below it is linked. A cell's pairs are compared in
    one task, block by block if it is crowded, and counted there: no pair is written.

    Vectors that are null, empty, zero or hold null or non-finite entries are
    linked with nothing, and so are those of different lengths with each other. Rows that repeat an id are
    separate; rows without id come before all others. An empty table
    gives no rows. Only the three named columns are read.
    """
    spark = df.sparkSession
    vector, label = F.col(vector_col), F.col(label_col)
    if df.schema[vector_col].dataType.simpleString() != "array<float>":
        vector = vector.cast("array<double>")
    zero = ~F.exists(F.coalesce(vector, F.array()).cast("array<double>"), lambda c: c != 0)
    rows = df.select(
        long_id(id_col).alias("vec_id"), F.when(usable(vector) & ~zero & label.isNotNull(), vector).alias("embedding"),
        F.xxhash64(label.cast("string")).alias("label_key"),
    )
    hashes = [F.when(F.col("embedding").isNotNull(), F.xxhash64(F.lit(k), "label_key", "embedding")).alias(f"h{k}") for k in (1, 2)]
    rows = landed(rows.select("vec_id", "label_key", "embedding", *hashes), "vectors")
    classes = rows.where("embedding IS NOT NULL").groupBy("h1", "h2").agg(
        F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"), F.first("label_key").alias("label_key"), F.first("embedding").alias("embedding")
    )
    classes = landed(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    largest = classes.groupBy("label_key").count().agg(F.max("count")).first()[0] or 0
    p = plan(largest, cosine, miss)
    known = landed(described(classes, p), "described-vectors")

    each = known.select("node", "sketch", F.explode("cells").alias("cell"))
    crowded = landed(each.groupBy("cell").agg(F.count(F.lit(1)).alias("c")).where(f"c > {BLOCK}"), "crowded-cells")
    blocks = F.coalesce(F.ceil(F.col("c") / BLOCK), F.lit(1)).cast("int")
    block = F.pmod(F.xxhash64("node", "cell"), F.col("blocks")).cast("int")
    placed = each.join(crowded, "cell", "left").select("cell", "node", "sketch", blocks.alias("blocks")).withColumn("block", block)
    # A block meets itself and every other: pair i * blocks + j for i <= j, where block j is side 1.
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("block", "other").cast("long"), F.greatest("block", "other").cast("long")
    members = other.select(
        "cell", (i * F.col("blocks") + j).alias("pair"), "node", F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"), "sketch"
    )
    found = landed(candidates(members, p), "candidates")
    vectors = known.select("node", "label_key", "n", "embedding", "cells", "sketch")
    checked = landed(verified(found.join(vectors, "node").select("cell", "pair", "part", "node", "side", *vectors.columns[1:]), p), "checked")

    links = landed(checked.groupBy("node").agg(F.sum("links").alias("links")), "link-counts")
    reached = components(checked.where("node != to").select(F.col("node").alias("a"), F.col("to").alias("b")))
    labelled = known.select("node", "first", "n", "h1", "h2").join(reached, "node", "left").join(links, "node", "left")
    labelled = landed(labelled.select("h1", "h2", "first", "n", F.coalesce("component", "node").alias("component"), F.coalesce("links", F.lit(0)).alias("links")), "labelled-vectors")
    least = landed(labelled.groupBy("component").agg(F.min("first").alias("component_id")), "least-vectors")
    of_class = labelled.join(least, "component").select("h1", "h2", (F.col("links") + F.col("n") - 1).alias("links"), "component_id")
    out = rows.select("vec_id", "h1", "h2").join(landed(of_class, "class-results"), ["h1", "h2"], "left")
    component: Column = F.coalesce("component_id", "vec_id")
    result = out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept")
    )
    return with_null_ids(result, "vec_id", "component_id")


VECTOR_SQL = """
WITH RECURSIVE
  v AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
           AND len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(e, lambda c: c <> 0)) > 0),
  links AS (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r
            WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
  reach AS (SELECT r, r AS other FROM v UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.other),
  least AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.other GROUP BY reach.r),
  degree AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(degree.n, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN least USING (r) LEFT JOIN degree USING (r)
"""


@query("op13_collision_counts", VECTOR_SQL)
def op13_collision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
