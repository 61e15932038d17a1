"""Connected components of links and of what shares buckets, as joins and aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from .common import landed


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; the component is its least node.

    Alternating large and small stars (Kiveris et al. 2014): every step hangs
    the neighbours of a node on its least neighbour, so chains shorten by half
    and the links end as one star per component. Minima are combined before
    the shuffle and written before they are joined, so the centre of a big star
    is split like any hot join key. Each step is written to the shared folder.
    """
    edges = landed(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "edges"
    )
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (state.n, state.x) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select("v", "v").distinct()
            )
        before = (state.n, state.x)
        both = edges.union(edges.select("v", "u"))
        least = landed(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = landed(large, "large")
        # Here a node has few neighbours: those of big centres hang on them already.
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = small.select("u", F.col("m").alias("v")).union(small.where("v != m").select(F.col("v"), F.col("m")))
        edges = landed(small.distinct(), "small")


def joined_parts(parts: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) after ``links`` (a, b) are added to what gave ``parts``, written.

    Links are first put between components, so what earlier links connected isn't walked again.
    """
    if parts is None:
        return landed(components(links), "parts")
    x = parts.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    y = parts.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    between = links.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    between = landed(between.where("a != b").distinct(), "between-parts")
    if between.isEmpty():
        return parts
    moved = landed(components(between).withColumnRenamed("component", "least"), "moved-parts")
    known = parts.join(moved.withColumnRenamed("node", "component"), "component", "left")
    new = moved.join(parts, "node", "left_anti")
    return landed(known.select("node", F.coalesce("least", "component").alias("component")).union(new.select("node", "least")), "parts")


def bucket_components(
    members: DataFrame,
    about: DataFrame,
    fits: str,
    load: Callable[[DataFrame], DataFrame],
    verify: Callable[[DataFrame, DataFrame], DataFrame],
    rounds: int = 1,
    within: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    reach: str = "true",
    free: Callable[..., None] = lambda *frames: None,
) -> DataFrame:
    """(node, component) of the nodes that links connect: pairs that share a bucket and are verified.

    ``members``: bucket, node; one row per node and bucket. ``about``: node, n.
    ``fits``: condition on ``na`` and ``nb``, the two nodes' n, that any link meets. ``load``: what
    ``verify`` needs of the nodes of a frame (node), looked up once. ``verify``: keeps the true links of a frame (a, b).

    A group of copies is not expanded into its pairs. First every node is
    tried with one node: the leader (least node) it shares most buckets with.
    What this connects needs no further test among itself. Then, ``rounds``
    times, nodes outside the largest component of a bucket are tried with one
    of that component's members there, another in each bucket, so what belongs to a
    dense group joins it. At last all pairs of different components that share a bucket
    are tried: no link that would join two components is lost. ``within`` tells how much a node can have in common with
    any other of the nodes then left, as (node, c) from (node, part) and what ``load`` gave, part being its component so far;
    nodes it leaves out and pairs that do not meet the condition ``reach`` on ``na``, ``ca``, ``nb`` and ``cb`` can't be links.
    ``free`` is told of frames, ``members`` too, that are not read any more.
    """
    counts = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("leader"))
    shared = landed(counts.where("size > 1").select("bucket", "leader"), "shared-buckets")
    kept = landed(members.join(shared, "bucket").select("bucket", "node", "leader"), "bucket-members")
    free(shared, members)
    nodes = landed(kept.select("node").distinct(), "bucket-nodes")
    known = landed(about.join(nodes, "node", "left_semi").select("node", "n"), "about-nodes")
    data = landed(load(nodes), "node-data")
    free(nodes)

    def fitting(pairs: DataFrame) -> DataFrame:
        x = known.select(F.col("node").alias("a"), F.col("n").alias("na"))
        y = known.select(F.col("node").alias("b"), F.col("n").alias("nb"))
        return pairs.join(x, "a").join(y, "b").where(fits).select(*pairs.columns)

    def open_members(parts: DataFrame) -> DataFrame:
        """(bucket, node, part) of the buckets whose members are in several components."""
        labelled = kept.join(parts, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("part"))
        mixed = labelled.groupBy("bucket").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x < y")
        return landed(labelled.join(mixed.select("bucket"), "bucket"), "open-members")

    stars = kept.where("node != leader").groupBy(F.col("leader").alias("a"), F.col("node").alias("b"))
    stars = fitting(stars.agg(F.count(F.lit(1)).alias("c")))
    first = stars.groupBy("b").agg(F.max_by("a", F.struct("c", "a")).alias("a")).select("a", "b")
    tried = landed(first, "first-pairs")
    parts = joined_parts(None, landed(verify(tried, data), "first-links"))
    for k in range(rounds):
        left = open_members(parts)
        here = left.groupBy("bucket", "part").agg(
            F.count(F.lit(1)).alias("size"), F.min_by("node", F.xxhash64("node", "bucket", F.lit(k))).alias("one")
        )
        largest = landed(here.groupBy("bucket").agg(F.max(F.struct("size", "part", "one")).alias("most")), "largest")
        pairs = left.join(largest, "bucket").where("part != most.part")
        pairs = pairs.select(F.least("node", "most.one").alias("a"), F.greatest("node", "most.one").alias("b")).distinct()
        pairs = landed(fitting(pairs.join(tried, ["a", "b"], "left_anti")), "next-pairs")
        free(left, largest)
        parts = joined_parts(parts, landed(verify(pairs, data), "next-links"))
        tried = tried.unionByName(pairs)
    left = open_members(parts)
    free(kept)
    facts = known
    if within is not None:
        facts = known.join(landed(within(landed(left.select("node", "part").distinct(), "open-nodes"), data), "in-common"), "node")
    else:
        facts = known.withColumn("c", F.lit(None).cast("array<long>"))
    opened = left
    left = left.join(facts, "node")
    x = left.select("bucket", F.col("node").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"), F.col("part").alias("pa"))
    y = left.select("bucket", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"), F.col("part").alias("pb"))
    across = x.join(y, "bucket").where((F.col("a") < F.col("b")) & (F.col("pa") != F.col("pb"))).where(f"({fits}) AND ({reach})")
    across = across.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
    pairs = landed(across, "last-pairs")
    free(opened, known)
    return joined_parts(parts, landed(verify(pairs, data), "last-links"))
