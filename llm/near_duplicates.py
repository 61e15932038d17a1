"""Near duplicates by SuperMinHash signatures, banding, exact verification and components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import (
    WordHashes, arrow_rows, documents, id_and_text, landed, mix, shingle_hashes, signed, text_keys, texts_in, with_null_ids, without, words_of,
)
from .components import bucket_components
from .registry import query

BANDS, BAND_ROWS = 40, 5
SPARSE_LEVELS = 8
ROUNDS = 2  # of trying outsiders of a group with its members


def super_minhash(sets: np.ndarray, sizes: np.ndarray, slots: int) -> np.ndarray:
    """SuperMinHash signatures (Ertl 2017) of several sets at once, as sets x slots.

    ``sets`` holds the distinct 64-bit elements of all sets, one after another.
    Every element draws a random permutation of the slots: at level j it offers
    j plus a random fraction to the j-th slot of its permutation, and a slot
    keeps the least offer. As an element visits each slot once, its ranks are
    correlated, which lowers the variance. Once all slots of a set hold less
    than j, deeper offers cannot win and the set stops: a set much larger than
    ``slots`` ends after a few levels. Two sets agree in a slot with the
    probability of their Jaccard similarity.
    """
    if slots > 256:
        raise ValueError("at most 256 slots")
    owner = np.repeat(np.arange(len(sizes)), sizes)
    best = np.full(len(sizes) * slots, np.iinfo(np.uint64).max, np.uint64)
    elements = sets
    drawn: list[np.ndarray] = []  # slot swapped in at each level so far, while there are few levels
    swapped: list[np.ndarray] = []  # what stood at the level's own place before
    table = None  # afterwards the permutations themselves
    for level in range(slots):
        if not len(elements):
            break
        rnd = mix(elements + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64))
        pick = (level + (rnd & np.uint64(0xFFFFFF)) % np.uint64(slots - level)).astype(np.int64)
        if level < SPARSE_LEVELS:
            slot, here = pick.copy(), np.full(len(pick), level, np.int64)
            for k, v in zip(drawn, swapped):
                slot = np.where(k == pick, v, slot)
                here = np.where(k == level, v, here)
            drawn.append(pick)
            swapped.append(here)
        else:
            rows = np.arange(len(elements))
            if table is None:
                table = np.tile(np.arange(slots, dtype=np.uint8), (len(elements), 1))
                for j, k in enumerate(drawn):
                    table[rows, j], table[rows, k] = table[rows, k], table[rows, j].copy()
            slot = table[rows, pick].astype(np.int64)
            table[rows, pick] = table[rows, level]
            table[rows, level] = slot
        offer = (np.uint64(level) << np.uint64(40)) | (rnd >> np.uint64(24))
        np.minimum.at(best, owner * slots + slot, offer)
        done = best.reshape(-1, slots).max(axis=1) < np.uint64(level + 1) << np.uint64(40)
        go_on = ~done[owner]
        if not go_on.all():
            owner, elements = owner[go_on], elements[go_on]
            if table is not None:
                table = table[go_on]
            elif level + 1 <= SPARSE_LEVELS:
                drawn, swapped = [k[go_on] for k in drawn], [v[go_on] for v in swapped]
    return best.reshape(-1, slots)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per set and band of ``rows`` slots."""
    grouped = signatures.reshape(len(signatures), bands, rows)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), grouped.shape[:2]).copy()
    for k in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, k])
    return keys


SKETCH_WORDS = 8  # two bits of up to 256 slots: all first bits, then all second ones


def sketches(signatures: np.ndarray) -> np.ndarray:
    """Two bits of every slot, as sets x SKETCH_WORDS: slots that agree in both differ in neither plane."""
    planes = np.zeros((len(signatures), 2, 256), np.uint8)
    for k in range(2):
        planes[:, k, : signatures.shape[1]] = (signatures >> np.uint64(k)) & np.uint64(1)
    return np.packbits(planes.reshape(len(signatures), -1), axis=1).view("<i8")


def sketch_limit(slots: int, percent: int) -> int:
    """Slots that may differ in a sketch at ``percent`` similarity: the mean and six deviations.

    Slots that disagree differ in their two bits in three cases of four.
    """
    differ = (1 - percent / 100) * 0.75
    return math.ceil(slots * differ + 6 * math.sqrt(slots * differ * (1 - differ)))


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, key (hash of the set), shingles (sorted distinct 64-bit hashes); ``docs``: doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hashes = WordHashes()
        for batch in batches:
            for ids, texts in texts_in(batch, 1 << 20):
                sets = [np.unique(shingle_hashes(hashes.of(words_of(t, lower=True)), shingle)) for t in texts]
                yield {"doc_id": ids, "key": [set_key(s) for s in sets], "shingles": [signed(s) for s in sets]}

    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("shingles", pa.list_(pa.int64()))])
    return docs.mapInArrow(arrow_rows(run, schema), "doc_id long, key long, shingles array<long>")


def set_key(shingles: np.ndarray) -> int:
    """Hash of a set: the sum of its mixed elements and its size."""
    with np.errstate(over="ignore"):
        total = mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(shingles))
        return int(signed(mix(np.array([total], np.uint64)))[0])


def fingerprints(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key, n (set size), key, band keys and sketch of each row; ``docs``: doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hashes = WordHashes()
        for batch in batches:
            for ids, texts in texts_in(batch, 1 << 20):
                sets = [np.unique(shingle_hashes(hashes.of(words_of(t, lower=True)), shingle)) for t in texts]
                sizes = np.array([len(s) for s in sets])
                signatures = super_minhash(np.concatenate(sets), sizes, bands * rows)
                keys = signed(band_keys(signatures, bands, rows))
                yield {
                    "doc_id": ids, "text_key": text_keys(texts), "n": sizes, "key": [set_key(s) for s in sets],
                    "bands": [k if n else k[:0] for k, n in zip(keys, sizes)], "sketch": list(sketches(signatures)),
                }

    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])
    kinds = "doc_id long, text_key long, n long, key long, bands array<long>, sketch array<long>"
    return docs.mapInArrow(arrow_rows(run, schema), kinds)


def near_duplicates(docs: DataFrame, *args, **options) -> DataFrame:
    """The rows of :func:`judged_rows` without their text's hash: doc_id, n_shingles, component_id, kept."""
    return with_null_ids(judged_rows(docs, *args, **options).drop("text_key"), "doc_id", "component_id")


def judged_rows(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = BAND_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, n_shingles, component_id, kept.

    Two documents are linked if 100 * |intersection| >= ``percent`` * |union| of
    their sets of distinct ``shingle``-word shingles (A-Z lower-cased; a shorter text is one
    shingle). ``component_id`` is the least id that links reach and ``kept`` tells
    whether the document is that one.

    Equal sets become one class before anything is paired. A pair of classes at
    the threshold shares no band with probability (1 - 0.8 ** 5) ** 40, about
    1e-7. Pairs whose signatures differ in more slots than six deviations allow at the
    threshold are not looked up, and links are confirmed on the whole sets. See
    :func:`llm.components.bucket_components` for how big groups avoid all pairs.

    Null, empty and blank texts have no shingles, are linked with nothing and
    kept. Rows that repeat an id and a text are one document and come out as often
    as they came in; rows that share an id but not the text are judged by their own texts. Rows without id (NO_ID) come
    before all others and stay. An empty table gives no rows. Only the two named columns are read.
    """
    plain = id_and_text(docs, id_col, text_col)
    prints = landed(fingerprints(plain, shingle, bands, rows), "fingerprints")
    classes = landed(
        prints.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("first"), F.min("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")),
        "classes",
    )
    members = classes.select(F.explode("bands").alias("bucket"), F.col("key").alias("node"))
    about = classes.select(F.col("key").alias("node"), F.struct("n", "sketch").alias("n"))

    def load(nodes: DataFrame) -> DataFrame:
        ids = classes.join(nodes.withColumnRenamed("node", "key"), "key", "left_semi").select(F.col("first").alias("doc_id"))
        texts = plain.join(landed(ids.distinct(), "wanted-ids"), "doc_id", "left_semi")
        return shingle_sets(texts, shingle).dropDuplicates(["key"])

    def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        x = sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa"))
        y = sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb")).cast("long")
        compared = pairs.join(x, "a").join(y, "b").select("a", "b", both.alias("i"), (F.size("sa") + F.size("sb")).cast("long").alias("t"))
        return compared.where(F.expr(f"100 * i >= {percent} * (t - i)")).select("a", "b")

    planes = [f"bit_count((na.sketch[{k}] ^ nb.sketch[{k}]) | (na.sketch[{k + 4}] ^ nb.sketch[{k + 4}]))" for k in range(4)]
    fits = f"100 * least(na.n, nb.n) >= {percent} * greatest(na.n, nb.n) AND {' + '.join(planes)} <= {sketch_limit(bands * rows, percent)}"

    def within(nodes: DataFrame, sets: DataFrame) -> DataFrame:
        """(node, c): the shingles that a node of another part holds too, all that the node can share with one; nodes with too few go.

        Those left after a first count count again among themselves.
        """
        for _ in range(2):
            of_node = sets.join(nodes.select(F.col("node").alias("key"), "part"), "key")
            of_node = of_node.select("key", "part", F.explode("shingles").alias("s"), F.size("shingles").alias("n"))
            spread = of_node.groupBy("s").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x < y").select("s")
            counted = of_node.join(landed(spread, "common-shingles"), "s").groupBy("key", "part", "n").agg(F.collect_list("s").alias("c"))
            nodes = landed(counted.where(f"100 * size(c) >= {percent} * n").select(F.col("key").alias("node"), "part", "c"), "able-nodes")
        return nodes.select("node", "c")

    # The second line is exact: pairs of parts that pass are links, so no others are written.
    enough = f">= {percent} * (na.n + nb.n)"
    reach = f"""{100 + percent} * least(size(ca), size(cb)) {enough}
        AND {100 + percent} * size(array_intersect(ca, cb)) {enough}"""
    groups = bucket_components(members, about, fits, load, verify, rounds=ROUNDS, within=within, reach=reach)
    labelled = classes.select("key", "first").join(groups.withColumnRenamed("node", "key"), "key", "left")
    labelled = labelled.select("key", "first", F.coalesce("component", "key").alias("component"))
    labelled = landed(labelled, "labelled-classes")
    least = landed(labelled.groupBy("component").agg(F.min("first").alias("component_id")), "least-ids")
    of_class = landed(labelled.join(least, "component").select("key", "component_id"), "class-components")
    joined = prints.select("doc_id", "text_key", "n", F.when(F.col("n") > 0, F.col("key")).alias("key")).join(of_class, "key", "left")
    component = F.coalesce("component_id", "doc_id")
    return joined.select(
        "doc_id", "text_key", F.col("n").alias("n_shingles"), component.alias("component_id"), (component == F.col("doc_id")).alias("kept")
    )


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the one with the least id. Rows go by id and text."""
    gone = judged_rows(docs, **options).where("NOT kept")
    return without(docs, gone, options.get("id_col", "doc_id"), options.get("text_col", "text"))


@query("op7_super_minhash")
def op7_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-word shingles, as this query's result is defined."""
    return near_duplicates(documents(spark, sf_dir), shingle=4, percent=80)
