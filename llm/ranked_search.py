"""Ranked lexical search: an inverted index in segments, searched by a hybrid of TAAT and DAAT.

The index has one row per segment, a few MB of text: its documents, its terms and
their postings. A query's short lists of a segment are added up term at a time
into accumulators, which then are one more iterator with a known greatest value. That iterator
and the long lists are merged document at a time: lists that together can't
lift a document among the best are only looked up for documents found in the
others, and whole lists and segments are skipped once their bounds are too low.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import arrow_rows, documents, id_and_text, landed, small_batches, texts_in, with_null_ids
from .registry import query

SEGMENT_BYTES = 4 << 20  # text of a segment; more only if a single text is longer
QUERY_BYTES = 4 << 20  # query text searched for in one pass over the index
STRETCH = 1 << 20  # bytes of a text that are cut into terms at a time
SHORT = 16  # a list of less than a sixteenth of its segment's documents is short
WINDOW = 512  # documents merged at a time
SALTS = 64

# Letters and digits of ASCII and all bytes of longer characters stay, A-Z in lower case; others end a term.
TERM_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

INDEX = pa.schema([
    ("segment", pa.int64()), ("held", pa.int64()), ("total", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
    ("terms", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64())), ("most", pa.list_(pa.int64())), ("shortest", pa.list_(pa.int64())),
    ("places", pa.binary()), ("counts", pa.binary()),
])
INDEX_KINDS = (
    "segment long, held long, total long, doc_ids array<long>, lengths array<long>, terms array<binary>, "
    "sizes array<long>, most array<long>, shortest array<long>, places binary, counts binary"
)


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, a stretch at a time."""
    at = 0
    while at < len(text):
        end = min(len(text), at + STRETCH)
        plain = text[at:end].translate(TERM_TABLE)
        while end < len(text) and plain[-1] != 32:  # go on to the end of the term
            more = text[end : end + 4096].translate(TERM_TABLE)
            stop = more.find(b" ") + 1 or len(more)
            plain += more[:stop]
            end += stop
        yield plain.split()
        at = end


class Codes(dict):
    """term -> its number in order of appearance."""

    def __missing__(self, term: bytes) -> int:
        code = self[term] = len(self)
        return code


def narrow(values: np.ndarray) -> bytes:
    """Whole numbers from 0 as little-endian bytes of the least width that holds them all."""
    kind = np.min_scalar_type(int(values.max()) if len(values) else 0)
    return values.astype(kind.newbyteorder("<")).tobytes()


def widened(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64) if n else np.empty(0, np.int64)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The index of all whole texts, one row per segment.

    segment; held (documents with a term) and total (their terms with repeats); doc_ids and lengths; terms and, for
    each, sizes (documents that hold it), most (greatest count) and shortest (least
    length among them); places and counts: documents of the segment and
    occurrences, term after term, as little-endian numbers.

    A row group of its files holds one segment, since Parquet's writer and Spark's reader hold as much as a row
    group at a time, which by default is a hundred rows or more: of what a task gets, one segment is in memory.

    Null and empty texts have no terms. Only the two named columns are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part, made = TaskContext.get().partitionId(), 0

        def segment(ids: list[int], words: list[np.ndarray], vocabulary: Codes) -> dict:
            lengths = np.array([len(w) for w in words], np.int64)
            pairs, counts = np.unique(np.concatenate(words) * len(ids) + np.repeat(np.arange(len(ids)), lengths), return_counts=True)
            code, place = np.divmod(pairs, len(ids))
            starts = np.searchsorted(code, np.arange(len(vocabulary)))
            some = len(vocabulary) > 0
            return {
                "segment": [(part << 32) + made], "held": [int((lengths > 0).sum())], "total": [int(lengths.sum())],
                "doc_ids": [np.array(ids, np.int64)], "lengths": [lengths], "terms": [list(vocabulary)],
                "sizes": [np.diff(np.append(starts, len(code)))],
                "most": [np.maximum.reduceat(counts, starts) if some else counts],
                "shortest": [np.minimum.reduceat(lengths[place], starts) if some else counts],
                "places": [narrow(place)], "counts": [narrow(counts)],
            }

        ids: list[int] = []
        words: list[np.ndarray] = []
        vocabulary, size = Codes(), 0
        for batch in batches:
            for some_ids, texts in texts_in(batch, min(segment_bytes, 256 << 10)):
                for text in texts:
                    codes = [np.fromiter(map(vocabulary.__getitem__, some), np.int64, len(some)) for some in terms_of(text)]
                    words.append(np.concatenate(codes) if codes else np.empty(0, np.int64))
                    size += len(text)
                ids += some_ids
                if size >= segment_bytes:
                    yield segment(ids, words, vocabulary)
                    ids, words, vocabulary, size, made = [], [], Codes(), 0, made + 1
        if ids:
            yield segment(ids, words, vocabulary)

    with small_batches(docs.sparkSession):
        rows = id_and_text(docs, id_col, text_col).mapInArrow(arrow_rows(run, INDEX), INDEX_KINDS)
        return landed(rows, "index", **{"parquet.block.row.count.limit": 1})


def length_factor(lengths: np.ndarray, held: int, total: int) -> np.ndarray:
    """m of documents by their lengths: 10 for the shortest, 100 at the mean length."""
    if len(lengths) and 90 * int(lengths.max()) * held >= 2**63:  # beyond 64 bits on the way, not at the end
        return np.array([10 + 90 * int(n) * held // total for n in lengths], np.int64)
    return 10 + 90 * lengths * held // max(total, 1)


def part_of_score(weight: int | np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weight * (1_000_000_000 * tf // (1000 * tf + 8 * m))


@dataclass
class Postings:
    """Documents of a segment in ascending order, what each adds to the score, and the most that one adds."""

    places: np.ndarray
    adds: np.ndarray
    most: int

    def between(self, a: int, b: int) -> slice:
        return slice(*np.searchsorted(self.places, (a, b)))


@dataclass
class Best:
    """The ``k`` best (score, doc_id) so far; equal scores by ascending id."""

    k: int
    scores: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    ids: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    @property
    def floor(self) -> int:
        """Scores below it can't come in."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        first = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[first], ids[first]


def accumulated(lists: list[Postings], n: int) -> Postings:
    """Short lists added up term at a time."""
    sums = np.zeros(n, np.int64)
    for x in lists:
        sums[x.places] += x.adds
    places = np.flatnonzero(sums)
    return Postings(places, sums[places], int(sums.max(initial=0)))


def merge(lists: list[Postings], doc_ids: np.ndarray, best: Best, window: int = WINDOW, short: int = SHORT) -> None:
    """Add the documents of a segment to ``best`` that belong there.

    Lists in ascending order of their greatest value: documents that only the
    first ones hold, whose bounds add up to less than the floor, can't come in. So each
    window of documents takes its candidates from the other lists; the first
    ones are looked up from the greatest down, for candidates still in reach.
    """
    n = len(doc_ids)
    few = [x for x in lists if len(x.places) * short < n]
    merged = [x for x in lists if len(x.places) * short >= n] + ([accumulated(few, n)] if few else [])
    merged = sorted((x for x in merged if x.most > 0), key=lambda x: x.most)
    bounds = np.cumsum([x.most for x in merged]).tolist()
    for a in range(0, n, window):
        floor = best.floor
        first = next((i for i, bound in enumerate(bounds) if bound >= floor), None)
        if first is None:
            return
        b = min(n, a + window)
        sums = np.zeros(b - a, np.int64)
        for x in merged[first:]:
            here = x.between(a, b)
            sums[x.places[here] - a] += x.adds[here]
        found = np.flatnonzero(sums)
        for i in range(first - 1, -1, -1):
            found = found[sums[found] + bounds[i] >= floor]
            if not len(found):
                break
            x = merged[i]
            at = np.minimum(np.searchsorted(x.places, found + a), len(x.places) - 1)
            hit = x.places[at] == found + a
            sums[found[hit]] += x.adds[at[hit]]
        found = found[sums[found] >= floor]
        if len(found):
            best.add(sums[found], doc_ids[found + a])


def search_segment(row: dict, weights: dict[bytes, int], items: list[list[bytes]], held: int, total: int, best: list[Best]) -> None:
    """All items against one row of the index. A list is decoded when the first item needs it."""
    at = [i for i, t in enumerate(row["terms"]) if t in weights]
    names = [row["terms"][i] for i in at]
    ends = np.cumsum(row["sizes"])
    postings = int(ends[-1]) if len(ends) else 0
    places, counts = widened(row["places"], postings), widened(row["counts"], postings)
    m = length_factor(row["lengths"], held, total)
    weight = np.array([weights[t] for t in names], np.int64)
    bounds = part_of_score(weight, row["most"][at], length_factor(row["shortest"][at], held, total)) if at else weight
    bound = dict(zip(names, bounds.tolist()))
    where = dict(zip(names, at))
    decoded: dict[bytes, Postings] = {}

    def postings_of(term: bytes) -> Postings:
        if term not in decoded:
            i = where[term]
            own = slice(int(ends[i] - row["sizes"][i]), int(ends[i]))
            adds = part_of_score(weights[term], counts[own], m[places[own]])
            decoded[term] = Postings(places[own], adds, int(adds.max()))
        return decoded[term]

    for terms, so_far in zip(items, best):
        present = [t for t in terms if t in bound]
        if present and sum(bound[t] for t in present) >= so_far.floor:
            merge([postings_of(t) for t in present], row["doc_ids"], so_far)


def index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            row: dict = {}
            for name in INDEX.names:
                value = batch.column(batch.schema.get_field_index(name))[i]
                if name in ("doc_ids", "lengths", "sizes", "most", "shortest"):
                    row[name] = value.values.to_numpy(zero_copy_only=False)
                else:
                    row[name] = value.as_py()
            yield row


def item_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term), each pair once; ``items`` that repeat an id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for ids, texts in texts_in(batch):
                for item, text in zip(ids, texts):
                    for some in terms_of(text):
                        terms = list(set(some))
                        yield {"item_id": np.full(len(terms), item), "term": terms}

    schema = pa.schema([("item_id", pa.int64()), ("term", pa.binary())])
    plain = id_and_text(items, item_col, text_col)
    return plain.mapInArrow(arrow_rows(run, schema), "item_id long, term binary").distinct()


def ranked(
    index: DataFrame, items: DataFrame, item_col: str = "item_id", item_text_col: str = "text", k: int = 10, query_bytes: int = QUERY_BYTES
) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item its ``k`` best documents of ``index`` with a score above 0.

    A term that df of the N documents with a term hold weighs floor(1000 * ln((2N + 2) / (2df + 1))); a document of
    n of all L terms has m = 10 + 90nN div L; its score adds up weight * (10^9 tf div (1000 tf + 8m)) over the item's
    distinct terms. Equal scores rank by ascending doc_id.

    Items are the query set: about ``query_bytes`` of their terms at a time are sent to
    the tasks and searched for in the whole index. A task keeps ``k`` documents per
    item over all its segments, so what is shuffled grows with the number of tasks.

    Null, empty and blank items have no terms and no rows. Rows that repeat an item's id are one item with
    the terms of all. Documents that repeat an id are scored one by one; those
    without id come before all others. Empty tables give no rows.
    """
    wanted = landed(item_terms(items, item_col, item_text_col), "item-terms")
    lexicon = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.sizes").alias("df"))
    lexicon = lexicon.join(landed(wanted.select("term").distinct(), "query-terms"), "term").groupBy("term").agg(F.sum("df").alias("df"))
    known = landed(wanted.join(landed(lexicon, "frequencies"), "term"), "known-terms")
    held, total = index.agg(F.coalesce(F.sum("held"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    sent = known.agg(F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0))).first()[0]
    parts = max(1, -(-sent // query_bytes))
    part = F.pmod(F.xxhash64("item_id"), F.lit(parts))
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
    found = None
    for number in range(parts):
        terms_by_item: dict[int, list[bytes]] = {}
        weights: dict[bytes, int] = {}
        for r in known.where(part == number).collect():
            term = bytes(r.term)
            weights[term] = math.floor(1000 * math.log((2 * held + 2) / (2 * r.df + 1)))
            terms_by_item.setdefault(r.item_id, []).append(term)
        queries = index.sparkSession.sparkContext.broadcast((weights, list(terms_by_item), list(terms_by_item.values())))

        def run(batches: Iterator[pa.RecordBatch], queries=queries) -> Iterator[dict]:
            weights, names, terms = queries.value
            best = [Best(k) for _ in names]
            for row in index_rows(batches):
                search_segment(row, weights, terms, held, total, best)
            for item, b in zip(names, best):
                if len(b.ids):
                    yield {"item_id": np.full(len(b.ids), item), "doc_id": b.ids, "score": b.scores}

        got = index.mapInArrow(arrow_rows(run, schema), "item_id long, doc_id long, score long")
        found = got if found is None else found.unionByName(got)
    with small_batches(index.sparkSession, 1):  # one segment at a time, as in the index
        found = landed(found, "found")
    # The best of each task, then of each salt, then of all.
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    order = [F.desc("score"), "doc_id"]
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))).where(F.col("rank") <= k)
    last = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return with_null_ids(last.select("item_id", "rank", "doc_id", "score"), "item_id", "doc_id")


LEXICAL_SQL = r"""
WITH
  d AS (SELECT doc_id, row_number() OVER () AS r,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
        FROM documents),
  q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark),
  s AS (SELECT count(*) AS held, CAST(sum(len(terms)) AS BIGINT) AS total FROM d WHERE len(terms) > 0),
  p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY ALL),
  w AS (SELECT term, CAST(floor(1000 * ln((2 * held + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
        FROM p, s GROUP BY term, held),
  m AS (SELECT r, doc_id, 10 + (90 * len(terms) * held) // total AS m FROM d, s WHERE len(terms) > 0),
  scored AS (SELECT item_id, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
             FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) <= 10
"""


@query("op11_taat_daat", LEXICAL_SQL)
def op11_taat_daat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents for each benchmark item, from an index of all documents."""
    return ranked(build_index(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
