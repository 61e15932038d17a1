"""Hidden Markov language model: trained by Baum-Welch, scored by the forward recursion.

Every token has a class: a frequent word has one by its hash, a rare or unknown
one by the hash of its last three bytes. States emit classes, a class emits its
words by their smoothed counts, so the model is a distribution over all texts
although its parameters are bounded (states x classes).

Documents are packed into blocks. A block's distinct words, not its tokens,
meet the corpus counts, and come back as the block's own vocabulary.
Sequences are cut into pieces; a piece is one transfer matrix between states,
so all pieces of a block advance together and joining the matrices
gives the same likelihoods and counts as the plain recursion over whole documents.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .blocks import block_rows, text_blocks, with_lists
from .common import NO_ID, WordHashes, arrow_rows, documents, landed, signed, with_null_ids
from .registry import query

STATES, CLASSES, ROUNDS = 6, 8192, 3
FREQUENT = 50  # a word seen as often has a class of its own hash
PIECE = 64
FOLDS = 10
ADD = 0.1
END = b" "  # no word holds a blank


def held_out(doc_id: int) -> bool:
    text = "" if doc_id == NO_ID else str(doc_id)
    return zlib.crc32(text.encode()) % FOLDS == 0


class Classes:
    """Class of a word by its hash and whether it is frequent; the end token has the last class."""

    def __init__(self, classes: int):
        self.half = classes // 2
        self.end = classes

    def of(self, keys: np.ndarray, suffixes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        own = (keys.view(np.uint64) % np.uint64(self.half)).astype(np.int64)
        return np.where(counts >= FREQUENT, own, self.half + suffixes % self.half)


def block_vocabulary(starts: np.ndarray, text: bytes, hashes: WordHashes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words with the end token first, their hashes, token numbers of the block, start of each document)."""
    number: dict[bytes, int] = {END: 0}
    tokens: list[np.ndarray] = []
    for a, b in zip(starts, starts[1:]):
        words = text[a:b].lower().split()
        for w in set(words).difference(number):
            number[w] = len(number)
        tokens.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
        tokens.append(np.zeros(1, np.int32))
    lengths = np.array([len(tokens[k]) + 1 for k in range(0, len(tokens), 2)], np.int64)
    words = list(number)
    keys = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    return words, signed(keys), np.concatenate(tokens), np.concatenate([[0], np.cumsum(lengths)])


def word_rows(blocks: DataFrame) -> DataFrame:
    """One row per block and distinct word: block, key (hash of the word), n (its training tokens in the block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for block, ids, starts, text in block_rows(batches):
            words, keys, tokens, begin = block_vocabulary(starts, text, WordHashes())
            learn = np.repeat([not held_out(int(i)) for i in ids], np.diff(begin))
            yield {"block": np.full(len(keys), block), "key": keys, "n": np.bincount(tokens[learn], minlength=len(keys))}

    schema = pa.schema([("block", pa.int64()), ("key", pa.int64()), ("n", pa.int64())])
    return blocks.mapInArrow(arrow_rows(run, schema), "block long, key long, n long")


CODED = pa.schema([
    ("doc_ids", pa.binary()), ("begin", pa.binary()), ("classes", pa.binary()), ("known", pa.binary()), ("log_counts", pa.binary()),
    ("new_words", pa.binary()),
])


def coded_blocks(blocks: DataFrame, counts: DataFrame, classes: int) -> DataFrame:
    """Blocks as class numbers; per document its known tokens and the sum of log10(count + 0.1).

    ``new_words``: per class the distinct training words that no earlier block
    has, so that the corpus has each once. ``counts``: block, key, total, first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        kinds, press = Classes(classes), zstandard.ZstdCompressor(level=1)
        for _, ids, starts, text, keys, totals, firsts in block_rows(batches, lists=3):
            words, mine, tokens, begin = block_vocabulary(starts, text, WordHashes())
            order = np.argsort(keys)
            at = order[np.searchsorted(keys[order], mine)]
            total = totals[at]
            suffixes = np.fromiter((zlib.crc32(w[-3:]) for w in words), np.int64, len(words))
            kind = kinds.of(mine, suffixes, total)
            kind[0] = kinds.end
            logs, docs = np.log10(total + ADD)[tokens], begin[:-1]
            fresh = np.bincount(kind, weights=(firsts[at].astype(np.int64) == 1) & (total > 0), minlength=classes + 1)
            yield {
                "doc_ids": [ids.tobytes()], "begin": [begin.tobytes()],
                "classes": [press.compress(kind[tokens].astype("<u2").tobytes())],
                "known": [np.add.reduceat((total > 0)[tokens].astype(np.int64), docs).tobytes()],
                "log_counts": [np.add.reduceat(logs, docs).tobytes()],
                "new_words": [press.compress(fresh.astype("<i8").tobytes())],
            }

    kinds = "doc_ids binary, begin binary, classes binary, known binary, log_counts binary, new_words binary"
    return with_lists(blocks, counts).mapInArrow(arrow_rows(run, CODED), kinds)


@dataclass
class Coded:
    ids: np.ndarray
    begin: np.ndarray
    classes: np.ndarray
    known: np.ndarray
    log_counts: np.ndarray
    new_words: np.ndarray

    def learn(self) -> np.ndarray:
        return np.array([not held_out(int(i)) for i in self.ids], bool)


def coded_rows(batches: Iterator[pa.RecordBatch], classes: int) -> Iterator[Coded]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids, begin, kind, known, logs, new = (batch.column(k)[i].as_py() for k in range(6))
            begin = np.frombuffer(begin, "<i8")
            press = zstandard.ZstdDecompressor()
            yield Coded(
                np.frombuffer(ids, "<i8"), begin,
                np.frombuffer(press.decompress(kind, max_output_size=2 * int(begin[-1])), "<u2"),
                np.frombuffer(known, "<i8"), np.frombuffer(logs, "<f8"),
                np.frombuffer(press.decompress(new, max_output_size=8 * (classes + 1)), "<i8"),
            )


@dataclass
class Model:
    """``start`` [states], ``step`` [states, states], ``emit`` [classes + 1, states]; rows of ``step`` and columns of ``emit`` add up to 1."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray


class Pieces:
    """Documents cut into pieces of at most PIECE tokens, longest first, and their transfer matrices."""

    def __init__(self, model: Model, classes: np.ndarray, begin: np.ndarray, piece: int = PIECE):
        self.model, self.classes = model, classes
        lengths = np.diff(begin)
        self.of_doc = -(-lengths // piece)
        doc = np.repeat(np.arange(len(lengths)), self.of_doc)
        self.first_piece = np.concatenate([[0], np.cumsum(self.of_doc)])
        nth = np.arange(len(doc)) - self.first_piece[doc]
        size = np.minimum(piece, lengths[doc] - nth * piece)
        self.order = np.argsort(-size, kind="stable")
        self.size, self.at = size[self.order], (begin[doc] + nth * piece)[self.order]
        self.opens = (nth == 0)[self.order]
        self.active = [int(n) for n in np.searchsorted(-self.size, -np.arange(1, piece + 1), side="right")]
        self.active = [n for n in self.active if n]

    def emissions(self, t: int) -> np.ndarray:
        return self.model.emit[self.classes[self.at[: self.active[t]] + t]]

    def entering(self) -> np.ndarray:
        """Transition into the first token of each piece: by ``start`` where a document opens."""
        opening = np.broadcast_to(self.model.start, self.model.step.shape)
        return np.where(self.opens[:, None, None], opening, self.model.step)

    def transfers(self) -> tuple[np.ndarray, np.ndarray]:
        """([pieces, from, to] scaled to a sum of 1, log of the scale)."""
        states = len(self.model.start)
        total = self.entering() * self.emissions(0)[:, None, :]
        log = np.zeros(len(total))
        for t in range(1, len(self.active)):
            n = self.active[t]
            moved = (total[:n].reshape(-1, states) @ self.model.step).reshape(n, states, states)
            total[:n] = moved * self.emissions(t)[:, None, :]
            if t % 8 == 7:
                log[:n] += self.rescale(total[:n])
        log += self.rescale(total)
        return total, log

    @staticmethod
    def rescale(total: np.ndarray) -> np.ndarray:
        scale = total.sum(axis=tuple(range(1, total.ndim)))
        total /= scale.reshape(-1, *[1] * (total.ndim - 1))
        return np.log(scale)

    def boundaries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log likelihood of each document, state weights entering and leaving each piece)."""
        moves, log = self.transfers()
        where = np.empty(len(self.order), np.int64)
        where[self.order] = np.arange(len(self.order))
        states, docs = len(self.model.start), len(self.of_doc)
        likelihood = np.zeros(docs)
        into, out = np.empty((len(moves), states)), np.empty((len(moves), states))
        longest = np.argsort(-self.of_doc, kind="stable")
        forward = np.full((docs, states), 1 / states)
        counts = -self.of_doc[longest]
        for j in range(int(self.of_doc.max(initial=0))):
            some = longest[: np.searchsorted(counts, -j, side="left")]
            row = where[self.first_piece[some] + j]
            into[row] = forward[some]
            moved = (forward[some][:, None, :] @ moves[row])[:, 0, :]
            likelihood[some] += log[row] + self.rescale(moved)
            forward[some] = moved
        backward = np.full((docs, states), 1 / states)
        for j in range(int(self.of_doc.max(initial=0)) - 1, -1, -1):
            some = longest[: np.searchsorted(counts, -j, side="left")]
            row = where[self.first_piece[some] + j]
            out[row] = backward[some]
            moved = (moves[row] @ backward[some][:, :, None])[:, :, 0]
            self.rescale(moved)
            backward[some] = moved
        return likelihood, into, out

    def expected(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts of (starts, steps, emissions) and the log likelihood of all documents."""
        likelihood, before, after = self.boundaries()
        model, (n_classes, states) = self.model, self.model.emit.shape
        forward, emitted = [], []
        now = before
        for t, n in enumerate(self.active):
            e = self.emissions(t)
            moved = (now[:, None, :] @ self.entering())[:, 0, :] if t == 0 else now[:n] @ model.step
            now = moved * e
            self.rescale(now)
            forward.append(now)
            emitted.append(e)
        starts, steps, emits = np.zeros(states), np.zeros((states, states)), np.zeros((n_classes, states))
        later = after
        for t in range(len(self.active) - 1, -1, -1):
            n = self.active[t]
            here = later[:n]
            weight = forward[t] * here
            self.rescale(weight)
            kind = self.classes[self.at[:n] + t]
            for s in range(states):
                emits[:, s] += np.bincount(kind, weights=weight[:, s], minlength=n_classes)
            ahead = emitted[t] * here
            if t == 0:
                starts += weight[self.opens].sum(axis=0)
                inner = ~self.opens
                past, ahead_of = before[inner], ahead[inner]
            else:
                past, ahead_of = forward[t - 1][:n], ahead
            back = ahead_of @ model.step.T
            mass = (past * back).sum(axis=1, keepdims=True)
            steps += (past / mass).T @ ahead_of * model.step
            if t:
                self.rescale(back)
                later[:n] = back
        return starts, steps, emits, float(likelihood.sum())


def summed(coded: DataFrame, per_block, size: int, classes: int) -> np.ndarray:
    """Sum over all blocks of the vector ``per_block(block)`` (``size`` numbers, a bound set by the model).

    Each task sends one vector; they are added per position after a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros(size)
        for block in coded_rows(batches, classes):
            total += per_block(block)
        places = np.flatnonzero(total)
        yield {"place": places, "value": total[places]}

    schema = pa.schema([("place", pa.int64()), ("value", pa.float64())])
    parts = coded.mapInArrow(arrow_rows(run, schema), "place long, value double")
    out = np.zeros(size)
    for r in parts.groupBy("place").agg(F.sum("value").alias("value")).collect():
        out[r.place] = r.value
    return out


def first_model(states: int, share: np.ndarray, seed: int) -> Model:
    """States that mostly stay, each with its own random tilt of the class shares."""
    rng = np.random.default_rng(seed)
    emit = share[:, None] * rng.uniform(0.5, 1.5, (len(share), states))
    step = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(step, 0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), step, emit / emit.sum(axis=0))


def train(coded: DataFrame, share: np.ndarray, classes: int, states: int, rounds: int, seed: int = 1) -> Model:
    """``rounds`` of Baum-Welch over the training documents of all blocks."""
    model = first_model(states, share, seed)
    n = classes + 1
    cuts = np.cumsum([states, states * states, n * states])
    for _ in range(rounds):
        sent = coded.sparkSession.sparkContext.broadcast((model.start, model.step, model.emit))

        def per_block(block: Coded, sent=sent) -> np.ndarray:
            learn = block.learn()
            lengths = np.diff(block.begin)
            if not learn.any():
                return np.zeros(cuts[-1])
            tokens = block.classes[np.repeat(learn, lengths)]
            starts, steps, emits, _ = Pieces(Model(*sent.value), tokens, np.concatenate([[0], np.cumsum(lengths[learn])])).expected()
            return np.concatenate([starts, steps.ravel(), emits.ravel()])

        counts = summed(coded, per_block, int(cuts[-1]), classes)
        starts, steps, emits = (x.reshape(s) for x, s in zip(np.split(counts, cuts[:-1]), (states, (states, states), (n, states))))
        # A few counts like the corpus keep every class possible in every state.
        emits = emits + 10 * share[:, None]
        starts, steps = starts + 1 / states, steps + 1 / states
        model = Model(starts / starts.sum(), steps / steps.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))
    return model


def markov_scores(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    states: int = STATES,
    classes: int = CLASSES,
    rounds: int = ROUNDS,
    block_bytes: int = 4 << 20,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words with A-Z lower-cased and an end. Documents with crc32(id as
    text) mod 10 = 0 are held out; all others are learnt from, every token of
    them. ``base_score`` is the log10 probability by smoothed token counts,
    ``score`` the log10 probability of the same tokens by the hidden Markov model.

    Null, empty and blank texts are one end token. Rows that repeat an id count
    as often as they occur; a row without id has the id ''. Without training
    documents all counts are 0 and both scores still are probabilities. An empty table gives no rows.
    """
    spark = docs.sparkSession
    blocks = text_blocks(docs, id_col, text_col, block_bytes)
    same = Window.partitionBy("key")
    counts = word_rows(blocks).select(
        "block", "key", F.sum("n").over(same).alias("total"), (F.min("block").over(same) == F.col("block")).cast("long").alias("first")
    )
    coded = landed(coded_blocks(blocks, counts, classes), "coded")

    def corpus(block: Coded) -> np.ndarray:
        tokens = block.classes[np.repeat(block.learn(), np.diff(block.begin))]
        return np.concatenate([np.bincount(tokens, minlength=classes + 1), block.new_words])

    in_class, distinct = np.split(summed(coded, corpus, 2 * (classes + 1), classes), 2)
    n_train, n_distinct = int(in_class.sum()), int(distinct.sum())
    inside = in_class + ADD * (distinct + 1)
    model = train(coded, inside / inside.sum(), classes, states, rounds)
    sent = spark.sparkContext.broadcast((model.start, model.step, model.emit, np.log10(inside)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        *parts, log_inside = sent.value
        model = Model(*parts)
        base = math.log10(n_train + ADD * (n_distinct + 1))
        for block in coded_rows(batches, classes):
            n = np.diff(block.begin)
            likelihood, _, _ = Pieces(model, block.classes, block.begin).boundaries()
            words = block.log_counts - np.add.reduceat(log_inside[block.classes], block.begin[:-1])
            yield {
                "doc_id": block.ids, "held_out": ~block.learn(), "n_tokens": n, "n_known": block.known,
                "train_tokens": np.full(len(n), n_train), "base_score": block.log_counts - n * base,
                "score": likelihood / math.log(10) + words,
            }

    schema = pa.schema([
        ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
    ])
    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return with_null_ids(coded.mapInArrow(arrow_rows(score, schema), kinds))


@query("op4_markov_scores")
def op4_markov_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markov_scores(documents(spark, sf_dir))
