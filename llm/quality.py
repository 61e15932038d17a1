"""Quality rules: word counts and repetition per document, line frequency across documents.

Only DataFrame expressions: no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import SPACE_PATTERN, documents, landed, long_id, with_null_ids
from .registry import query

SYMBOLS = "#*$%&|<>"


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_PATTERN), lambda w: w != "")


def window_keys(words: Column) -> Column:
    """64-bit hash of every 3 consecutive words (null past the last ones)."""
    later = [F.slice(words, F.lit(k), F.greatest(F.size(words), F.lit(1))) for k in (2, 3)]
    pairs = F.zip_with(words, later[0], lambda a, b: F.xxhash64(a, b))
    return F.slice(F.zip_with(pairs, later[1], lambda ab, c: F.xxhash64(ab, c)), F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))


def repeated_words(windows: Column) -> Column:
    """Number of words that lie in a 3-word window found at least twice in the text.

    Sorted by (hash, place), equal windows are neighbours; texts whose windows
    all differ are not sorted at all.
    """
    n = F.size(windows)
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # The lambda over one element names the sorted array, which is then sorted once.
    doubles = F.transform(
        F.array(placed),
        lambda p: F.flatten(
            F.zip_with(
                p, F.slice(p, F.lit(2), F.greatest(n, F.lit(1))),
                lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])).otherwise(F.array().cast("array<int>")),
            )
        ),
    )
    places = F.flatten(doubles)
    covered = F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(i, i + 1, i + 2))))
    return F.when(F.size(F.array_distinct(windows)) == n, 0).otherwise(F.size(covered))


def line_list(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def normal_lines(text: Column) -> Column:
    """Lines in lower case, runs of white space as one blank, ends trimmed; blank lines are ''."""
    blanks = F.regexp_replace(F.lower(text), r"[\x20\x09\x0B-\x0D]+", " ")
    return F.transform(F.split(blanks, "\n", -1), lambda x: F.trim(x))


def base_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeat_percent: int = 50,
    carry: Sequence[Column] = (),
) -> DataFrame:
    """doc_id, text_key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed; then ``carry``, named columns of ``docs``.

    ``text_key`` is a hash of the text. A null text has no words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(long_id(id_col), text.alias("text"), *carry)
    kept = rows.columns[2:]
    # Two steps, so that words and windows are made once and not wherever they are used.
    split = rows.select(
        "doc_id", F.xxhash64("text").alias("text_key"), word_list(F.col("text")).alias("words"),
        F.length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        line_list(F.col("text")).alias("lines"), *kept,
    )
    windowed = split.select("*", window_keys(F.col("words")).alias("windows"))
    counted = windowed.select(
        "doc_id", "text_key", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("windows")).cast("long").alias("n_repeat_words"), *kept,
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return counted.select(*counted.columns[:7], failed.alias("base_failed"), *kept)


def document_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per line with a word: doc_id, text_key, host, line (hash of the normalised line), words, sketch.

    Lines are compared as :func:`normal_lines` has them.
    ``sketch`` stands for the document when documents are counted: the least
    hash among its other lines, which copies and most near copies share.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(long_id(id_col), text.alias("text"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"))
    lines = F.filter(normal_lines(F.col("text")), lambda x: x != "")

    def line_row(line: Column) -> Column:
        return F.struct(F.xxhash64(line).alias("line"), (F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1).alias("words"))

    hashed = rows.select("doc_id", "host", F.xxhash64("text").alias("text_key"), F.transform(lines, line_row).alias("lines"))
    least = F.slice(F.array_sort(F.array_distinct(F.transform("lines", lambda x: x["line"]))), 1, 2)
    sketched = hashed.withColumn("least", least)
    each = sketched.select("doc_id", "text_key", "host", "least", F.explode("lines").alias("l"))
    first, second = F.get("least", F.lit(0)), F.get("least", F.lit(1))
    return each.select(
        "doc_id", "text_key", "host", F.col("l.line").alias("line"), F.col("l.words").cast("long").alias("words"),
        F.when(first == F.col("l.line"), F.coalesce(second, first)).otherwise(first).alias("sketch"),
    )


def documents_with_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per row that holds a line with a word: doc_id, text_key, host as :func:`document_lines` has them, without taking lines apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(long_id(id_col), text.alias("text"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"))
    return rows.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("doc_id", F.xxhash64("text").alias("text_key"), "host")


def frequent_lines(
    lines: DataFrame, min_documents: int = 20, share: float = 0.002, every_text: bool = True, documents: DataFrame | None = None,
) -> DataFrame:
    """(host, line) of the lines that more documents of a host hold than its limit allows.

    The limit is ``share`` of the host's documents, at least ``min_documents``.
    Each different text is a document, for the lines as for the limit; only exact copies count
    once. Without ``every_text`` documents are counted by sketch, which takes many texts made
    of the same lines for copies of a few.
    (host, line, text or sketch) is made distinct before the shuffle, so a line or
    a host in a third of all rows arrives combined. ``documents`` (:func:`documents_with_lines` of the
    same rows) spares making all lines a second time to count the hosts' documents.
    """
    counted, member = ("text_key", "text_key") if every_text else ("sketch", "doc_id")
    seen = lines.groupBy("host", "line", counted).agg(F.lit(1).alias("_one"))
    counts = seen.groupBy("host", "line").agg(F.count(F.lit(1)).alias("documents"))
    hosts = (lines if documents is None else documents).groupBy("host", member).agg(F.lit(1).alias("_one")).groupBy("host").agg(F.count(F.lit(1)).alias("in_host"))
    over = counts.where(F.col("documents") > min_documents).join(hosts, "host")
    return over.where(F.col("documents") > F.col("in_host") * share).select("host", "line", "documents")


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    min_documents: int = 20,
    share: float = 0.002,
    least_left: float = 0.3,
    every_text: bool = True,
) -> DataFrame:
    """One row per row of ``docs``: the base counts, base_failed, kept_words, depleted and kept.

    Lines above their host's limit (:func:`frequent_lines`, also for ``every_text``) count as removed; a
    document is depleted if less than ``least_left`` of its words remain.

    Null and empty texts have no words and fail; a null host is the host ''.
    Equal rows get equal verdicts; rows that share an id but not the text are
    judged separately, rows without id are one document when lines are counted. An empty table gives no rows. Only the four named columns are read.
    """
    base = base_rules(docs, id_col, text_col, min_words, max_repeat_percent)
    lines = document_lines(docs, id_col, text_col, host_col)
    holders = documents_with_lines(docs, id_col, text_col, host_col)
    frequent = frequent_lines(lines, min_documents, share, every_text, holders).select("host", "line", F.lit(True).alias("_frequent"))
    left = (
        lines.join(frequent, ["host", "line"], "left")
        .groupBy("doc_id", "text_key")
        .agg(
            F.sum("words").alias("_words"),
            F.sum(F.when(F.col("_frequent"), 0).otherwise(F.col("words"))).alias("_left"),
        )
    )
    judged = base.join(left, ["doc_id", "text_key"], "left")
    # Repeated rows double both sums.
    share_left = F.coalesce(F.try_divide("_left", "_words"), F.lit(1.0))
    depleted = share_left < least_left
    return with_null_ids(judged.select(
        "doc_id", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.round(share_left * F.col("n_words")).cast("long").alias("kept_words"), depleted.alias("depleted"),
        (~F.col("base_failed") & ~depleted).alias("kept"),
    ))


def words_in(lines: Column) -> Column:
    """Words of normalised lines, none of them blank."""
    each = F.transform(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1)
    return F.aggregate(each, F.lit(0).cast("long"), lambda total, n: total + n)


def lines_by_host(docs: DataFrame, id_col: str, text_col: str, host_col: str, **limits) -> DataFrame:
    """(host, frequent): the lines of :func:`frequent_lines` as one list per host, at most as many as ``share`` allows.

    That is the mean number of lines of a document of the host over ``share``, however large the host.
    """
    lines, holders = (f(docs, id_col, text_col, host_col) for f in (document_lines, documents_with_lines))
    return landed(frequent_lines(lines, documents=holders, **limits).groupBy("host").agg(F.collect_set("line").alias("frequent")), "frequent-lines")


def cleaned(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """``rows`` (row, text, host) as row, text, words, left: the host's frequent lines go from the text, ``words`` of all lines and those ``left``.

    Other lines stay as they are, blank ones too; a text without such a line doesn't change. No text is shuffled while Catalyst
    can broadcast the hosts' lists, which it decides by their size.
    """
    listed = rows.join(frequent, "host", "left").withColumn("lines", normal_lines(F.col("text")))
    hashes = F.transform("lines", lambda x: F.when(x != "", F.xxhash64(x)))
    found = listed.withColumn("found", F.array_intersect(hashes, F.coalesce("frequent", F.array().cast("array<long>"))))
    stays = F.filter(
        F.arrays_zip(F.split("text", "\n", -1).alias("line"), F.col("lines").alias("normal")),
        lambda x: (x["normal"] == "") | ~F.array_contains("found", F.xxhash64(x["normal"])),
    )
    stay = found.withColumn("stay", F.when(F.size("found") > 0, stays))
    before = words_in(F.filter("lines", lambda x: x != ""))
    after = words_in(F.filter(F.transform("stay", lambda x: x["normal"]), lambda x: x != ""))
    shorter = F.array_join(F.transform("stay", lambda x: x["line"]), "\n")
    return stay.select("row", F.coalesce(shorter, "text").alias("text"), before.alias("words"), F.coalesce(after, before).alias("left"))


def packed_rows(docs: DataFrame, text_col: str, host_col: str) -> list[Column]:
    """row (all columns), text and host of ``docs``, whatever its columns are called."""
    host = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    return [F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), host.alias("host")]


def unpacked(df: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """The columns of ``docs`` from row and text; a null text stays null."""
    given = F.col("row")[text_col]
    text = F.when(given.isNotNull(), F.col("text")).alias(text_col)
    return df.select(*[text if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def without_frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """``docs`` with the lines above their host's limit (``limits`` of :func:`frequent_lines`) taken out of the texts.

    Rows and the other columns stay. Null and empty texts have no lines; a null host is the host ''.
    """
    frequent = lines_by_host(docs, id_col, text_col, host_col, **limits)
    return unpacked(cleaned(docs.select(*packed_rows(docs, text_col, host_col)), frequent), docs, text_col)


def without_rejected(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    least_left: float = 0.3,
    remove_lines: bool = False,
    **limits,
) -> DataFrame:
    """``docs`` without the rows that :func:`quality_rules` rejects; with ``remove_lines`` also without lines above their host's limit.

    The base rules judge each text as it is given. Only lines are looked at across documents (``limits`` of
    :func:`frequent_lines`), so a row is judged where it is read.
    """
    frequent = lines_by_host(docs, id_col, text_col, host_col, **limits)
    row, text, host = packed_rows(docs, text_col, host_col)
    ruled = base_rules(docs, id_col, text_col, min_words, max_repeat_percent, [row, text.alias("given"), host])
    # The numbers keep the filters above: pushed down, they would make words, windows and lines anew wherever they use them.
    ruled = ruled.withColumn("number", F.monotonically_increasing_id()).where("NOT base_failed AND number >= 0")
    judged = cleaned(ruled.select("row", F.col("given").alias("text"), "host"), frequent).withColumn("number", F.monotonically_increasing_id())
    left = judged.where((F.coalesce(F.try_divide("left", "words"), F.lit(1.0)) >= least_left) & (F.col("number") >= 0))
    return unpacked(left if remove_lines else left.withColumn("text", F.col("row")[text_col]), docs, text_col)


@query("op8_line_frequency")
def op8_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).drop("text_key")
