"""Rows that share an id but not the text, and lines above their host's limit."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from llm import decontaminate, fuzzy_lines, near_duplicates, quality

KINDS = "doc_id long, text string, source string, lang string, n_chars long, _id long, text_key long"
A = " ".join(f"a{i}" for i in range(60))
B = " ".join(f"b{i}" for i in range(60))
ITEM = " ".join(f"q{i}" for i in range(30))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", 1, 2, 3) for i, t, s in rows], KINDS)


def left(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_duplicates_go_by_id_and_text(spark):
    docs = frame(spark, [(3, A, "s"), (7, A, "s"), (7, B, "s"), (7, None, "s"), (None, B, "s"), (9, B, "s"), (9, "", "s"), (9, A + " x", "s")])
    out = near_duplicates.without_near_duplicates(docs)
    assert left(out) == Counter([(3, A), (7, None), (None, B), (9, "")]) and out.columns == docs.columns


def test_benchmark_goes_by_id_and_text(spark):
    benchmark = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    docs = frame(spark, [(3, f"{A} {ITEM} {A}", "s"), (3, A, "s"), (None, ITEM, "s"), (None, B, "s"), (4, None, "s")])
    out = decontaminate.without_benchmark(docs, benchmark)
    assert left(out) == Counter([(3, A), (None, B), (4, None)]) and out.columns == docs.columns


def test_lines_go_by_id_and_text(spark):
    docs = frame(spark, [(1, f"{A}\n{B}", "s"), (5, f"own\n{B}", "s"), (5, f"{ITEM}\nother line", "s"), (None, "first of all", "s")])
    out = fuzzy_lines.without_repeated_lines(docs)
    assert left(out) == Counter([(1, f"{A}\n{B}"), (5, "own"), (5, f"{ITEM}\nother line"), (None, "first of all")])


def plain_removal(rows, min_documents, share, min_words=50, least_left=0.3):
    """(id, text) after both rules; lines in ``rows``, all rows counted."""
    normal = lambda x: " ".join(x.replace("\n", " ").lower().split())  # noqa: E731  ASCII rows only
    texts, holders = {}, {}
    for _, t, s in rows:
        texts.setdefault(s or "", set()).add(t or "")
        for x in (t or "").split("\n"):
            if normal(x):
                holders.setdefault((s or "", normal(x)), set()).add(t or "")
    over = {k for k, v in holders.items() if len(v) > min_documents and len(v) > share * len(texts[k[0]])}
    out = []
    for i, t, s in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if (s or "", normal(x)) not in over]
        words, rest = (sum(len(normal(x).split()) for x in some) for some in (lines, stay))
        if words >= min_words and rest >= least_left * words:
            out.append((i, "\n".join(stay)))
    return Counter(out)


@pytest.fixture(scope="module")
def hosted():
    """A host whose pages share a menu and a footer, some with nothing else; another host with the same lines, once."""
    menu, footer = " ".join(f"menu{i}" for i in range(30)), "  Footer   LINE " + " ".join(f"f{i}" for i in range(30))
    rows = []
    for i in range(40):
        own = " ".join(f"own{i}x{k}" for k in range(60))
        rows.append((i, f"{menu}\n\n{own}\n{footer.lower() if i % 2 else footer}", "big"))
    rows += [(100 + i, f"{menu}\n{footer}\nword{i}", "big") for i in range(10)]  # depleted
    rows += [(200, f"{menu}\n{footer}", "small"), (201, f"{menu}\n{footer}", None), (202, None, "big"), (203, "", "big"), (None, rows[3][1], "big"), (3, rows[4][1], "big")]
    return rows


@pytest.mark.parametrize("remove", [True, False])
def test_frequent_lines_are_removed(spark, hosted, remove):
    docs = frame(spark, hosted)
    out = quality.without_rejected(docs, remove_lines=remove)
    want = plain_removal(hosted, 20, 0.002)
    assert out.columns == docs.columns
    if remove:
        assert left(out) == want
        texts = [r.text for r in out.where("source = 'big'").collect()]
        assert texts and not any("menu" in t or "ooter" in t for t in texts) and all(t.startswith("\nown") for t in texts)
    else:
        given = Counter((i, t) for i, t, _ in hosted)
        assert Counter(i for i, _ in left(out).elements()) == Counter(i for i, _ in want.elements()) and not left(out) - given


def test_removal_keeps_what_the_rules_keep(spark, hosted):
    """The verdicts of the filter are those of the query, on planted and on given documents."""
    for docs in (frame(spark, hosted), spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        kept = quality.quality_rules(docs).where("kept").groupBy("doc_id").count()
        out = quality.without_rejected(docs).groupBy("doc_id").count()
        assert Counter(map(tuple, kept.collect())) == Counter(map(tuple, out.collect()))
    assert quality.without_rejected(docs.limit(0), remove_lines=True).count() == 0


def test_pipeline_stage_removes_lines_and_depleted_documents(spark, hosted):
    import corpus_pipeline

    docs = frame(spark, hosted).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
    out = corpus_pipeline.quality_rules(spark, docs, "")
    assert left(out) == plain_removal(hosted, 20, 0.002) and out.columns == docs.columns
    assert out.where("n_chars <> length(text)").count() == 0
