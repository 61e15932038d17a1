"""Mixing, sharding, token files and quality rules against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from pathlib import Path

import duckdb
import numpy as np
import pytest
from conftest import plan_of
from oracle import compare, connect
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm import hilbert, mixing, quality, token_files
from llm.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

ODD = [
    (1, None, None), (2, "", "a"), (3, " \n\t ", "a"), (4, "one", "b"), (4, "one", "b"), (5, "a  b\n\n c   d<|endoftext|>\r\n", "b"),
    (6, "x y z " * 4000, "hot"), (7, "é" * 3000 + " # $", "hot"), (8, "a b c\na b c\n a  B c\n", None), (-9, "same", "hot"), (10, "\x1c \x85 q", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns with names the operators use."""
    rows = [(i, t, s, i, "x", 3, "y") for i, t, s in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, shard int, slot string, block int, line string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_query_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), SQL[name]) == ""


def plain_quality(text):
    text = text or ""
    words = WORD.findall(text)
    at = defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i : i + 3])].append(i)
    covered = {j for places in at.values() if len(places) > 1 for i in places for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, r = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n


def test_base_rules(spark, docs, odd):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for df in (docs, odd, docs.limit(0)):
        ours = Counter(tuple(r) for r in quality.quality_rules(df).select(names).collect())
        assert ours == Counter((r.doc_id, *plain_quality(r.text)) for r in df.collect())


def plain_verdicts(rows, min_documents, share, least_left=0.3):
    """(doc_id, kept_words, depleted, kept) of each row: lines counted by the different texts of a host that hold them."""
    lines_of = []
    for r in rows:
        lines = [re.sub(r"[\x20\x09\x0B-\x0D]+", " ", line.lower()).strip(" ") for line in (r.text or "").split("\n")]
        lines_of.append([line for line in lines if line])
    holders, in_host = defaultdict(set), defaultdict(set)
    for r, lines in zip(rows, lines_of):
        for line in lines:
            holders[r.source or "", line].add(r.text)
            in_host[r.source or ""].add(r.text)
    gone = {k for k, texts in holders.items() if len(texts) > min_documents and len(texts) > len(in_host[k[0]]) * share}
    out = Counter()
    for r, lines in zip(rows, lines_of):
        sizes = [(line.count(" ") + 1, (r.source or "", line) in gone) for line in lines]
        total, left = sum(n for n, _ in sizes), sum(n for n, frequent in sizes if not frequent)
        part = left / total if total else 1.0
        n_words, *_, failed = plain_quality(r.text)
        out[r.doc_id, int(part * n_words + 0.5), part < least_left, not failed and part >= least_left] += 1
    return out


def test_verdicts_equal_brute_force(spark, docs, odd):
    """op8's verdict on whole tables, with its own limits and with tight ones that deplete documents."""
    depleted = 0
    for df, least, share in ((docs, 20, 0.002), (docs, 1, 0.01), (odd, 20, 0.002), (odd, 0, 0.1), (odd.limit(0), 20, 0.002)):
        got = quality.quality_rules(df, min_documents=least, share=share).select("doc_id", "kept_words", "depleted", "kept").collect()
        assert Counter(tuple(r) for r in got) == plain_verdicts(df.collect(), least, share)
        depleted += sum(r.depleted for r in got)
    assert depleted


def test_frequent_lines_deplete(spark):
    """Counted by sketch, a line in many different documents goes; the lines of many copies stay."""
    body = "\n".join(f"w{k} and w{k + 1}" for k in range(12))
    rows = [(i, f"Share  THIS now please\n{i} only here", "h") for i in range(30)]
    rows += [(100 + i, body, "h") for i in range(30)] + [(200 + i, body + f"\nending {i}", "h") for i in range(30)]
    rows += [(300, "share this now please\nonly one here", "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    lines = quality.document_lines(df)
    assert quality.frequent_lines(lines, min_documents=20, every_text=False).select("documents").collect() == [(30,)]
    got = {r.doc_id: r.depleted for r in quality.quality_rules(df, min_words=1, least_left=0.5, every_text=False).collect()}
    assert {i for i, gone in got.items() if gone} == set(range(30))


def test_lines_count_every_text(spark, tmp_path):
    """Documents made of shared lines only count in full for op8, and so do a line alone and a footer; exact copies count once."""
    rng = random.Random(1)
    stock = [f"stock line {k}" for k in range(30)]
    rows = [(i, "\n".join(rng.sample(stock, 10)), "stock") for i in range(300)]
    footer = "\n".join(f"footer {k} of this page" for k in range(6))
    rows += [(1000 + i, f"{footer}\nown {i}", "footer") for i in range(60)]
    rows += [(2000 + i, "Only  line" + " " * i, "alone") for i in range(30)]
    rows += [(3000 + i, f"{footer}\nthe end", "copies") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    texts = defaultdict(set)
    for _, text, host in rows:
        for line in text.split("\n"):
            texts[host, " ".join(line.lower().split())].add(text)
    found = quality.frequent_lines(quality.document_lines(df))
    got = sorted((r.host, r.documents) for r in found.collect())
    assert got == sorted((host, len(t)) for (host, _), t in texts.items() if len(t) > 20)
    assert Counter(host for host, _ in got) == {"stock": 30, "footer": 6, "alone": 1}
    df.write.parquet(f"{tmp_path}/documents.parquet")
    gone = {r.doc_id for r in QUERIES["op8_line_frequency"](spark, str(tmp_path)).where("depleted").collect()}
    assert gone == {i for i, _, host in rows if host != "copies"}


def test_host_documents_are_counted_without_their_lines(spark, odd, monkeypatch):
    """Lines are made for their counts and for the verdicts; the documents of a host are the same as counted from lines."""
    strange = [(i, t, "a") for i, t in enumerate(["\x1c", "\x85", "\u2003", "\n \t\x0b\x0c\r", "\n\nİ\n", "\x00", "#", " x", "İ", None, ""])]
    df = odd.select("doc_id", "text", "source").union(spark.createDataFrame(strange, "doc_id long, text string, source string"))
    for c in ("text_key", "doc_id"):
        kept = [f(df).select("host", c).distinct().collect() for f in (quality.document_lines, quality.documents_with_lines)]
        assert sorted(kept[0]) == sorted(kept[1]) and len(kept[0]) > 8
    # Two times lines: one Generate for the counts, one for the verdicts.
    assert plan_of(quality.quality_rules(df)).split("Initial Plan")[0].count("Generate explode") == 2
    for every_text in (True, False):
        given = quality.quality_rules(df, min_documents=1, share=0.2, every_text=every_text)
        with monkeypatch.context() as patch:
            patch.setattr(quality, "documents_with_lines", quality.document_lines)
            from_lines = quality.quality_rules(df, min_documents=1, share=0.2, every_text=every_text)
        assert sorted(map(repr, given.collect())) == sorted(map(repr, from_lines.collect()))


def test_pfair_frame():
    weights = {"a": 0.5, "b": 0.3, "c": 0.17, "d": 0.03}
    ticks = mixing.whole_ticks(weights, 100)
    assert ticks == {"a": 50, "b": 30, "c": 17, "d": 3}
    done = Counter()
    for source, nth, release, deadline, slot in mixing.frame_schedule(ticks):
        assert release <= slot < deadline and nth == done[source]
        done[source] += 1
        for s, n in ticks.items():
            assert abs(done[s] - (slot + 1) * n / 100) < 1
    assert done == ticks


def test_whole_ticks_lifts_small_sources():
    ticks = mixing.whole_ticks({"big": 1e6, "x": 1, "y": 1}, 10)
    assert ticks == {"big": 8, "x": 1, "y": 1}
    with pytest.raises(ValueError):
        mixing.whole_ticks({"a": 0.0})


def test_mix(spark, docs, odd):
    out = mixing.mix_sources(docs, block_rows=2, ticks=40).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    by = defaultdict(list)
    for r in sorted(out, key=lambda r: (r.slot, r.position_in_block)):
        assert r.release <= r.slot < r.deadline
        by[r.source].append(r.doc_id)
    for ids in by.values():
        assert ids == sorted(ids, key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))
    strange = mixing.mix_sources(odd, weights={"": 1, "a": 1, "b": 5, "hot": 2, "c": 1}, ticks=10)
    assert strange.count() == len(ODD) and strange.select("slot").distinct().count() == 5
    assert mixing.mix_sources(odd.limit(0)).count() == 0
    with pytest.raises(Exception, match="no weight for source"):
        mixing.mix_sources(odd, weights={"a": 1}).collect()


@pytest.mark.parametrize("weights", [
    None, dict.fromkeys("abcdefg", 1.0), dict.fromkeys("abcdefg", 1 / 3), {"a": 0.9999, "b": 0.0001},
    {"a": 3, "b": 2, "c": 2}, {"a": 0.61803398875, "b": 0.2718281828, "c": 0.11013782845},
])
def test_mix_keeps_given_weights(spark, weights):
    """Over many frames no source is a block off its exact share, however the weights divide."""
    names = list(weights or "abc")
    rows = [(i, names[i % len(names)] if i < 3000 else "a") for i in range(9000 if len(names) == 2 else 6000)]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string"), weights, block_rows=1).collect()
    assert len(out) == len(rows) == len({r.slot for r in out})
    given = {s: Fraction(str(w)) for s, w in (weights or dict.fromkeys(names, 1)).items()}
    total = sum(given.values())
    for r in out:
        w = given[r.source] / total
        assert r.release == r.block // w and r.deadline == -(-(r.block + 1) // w) and r.release <= r.slot < r.deadline
        assert abs(r.block + 1 - (r.slot + 1) * w) < 1 and abs(r.block - r.slot * w) < 1


def test_mix_takes_any_number_of_sources(spark):
    out = mixing.mix_sources(spark.range(2500).selectExpr("id AS doc_id", "concat('s', id % 1250) AS source"), block_rows=1).collect()
    assert sorted(r.slot for r in out) == list(range(2500))


def test_query_mixes_by_its_schedule(spark, monkeypatch, tmp_path):
    """Equal weights too get their slots from releases and deadlines, on the driver or by a task; places are those of the SQL."""
    asked = []
    schedule, long_schedule = mixing.frame_schedule, mixing.long_schedule
    monkeypatch.setattr(mixing, "frame_schedule", lambda blocks: asked.append("frame") or schedule(blocks))
    monkeypatch.setattr(mixing, "long_schedule", lambda *args: asked.append("long") or long_schedule(*args))
    rows = [(i, f"s{i % 7 if i < 700 else 3}") for i in range(1500)] + [(None, None), (1500, "")]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    columns = ["doc_id", "mix_source", "block", "release", "deadline", "slot", "position_in_block"]
    got = sorted(map(repr, map(tuple, QUERIES["op6_pfair_mix"](spark, str(tmp_path)).collect())))
    far = mixing.mix_sources(df, ticks=3).select(columns)
    assert sorted(map(repr, map(tuple, far.collect()))) == got and asked == ["frame", "long"]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(repr, db.execute(mixing.MIX_SQL).fetchall())) == got


def test_hilbert_curve_is_a_walk():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        index = hilbert.hilbert_index(grid, bits)
        assert sorted(index) == list(range(1 << (bits * dims)))
        walk = grid[np.argsort(index)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_shards(spark, docs, odd):
    cells = lambda: {"source": hilbert.category_cell(F.col("source"), 5), "size": hilbert.size_cell(F.octet_length("text"), 5)}
    for df, shards in ((docs, 7), (odd, 40), (docs, 1)):
        rows = hilbert.hilbert_shards(df.drop("n_chars"), cells(), shards=shards).collect()
        assert len(rows) == df.count()
        by = defaultdict(list)
        for r in rows:
            by[r.shard].append(r)
        counts = [len(by[s]) for s in range(shards)]
        assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
        last = (-1, 0)
        for s in range(shards):
            ordered = sorted(by[s], key=lambda r: r.slot)
            assert [r.slot for r in ordered] == list(range(len(ordered)))
            for r in ordered:
                assert (r.curve, r.doc_id) >= last
                last = (r.curve, r.doc_id)
    assert hilbert.hilbert_shards(odd.limit(0), cells()).count() == 0
    ranges = hilbert.shard_ranges(hilbert.hilbert_shards(docs, cells(), shards=7)).collect()
    assert sum(r.rows for r in ranges) == docs.count() and all(r.least_cell_size <= r.greatest_cell_size for r in ranges)


def test_op10_contract(spark, docs):
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in QUERIES["op10_hilbert_shards"](spark, SF).collect():
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id]) + 16, zlib.crc32(texts[r.doc_id]), "rows", None)


@pytest.mark.parametrize("bits,special_ids", [(16, True), (32, False)])
def test_token_files_round_trip(spark, docs, odd, bits, special_ids, tmp_path):
    plain = Tokenizer.from_file(token_files.default_tokenizer())
    plain.encode_special_tokens = not special_ids
    for k, df in enumerate((docs, odd, odd.limit(0))):
        out = f"{tmp_path}/{bits}-{k}"
        token_files.write_token_files(df, out, token_files.default_tokenizer(), id_bits=bits, special_ids=special_ids)
        got = sorted(token_files.read_token_files(spark, out).collect(), key=lambda r: r.position)
        rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda r: r[0])
        at = 0
        for r, (doc_id, text) in zip(got, rows, strict=True):
            ids = [*plain.encode(text, add_special_tokens=False).ids, 2]
            assert (r.doc_id, r.start, r.n_tokens) == (doc_id, at, len(ids))
            assert np.frombuffer(r.ids, "<u2" if bits == 16 else "<u4").tolist() == ids
            at += len(ids)
        sizes = sum(p.stat().st_size for p in Path(out).glob("*.bin"))
        assert sizes == at * bits // 8


def test_token_files_are_read_by_one_python_worker_a_task(spark, tmp_path):
    """Digests are expressions, for ids of either width; texts go to Python in small batches, whose limit holds no longer than that."""
    key, rows = "spark.sql.execution.arrow.maxRecordsPerBatch", [(i, "one two " * (i % 5)) for i in range(2500)]
    before, seen = spark.conf.get(key), spark.sparkContext.accumulator(0)
    rest = token_files.texts_in

    def watched(batch, most):
        seen.add(1)
        return rest(batch, most)

    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    plain = Tokenizer.from_file(token_files.default_tokenizer())
    coded = {t: [*plain.encode(t, add_special_tokens=False).ids, 2] for t in {t for _, t in rows}}
    expected = {i: zlib.crc32(np.array(coded[t], "<u4").tobytes()) for i, t in rows}
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(token_files, "texts_in", watched)
        token_files.write_token_files(docs, f"{tmp_path}/16", token_files.default_tokenizer())
    assert seen.value >= 3 and spark.conf.get(key) == before
    token_files.write_token_files(docs, f"{tmp_path}/32", token_files.default_tokenizer(), id_bits=32)
    for out, bits in (("16", None), ("16", 32), ("32", None)):
        read = token_files.read_token_files(spark, f"{tmp_path}/{out}", bits)
        crc = read.select("doc_id", token_files.ids_crc32("ids", "id_bits"))
        assert "EvalPython" not in plan_of(crc) and dict(map(tuple, crc.collect())) == expected
        assert {len(r.ids) * 8 // r.n_tokens for r in read.collect()} == {bits or int(out)}
    with pytest.raises(Exception, match="don't fit"):
        token_files.read_token_files(spark, f"{tmp_path}/32", 16).collect()


def test_white_space_at_the_edges_of_pieces():
    """The vocabulary joins a line feed with U+00A0: such pieces must not meet the feed between pieces."""
    plain = Tokenizer.from_file(token_files.default_tokenizer())
    space = ["\xa0", "\xa0\xa0", " \xa0", "\xa0 ", "  ", "\t", "\x85", "\x1c", "\u2003", "\u3000\xa0", "\n\xa0", "\r\n"]
    texts = [t for s in space for t in (s, f"{s}Hello", f"{s}{s}Hello é", f"é Hello{s}", f"é{s}Hello{s} you", f"Hello {s}you")]
    coded = token_files.Encoder(token_files.default_tokenizer(), "<u4").encode(texts)
    for text, ids in zip(texts, coded, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_special_tokens_as_the_library_has_them(spark, tmp_path):
    """op5's ids are those of a tokenizer with its default settings, also where a text holds a special token's string."""
    end = "<|endoftext|>"
    texts = [end, f"a{end}b", f"one  {end} two\n{end}{end}\xa0é", f"{end[:-1]} >", f" {end}\n", "plain", f"<|{end}|>"]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plain, at, expected = Tokenizer.from_file(token_files.default_tokenizer()), 0, []
    for i, text in rows:
        ids = [*plain.encode(text, add_special_tokens=False).ids, 2]
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), i))
        at += len(ids)
    assert plain.encode(end, add_special_tokens=False).ids == [50256]
    got = QUERIES["op5_token_files"](spark, str(tmp_path)).orderBy("position").collect()
    assert [tuple(r) for r in got] == expected


def test_op5_checksums(spark, docs):
    plain = Tokenizer.from_file(token_files.default_tokenizer())
    got = {r.doc_id: r.ids_crc32 for r in QUERIES["op5_token_files"](spark, SF).collect()}
    for r in docs.collect():
        ids = [*plain.encode(r.text, add_special_tokens=False).ids, 2]
        assert got[r.doc_id] == zlib.crc32(np.array(ids, "<u4").tobytes())
