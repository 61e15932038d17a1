"""The pipeline against its stages done plainly, one after another."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_decontaminate import plain_matches
from test_first import plain_quality
from test_near import plain_components
from tokenizers import Tokenizer

import corpus_pipeline
from llm import quality, token_files

SF = "/root/testdata/sf0.001"


def plain_run(documents, items):
    kept = [r for r in documents if not plain_quality(r.text)[-1]]  # no line passes its host's limit in this table
    stays = {i for i, _, _, stay in plain_components([(r.doc_id, r.text) for r in kept], 5, 80) if stay}
    kept = [r for r in kept if r.doc_id in stays]
    held = {i for i, _ in plain_matches([(r.doc_id, r.text) for r in kept], items)}
    kept = [r for r in kept if r.doc_id not in held]
    import hashlib

    by = defaultdict(list)
    for r in sorted(kept, key=lambda r: (hashlib.md5(str(r.doc_id).encode()).hexdigest(), r.doc_id)):
        by[r.source].append(r)
    # Equal weights: every source once in each frame, by name.
    nth = {s: k for k, s in enumerate(sorted(by))}
    order = [(k // 64 * len(nth) + nth[s], k % 64, r) for s, rows in by.items() for k, r in enumerate(rows)]
    plain, at, out = Tokenizer.from_file(token_files.default_tokenizer()), 0, []
    for position, (_, _, r) in enumerate(sorted(order, key=lambda x: x[:2])):
        ids = [*plain.encode(r.text, add_special_tokens=False).ids, 2]
        out.append((r.doc_id, position, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_pipeline_equals_plain_stages(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert quality.quality_rules(documents).where("depleted").count() == 0
    got = sorted((tuple(r) for r in corpus_pipeline.run(spark, SF).collect()), key=lambda r: r[1])
    assert got == plain_run(documents.collect(), items)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_take_odd_tables(spark, name, stage):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    long_text = " ".join(f"w{k}" for k in range(80))
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (2, long_text, "en", "a", 9), (2, long_text, "en", "a", 9), (None, long_text + " x", None, "b", 1)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, kinds)
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert out.count() <= len(given)
    if name == "mixing":
        assert stage(spark, spark.createDataFrame(rows, kinds), SF).count() == len(rows)


def test_last_stage_keeps_the_stored_order(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy(F.desc("doc_id"))
    docs.write.parquet(f"{tmp_path}/docs")
    out = corpus_pipeline.token_files(spark, spark.read.parquet(f"{tmp_path}/docs"), SF).orderBy("position")
    ids = [r.doc_id for r in out.collect()]
    assert ids == sorted(ids, reverse=True)
