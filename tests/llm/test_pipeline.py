"""The pipeline's stages on small and odd tables, held against the operators one by one."""

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallywork.llm import queries


def test_stages_and_their_order():
    assert len(corpus_pipeline.STAGES) in (4, 5) and corpus_pipeline.ORACLE_SQL is None and "pipeline" in queries.queries()


def test_run_follows_the_stages(spark, small, docs):
    from tokenizers import Tokenizer

    at, seen = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = spark.createDataFrame(stage(spark, at, small).toPandas(), docs.schema)
        assert at.columns == docs.columns
        seen.append(at.count())
    assert docs.count() >= seen[0] >= seen[1] == seen[2] > 0
    t = Tokenizer.from_file(queries.tokenizer_path())
    want = collections.Counter()
    for r in at.collect():
        want[r["doc_id"], len(t.encode(r["text"], add_special_tokens=False).ids) + 1] += len(t.encode(r["text"], add_special_tokens=False).ids) + 1
    got = collections.Counter()
    for r in queries.pipeline(spark, small).collect():
        got[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert got == want


def test_near_copies_leave_one(spark, small):
    base = " ".join(f"word{i}" for i in range(300))
    rows = [(k, base + (f" tail{k}" if k else ""), "en", "a", 1) for k in range(6)] + [(9, " ".join(f"other{i}" for i in range(300)), "en", "b", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, small).collect()}
    assert 0 in kept and 9 in kept and len(kept) <= 3


@pytest.mark.parametrize("which", [0, 1, 2, 3, 4])
def test_each_stage_takes_odd_and_empty_tables(spark, small, odd_docs, empty_docs, which):
    _, stage = corpus_pipeline.STAGES[which]
    out = stage(spark, odd_docs, small)
    assert out.count() > 0 and stage(spark, empty_docs, small).count() == 0
    if which < 4:
        assert out.columns == odd_docs.columns
    else:
        assert out.agg(F.sum("length")).first()[0] == out.agg(F.sum("length")).first()[0] > 0


def test_crc_is_of_little_endian_ids(spark, small, empty_docs):
    df = spark.createDataFrame([(1, "a b", "en", "a", 3)], empty_docs.schema)
    r = corpus_pipeline.token_packing(spark, df, small).first()
    from tokenizers import Tokenizer

    ids = [*Tokenizer.from_file(queries.tokenizer_path()).encode("a b", add_special_tokens=False).ids, 1]
    assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
