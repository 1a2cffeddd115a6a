"""Columns that can't be null or have names of our own, and counts beyond 32 bits."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenry.llm import blocks as B
from lumenry.llm import perplexity, quality_rules
from lumenry.llm.substring_dedup import substring_dedup

TEXT = " ".join(f"some plain words of a text number {k} that is long enough to stay" for k in range(4))


def test_carried_columns_that_are_not_nullable(spark):
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.lit(TEXT).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(5).cast("long").alias("n_chars"), F.array(F.lit(1)).alias("tags"))
    assert not docs.schema["tags"].nullable
    rows = substring_dedup(docs, carry=docs.columns).collect()
    assert sorted(r.row.tags[0] for r in rows) == [1, 1, 1] and sorted(r.n_removed for r in rows)[0] == 0
    assert [r.doc_id for r in corpus_pipeline.substrings(spark, docs, "").collect()] == [0]


@pytest.mark.parametrize("held", [256, 0])
def test_clashing_names_stay(spark, monkeypatch, held):
    monkeypatch.setattr(quality_rules, "HELD", held)
    rows = [(k, f"{TEXT} {k}", "en", "t", "l", "p", "q", "r") for k in range(5)] + [(9, "short", "en", "t", "l", "p", "q", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _text string, _lang_of string, _lang string, _profile string, row string")
    docs = docs.withColumn("fixed", F.lit(7))
    out = quality_rules.keep_good(docs, quality_rules.Limits(repeat_percent=100))
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [(*r, 7) for r in rows[:5]]


def test_counts_of_any_size():
    values = np.array([[0, 1, 253, 254, 255, 256, 2**31, 2**32 - 1, 2**32, 2**33 + 5, 0, 2**62]])
    assert (B.dense(B.sparse(values), 1) == values).all()
    assert (B.dense(B.sparse(np.zeros((2, 3), np.int64)), 2) == 0).all()


def test_shared_counts_beyond_32_bits():
    """Three blocks have a key 10^9 times each: all get the sum, one is the owner."""
    keys = [np.array([3, 7], np.uint64), np.array([7], np.uint64), np.array([7, 9], np.uint64)]
    sent = [np.array([[1, 10**9]]), np.array([[10**9]]), np.array([[10**9, 0]])]
    got = [B.dense(x) for x in perplexity._shared(keys, sent, 0)]
    assert [x.tolist() for x in (got[0] >> 1, got[1] >> 1, got[2] >> 1)] == [[[1, 3 * 10**9]], [[3 * 10**9]], [[3 * 10**9, 0]]]
    assert sum(int(x[0, k] & 1) for x, k in ((got[0], 1), (got[1], 0), (got[2], 0))) == 1
