"""Lookups from blocks to shards: packing, and several hops that give what one hop gives."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from lumenry.llm import blocks, ngram_join, perplexity, substring_dedup

SF = "/root/testdata/sf0.001"


def test_packing():
    rng = np.random.default_rng(3)
    for bits in (1, 16, 32, 40, 64):
        keys = np.sort(rng.integers(0, 2**bits - 1, 500, np.uint64, endpoint=True))
        assert (blocks.unpacked(blocks.packed(keys, bits), bits) == keys).all()
    for values in (np.zeros((2, 0), np.int64), np.zeros((1, 9), np.int64), rng.integers(0, 3, (3, 101)) * rng.integers(0, 2**31, (3, 101)), np.array([[254, 255, 256, 2**32 - 1]])):
        assert (blocks.dense(blocks.sparse(values), len(values)) == values).all()
        assert (blocks.restored(blocks.plain(values), len(values)) == values).all()
    assert (blocks.restored(blocks.plain(np.array([[-(2**63), 2**63 - 1]]))) == [[-(2**63), 2**63 - 1]]).all()


@pytest.mark.parametrize("radix", (2, 4))
def test_hops(spark, monkeypatch, radix):
    """Routers of few digits, so that answers take two hops and more."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    good = docs.select("doc_id").filter("doc_id % 3 = 0")

    def results():
        a = substring_dedup.substring_dedup(docs, block_bytes=40_000).select("doc_id", "n_removed", "kept_text")
        b = ngram_join.ngram_join(docs, block_bytes=40_000)
        c = perplexity.perplexities(docs, good, block_bytes=40_000).selectExpr("doc_id", "round(perplexity, 6)")
        return [Counter(map(tuple, x.collect())) for x in (a, b, c)]

    want = results()
    monkeypatch.setattr(blocks, "RADIX", radix)
    held = blocks.write_blocks(docs, 40_000)
    told = blocks.route(held)
    assert told.hops >= 2 and told.shards >= 8
    assert results() == want


def test_clean_up(spark):
    """Tables and files that operators leave can be dropped at once."""
    before = {t.name for t in spark.catalog.listTables()}
    blocks.write_blocks(spark.range(3).selectExpr("id", "'a b' AS text"))
    assert blocks.clean_up(spark) >= 2
    assert {t.name for t in spark.catalog.listTables()} <= before
    assert blocks.clean_up(spark) == 0
