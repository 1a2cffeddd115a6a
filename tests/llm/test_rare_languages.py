"""Junk in languages of few documents."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lumenry.llm import quality_rules


@pytest.mark.parametrize("held", [4096, 1])
def test_junk_in_rare_and_null_language(spark, monkeypatch, held):
    monkeypatch.setattr(quality_rules, "HELD", held)
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.lit("en").alias("lang"))
    junk = " ".join(f"{k}#$%&|{k * 7919}" for k in range(200))
    more = spark.createDataFrame([(-1, junk, "xx"), (-2, junk, None), (-3, "", "yy")], "doc_id long, text string, lang string")
    docs = base.unionByName(more)
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).filter("doc_id < 0").collect()}
    assert not got[-1].base_failed and not got[-1].kept and not got[-2].base_failed and not got[-2].kept
    left = quality_rules.keep_good(docs)
    assert left.columns == docs.columns and left.filter("doc_id < 0").count() == 0 and left.count() > 50
