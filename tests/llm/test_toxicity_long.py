"""Toxicity of texts longer than the 4096 characters to which training texts were once cut."""

from __future__ import annotations

import numpy as np

from lumenry.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_training_texts_are_whole(spark):
    ids = range(40)
    texts = {k: ("word " * 2000 + f"end{k}") for k in ids}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in ids], "doc_id long, toxic long")
    toxic, ordinary, _ = toxicity.sample(docs, labels)
    assert toxic and ordinary and set(toxic) | set(ordinary) <= set(texts.values())
    fewer = toxicity.sample(docs, labels, 5)
    assert len(fewer[0]) == len(fewer[1]) == 5 and set(fewer[0]) | set(fewer[1]) <= set(texts.values())


def test_long_texts_by_themselves(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = docs.filter("length(text) > 4096").select("doc_id")
    got = toxicity.toxicity(docs, labels).filter("held_out").join(labels, "doc_id").join(long, "doc_id").collect()
    toxic = np.array([r.score for r in got if r.toxic == 1])
    clean = np.array([r.score for r in got if r.toxic == 0])
    print(f"held-out texts over 4096 characters: {len(toxic)} toxic, recall {(toxic >= 0.5).mean():.3f}; {len(clean)} clean, false positives {(clean >= 0.5).mean():.3f}; area {(toxic[:, None] > clean[None, :]).mean():.3f}")
    assert len(toxic) >= 5 and len(clean) >= 50
    assert (toxic[:, None] > clean[None, :]).mean() > 0.9
    assert (clean >= 0.5).mean() < 0.05
