"""The n-gram join where rows repeat a doc_id with different texts."""

from __future__ import annotations

from collections import Counter

from lumenry.llm import ngram_join


def test_two_texts_of_one_id_keep_their_links(spark):
    a, b = [f"a{k}" for k in range(100)], [f"b{k}" for k in range(100)]
    rows = [(1, a), (1, b), (2, [*a[:-1], "x"]), (3, [*b[:-1], "y"]), (4, [f"c{k}" for k in range(100)])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id, r.n_links) for r in ngram_join.ngram_join(docs).collect())
    assert got == Counter([(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 4, 0)])
