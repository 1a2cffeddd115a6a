"""Ranked search against a brute force, with nulls, ties, repeated rows, empty tables and blocks of items."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lumenry.llm import lexical_search as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(lower)


def brute(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                scores.append((-score, i is None, i))
        scores.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(scores[:k])]
    return out


@pytest.fixture(scope="module")
def table():
    rng = random.Random(4)
    vocabulary = [*"abcdefghij", "Ünïcode", "ünïcode", "averylongwordofmanyletters", "averylongwordofmanyletterS", "averylongwordofmanyletterz", "x1", "X1", "日本", "don't", "e_mail", "12345678", "123456789"]
    docs = [(k, rng.choice([" ", ", ", "\n", "--"]).join(rng.choices(vocabulary, k=rng.randrange(1, 40)))) for k in range(300)]
    docs += [(k, docs[k][1]) for k in range(40)]  # repeated rows
    docs += [(1000 + k, docs[7][1]) for k in range(30)]  # ties
    docs += [(None, docs[7][1]), (None, "a b"), (400, None), (401, ""), (402, "... !!"), (403, "b " * 30000), (5, "other text of that id: j")]
    items = [(k, " ".join(rng.choices(vocabulary, k=6))) for k in range(25)] + [(3, "a a a b"), (None, "c d"), (40, None), (41, ""), (42, "nowhere"), (43, docs[7][1])]
    rng.shuffle(docs)
    return docs, items


def _key(row):
    return tuple((v is not None, v) for v in row)


@pytest.mark.parametrize("rows", [4096, 7])
def test_equals_brute_force(spark, table, monkeypatch, rows):
    docs, items = table
    monkeypatch.setattr(L, "ITEM_ROWS", rows)  # blocks of items
    if rows == 7:
        monkeypatch.setattr(L, "ENTRIES", 50)
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS n", "'x' AS terms", "2 AS item").repartition(5)
    got = L.lexical_search(d, spark.createDataFrame(items, "item_id long, text string"), k=20)
    assert [f.simpleString() for f in got.schema] == ["item_id:bigint", "rank:int", "doc_id:bigint", "score:bigint"]
    assert sorted((tuple(r) for r in got.collect()), key=_key) == sorted(brute(docs, items, 20), key=_key)


def test_empty_tables(spark, table):
    docs, items = (spark.createDataFrame(t, s) for t, s in zip(table, ("doc_id long, text string", "item_id long, text string"), strict=True))
    assert L.lexical_search(docs.limit(0), items).collect() == []
    assert L.lexical_search(docs, items.limit(0)).collect() == []
    assert L.lexical_search(docs.filter("text is null"), items).collect() == []


def test_radix_order():
    keys = np.random.default_rng(1).integers(0, 2**40, 5000)
    keys[100:200] = keys[5]
    assert (L.radix_order(keys, 2**40) == np.argsort(keys, kind="stable")).all()
    assert len(L.radix_order(np.zeros(0, np.int64), 0)) == 0


def test_words_of_equal_hash_are_compared(monkeypatch):
    monkeypatch.setattr(L.W, "span_hashes", lambda held, start, end: (end - start).astype(np.uint64))
    import pyarrow as pa

    asked = L.Terms([(1, "abc longerword1234 exactly8")])
    words = L.W.split(pa.array(["abd abc longerword1235 longerword1234 exactly9 exactly8"]), lower=True, separator=L.SEPARATOR)
    at, _ = asked.find(words)
    assert at.tolist() == [1, 3, 5]
