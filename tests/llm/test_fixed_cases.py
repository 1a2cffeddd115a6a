"""Hubs of graphs, null languages, the orders of epochs, odd texts under a fitted toxicity model, inexact notices."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from lumenry.llm import graph, license_scan, mixing, quality_rules, toxicity
from lumenry.llm import words as W
from lumenry.llm.license_templates import TEMPLATES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_components_with_hubs(spark):
    rng = random.Random(1)
    edges = [(0, k) for k in range(1, 300)] + [(1000 + rng.randrange(400), 1000 + rng.randrange(400)) for _ in range(250)] + [(299, 900), (900, 5000), (7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    want = {x: root(x) for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_null_language_is_not_the_empty_one(spark):
    plain = [(k, " ".join(f"some plain words of text {random.Random(k * 100 + j).choice('abcdefgh')}" for j in range(20)), None) for k in range(60)]
    shout = [(100 + k, " ".join(f"THESE ARE LOUD {random.Random(k * 100 + j).choice('ABCDEFGH')}" for j in range(30)), "") for k in range(60)]
    got = quality_rules.quality_rules(spark.createDataFrame(plain + shout, "doc_id long, text string, lang string"), quality_rules.Limits(repeat_percent=100)).collect()
    assert len(got) == 120 and all(r.kept and r.class_distance < 0.1 for r in got)


def _xx(value, seed: int) -> int:
    """xxhash64 of a column value as Spark chains it; signed."""
    data = value.encode() if isinstance(value, str) else value[0].to_bytes(4, "little", signed=True) if isinstance(value, tuple) else value.to_bytes(8, "little", signed=True)
    return xxhash.xxh64(data, seed % 2**64).intdigest()


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def test_which_documents_a_leaf_takes(spark):
    """The prefix of the epoch that isn't whole, by hashes made outside of Spark."""
    rng = random.Random(3)
    held = [(k, " ".join(["w"] * rng.randrange(1, 9)), f"s{k % 3}") for k in range(300)]
    docs = spark.createDataFrame(held, "doc_id long, text string, source string")
    for share in (0.4, 1.3):
        got = Counter((r.doc_id, r.epoch, r.n_taken) for r in mixing.mix_sources(docs, ["source"], share, {("s0",): 3.0}, epochs=2).collect())
        sizes = {i: len(WORD.findall(t)) for i, t, _ in held}
        leaf = Counter()
        for i, _, s in held:
            leaf[s] += sizes[i]
        total, room = share * sum(leaf.values()), {s: 2 * n for s, n in leaf.items()}
        weights, budget, left = {"s0": 3.0, "s1": 1.0, "s2": 1.0}, {}, dict(room)
        rest = min(total, sum(room.values()))
        while left:
            level = rest / sum(weights[s] for s in left)
            full = [s for s in left if left[s] <= level * weights[s]]
            for s in full or list(left):
                budget[s] = left[s] if full else level * weights[s]
                rest -= budget[s] if full else 0
                del left[s]
        want = Counter()
        for s, b in budget.items():
            b = math.floor(b + 1e-9)
            whole = b // leaf[s]
            mine = [(i, t) for i, t, source in held if source == s]
            rank = {i: _xx(t, _xx(i, _xx((17,), 42))) for i, t in mine}
            order = sorted(mine, key=lambda x: _signed(_xx((whole,), _xx(_signed(rank[x[0]]), 42))))
            for epoch in range(whole):
                want.update((i, epoch, sizes[i]) for i, _ in mine)
            rest_of = b - whole * leaf[s]
            for i, _ in order:
                if rest_of > 0:
                    want[i, whole, min(sizes[i], rest_of)] += 1
                    rest_of -= sizes[i]
        assert got == want


def test_fitted_model_on_odd_texts(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    base = docs.filter("length(text) > 500").first().text
    odd = [(-1, None), (-2, ""), (-3, " \n"), (-4, base), (-4, base), (-5, base * 200), (None, base), (-6, "\0" * 50), (-7, "é　" * 3000)]
    got = toxicity.toxicity(docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string")), labels).filter("doc_id < 0 OR doc_id IS NULL").collect()
    assert len(got) == len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.score)
    assert len(by[-4] | by[None]) == 1 and len(by[-1] | by[-2] | by[-3]) == 1 and next(iter(by[-1])) < 0.5


def test_window_lengths_by_brute_force():
    """Savings are the differences of two compressions by plain library calls."""
    import zstandard

    toxic, ordinary = b"\0 horrid\0 beastly" * 3, b"\0 window\0 garden." * 3
    how = zstandard.ZstdCompressionParameters(
        window_log=18, hash_log=17, chain_log=17, search_log=4, min_match=toxicity.LEAST_MATCH, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    sizes = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how) for x in (ordinary, toxic)]
    text = " ".join(random.Random(2).choice(["horrid", "beastly", "window", "garden", "Tree", "cloud"]) for _ in range(100))
    w = text.lower().split()
    want = [len(sizes[0].compress(x)) - len(sizes[1].compress(x)) for k in range(0, 100, 16) for x in [b" " + " ".join(w[k : k + 16]).encode()]]
    assert toxicity.Distance(toxic, ordinary).saved(text).tolist() == want


def _smith_waterman(text, template):
    """The score of the best local alignment: 2 a match, -1 a word replaced, left out or put in."""
    rows = np.zeros((len(template) + 1, len(text) + 1), int)
    for i in range(1, len(template) + 1):
        for j in range(1, len(text) + 1):
            rows[i, j] = max(0, rows[i - 1, j - 1] + (2 if template[i - 1] == text[j - 1] else -1), rows[i - 1, j] - 1, rows[i, j - 1] - 1)
    return rows.max()


@pytest.mark.parametrize("name", ["mit-grant", "mit-body", "bsd-2-body", "zlib-body", "gpl-header", "isc-body"])
def test_inexact_notices_against_full_alignment(spark, name):
    """Words replaced, left out and put in: found where a full alignment finds three quarters of the words."""
    rng = random.Random(len(name))
    words = re.findall(r"[A-Za-z0-9]+", TEMPLATES[name][1].lower())
    held = []
    for k in range(8):
        body = []
        for x in words:
            what = rng.random()
            if what < 0.03:
                continue
            body.append(f"q{rng.randrange(99)}" if what < 0.06 else x)
            if what > 0.98:
                body.append("zz")
        before = [f"p{rng.randrange(999)}" for _ in range(rng.randrange(60))]
        held.append((k, " ".join(before + body + ["end"] * 9), before, body))
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame([x[:2] for x in held], "doc_id long, text string"), {name: TEMPLATES[name]}).collect()}
    index = license_scan.index_of({name: TEMPLATES[name]})
    for k, text, before, body in held:
        r = got[k]
        assert r.template_words == len(words) and r.coverage >= 0.75
        assert abs(r.start_word - len(before)) <= 3 and abs(r.end_word - len(before) - len(body)) <= 3
        import pyarrow as pa

        hashes = W.split(pa.array([text]), True, license_scan._BETWEEN).hashes()
        full = _smith_waterman(hashes.tolist(), index.words[0].tolist())
        # matched words less what else the span and the template hold is the score of the full alignment
        gaps = max(r.end_word - r.start_word, 0) - r.matched_words
        assert 2 * r.matched_words - gaps - len(words) <= full <= 2 * r.matched_words
