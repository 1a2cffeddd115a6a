"""Top-k: components of any size, and what the resolutions drop."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np

from lumenry.llm import topk

LEAST, MOST = -(2**63), 2**63 - 1


def brute(held, k=20):
    good = {i: [math.floor(c * 64) if abs(c) < 2**53 else int(c) * 64 for c in v] for i, v in held}
    out = {}
    for q, a in good.items():
        if q % 20 == 0:
            scores = sorted((-min(max(sum(x * y for x, y in zip(a, b)), LEAST), MOST), i) for i, b in good.items() if i != q and len(a) == len(b))[:k]
            out[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return {q: v for q, v in out.items() if v}


def test_components_of_any_size(spark):
    rng = np.random.default_rng(5)
    held = [(k, (rng.normal(size=6) * 10.0 ** rng.integers(-3, 4)).tolist()) for k in range(60)]
    held += [(k, (rng.normal(size=6) * 10.0 ** rng.integers(5, 12)).tolist()) for k in range(60, 120)]
    held += [(k, (rng.normal(size=6) * 10.0**size).tolist()) for k, size in ((120, 30), (121, 150), (140, 307), (141, 307), (160, -300), (161, 15), (180, 15))]
    held += [(200, [0.0] * 6), (201, [4e6] * 6), (220, [4e6] * 6), (221, [4e6] * 5 + [4e6 + 1 / 64])]
    got = defaultdict(list)
    for r in topk.top_k(spark.createDataFrame(held, "vec_id long, embedding array<double>")).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert {q: sorted(v) for q, v in got.items()} == brute(held)


def test_resolutions_drop_what_cannot_be_among_the_best():
    """Clustered vectors: each resolution leaves fewer pairs, and the result is that of all pairs."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 32)) * 40
    rows = np.floor(centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 32)) * 8)
    ids, queries = np.arange(3000), rows[::20]
    told = np.zeros(len(topk.resolutions(32)) + 1, np.int64)
    known = np.full(len(queries), LEAST)
    q, found, scores = topk.search(queries, ids[::20], known, rows, ids, 20, topk.axes(rows[:500]), told)
    every = queries @ rows.T
    every[np.arange(len(queries)), ids[::20]] = -np.inf
    for k, name in enumerate(ids[::20]):
        best = np.lexsort((ids, -every[k]))[:20]
        assert found[q == name].tolist() == best.tolist() and scores[q == name].tolist() == every[k, best].tolist()
    assert (np.diff(told) <= 0).all() and told[0] == len(queries) * (len(rows) - 1)
    assert told[-1] < told[0] / 2, told  # the first rows meet queries that know no score yet
    again = np.zeros_like(told)
    topk.search(queries, ids[::20], scores[19::20], rows, ids, 20, topk.axes(rows[:500]), again)
    assert again[-1] < again[0] / 5 and again[1] < told[1], again  # a known k-th score drops more


def test_turning_changes_no_distance():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(50, 12))
    turn = topk.axes(x)
    assert np.allclose(turn @ turn.T, np.eye(12))
