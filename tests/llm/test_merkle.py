"""The manifest against a plain tree of lists, for any partitions, and its stack alone."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from lumenry.llm import merkle


def H(nodes):
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, lower=False):
    doc_id, text, source, lang, n_chars = row
    if lower and text is not None:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return H(map(field, (doc_id, source, lang, n_chars, text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def beside(tree, pos):
    for level in tree[:-1]:
        first = pos // 16 * 16
        run = level[first : first + 16]
        yield run[: pos - first], run[pos - first + 1 :]
        pos //= 16


def brute(rows):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[2], []).append((row, leaf(row)))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by_source[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    low = {s: levels([h for _, h in by_source[s]]) for s in sources}
    high = levels([low[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for pos, (row, h) in enumerate(by_source[s]):
            path = [*beside(low[s], pos), *beside(high, k)]
            folded = leaf(row, True) if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 else h
            for a, b in path:
                folded = H([*a, folded, *b])
            out.append((row[0], h, low[s][-1][0], high[-1][0], H(x for a, b in path for x in (*a, *b)), folded, folded == high[-1][0]))
    return out


def key(row):
    return tuple((v is not None, v) for v in row)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    held = [(k if k % 50 else None, rng.choice(["Ab", "ab", "", "Été A"]) if k % 7 else None, rng.choice(["s0", "s0", "s0", "", "é", None, f"t{k}"]), rng.choice(["en", None]), k if k % 9 else None) for k in range(900)]
    return held + [(5, "X", "s0", "en", 1)] * 40 + [(5, "other", "s0", "en", 1), (6, "long A" * 50_000, "s1", "de", 2)]


@pytest.mark.parametrize(("per_part", "least"), [(1 << 18, 1 << 10), (37, 1), (5, 1)])
def test_equals_plain_trees(spark, rows, monkeypatch, per_part, least):
    """One partition and many, whose edges are merged."""
    monkeypatch.setattr(merkle, "LEAST", least)
    rows = rows if per_part > 5 else rows[:200]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").selectExpr("*", "1 AS part", "'x' AS key", "'y' AS digest").repartition(3)
    got = [tuple(r) for r in merkle.manifest(df, per_part=per_part).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert {r[-1] for r in got} == {True, False}


def test_empty_and_single(spark, rows):
    df = spark.createDataFrame(rows[:1], "doc_id long, text string, source string, lang string, n_chars long")
    assert merkle.manifest(df.limit(0)).collect() == []
    assert [tuple(r) for r in merkle.manifest(df).collect()] == brute(rows[:1])


def test_stacks_of_any_cut_agree():
    """The runs of a whole stack are those of its parts and of what their edges merge to."""
    rng = random.Random(2)
    for total in (1, 2, 15, 16, 17, 255, 256, 257, 700, 4097):
        leaves = [H([str(k)]) for k in range(total)]
        whole = merkle.Mountains(0, total, leaves)
        assert whole.top == levels(leaves)[-1][0] and not whole.edges
        cuts = sorted({0, total, *(rng.randrange(total + 1) for _ in range(5))})
        met, runs = {}, {}
        for a, b in zip(cuts, cuts[1:]):
            part = merkle.Mountains(a, total, leaves[a:b])
            runs |= part.runs
            met |= {(level, pos): node for level, pos, node in part.edges}
        for level in range(merkle.height(total)):
            for run in {pos // 16 for at, pos in met if at == level}:
                nodes = [met[level, pos] for pos in range(run * 16, run * 16 + 16) if (level, pos) in met]
                runs[level, run] = nodes
                met[level + 1, run] = H(nodes)
        assert runs == whole.runs
