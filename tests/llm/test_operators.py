"""Each operator against a brute-force version, with nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lumenry.llm import bpe as BPE
from lumenry.llm import html_text, license_scan, mixing, ngram_join, perplexity, quality_rules, queries, substring_dedup, topk, toxicity
from lumenry.llm.license_templates import TEMPLATES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def rows(spark):
    """Documents of the smallest table, and odd ones; columns that clash with names the operators use."""
    held = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    base = held[0][1]
    twice = " ".join(f"w{k}" for k in range(30))
    held += [
        (900001, None, "en", "src1"), (900002, "", "en", None), (900003, " \t\n ", None, "src1"), (900004, "one two", "en", "srcx"), (900005, "ONE two", "en", "src0"),
        (900006, base, "en", "src1"), (900006, base, "en", "src1"), (900007, f"{twice} mid {twice}", "de", "src1"), (900008, "x" * 5000 + " " + "é" * 300, "fr", "src1"),
        (900009, " ".join(f"v{k % 997} u{k}" for k in range(30000)), "es", "src1"), (None, "text without an id " + twice, "en", "src1"), (900010, "a b　c\x1cd\u0085e", "en", "src1"),
    ]
    return held


@pytest.fixture(scope="module")
def docs(spark, rows):
    schema = "doc_id long, text string, lang string, source string, block long, node long, row string, shard int, rank int, part int"
    return spark.createDataFrame([(*r, 1, 2, "x", 3, 4, 5) for r in rows], schema).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def words(text):
    return WORD.findall(text or "")


def test_substring_dedup(docs, none, rows):
    least = lambda i: -(2**63) if i is None else i
    first, want = {}, Counter()
    for i, text, *_ in rows:
        w = words(text)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            first[key] = min(first.get(key, (math.inf, 0)), (least(i), k))
    for i, text, *_ in rows:
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if first[tuple(w[k : k + 20])] < (least(i), k):
                gone[k : k + 20] = [True] * 20
        want[i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)] += 1
    for size in (20_000, 1 << 20):
        got = substring_dedup.substring_dedup(docs, block_bytes=size).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == want
        assert all(sum(x.end - x.start for x in r.removed) == r.n_removed for r in got)
    assert substring_dedup.substring_dedup(none).count() == 0
    assert substring_dedup.lengths(20) == [10, 20] and substring_dedup.lengths(50)[-1] == 50
    odd = substring_dedup.substring_dedup(docs, window=37).filter("doc_id = 900006").collect()
    assert len(odd) == 2 and all(r.n_removed == r.n_words for r in odd)


def test_ngram_join(docs, none, rows, monkeypatch):
    sets = []
    for i, text, *_ in rows:
        w = words((text or "").translate(LOWER))
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [0] * len(sets)
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x[1] and None not in (x[0], y[0]) and 100 * len(x[1] & y[1]) >= 80 * len(x[1] | y[1]):
                links[a] += 1
                links[b] += 1
                up[root(a)] = root(b)
    groups = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        groups[root(k)].append(i)
    want = Counter((i, len(s), i if i is None else min(groups[root(k)]), links[k]) for k, (i, s) in enumerate(sets))
    for cell in (4, 128):
        monkeypatch.setattr(ngram_join, "CELL", cell)
        got = ngram_join.ngram_join(docs, block_bytes=50_000).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got) == want
    assert ngram_join.ngram_join(none).count() == 0


def test_near_copies_of_one_group_in_small_cells(spark, monkeypatch):
    """A group of near copies over many cells, each text with changes of its own."""
    rng = np.random.default_rng(3)
    base = [f"b{k}" for k in range(150)]
    texts = []
    for _ in range(150):
        w = list(base)
        for k in rng.integers(0, 150, int(rng.integers(0, 6))):
            w[k] = f"n{rng.integers(0, 10**6)}"
        texts.append(" ".join(w))
    sets = [frozenset(tuple(x.split()[k : k + 5]) for k in range(146)) for x in texts]
    want = [sum(a != b and 100 * len(x & y) >= 80 * len(x | y) for b, y in enumerate(sets)) for a, x in enumerate(sets)]
    monkeypatch.setattr(ngram_join, "CELL", 16)
    got = ngram_join.ngram_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block_bytes=20_000).collect()
    assert [r.n_links for r in sorted(got)] == want


def test_quality_rules(docs, none, rows):
    symbols = set("#*$%&|<>")

    def counts(text):
        text = text or ""
        w = words(text)
        lines = [x for x in text.split("\n") if words(x)]
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        hit = set()
        for k in range(len(w) - 7):
            if seen[tuple(w[k : k + 8])] > 1:
                hit.update(range(k, k + 8))
        return len(w), sum(map(len, w)), sum(c in symbols for c in text), len(lines) - len(set(lines)), len(hit)

    got = quality_rules.quality_rules(docs).collect()
    want = Counter((i, *counts(t)) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(none).count() == 0
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.kept)


def test_divergence():
    p = np.array([[1, 1, 0], [0, 0, 0]])
    q = np.tile([0.5, 0.5, 0.0], (2, 1))
    assert quality_rules.distance(p, q).tolist() == [0, 0]
    assert quality_rules.distance(np.array([[0, 0, 4]]), q[:1])[0] == pytest.approx(1)


def test_labelled_junk_is_rejected(spark):
    sf = "/root/testdata/sf0.01"
    got = quality_rules.quality_rules(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    share = {(r.quality, r.kept): r["count"] for r in got.filter("not base_failed").groupBy("quality", "kept").count().collect()}
    assert share.get((1, False), 0) <= 0.02 * share[1, True]
    assert share[0, False] >= 0.8 * (share[0, False] + share.get((0, True), 0))


def test_bpe_is_what_the_library_gives(docs, none, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(queries.VOCABULARY)
    library = Tokenizer.from_file(path)
    got = BPE.bpe(docs, path).collect()
    want = Counter()
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[i, tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == want
    assert BPE.bpe(none, path).count() == 0
    again = BPE.decode(BPE.bpe(docs, path).select("doc_id", "ids", "decoded"), path, as_col="again")
    assert again.filter("again <> decoded").count() == 0


def test_bpe_odd_texts():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(queries.VOCABULARY)
    v, library = BPE.vocabulary(open(path).read()), Tokenizer.from_file(path)
    draw = random.Random(5)
    texts = ["".join(draw.choice("aaaBbéßΣσİ ıǅ́\x1c\x85 　'strem\n\t123½²ⅷ<|>end😀中文한") for _ in range(draw.randint(0, 50))) for _ in range(1500)]
    texts += ["a<|endoftext|>b <|startoftext|><|ENDOFTEXT|>", "ΑΣ ΟΔΟΣ", "a" * 50 + " aaa", "it's they'll I'M"]
    encoder = BPE._Encoder(v)
    for x in texts:
        w = encoder.split(x)
        encoder.learn(set(w))
        assert np.frombuffer(b"".join(encoder.ids[y] for y in w), np.int32).tolist() == library.encode(x, add_special_tokens=False).ids


def test_top_k(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 12)).astype(np.float32)
    x[50:60] = x[0]  # ties
    held = [(k, v.tolist(), 0) for k, v in enumerate(x)]
    held += [(1000, None, 0), (1020, [float("nan")] * 12, 0), (1040, [1.0, None] * 6, 0), (None, x[0].tolist(), 0), (2000, [0.5] * 5, 0), (2020, [0.25] * 5, 0), (3000, [1e5] * 12, 0)]
    df = spark.createDataFrame(held, "vec_id long, embedding array<float>, block int")
    good = {k: [math.floor(64 * float(np.float32(c))) for c in v] for k, v, _ in held if k is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)}
    want = {}
    for q, a in good.items():
        if q % 20 == 0:
            scores = sorted((-sum(map(int.__mul__, a, b)), k) for k, b in good.items() if k != q and len(a) == len(b))[:20]
            want[q] = [(n + 1, k, -s) for n, (s, k) in enumerate(scores)]
    got = defaultdict(list)
    for r in topk.top_k(df).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert {q: sorted(v) for q, v in got.items()} == {q: v for q, v in want.items() if v}
    assert topk.top_k(df.filter("false")).count() == 0


def test_segment_bounds_hold():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(20, 16)), rng.normal(size=(20, 16))
    exact = ((a - b) ** 2).sum(1)
    below = np.zeros(20)
    for s in topk.resolutions(16):
        (am, ad), (bm, bd) = topk.statistics(a, s), topk.statistics(b, s)
        bound = 16 / s * (((am - bm) ** 2).sum(1) + ((ad - bd) ** 2).sum(1))
        assert (bound <= exact + 1e-9).all() and (bound >= below - 1e-9).all()  # finer ones are tighter
        below = bound


def test_mixing(docs, none, rows):
    levels, weights = ["lang", "source"], {("en",): 2.0, ("en", "src1"): 3.0, ("fr",): 0.0}
    got = mixing.mix_sources(docs, levels, 0.6, weights, epochs=2, carry=["doc_id", "text"]).collect()
    sizes = [((lang or "", source or ""), len(words(t))) for _, t, lang, source in rows if words(t)]
    leaf = Counter()
    for path, n in sizes:
        leaf[path] += n
    total = 0.6 * sum(leaf.values())

    def fill(budget, rooms):  # room and weight by child: water filling, one full child at a time
        out, left = {}, dict(rooms)
        while left:
            level = budget / sum(w for _, w in left.values())
            full = {k: r for k, (r, w) in left.items() if r <= level * w}
            if not full:
                return out | {k: level * w for k, (_, w) in left.items()}
            for k, r in full.items():
                out[k], budget = r, budget - r
                del left[k]
        return out

    room = {p: 2 * n for p, n in leaf.items()}
    top = {}
    for p in {p[0] for p in leaf}:
        if weights.get((p,), 1) > 0:
            top[p] = (sum(r for q, r in room.items() if q[0] == p), weights.get((p,), 1.0))
    given = fill(min(total, sum(r for r, _ in top.values())), top)
    want = {}
    for p, budget in given.items():
        for q, b in fill(budget, {q: (r, weights.get(q, 1.0)) for q, r in room.items() if q[0] == p}).items():
            want[q] = math.floor(b + 1e-6)
    taken = Counter()
    for r in got:
        taken[tuple(r.path)] += r.n_taken
        assert r.row.doc_id == r.doc_id and len(words(r.row.text)) == r.n_tokens
    assert all(abs(taken[q] - n) <= 1 for q, n in want.items()) and set(taken) <= set(want)
    by_leaf = defaultdict(lambda: defaultdict(list))
    for r in got:
        by_leaf[tuple(r.path)][r.epoch].append(r)
    for epochs in by_leaf.values():  # a prefix: only the last epoch is not whole, and one row at most is cut
        assert sum(r.n_taken < r.n_tokens for e in epochs.values() for r in e) <= 1
    assert mixing.mix_sources(none, levels, 0.5).count() == 0
    same = mixing.mix_sources(docs, levels, 0.6, weights, epochs=2).collect()
    assert Counter((r.doc_id, r.epoch, r.n_taken) for r in same) == Counter((r.doc_id, r.epoch, r.n_taken) for r in got)


def test_toxicity(spark, docs, none):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.toxicity(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    toxic = np.array([r.score for r in held if r.toxic == 1])
    clean = np.array([r.score for r in held if r.toxic == 0])
    assert (toxic[:, None] > clean[None, :]).mean() > 0.9
    assert (toxic >= 0.5).mean() > 0.6 and (clean >= 0.5).mean() < 0.03
    assert toxicity.toxicity(none, labels).count() == 0
    few = toxicity.toxicity(docs, labels.filter("false")).collect()
    assert len(few) == docs.count() and all(r.score == 0 for r in few)


def test_html(spark):
    page = """<!DOCTYPE html><title>no</title><style>.q, div.z{display:none}</style><p>One <b>two</b>three
     four<p>Five<br>six &amp; seven<ul><li>a<li>b<ol><li>x<li>y</ol></ul><table><tr><td>a<td>long cell<tr><th>bbbb<td>c<br>d</table>
     <div class=q>no</div><div hidden>no</div><pre>  kept
   as is</pre><span style="visibility:hidden">no<i style="visibility:visible">yes</i></span><script>var a="</p>";</script>a < b"""
    want = "One twothree four\n\nFive\nsix & seven\n\n- a\n- b\n  1. x\n  2. y\n\na     long cell\nbbbb  c\n      d\n\n  kept\n   as is\n\nyesa < b"
    pages = [(1, page), (2, None), (3, ""), (4, "plain  text"), (5, "<div>" * 20000 + "deep"), (6, "<td>cell</p>x<"), (7, "<!-- open"), (7, "<p>twice")]
    df = spark.createDataFrame([(*p, "t") for p in pages], "page_id long, html string, text string")
    got = Counter((r.page_id, r.text) for r in html_text.html_text(df).collect())
    assert got == Counter([(1, want), (2, ""), (3, ""), (4, "plain text"), (5, "deep"), (6, "cell\n\nx<"), (7, ""), (7, "twice")])
    assert html_text.html_text(df.filter("false")).count() == 0


def test_html_keeps_all_visible_words(spark):
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        bare = re.sub(r"(?s)<!--.*?-->|<(script|style|title)\b.*?</\1>", " ", r.html)
        from html import unescape

        assert "".join(unescape(re.sub(r"<[^<>]*(>|$)", " ", bare)).split()) == "".join(re.sub(r"(?m)^- ", "", html_text.text_of(r.html)).split())


def test_license_scan(docs, none, rows, spark):
    grant = TEMPLATES["mit-grant"][1].replace("granted, free", "granted BAD free").replace("copy of this", "copy this")
    more = spark.createDataFrame([(1, "é " + grant + " end"), (2, TEMPLATES["mit-notice"][1] + " x " + TEMPLATES["mit-notice"][1]), (3, None)], "doc_id long, text string")
    got = {(r.doc_id, r.template, r.start_word): r for r in license_scan.license_scan(more).collect()}
    r = got[1, "mit-grant", 1]
    assert 0.9 < r.coverage < 1 and grant.startswith("Permission") and r.start_char == 2 and r.end_char == 2 + len(grant)
    assert {k for k in got if k[0] == 2} == {(2, "mit-notice", 0), (2, "mit-notice", 6)}
    assert license_scan.license_scan(none).count() == 0
    # without an index: every template at every word
    split = re.compile(r"[A-Za-z0-9\u0080-\U0010ffff]+")
    notices = {n: split.findall(t.lower()) for n, (_, t) in TEMPLATES.items()}
    want = set()
    for i, text, *_ in rows:
        w = split.findall((text or "").translate(LOWER))
        for n, t in notices.items():
            want |= {(i, n, k) for k in range(len(w) - len(t) + 1) if w[k] == t[0] and w[k : k + len(t)] == t}
    found = {(r.doc_id, r.template, r.start_word) for r in license_scan.license_scan(docs).collect() if r.coverage == 1}
    assert want and found == want


def test_perplexity(docs, none, rows, spark):
    """The model's figures from plain dictionaries."""
    trusted = {i for i, *_ in rows if i is not None and i % 3 == 0}
    got = perplexity.perplexities(docs.select("doc_id", "text", "lang"), spark.createDataFrame([(i,) for i in trusted], "doc_id long"), block_bytes=40_000).collect()
    pairs, texts = Counter(), []
    for i, text, *_ in rows:
        w = words((text or "").translate(LOWER))
        texts.append((i, w))
        if i in trusted:
            pairs.update(zip(w, w[1:]))
    after, before, context = defaultdict(list), Counter(b for _, b in pairs), Counter()
    for (a, _), n in pairs.items():
        after[a].append(n)
        context[a] += n
    d2 = perplexity.discounts([sum(n == k for n in pairs.values()) for k in (1, 2, 3, 4)])
    d1 = perplexity.discounts([sum(n == k for n in before.values()) for k in (1, 2, 3, 4)])
    free = sum(d1[min(n, 3)] for n in before.values())
    low = lambda x: (before[x] - d1[min(before[x], 3)] + free / (len(before) + 1)) / len(pairs)

    def p(a, b):
        if a is None or not context[a]:
            return low(b)
        n = pairs[a, b]
        return (n - d2[min(n, 3)] + sum(d2[min(k, 3)] for k in after[a]) * low(b)) / context[a]

    want = defaultdict(list)
    for i, w in texts:
        want[i].append(math.exp(-sum(math.log(p(a, b)) for a, b in zip([None, *w], w)) / len(w)) if w else None)
    assert len(got) == len(rows)
    for r in got:
        assert r.perplexity == pytest.approx(want[r.doc_id][0], rel=1e-6) if want[r.doc_id][0] is not None else r.perplexity is None
    context_total = sum(p("and", x) for x in before) + p("and", "\0never") if context["and"] else 1
    assert context_total == pytest.approx(1, abs=1e-6)


def test_quality_classifier(spark, docs, none):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = perplexity.quality_classifier(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").collect()
    kept = {q: np.mean([r.kept for r in got if r.quality == q]) for q in (0, 1)}
    assert kept[1] > 0.97 and kept[0] < 0.5
    assert perplexity.quality_classifier(none, labels).count() == 0
    free = perplexity.quality_classifier(docs, labels.filter("false")).collect()
    assert len(free) == docs.count() and all(r.kept == (r.n_words > 0) for r in free)


def test_digests(spark):
    for name in ("op2_substring_dedup", "op7_bpe"):
        for r in queries.QUERIES[name](spark, SF).collect():
            assert all(re.fullmatch("[0-9a-f]{64}", v) for k, v in r.asDict().items() if k.endswith("sha256"))
    empty = hashlib.sha256(b"").hexdigest()
    assert empty.startswith("e3b0")
