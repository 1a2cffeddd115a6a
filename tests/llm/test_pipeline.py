"""The pipeline's stages, each on its own input, against brute force."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from lumenry.llm.quality_rules import quality_rules

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def held(spark, tmp_path_factory):
    """Input and rows of each stage, written and read again between them; some odd rows at the start."""
    top = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.filter("doc_id = 1").first()
    odd = [(90001, None, "en", "src1", None), (90002, "", None, None, 0), (None, first.text, "en", "src2", 5), (90003, first.text, "en", "src3", 7), (90003, first.text, "en", "src3", 7)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    docs.write.parquet(str(top / "in"))
    docs, out = spark.read.parquet(str(top / "in")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(top / str(k)))
        after = spark.read.parquet(str(top / str(k)))
        out.append((docs, after))
        docs = after
    return out


def rows(df):
    return [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in df.collect()]


def test_columns(held):
    for before, after in held[:-1]:
        assert before.columns == after.columns and after.count() > 0


def test_quality(held):
    before, after = held[0]
    good = {r.doc_id for r in quality_rules(before).collect() if r.kept}
    assert Counter(rows(after)) == Counter(r for r in rows(before) if r[0] in good)


def test_near_duplicates(held):
    before, after = held[1]
    sets = {}
    for i, text, *_ in rows(before):
        w = WORD.findall((text or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    ids = sorted(i for i in sets if i is not None)
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    want = Counter(set(r for r in rows(before) if r[0] is not None and root(r[0]) == r[0])) + Counter(r for r in rows(before) if r[0] is None)
    assert Counter(rows(after)) == want


def test_substrings(held):
    before, after = held[2]
    least = lambda r: (r[0] is not None, r[0] or 0)
    first, want = {}, Counter()
    for r in sorted(rows(before), key=least):
        w = WORD.findall(r[1] or "")
        for k in range(len(w) - 19):
            first.setdefault(tuple(w[k : k + 20]), (r[0], k))
    for r in rows(before):
        w = WORD.findall(r[1] or "")
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if first[tuple(w[k : k + 20])] != (r[0], k):
                gone[k : k + 20] = [True] * 20
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        if not w or not all(gone):
            want[(r[0], kept, *r[2:4], len(kept)) if any(gone) else r] += 1
    assert Counter(rows(after)) == want


def test_mixing(held):
    before, after = held[3]
    texts = defaultdict(set)
    for r in rows(before):
        texts[r[0]].add(r[1])
    taken = Counter()
    for i, text, _, source, n in rows(after):
        w = WORD.findall(text)
        whole = next(iter(texts[i]))
        assert text == whole or w == WORD.findall(whole)[: len(w)] and n == len(text)
        taken[("reference", "forum", "web")[int(re.search(r"\d+$", source)[0]) % 3]] += len(w)
    total = sum(len(WORD.findall(r[1] or "")) for r in rows(before))
    assert sum(taken.values()) <= total
    room = Counter()
    for r in rows(before):
        room[("reference", "forum", "web")[int(re.search(r"\d+$", r[3])[0]) % 3]] += 2 * len(WORD.findall(r[1] or ""))
    for domain, weight in (("reference", 3), ("forum", 1), ("web", 2)):
        assert taken[domain] >= min(room[domain], total * weight / 6) * 0.98 - 30  # a fraction of a token is lost in each leaf


def test_bpe(held):
    import public_tokenizers
    from tokenizers import Tokenizer

    before, after = held[4]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((r[0], tuple(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows(before))
    assert Counter((r.doc_id, tuple(r.ids)) for r in after.collect()) == want
    assert after.filter("n_tokens <> size(ids)").count() == 0


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
