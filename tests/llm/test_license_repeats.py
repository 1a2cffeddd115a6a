"""License notices that repeat closely."""

from __future__ import annotations

from lumenry.llm import license_scan
from lumenry.llm.license_templates import TEMPLATES


def test_adjacent_repetitions_of_every_template(spark):
    texts, want = [], set()
    for k, (name, (_, notice)) in enumerate(TEMPLATES.items()):
        size = len(license_scan.index_of({name: ("", notice)}).words[0])
        for gap in (0, 1, 2):
            texts.append((3 * k + gap, "\n".join([notice + " zzz" * gap] * 20)))
            want |= {(3 * k + gap, name, (size + gap) * i) for i in range(20)}
    got = license_scan.license_scan(spark.createDataFrame(texts, "doc_id long, text string")).filter("coverage = 1").collect()
    names = list(TEMPLATES)
    own = [(r.doc_id, r.template, r.start_word) for r in got if names[r.doc_id // 3] == r.template]
    assert len(own) == len(want) and set(own) == want


def test_damaged_among_whole(spark):
    """Every other notice lacks its sixth word."""
    notice = TEMPLATES["mit-grant"][1]
    split = notice.split(" ")
    damaged = " ".join(split[:5] + split[6:])
    got = license_scan.license_scan(spark.createDataFrame([(1, " ".join([notice, damaged] * 10))], "doc_id long, text string")).filter("template = 'mit-grant'").collect()
    assert sorted(r.coverage == 1 for r in got) == [False] * 10 + [True] * 10
