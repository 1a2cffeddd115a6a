"""Posts to the page, end to end."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from lumenry.operators import parse, publish
from lumenry.sources import state as K

POST = """NEXT LIVE
6/1(月)
『Spring Night Parade』
会場：Hall One
OPEN 17:30 / START 18:00
抽選受付：5/1 12:00〜5/9 23:59
一般：2,000円 / VIP：9,000円
https://tiget.net/events/1"""


def test_posts_to_page(spark):
    at = lambda d: dt.datetime(2026, 4, d, 3)
    rows = [
        (1, POST, at(1)), (2, "『Spring Night Parade』 6/1\n会場：Hall One\nSOLD OUT\nhttps://tiget.net/events/1", at(20)), (3, "自己紹介", at(2)), (4, None, at(3)), (5, "ライブ", at(4)),
        (1, POST, at(1)),
    ]
    raw = spark.createDataFrame(rows, "post_id long, text string, posted_at timestamp")
    told = {r.post_id: r for r in parse.parsed(raw).collect()}
    assert set(told) == {"1", "2", "5"} and told["5"].confidence <= 0.55 and told["5"].classification == "needs_review"
    assert [(p.sale_type, p.ticket_tier, p.price) for p in told["1"].sales][:2] == [("抽選", "一般", 2000), ("抽選", "VIP", 9000)]
    events, page = parse.page_of(raw, None, "2026-05-02T00:00:00")
    held = {r.event_id: r for r in events.collect()}
    assert set(held) == {"1", "5"} and held["1"].post_ids == ["1", "2"] and held["1"].ticket_status == "sold_out" and held["1"].n_merged == 2
    first = page.first()
    assert (first.id, first.event_name, first.venue, first.next_deadline_at, first.is_ready) == ("1:2026-06-01", "Spring Night Parade", "Hall One", "2026-05-09T23:59:00", True)
    assert first.ticket_summary.startswith("抽選 / 一般 2,000円") and first.application_summary == "抽選 5/1 12:00〜5/9 23:59"
    bad = page.select("*", F.lit("x").alias("my_token")).select("id", publish.row_errors(page.select("*", F.lit("x").alias("my_token"))).alias("e")).collect()
    assert "secret-like field my_token" in bad[0].e and any("not ready" in r.e for r in bad if r.id.startswith("5"))


def test_labelled_examples(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"post": {"id": "1", "text": "x", "created_at": "2026-04-01T00:00:00Z"}, "expected": {"event_name": "n", "classification": "event"}}))
    (tmp_path / "b.json").write_text("[]")
    got = K.read_labelled(spark, str(tmp_path), "event_name string, classification string").collect()
    assert [(r.post_id, r.expected.event_name, r.expected.classification) for r in got] == [("1", "n", "event")]
