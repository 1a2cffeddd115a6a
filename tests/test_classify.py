"""Which posts are about an event."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenry.operators import posts as P

CASES = {
    "ＰＲＯＦＩＬＥ ０１ 会場": "non_event", "自己紹介": "non_event", "アンチ コンプリート": "non_event", "御礼 ライブ": "non_event", "ニックネーム サイン 日付 コメント": "non_event", "ニックネーム サイン ライブ": "needs_review",
    "グッズ新発売": "non_event", "グッズ tiget.net ライブ": "needs_review", "ありがとう ライブ": "non_event", "ありがとう チケット": "needs_review", "お知らせです": "non_event", "お知らせ ライブ": "needs_review",
    "本日は こちら": "needs_review", "ライブ": "needs_review", "hello": "non_event",
}


def test_bare_texts(spark):
    none = F.lit(None).cast("string")
    df = spark.createDataFrame(list(enumerate(CASES)), "k long, text string").withColumns({c: none for c in ("event_name", "venue", "ticket_url", "event_date")} | {"has_time": F.lit(False), "has_performance": F.lit(False)})
    got = {r.k: r for r in P.classify(df).collect()}
    assert {t: got[k].classification for k, t in enumerate(CASES)} == CASES
    assert got[0].source_kind == "other"


def test_structure_decides(spark):
    rows = [(1, "ライブ", "2026-06-01", "a", None, None, False), (2, "ライブ", None, None, None, "https://tiget.net/1", False), (3, "訂正", "2026-06-01", None, None, None, False), (4, "ライブ 公演", None, None, "v", None, False), (5, "x", "2026-06-01", None, "v", None, True)]
    df = spark.createDataFrame(rows, "k long, text string, event_date string, event_name string, venue string, ticket_url string, has_time boolean").withColumn("has_performance", F.lit(False))
    got = {r.k: (r.classification, r.classification_confidence) for r in P.classify(df).collect()}
    assert got == {1: ("event", "high"), 2: ("needs_review", "low"), 3: ("needs_review", "low"), 4: ("event", "medium"), 5: ("event", "high")}


def test_members_are_a_parameter(spark):
    from lumenry.operators import publish as R

    texts = {1: "Hello\nMinami Aoi", 2: "Minami Aoi ライブ 出演", 3: "we like minami aoi", 4: "profile 3\nx", 5: "plain"}
    df = spark.createDataFrame(list(texts.items()), "k int, text string").withColumns({**{c: F.lit(None).cast("string") for c in ("event_date", "event_name", "venue", "ticket_url")}, "has_time": F.lit(False), "has_performance": F.lit(False)})
    told = lambda members: {r.k: (r.classification, r.classification_confidence) for r in P.classify(df, members=members).collect()}
    assert told(("Minami Aoi",))[1] == told(("Minami Aoi",))[3] == told(())[4] == ("non_event", "high") and told(("Minami Aoi",))[2][0] == "needs_review"
    events = df.withColumns({"event_name": F.col("text"), "event_date": F.lit("2026-06-01"), "venue": F.lit("Hall"), "start_time": F.lit("18:00"), **{c: F.lit(None).cast("string") for c in ("open_time", "performance_time", "benefit_time", "general_price", "notes")}})
    bad = {r.k for r in events.filter(F.size(R.readiness_reasons(events, ("Minami Aoi",))) > 0).collect()}
    assert bad == {1, 3, 4}
