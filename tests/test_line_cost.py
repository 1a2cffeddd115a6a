"""What reading a line costs: no errors raised and caught, no generator that interprets what it is given, no pattern per word."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lumenry.functions import dates as D
from lumenry.functions import text as T
from lumenry.operators import posts as P
from lumenry.operators import sale_scan as S

DAY = dt.date(2024, 5, 1)


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_days_are_read_without_casts_that_fail(spark):
    texts = {"": None, "x": None, "7/1 20:00": dt.date(2024, 7, 1), "7月1日": dt.date(2024, 7, 1), "1.5": dt.date(2025, 1, 5), "2024/2/30": None, "2023/2/29": None, "2026-3-4": dt.date(2026, 3, 4), "0/5": None, "12/251": None, None: None}
    df = spark.createDataFrame([(t, DAY) for t in texts], "t string, d date").repartition(1)
    told = df.select("t", D.event_date(F.col("t"), F.col("d")).alias("day"))
    assert "try_cast" not in _plan(told)
    got = {r.t: r.day for r in told.collect()}
    assert got == texts


def test_once_leaves_nothing_for_the_generator(spark):
    df = spark.range(3).select(F.col("id").cast("string").alias("t"))
    told = T.once(df, {"a": F.regexp_replace("t", "1", "x"), "b": F.upper("t")})
    line = next(x for x in _plan(told).splitlines() if "Generate" in x)
    assert "regexp_replace" not in line and "upper" not in line
    assert sorted((r.t, r.a) for r in told.collect()) == [("0", "0"), ("1", "x"), ("2", "2")]


def test_words_are_sought_as_they_are(spark):
    df = spark.createDataFrame([("a.c",), ("abc",), ("",), (None,)], "t string")
    told = df.select("t", T.any_of(F.col("t"), ("a.c", "x|")).alias("any"), P.first_of(F.col("t"), (("1", ("zz",)), ("2", ("b", "c")), ("3", ("a",))), "none").alias("code"), P.first_of(F.col("t"), (("1", ("b",)),)).alias("open"))
    assert "RLIKE" not in _plan(told)
    assert [(r["any"], r.code, r.open) for r in told.collect()] == [(True, "2", None), (False, "2", "1"), (False, "none", None), (None, "none", None)]


def test_equal_periods_once(spark):
    period = "struct<" + S.PERIOD + ">"
    rows = [("抽選", None, "一般", "a", None), ("抽選", "", "一般", "a", ""), ("抽選", "一般", "VIP", "a", None), (None, "一般", "一般", "a", None), ("抽選", "一般a", "一般", "", None), ("抽選", "一般", "一般", "b", None)]
    cells = [{"sale_type": k, "ticket_name": n, "ticket_tier": t, "start_at": s, "deadline_at": e} for k, n, t, s, e in rows]
    df = spark.createDataFrame([([{**{c: None for c in S.NAMES}, **x, "price": i} for i, x in enumerate(cells)],), ([],), (None,)], f"p array<{period}>")
    assert [r.p if r.p is None else [x.price for x in r.p] for r in df.select(S._each_once(F.col("p")).alias("p")).collect()] == [[0, 3, 4, 5], [], None]


def test_classes_are_worked_out_once(spark):
    cells = {c: F.lit(None).cast("string") for c in P.FEATURES[:4]} | {c: F.lit(False) for c in P.FEATURES[4:]}
    posts = spark.createDataFrame([("ライブ 公演 チケット",), ("御礼",), (None,)], "text string").withColumns(cells)
    told = P.classify(posts)
    assert told.columns == [*posts.columns, "classification", "classification_confidence", "source_kind"]
    kept = told.filter("classification <> 'non_event'")
    assert not [x for x in _plan(kept).splitlines() if "Filter" in x and "御礼" in x]
    assert sorted((r.text or "", r.classification) for r in told.collect()) == [("", "non_event"), ("ライブ 公演 チケット", "needs_review"), ("御礼", "non_event")]
