"""Posts and events made of the test tables, so that what is read back from a text is known beforehand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data; one of fewer splits than there are cores is dealt anew, as costly expressions follow."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event for each order: customer (by a digest, so no two names are alike) and segment give the name, the nation the hall, the total the price."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return orders.select(
        F.col("o_orderkey").alias("event_id"),
        F.to_date("o_orderdate").alias("event_day"),
        F.date_sub(F.to_date("o_orderdate"), 10 + F.pmod("o_orderkey", F.lit(20)).cast("int")).alias("posted_day"),
        F.concat_ws(" ", "c_mktsegment", F.lit("NIGHT"), F.substring(F.md5(F.col("o_custkey").cast("string")), 1, 16)).alias("event_name"),
        F.concat(F.lit("Hall "), F.col("c_nationkey").cast("string")).alias("venue"),
        F.floor("o_totalprice").cast("int").alias("general_price"),
        F.floor(F.col("o_totalprice") + 1500).cast("int").alias("priority_price"),
        "o_orderstatus", "o_custkey", "o_orderpriority",
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An announcement of each event, posted at noon of the schedule's zone."""
    s = schedule(spark, sf_dir)
    text = F.concat_ws(
        "\n",
        F.lit("NEXT LIVE"),
        F.date_format("event_day", "M/d"),
        F.concat(F.lit("『"), F.col("event_name"), F.lit("』")),
        F.concat(F.lit("会場："), F.col("venue")),
        F.lit("OPEN 17:30 / START 18:00"),
        F.concat(F.lit("一般：¥"), F.format_number("general_price", 0), F.lit(" / 優先：¥"), F.col("priority_price").cast("string")),
        F.concat(F.lit("抽選受付："), F.date_format(F.date_sub("event_day", 9), "M/d"), F.lit(" 12:00〜"), F.date_format(F.date_sub("event_day", 5), "M/d"), F.lit(" 25:30")),
        F.concat(F.lit("https://ticketdive.com/event/"), F.col("event_id").cast("string"), F.lit("?utm_source=x")),
    )
    return s.select(F.col("event_id").alias("post_id"), text.alias("text"), (F.col("posted_day").cast("timestamp") + F.expr("INTERVAL 3 HOURS")).alias("posted_at"))


def digit(key: Column, k: int) -> Column:
    """The k-th hexadecimal digit of a key's digest, 0 to 15: what a row's text is made of is chosen by it."""
    return F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(key.cast("string")), k, 1)) - 1


def digit_sql(key: str, k: int) -> str:
    return f"(strpos('0123456789abcdef', substr(md5(CAST({key} AS VARCHAR)), {k}, 1)) - 1)"


def with_words(text: Column, key: Column, rules, share: int, write=lambda word: word) -> Column:
    """A text and, after it, a word of each rule whose digit is less than ``share``; which one, another digit says. Groups of words come whole, and without their last word by the digit after."""
    parts = [F.coalesce(text, F.lit(""))]
    for k, (_, words) in enumerate(rules, 1):
        single = [w for w in words if isinstance(w, str)]
        groups = [w for w in words if not isinstance(w, str)]
        told = F.array(*[F.lit(write(w)) for w in single or [" ".join(groups[0])]])
        parts.append(F.when(digit(key, k) < share, F.element_at(told, F.pmod(digit(key, k + len(rules)), F.size(told)).cast("int") + 1)))
        if groups and not single:
            parts.append(F.when(digit(key, k) == share, F.lit(write(" ".join(groups[0][:-1])))))
    return F.concat_ws("。\n", *parts)


def first_of_sql(text: str, key: str, rules, share: int, otherwise: str) -> str:
    """The code of the first rule whose word was put in or stands in the text itself."""
    cases = []
    for k, (code, words) in enumerate(rules, 1):
        single = [w for w in words if isinstance(w, str)]
        found = [f"contains({text}, '{w}')" for w in single] + ["(" + " AND ".join(f"contains({text}, '{x}')" for x in w) + ")" for w in words if not isinstance(w, str)]
        cases.append(f"WHEN {digit_sql(key, k)} < {share} OR {' OR '.join(found)} THEN '{code}'")
    return "CASE " + " ".join(cases) + f" ELSE {otherwise} END"


# What posts of all kinds say beside the fields that they give or leave out; the place is the digit.
PHRASES = ("プロフィール", "御礼", "グッズ", "ありがとう", "お知らせ", "本日はこちら", "タイムテーブル公開", "開演時間の訂正", "ライブ公演", "明日はこちら")


def all_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A post of each event that gives or leaves out day, name, hall, times and link, and says one of PHRASES or none, as digits of its key say."""
    s = schedule(spark, sf_dir)
    has = lambda k, share: digit(F.col("event_id"), k) < share
    text = F.concat_ws(
        "\n",
        F.get(F.array(*map(F.lit, PHRASES)), digit(F.col("event_id"), 6)),
        F.when(has(1, 10), F.date_format("event_day", "M/d")),
        F.when(has(2, 8), F.concat(F.lit("『"), F.col("event_name"), F.lit("』"))),
        F.when(has(3, 8), F.concat(F.lit("会場："), F.col("venue"))),
        F.when(has(4, 6), F.lit("OPEN 17:30 / START 18:00")),
        F.when(has(5, 4), F.concat(F.lit("https://ticketdive.com/event/"), F.col("event_id").cast("string"))),
    )
    return s.select(F.col("event_id").alias("post_id"), text.alias("text"), (F.col("posted_day").cast("timestamp") + F.expr("INTERVAL 3 HOURS")).alias("posted_at"))


def all_kinds_sql() -> str:
    """Of each such post, from what it was made of: whether it gives a day, name, hall, times, link (d, n, v, t, u), its phrase p, and the class."""
    has = ", ".join(f"CAST({digit_sql('event_id', k)} < {share} AS INTEGER) AS {name}" for k, share, name in ((1, 10, "d0"), (2, 8, "n"), (3, 8, "v"), (4, 6, "t"), (5, 4, "u")))
    flags = f"(SELECT event_id, {has}, {digit_sql('event_id', 6)} AS p FROM (SELECT o_orderkey AS event_id FROM orders JOIN customer ON o_custkey = c_custkey))"
    told = f"(SELECT *, greatest(d0, CAST(p IN (5, 9) AS INTEGER)) AS d, v + u + CASE WHEN p = 8 THEN 2 WHEN p IN (5, 6, 7, 9) THEN 1 ELSE 0 END AS positive FROM {flags})"
    return f"""(SELECT event_id, d0, n, v, t, u, p, CASE WHEN p = 0 AND v + t + u = 0 THEN 'non_event high' WHEN p = 1 THEN 'non_event high' WHEN p IN (2, 3, 4) AND v + t + u = 0 THEN 'non_event high'
 WHEN p IN (5, 9) AND v + u = 0 AND d + n + v + t + u < 3 THEN 'needs_review low' WHEN u = 1 AND d + n = 0 THEN 'needs_review low' WHEN p IN (6, 7) AND d + n + v + t + u < 2 THEN 'needs_review low'
 WHEN d + n + v + t + u >= 3 OR d = 1 AND n + v + u > 0 THEN 'event high' WHEN positive >= 2 AND d + n + v + t + u >= 1 THEN 'event medium' WHEN positive > 0 THEN 'needs_review low' ELSE 'non_event high' END AS class FROM {told})"""
