"""The schedule engine's queries over the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..operators import extract as X
from ..operators import match as M
from ..operators import merge as G
from ..operators import periods as S
from ..operators import posts as P
from ..operators import publish as R
from ..operators import report as Q
from ..operators import sales as L
from ..sources import sinks as W
from ..sources import state as K
from ..sources.shared import parts, shared_folder
from ..streaming import sync as Y
from .synth import all_kinds, all_kinds_sql, first_of_sql, posts, schedule, table, with_words

FLAGSHIP = "public_schedule"
QUERIES: dict = {}
SQL: dict[str, str] = {}
TODAY = "1998-06-10"
_SCHEDULE = """(SELECT o_orderkey AS event_id, CAST(o_orderdate AS DATE) AS event_day,
 c_mktsegment || ' NIGHT ' || substr(md5(CAST(o_custkey AS VARCHAR)), 1, 16) AS event_name, 'Hall ' || c_nationkey AS venue,
 CAST(floor(o_totalprice) AS INTEGER) AS general_price, CAST(floor(o_totalprice + 1500) AS INTEGER) AS priority_price,
 o_orderstatus, o_custkey, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey) s"""


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _today():
    return F.to_date(F.lit(TODAY))


@_query(f"""SELECT event_id || ':' || event_day AS id, CAST(event_day AS VARCHAR) AS event_date, event_name, venue,
 'OPEN 17:30 / START 18:00' AS times, '一般 ' || format('{{:,}}', general_price) || '円 / 優先 ' || format('{{:,}}', priority_price) || '円' AS tickets,
 'https://ticketdive.com/event/' || event_id || '?utm_source=x' AS ticket_url FROM {_SCHEDULE}""")
def public_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts to published rows: extract, keep what is ready, one row a day."""
    read = ("event_date", "event_name", "venue", "open_time", "start_time", "performance_time", "benefit_time", "ticket_url", "general_price", "priority_price", "same_day_price", "sales")
    df = X.extract(posts(spark, sf_dir), only=read).withColumnRenamed("post_id", "event_id")
    ready = df.filter(F.size(R.readiness_reasons(df)) == 0)
    return R.web_rows(R.occurrences(ready))


@_query(f"""SELECT event_id AS post_id, event_day AS event_date, event_name, venue, '17:30' AS open_time, '18:00' AS start_time,
 general_price, priority_price, 'initial_announcement' AS source_kind, 0.9 AS confidence FROM {_SCHEDULE}""")
def extract_event_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = X.extract(posts(spark, sf_dir), only=("event_date", "event_name", "venue", "open_time", "start_time", "general_price", "priority_price", "source_kind", "confidence"))
    names = ("post_id", "event_date", "event_name", "venue", "open_time", "start_time", "general_price", "priority_price", "source_kind")
    return df.select(*names, F.round(F.col("confidence"), 2).alias("confidence"))


@_query(f"""SELECT event_id AS post_id, '一般' AS ticket_tier, general_price AS price FROM {_SCHEDULE}
 UNION ALL SELECT event_id, '優先', priority_price FROM {_SCHEDULE}""")
def extract_price_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = posts(spark, sf_dir).select("post_id", X.price_tiers(T.lines(F.col("text"))).alias("tickets"))
    return df.select("post_id", F.explode("tickets").alias("t")).select("post_id", "t.ticket_tier", "t.price")


@_query(f"""SELECT event_id AS post_id, '抽選' AS sale_type, CAST(event_day AS TIMESTAMP) - INTERVAL 9 DAY + INTERVAL 3 HOUR AS start_at,
 CAST(event_day AS TIMESTAMP) - INTERVAL 5 DAY + INTERVAL 990 MINUTE AS deadline_at FROM {_SCHEDULE}""")
def extract_sale_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of sale periods; 25:30 is half past one of the next day."""
    df = posts(spark, sf_dir).select("post_id", X.sale_periods(T.lines(F.col("text")), D.local_date(F.col("posted_at"))).alias("sales"))
    return df.select("post_id", F.explode("sales").alias("s")).select(
        "post_id", "s.sale_type", F.col("s.start_at").cast("timestamp_ntz").alias("start_at"), F.col("s.deadline_at").cast("timestamp_ntz").alias("deadline_at")
    )


@_query("""SELECT o_orderkey, CASE WHEN month(d) = 2 AND day(d) = 29 AND year(d) > year(d - k) THEN NULL ELSE d END AS event_date
 FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderkey % 300 AS INTEGER) AS k FROM orders)""")
def infer_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month and day of each order's date, read with a posting day up to 300 days before it."""
    day = F.to_date("o_orderdate")
    posted = F.date_sub(day, F.pmod("o_orderkey", F.lit(300)).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", D.event_date(F.date_format(day, "M月d日"), posted).alias("event_date"))


@_query("""SELECT o_orderkey, CAST(unnest(generate_series(CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INTEGER), INTERVAL 1 DAY)) AS DATE) AS event_date FROM orders""")
def expand_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    last = F.date_add(day, F.pmod("o_orderkey", F.lit(5)).cast("int"))
    text = F.concat(F.date_format(day, "M/d"), F.lit("(土)〜"), F.date_format(last, "M/d"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(D.event_dates(text, day)).alias("event_date"))


@_query("""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '[?&]utm_[^&]*', ''), '/+$', ''), '/+[?]', '?') AS url_key FROM pages""")
def normalize_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.url_key(F.col("url")).alias("url_key"))


@_query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?:]+)', 1) AS host,
 regexp_matches(url, '^[a-z]+://[^?]*/tickets?(/|$)') OR regexp_matches(regexp_extract(url, '^[a-z]+://([^/?:]+)', 1), '(^|[.])(tiget[.]net|eplus[.]jp)$') AS is_ticket,
 regexp_matches(regexp_extract(url, '^[a-z]+://([^/?:]+)', 1), '(^|[.])(youtube[.]com|youtu[.]be)$') AS is_streaming FROM pages""")
def url_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", P.host(url).alias("host"), P.is_ticket_url(url).alias("is_ticket"), P.is_streaming_url(url).alias("is_streaming"))


@_query("""SELECT p_partkey, replace(lower(p_name), ' ', '') AS name_key, replace(replace(replace(lower(p_brand || ' / ' || p_type), ' ', ''), '/', ''), '-', '') AS venue_key FROM part""")
def normalize_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey", T.name_key(F.col("p_name")).alias("name_key"), T.venue_key(F.concat_ws(" / ", "p_brand", "p_type")).alias("venue_key")
    )


@_query(r"""SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY md5(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', '', 'g'))""")
def casefold_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each folded text; a digest is the key, so texts aren't shuffled."""
    key = F.md5(T.folded(F.col("text"), compose=False))
    return table(spark, sf_dir, "documents").select("doc_id", key.alias("k")).groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).drop("k")


@_query(f"SELECT doc_id, {first_of_sql('lower(text)', 'doc_id', P.KINDS, 2, chr(39) + 'other' + chr(39))} AS source_kind FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def source_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents with words of up to eight kinds put after them: the first kind that is told of."""
    told = T.once(table(spark, sf_dir, "documents").select("doc_id", "text"), {"text": with_words(F.col("text"), F.col("doc_id"), P.KINDS, 2)})
    return told.select("doc_id", P.source_kind(F.col("text")).alias("source_kind"))


@_query(f"SELECT event_id AS post_id, split_part(class, ' ', 1) AS classification, split_part(class, ' ', 2) AS classification_confidence FROM {all_kinds_sql()}")
def classify_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts that give or leave out each field and say what speaks for or against an event: read, then classified."""
    return P.classify(X.extract(all_kinds(spark, sf_dir), only=P.FEATURES)).select("post_id", "classification", "classification_confidence")


@_query(f"""SELECT event_id, array_to_string(list_filter([CASE WHEN event_id % 7 = 0 THEN 'missing event_date' END, CASE WHEN event_id % 5 = 0 THEN 'missing event_name' END,
 CASE WHEN event_id % 3 = 0 AND event_id % 4 = 0 THEN 'missing venue and no strong live structure' END,
 CASE WHEN event_id % 7 <> 0 AND event_id % 5 <> 0 AND event_id % 3 = 0 AND event_id % 4 = 0 THEN 'insufficient live structure' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM {_SCHEDULE}""")
def public_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = lambda n: F.pmod("event_id", F.lit(n)) != 0
    df = schedule(spark, sf_dir).select(
        "event_id", F.when(k(7), F.col("event_day")).alias("event_date"), F.when(k(5), F.col("event_name")).alias("event_name"),
        F.when(k(3), F.col("venue")).alias("venue"), F.when(k(4), F.col("general_price")).alias("general_price"),
    )
    return df.select("event_id", F.array_join(R.readiness_reasons(df), "; ").alias("reasons"))


@_query(f"""SELECT event_id, array_to_string(list_filter([CASE WHEN event_id % 5 = 0 THEN 'missing event_name' END, CASE WHEN event_id % 3 = 0 THEN 'missing venue' END,
 CASE WHEN event_id % 2 = 0 AND o_orderstatus <> 'F' AND event_id % 11 <> 0 THEN 'missing ticket deadline' END, CASE WHEN event_id % 7 = 0 OR event_id % 13 = 0 THEN 'likely image-dependent' END, CASE WHEN event_id % 10 BETWEEN 1 AND 7 THEN 'ambiguous event match' END,
 CASE WHEN event_id % 13 = 0 THEN 'classification: likely image' WHEN event_id % 17 = 0 THEN 'classification: few words' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM {_SCHEDULE}""")
def review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = lambda n: F.pmod("event_id", F.lit(n))
    df = schedule(spark, sf_dir).select(
        "event_id", F.when(k(5) != 0, F.col("event_name")).alias("event_name"), F.when(k(3) != 0, F.col("venue")).alias("venue"), F.when(k(11) == 0, 0).otherwise(F.col("general_price")).alias("general_price"),
        F.when(k(2) != 0, F.col("event_day")).alias("deadline_at"), F.when(F.col("o_orderstatus") == "F", "ended").alias("status"), (k(10) / 10).alias("match_score"),
        F.when(k(7) == 0, F.concat(F.lit("本日はこちら "), "event_name")).otherwise(F.col("event_name")).alias("source_text"), F.when(k(13) == 0, "likely image").when(k(17) == 0, "few words").alias("classification_reason"),
    )
    return df.select("event_id", F.array_join(R.review_reasons(df), "; ").alias("reasons"))


@_query("""SELECT o_orderkey AS post_id, CAST(d AS VARCHAR) || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE ',' || CAST(d + 1 AS VARCHAR) END AS days FROM (SELECT o_orderkey, CASE WHEN month(x) = 2 AND day(x) >= 27 THEN x + 3 ELSE x END AS d FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS x FROM orders))""")
def appearance_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A festival of two days; every other post tells on which of them the act appears."""
    raw = F.to_date("o_orderdate")
    day = F.when((F.month(raw) == 2) & (F.dayofmonth(raw) >= 27), F.date_add(raw, 3)).otherwise(raw)
    md = lambda n: F.date_format(F.date_add(day, n), "M/d")
    own = F.when(F.pmod("o_orderkey", F.lit(2)) == 0, F.concat(F.lit("出演日："), md(0)))
    text = F.concat_ws("\n", F.lit("NEXT LIVE"), F.concat(F.lit("日程："), md(0), F.lit("、"), md(1)), F.lit("『FES』"), own)
    posts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("post_id"), text.alias("text"), (F.date_sub(day, 20).cast("timestamp") + F.expr("INTERVAL 3 HOURS")).alias("posted_at"))
    return X.extract(posts, only=("event_dates",)).select("post_id", F.array_join(F.col("event_dates").cast("array<string>"), ",").alias("days"))


@_query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_join_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@_query("""SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, s_suppkey, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - s_acctbal), s_suppkey) AS r
 FROM customer JOIN supplier ON c_nationkey = s_nationkey) WHERE r = 1""")
def best_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier of a customer's nation with the nearest balance, ties to the smaller key."""
    left = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "nation")
    right = table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "nation")
    return M.nearest(left, right, "nation", ("c_custkey", "c_acctbal"), ("s_suppkey", "s_acctbal"))


@_query("""SELECT o_custkey AS post_id, min(o_orderkey) AS event_id, 0.9 AS score FROM orders JOIN (SELECT o_custkey AS k, max(CAST(o_orderdate AS DATE)) AS d FROM orders GROUP BY 1) m
 ON o_custkey = k AND CAST(o_orderdate AS DATE) = d JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A post of each customer about the day of its last order, matched with all orders' events."""
    s = schedule(spark, sf_dir)
    none = F.lit(None).cast("string")
    common = lambda df: df.withColumns({"ticket_url": none, "open_time": none, "start_time": none, "event_dates": F.array("event_date")})
    last = s.groupBy("o_custkey").agg(F.max(F.struct("event_day", "event_name", "venue")).alias("m"))
    new = common(last.select(F.col("o_custkey").alias("post_id"), F.col("m.event_day").alias("event_date"), F.col("m.event_name").alias("event_name"), F.col("m.venue").alias("venue"), F.lit("initial_announcement").alias("source_kind")))
    known = common(s.select("event_id", F.col("event_day").alias("event_date"), "event_name", "venue", F.lit(None).cast("array<string>").alias("post_ids")))
    return M.best_match(new, known)


@_query("""SELECT user_id, arg_max(event_type, ts) AS event_type, arg_max(value, ts) FILTER (WHERE value >= 5) AS value, count(*) AS n_updates FROM events GROUP BY user_id""")
def merge_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("value") >= 5, F.col("value")))
    return G.latest_fields(updates, "user_id", ["ts"], ["event_type", "value"])


_PERIODS = """(SELECT l_orderkey AS event_id, CAST(l_shipdate AS DATE) - 10 AS start_at, CAST(l_shipdate AS DATE) AS deadline_at,
 CASE l_returnflag WHEN 'A' THEN '抽選' WHEN 'N' THEN '一般' ELSE '当日券' END AS sale_type FROM lineitem)"""


@_query(f"""SELECT event_id, start_at, deadline_at, sale_type FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY CASE WHEN deadline_at >= DATE '{TODAY}' THEN 0 ELSE 1 END,
 CASE WHEN deadline_at >= DATE '{TODAY}' THEN CASE sale_type WHEN '抽選' THEN 1 WHEN '一般' THEN 2 ELSE 3 END ELSE 0 END, deadline_at, start_at, sale_type) AS r FROM {_PERIODS}) WHERE r = 1""")
def relevant_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("l_shipdate")
    kind = F.when(F.col("l_returnflag") == "A", "抽選").when(F.col("l_returnflag") == "N", "一般").otherwise("当日券")
    periods = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("event_id"), F.date_sub(day, 10).alias("start_at"), day.alias("deadline_at"), kind.alias("sale_type"), F.lit(None).cast("string").alias("status")
    )
    return S.relevant_period(periods, "event_id", _today()).drop("status")


@_query("SELECT DISTINCT l_orderkey, CAST(l_shipdate AS DATE) AS day FROM lineitem")
def occurrence_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.to_date("l_shipdate")).alias("event_date"), F.collect_set(F.to_date("l_shipdate")).alias("event_dates"))
    return R.occurrences(events).select("l_orderkey", "day")


@_query("""SELECT c_nationkey, c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment
 ORDER BY (CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END + CASE WHEN c_acctbal < 0 THEN 0 ELSE 1 END) DESC, c_custkey) AS r FROM customer) WHERE r = 1""")
def fullest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").withColumns({"a": F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")), "b": F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))})
    return R.fullest(df, [F.col("c_nationkey"), F.col("c_mktsegment")], ["a", "b"], [F.col("c_custkey")]).select("c_nationkey", "c_mktsegment", "c_custkey")


@_query(f"""SELECT count(*) AS n_rows, min(event_day) AS first_day, max(event_day) AS last_day, CAST(count(*) FILTER (WHERE event_id % 11 = 0) AS BIGINT) AS n_bad_rows, CAST(0 AS BIGINT) AS n_repeated_ids FROM {_SCHEDULE}""")
def validate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = schedule(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("id"), F.col("event_day").cast("string").alias("event_date"), "event_name",
        F.when(F.col("event_id") % 11 == 0, "ftp://x").otherwise("https://x").alias("ticket_url"),
    )
    return R.validation_summary(rows)


@_query("""SELECT change, count(*) AS n FROM (SELECT CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' WHEN b.v = a.v THEN 'kept' ELSE 'changed' END AS change
 FROM (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01') b FULL JOIN
 (SELECT o_orderkey AS k, CASE WHEN o_totalprice > 300000 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01') a ON a.k = b.k) GROUP BY 1""")
def diff_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    before = o.filter("o_orderdate < timestamp_ntz '1999-01-01'").select("o_orderkey", "o_orderstatus")
    after = o.filter("o_orderdate >= timestamp_ntz '1996-01-01'").select("o_orderkey", F.when(F.col("o_totalprice") > 300000, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    return R.diff_rows(before, after, "o_orderkey", ["o_orderstatus"])


_MISSING = """SELECT 'quality' AS field, count(*) FILTER (WHERE quality IS NULL) AS n_missing, count(*) AS n_rows FROM documents LEFT JOIN labels USING (doc_id)
 UNION ALL SELECT 'toxic', count(*) FILTER (WHERE toxic IS NULL), count(*) FROM documents LEFT JOIN labels USING (doc_id)
 UNION ALL SELECT 'source', count(*) FILTER (WHERE coalesce(source, '') = ''), count(*) FROM documents LEFT JOIN labels USING (doc_id)"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")


@_query(_MISSING)
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.missing_counts(_labelled(spark, sf_dir), ["quality", "toxic", "source"])


@_query(f"SELECT * FROM ({_MISSING}) WHERE n_missing > 0 ORDER BY n_missing DESC, field LIMIT 2")
def top_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.top_missing(_labelled(spark, sf_dir), ["quality", "toxic", "source"], 2)


_DAYS = "(SELECT event_id, event_day, CASE WHEN event_id % 3 <> 0 THEN event_day - 5 END AS deadline_day, CASE WHEN event_id % 4 = 0 THEN event_day - 2 END AS payment_day, o_orderstatus = 'F' AS sold_out FROM " + _SCHEDULE + ")"


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("event_day")
    return schedule(spark, sf_dir).select(
        "event_id", "event_day", F.when(F.col("event_id") % 3 != 0, F.date_sub(day, 5)).alias("deadline_day"), F.when(F.col("event_id") % 4 == 0, F.date_sub(day, 2)).alias("payment_day"), (F.col("o_orderstatus") == "F").alias("sold_out")
    )


_ENTRIES = f"SELECT event_id, 'live' AS kind, event_day AS day FROM {_DAYS} UNION ALL SELECT event_id, 'application', deadline_day FROM {_DAYS} WHERE deadline_day IS NOT NULL UNION ALL SELECT event_id, 'payment', payment_day FROM {_DAYS} WHERE payment_day IS NOT NULL"


@_query(_ENTRIES)
def calendar_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.calendar_entries(_days(spark, sf_dir)).drop("sold_out")


@_query(f"""SELECT CAST(d AS DATE) AS day, row_number() OVER (ORDER BY d) - 1 AS cell, month(d) = 6 AS in_month, count(*) FILTER (WHERE kind = 'application') AS n_application,
 count(*) FILTER (WHERE kind = 'payment') AS n_payment, count(*) FILTER (WHERE kind = 'live') AS n_live, count(DISTINCT CASE WHEN sold_out THEN e.event_id END) AS n_sold_out
 FROM (SELECT unnest(generate_series(DATE '1998-05-31', DATE '1998-07-11', INTERVAL 1 DAY)) AS d) LEFT JOIN
 (SELECT x.*, sold_out FROM ({_ENTRIES}) x JOIN {_DAYS} y USING (event_id)) e ON e.day = CAST(d AS DATE) GROUP BY d""")
def calendar_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.month_grid(Q.calendar_entries(_days(spark, sf_dir)), 1998, 6)


@_query(f"""SELECT CASE WHEN deadline_day = DATE '{TODAY}' THEN 'today' WHEN deadline_day = DATE '{TODAY}' + 1 THEN 'tomorrow' ELSE 'missing' END AS bucket, event_id
 FROM {_DAYS} WHERE deadline_day IN (DATE '{TODAY}', DATE '{TODAY}' + 1) OR (deadline_day IS NULL AND event_day >= DATE '{TODAY}')""")
def deadline_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.deadline_alerts(_days(spark, sf_dir), _today())


@_query(" UNION ALL ".join(
    f"SELECT '{w}' AS filter, event_id, CASE WHEN event_day < DATE '{TODAY}' THEN 'past' WHEN event_day = DATE '{TODAY}' THEN 'today' WHEN event_day = DATE '{TODAY}' + 1 THEN 'tomorrow' WHEN event_day <= DATE '{TODAY}' + 3 THEN 'soon' ELSE 'later' END AS urgency FROM {_DAYS} WHERE {c}"
    for w, c in (("upcoming", f"event_day >= DATE '{TODAY}'"), ("week", f"event_day >= DATE '{TODAY}' AND event_day < DATE '{TODAY}' + 7"), ("month", f"event_day >= DATE '{TODAY}' AND event_day < DATE '1998-07-01'"), ("missing_deadline", f"deadline_day IS NULL AND event_day >= DATE '{TODAY}'"))
))
def serve_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _days(spark, sf_dir)
    parts = [Q.shown(days, w, _today()).select(F.lit(w).alias("filter"), "event_id", Q.urgency(F.datediff("event_day", _today())).alias("urgency")) for w in ("upcoming", "week", "month", "missing_deadline")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@_query(f"SELECT event_day, array_to_string(list_sort(list(event_id)), ',') AS event_ids, count(*) AS n FROM {_SCHEDULE} GROUP BY 1")
def grouped_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.grouped_by_day(schedule(spark, sf_dir)).select("event_day", F.array_join(F.col("event_ids").cast("array<string>"), ",").alias("event_ids"), "n")


@_query("""SELECT count(*) FILTER (WHERE NOT old) AS n_added, count(*) FILTER (WHERE old AND new AND changed) AS n_updated, count(*) FILTER (WHERE old AND NOT (new AND changed)) AS n_kept
 FROM (SELECT ts < TIMESTAMP '2024-01-20' AS old, ts >= TIMESTAMP '2024-01-10' AS new, value > 50 AS changed FROM events) WHERE old OR new""")
def archive_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    old = e.filter("ts < timestamp_ntz '2024-01-20'").select("event_id", "event_type")
    new = e.filter("ts >= timestamp_ntz '2024-01-10'").select("event_id", F.when(F.col("value") > 50, "changed").otherwise(F.col("event_type")).alias("event_type"))
    return K.archive_merge(old, new, "event_id", ["event_type"])[1]


@_query("SELECT CAST(max(event_id) AS VARCHAR) AS cursor FROM events")
def cursor_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.cursor(table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("post_id")))


@_query("SELECT event_id, CASE WHEN event_id IN (SELECT doc_id FROM labels) THEN 'new' ELSE event_type END AS state FROM events UNION ALL SELECT doc_id, 'new' FROM labels WHERE doc_id NOT IN (SELECT event_id FROM events)")
def upsert_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("state"))
    return K.upserted(old, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("event_id"), F.lit("new").alias("state")), "event_id")


@_query("""SELECT conv_id AS post_id, string_agg(turn || '=' || role, ',' ORDER BY turn) AS attached FROM conversations GROUP BY 1""")
def media_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("media_key", F.concat_ws("-", "conv_id", "turn"))
    held = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "media_key"))).alias("m")).select(F.col("conv_id").alias("post_id"), F.col("m.media_key").alias("media_keys"))
    out = K.attach_media(held, c.select("media_key", F.concat_ws("=", "turn", "role").alias("url")))
    return out.select("post_id", F.array_join(F.transform("attached", lambda a: a["url"]), ",").alias("attached"))


@_query()
def similarity_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.similarity(F.lower("p_name"), F.lower(F.concat_ws(" ", "p_type", "p_name"))).alias("ratio"))


@_query("SELECT user_id, count(*) AS n_updates, arg_max(event_type, ts) AS event_type FROM events GROUP BY 1")
def stream_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream, each id once, merged batch by batch into a kept state; then the state's latest rows."""
    where = shared_folder(spark, "sync")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = Y.each_once(Y.read_files(spark, f"{sf_dir}/events.parquet*", schema), "event_id", "ts")
    # a batch that is handed over again overwrites what it wrote before
    query = Y.sync(stream, f"{where}/checkpoint", lambda df, n: df.write.mode("overwrite").parquet(f"{where}/state/batch={n}"))
    query.awaitTermination()
    return G.latest_fields(spark.read.parquet(f"{where}/state"), "user_id", ["ts"], ["event_type"]).select("user_id", "n_updates", "event_type")


_SALES = """(SELECT l_orderkey AS event_id, CASE l_returnflag WHEN 'A' THEN '抽選' WHEN 'N' THEN '一般' ELSE '当日券' END AS sale_type, l_linestatus AS ticket_name,
 CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_shipdate AS DATE) END AS deadline_at, CASE WHEN l_quantity > 10 THEN CAST(l_quantity AS INTEGER) END AS price,
 CASE WHEN l_quantity < 25 THEN 'on_sale' ELSE '不明' END AS status, CASE l_linenumber % 3 WHEN 0 THEN '一般' WHEN 1 THEN '優先' ELSE '不明' END AS ticket_tier, l_linenumber AS n, l_partkey AS p FROM lineitem) x"""


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "抽選").when(F.col("l_returnflag") == "N", "一般").otherwise("当日券")
    tier = F.element_at(F.array(F.lit("一般"), F.lit("優先"), F.lit("不明")), F.col("l_linenumber") % 3 + 1)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("event_id"), kind.alias("sale_type"), F.col("l_linestatus").alias("ticket_name"), F.lit(None).cast("date").alias("start_at"),
        F.when(F.col("l_linenumber") % 2 == 0, F.to_date("l_shipdate")).alias("deadline_at"), F.when(F.col("l_quantity") > 10, F.col("l_quantity").cast("int")).alias("price"),
        F.when(F.col("l_quantity") < 25, "on_sale").otherwise("不明").alias("status"), tier.alias("ticket_tier"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"),
    )


@_query(f"""SELECT event_id, sale_type, ticket_name, deadline_at, arg_max(price, (n, p, price)) FILTER (WHERE price IS NOT NULL) AS price,
 CASE WHEN count(*) FILTER (WHERE status <> '不明') > 0 THEN 'on_sale' END AS status, count(*) AS n_posts FROM {_SALES} GROUP BY 1, 2, 3, 4""")
def period_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as posts about sale periods, in order of line and part."""
    return L.upserted_periods(_sales(spark, sf_dir), "event_id", ["n", "p"], ["price", "status"]).drop("start_at")


@_query(f"""SELECT event_id, ticket_tier, count(*) AS n, max(coalesce(price, twin_price)) AS price FROM (SELECT *, max(CASE WHEN deadline_at IS NULL THEN price END) OVER w AS twin_price,
 max(CASE WHEN deadline_at IS NOT NULL THEN 1 ELSE 0 END) OVER w AS twin FROM {_SALES} WINDOW w AS (PARTITION BY event_id, ticket_tier)) WHERE deadline_at IS NOT NULL OR twin = 0 GROUP BY 1, 2""")
def period_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.without_dateless_twins(_sales(spark, sf_dir), "event_id", parts(spark.read.parquet(f"{sf_dir}/lineitem.parquet")))
    return out.groupBy("event_id", "ticket_tier").agg(F.count("*").alias("n"), F.max("price").alias("price"))


@_query(f"""SELECT event_id, sale_type, deadline_at FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY CASE sale_type WHEN '抽選' THEN 1 WHEN '一般' THEN 2 ELSE 4 END, deadline_at NULLS LAST) AS r FROM {_SALES}) WHERE r = 1""")
def selected_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.selected_period(_sales(spark, sf_dir), "event_id").select("event_id", "sale_type", "deadline_at")


@_query(f"""SELECT event_id, count(*) AS n, min(CASE WHEN deadline_at >= DATE '{TODAY}' THEN deadline_at END) AS next_deadline, CAST(max(CASE WHEN deadline_at >= DATE '{TODAY}' THEN 1 ELSE 0 END) AS BIGINT) AS n_next,
 count(*) FILTER (WHERE status = 'on_sale') AS n_on_sale FROM {_SALES} GROUP BY 1""")
def next_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.with_next_flag(_sales(spark, sf_dir), "event_id", _today())
    return out.groupBy("event_id").agg(
        F.count("*").alias("n"), F.min(F.when(F.col("is_next_deadline"), F.col("deadline_at"))).alias("next_deadline"), F.count_if("is_next_deadline").alias("n_next"), F.count_if(F.col("status_label") == "販売中").alias("n_on_sale")
    )


@_query(f"""SELECT event_id, ticket_tier, count(*) AS n, sum(price) AS prices FROM (
 SELECT event_id, ticket_tier, price FROM {_SALES} WHERE NOT (ticket_tier = '不明' AND deadline_at IS NOT NULL) UNION ALL
 SELECT a.event_id, coalesce(t.ticket_tier, a.ticket_tier), coalesce(t.price, a.price) FROM (SELECT * FROM {_SALES} WHERE ticket_tier = '不明' AND deadline_at IS NOT NULL) a
 LEFT JOIN (SELECT event_id, ticket_tier, min(price) AS price FROM {_SALES} WHERE ticket_tier <> '不明' AND price IS NOT NULL GROUP BY 1, 2) t ON t.event_id = a.event_id) GROUP BY 1, 2""")
def tier_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = _sales(spark, sf_dir)
    tickets = sales.filter("ticket_tier <> '不明' and price is not null").groupBy("event_id", "ticket_tier").agg(F.min("price").alias("price"))
    return L.tier_expanded(sales, tickets, "event_id").groupBy("event_id", "ticket_tier").agg(F.count("*").alias("n"), F.sum("price").alias("prices"))


@_query(f"""SELECT event_id, min(CASE WHEN ticket_tier = '一般' THEN price END) AS general_price, min(CASE WHEN ticket_tier = '優先' THEN price END) AS priority_price FROM {_SALES} GROUP BY 1""")
def best_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.best_prices(_sales(spark, sf_dir), "event_id")


@_query("""SELECT coalesce(o.k, n.k) AS k, coalesce(manual, false) AS manual, CASE WHEN n.k IS NULL OR manual THEN o.name ELSE n.name END AS name, CASE WHEN n.k IS NULL THEN o.bal ELSE n.bal END AS bal
 FROM (SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal, c_custkey % 4 = 0 AS manual FROM customer) o
 FULL JOIN (SELECT s_suppkey + 10 AS k, s_name AS name, s_acctbal AS bal FROM supplier) n ON o.k = n.k""")
def sheet_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), (F.col("c_custkey") % 4 == 0).alias("manual"))
    new = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 10).alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    return W.sheet_upsert(old, new, ["k"], ["name"])


@_query("""SELECT p_partkey, CASE WHEN length(p_name || ' ' || p_type) > 12 THEN substr(p_name || ' ' || p_type, 1, 11) || '…' ELSE p_name || ' ' || p_type END AS short,
 length(p_name) + CASE WHEN p_name LIKE '% %' THEN 3 ELSE 0 END AS richness,
 '{"name":{"title":[{"text":{"content":"' || p_name || '"}}]},"brand":{"select":{"name":"' || CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN p_brand ELSE 'Brand#1' END || '"}},"size":{"number":' || p_size || '}}' AS properties FROM part""")
def display_and_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortened labels, richness of names and the typed properties that a document store takes."""
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), "p_type")
    payload = W.properties(df, {"name": "title", "brand": "select", "size": "number"}, {"brand": ["Brand#1", "Brand#2"]})
    return df.select("p_partkey", W.shortened(F.concat_ws(" ", "name", "p_type")).alias("short"), W.name_richness(F.col("name")).alias("richness"), payload.alias("properties"))


@_query("SELECT quality = 1 AS expected, length(text) > 500 AS actual, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2")
def labelled_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected against actual: a confusion table of a length rule and the quality labels."""
    both = table(spark, sf_dir, "documents").select("doc_id", (F.length("text") > 500).alias("actual")).join(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("expected")), "doc_id")
    return both.groupBy("expected", "actual").agg(F.count("*").alias("n"))
