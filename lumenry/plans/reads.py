"""Queries of prices and times in single lines, of rows in their orders, of samples, and of published files read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import details as X
from ..operators import extract as E
from ..operators import posts as P
from ..operators import report as Q
from ..sources import sinks as W
from ..sources import state as K
from ..sources.shared import shared_folder
from .catalog import _DAYS, _SCHEDULE, _days, _query
from .synth import all_kinds, all_kinds_sql, digit, digit_sql, schedule, table

# Lines of a post about its price ({} stands for the amount), with the prices that they tell of: (general, priority), P for the amount.
_PRICES = (
    ("料金：無料", "0", "NULL"), ("入場 無料", "0", "NULL"), ("観覧無料ライブ", "0", "NULL"), ("PRICE: FREE", "0", "NULL"), ("前売：¥0", "0", "NULL"), ("優先：無料", "NULL", "0"),
    ("料金：¥{}", "P", "NULL"), ("¥{}（前売）", "P", "NULL"), ("free drink", "NULL", "NULL"), ("料金：0円", "0", "NULL"), ("無料の日です", "NULL", "NULL"), ("入場料：¥0", "0", "NULL"),
    ("一般 無料 / 優先：¥{}", "0", "P"), ("販売方式：無料公演", "0", "NULL"), ("チケット代 {}円", "P", "NULL"), ("料金：一般は無料", "0", "NULL"),
)


@_query("SELECT event_id AS post_id, " + ", ".join(f"CASE d {' '.join(f'WHEN {k} THEN {told[c].replace(chr(80), chr(112)) if told[c] == chr(80) else told[c]}' for k, told in enumerate(_PRICES))} END AS {name}" for c, name in ((1, "general_price"), (2, "priority_price"))) + f" FROM (SELECT event_id, general_price AS p, {digit_sql('event_id', 1)} AS d FROM {_SCHEDULE})")
def free_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of tickets of a kind, of all tickets, and of what isn't a ticket, free or not."""
    s = schedule(spark, sf_dir)
    line = F.element_at(F.array(*[F.replace(F.lit(told), F.lit("{}"), F.col("general_price").cast("string")) for told, _, _ in _PRICES]), digit(F.col("event_id"), 1).cast("int") + 1)
    posts = s.select(F.col("event_id").alias("post_id"), F.concat(F.lit("NEXT LIVE\n"), line).alias("text"), (F.col("posted_day").cast("timestamp") + F.expr("INTERVAL 3 HOURS")).alias("posted_at"))
    return X.with_details(E.extract(posts, only=("general_price", "priority_price")), only=()).select("post_id", "general_price", "priority_price")


_H, _M = digit_sql("event_id", 1), digit_sql("event_id", 2)


@_query(f"""SELECT event_id AS post_id, lpad(CAST(6 + {_H} AS VARCHAR), 2, '0') || ':' || lpad(CAST(10 + {_M} AS VARCHAR), 2, '0') || '-' || lpad(CAST(7 + {_H} AS VARCHAR), 2, '0') || ':00' AS performance_time,
 CASE WHEN {_M} < 8 THEN lpad(CAST(8 + {_H} AS VARCHAR), 2, '0') || ':30' END AS benefit_time, '05:00' AS open_time, '05:30' AS start_time FROM {_SCHEDULE}""")
def context_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of the act's part and of the meeting after it; lines about doors and beginning tell of neither, whatever they name."""
    h, m = digit(F.col("event_id"), 1), digit(F.col("event_id"), 2)
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    text = F.concat_ws(
        "\n", F.lit("NEXT LIVE"), F.lit("開場 05:00 / 開演 05:30"), F.lit("開演後すぐ出番 05:45 開場前特典会 04:00"),
        F.concat(F.lit("出番："), two(6 + h), F.lit(":"), two(10 + m), F.lit("〜"), two(7 + h), F.lit(":00")), F.when(m < 8, F.concat(F.lit("特典会 "), two(8 + h), F.lit("時30分〜"))),
    )
    posts = schedule(spark, sf_dir).select(F.col("event_id").alias("post_id"), text.alias("text"), (F.col("posted_day").cast("timestamp") + F.expr("INTERVAL 3 HOURS")).alias("posted_at"))
    told = ("performance_time", "benefit_time", "open_time", "start_time")
    return E.extract(posts, only=told).select("post_id", *told)


@_query(f"SELECT count(*) AS posts_fetched, count(*) FILTER (WHERE NOT starts_with(class, 'non_event')) AS posts_parsed, count(*) FILTER (WHERE starts_with(class, 'non_event')) AS non_event_skipped, count(*) FILTER (WHERE starts_with(class, 'needs_review')) AS to_review FROM {all_kinds_sql()}")
def post_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run tells of its posts: how many came, how many were read, how many are about no event."""
    return Q.post_counts(P.classify(E.extract(all_kinds(spark, sf_dir), only=P.FEATURES)))


@_query("SELECT event_id, row_number() OVER (ORDER BY day NULLS FIRST, event_id) AS position FROM (SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN date_trunc('day', ts) END AS day FROM events)")
def state_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State as it is listed: by day, rows without one first, then by id; the place of each."""
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 10 != 0, F.date_trunc("day", "ts")).alias("at"))
    return W.positioned(rows, K.state_order("at", "event_id")).select("event_id", "position")


@_query("""SELECT post_id, row_number() OVER (ORDER BY CASE WHEN post_id NOT LIKE 'p%' THEN CAST(post_id AS BIGINT) END DESC NULLS LAST, posted_at DESC, post_id DESC) AS position
 FROM (SELECT CASE WHEN event_id % 3 = 0 THEN 'p' ELSE '' END || event_id AS post_id, ts AS posted_at FROM events)""")
def record_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as an archive holds them: numeric ids first, the largest first, then the latest."""
    post = F.concat(F.when(F.col("event_id") % 3 == 0, "p").otherwise(""), F.col("event_id").cast("string"))
    rows = table(spark, sf_dir, "events").select(post.alias("post_id"), F.col("ts").alias("posted_at"))
    return W.positioned(rows, K.record_order()).select("post_id", "position")


@_query("SELECT CAST(event_id AS VARCHAR) AS post_id, event_type FROM events WHERE event_id > (SELECT max(event_id) // 2 FROM events) ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC LIMIT 100")
def newest_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest hundred posts of ids above the cursor: a page of the archive, so its size is what it is."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("post_id"), F.col("ts").alias("posted_at"), "event_type")
    since = rows.agg(F.floor(F.max(F.col("post_id").cast("long")) / 2).cast("string").alias("since")).first().since
    return K.newest(rows, since, 100).select("post_id", "event_type")


@_query(f"SELECT event_id, row_number() OVER (ORDER BY d.deadline_day NULLS LAST, s.event_day NULLS LAST, event_name, venue, event_id) AS position FROM {_SCHEDULE} JOIN (SELECT event_id, deadline_day FROM {_DAYS}) d USING (event_id)")
def page_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page sorted by deadline: events without one after all others."""
    days = _days(spark, sf_dir).select("event_id", "deadline_day")
    rows = schedule(spark, sf_dir).select("event_id", "event_day", "event_name", "venue").join(days, "event_id")
    return W.positioned(rows, Q.page_order("deadline")).select("event_id", "position")


@_query("SELECT c_custkey, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 100")
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample to look at, written as JSON without secret-like fields and read back: a hundred rows, as a sample is."""
    where = shared_folder(spark, "sample")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.md5("c_name").alias("access_token"))
    K.write_samples(rows, where, ["c_custkey"])
    return spark.read.json(where).select("c_custkey", "c_mktsegment")


@_query("""SELECT c_custkey, c_mktsegment, CAST(NULL AS VARCHAR) AS error FROM customer WHERE (c_custkey // 100) % 5 <> 0
 UNION ALL SELECT NULL, NULL, 'malformed JSON' FROM (SELECT DISTINCT c_custkey // 100 AS piece FROM customer) WHERE piece % 5 = 0""")
def public_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published files, an array of rows each, read back; one that is cut off is an error and gives no rows."""
    where = shared_folder(spark, "public")
    piece = F.floor(F.col("c_custkey") / 100)
    rows = table(spark, sf_dir, "customer").groupBy(piece.alias("piece")).agg(F.to_json(F.collect_list(F.struct("c_custkey", "c_mktsegment"))).alias("value"))
    whole = F.when(F.col("piece") % 5 == 0, F.left("value", F.length("value") - 2)).otherwise(F.col("value"))
    rows.select(whole.alias("value")).write.option("maxRecordsPerFile", 1).text(where)
    read, errors = K.read_public(spark, where, "c_custkey long, c_mktsegment string")
    return read.withColumn("error", F.lit(None).cast("string")).unionByName(errors.select("error"), allowMissingColumns=True)
