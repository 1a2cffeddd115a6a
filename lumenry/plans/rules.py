"""Further queries of the schedule engine: merge rules, published rows, details of posts, state and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..operators import details as X
from ..operators import extract as X0
from ..operators import fold as G
from ..operators import match as M
from ..operators import parse as E
from ..operators import posts as P
from ..operators import publish as R
from ..operators import report as Q
from ..operators import sale_scan as C
from ..operators import summary as U
from ..sources import archive_stream as V
from ..sources import keyed as N
from ..sources import payload as A
from ..sources import sinks as W
from ..sources import state as K
from ..sources.shared import kept, parts, shared_folder
from ..streaming import calendar as Z
from ..streaming import sync as Y
from .catalog import _DAYS, _ENTRIES, _SCHEDULE, TODAY, _days, _query
from .synth import all_kinds, all_kinds_sql, digit, first_of_sql, schedule, table, with_words

AS_OF = f"{TODAY}T00:00:00"
def _none() -> Column:
    return F.lit(None).cast("string")


def _strings(*names: str) -> dict:
    return {c: F.lit(None).cast("string") for c in names}


@_query("""SELECT a, CASE WHEN p > 1 THEN 1.0 ELSE round(p, 2) END AS score FROM (SELECT a, greatest(0.0, CASE WHEN same_url THEN 0.45 ELSE 0 END + CASE WHEN same_day THEN 0.30 ELSE -0.35 END + 0.35 + 0.25
  + CASE WHEN upd AND same_day THEN 0.15 ELSE 0 END + CASE WHEN upd AND same_url THEN 0.05 ELSE 0 END) AS p FROM
 (SELECT o_orderkey AS a, o_orderkey % 3 = b % 3 AS same_url, CAST(o_orderdate AS DATE) = d AS same_day, o_orderstatus = 'F' AS upd FROM orders JOIN
  (SELECT o_custkey AS k, min(o_orderkey) AS b, min_by(CAST(o_orderdate AS DATE), o_orderkey) AS d FROM orders GROUP BY 1) ON o_custkey = k JOIN customer ON o_custkey = c_custkey))""")
def match_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's post against the event of its customer's first order: same name and hall, other days and URLs."""
    s = schedule(spark, sf_dir).withColumns({"ticket_url": F.concat(F.lit("https://tiget.net/"), F.pmod("event_id", F.lit(3)).cast("string")), "event_date": F.col("event_day"), **_strings("open_time", "start_time"), "event_dates": F.array("event_day")})
    keyed = M.keyed(s).select("event_id", "o_custkey", "o_orderstatus", "k_name", "k_venue", "k_url", "k_dates", "open_time", "start_time")
    first = keyed.groupBy("o_custkey").agg(F.min_by(F.struct(*[c for c in keyed.columns if c != "o_custkey"]), "event_id").alias("b"))
    left = keyed.select([F.col(c).alias("a_" + c) for c in keyed.columns])
    both = left.join(first, F.col("a_o_custkey") == F.col("o_custkey")).select("*", *[F.col(f"b.{c}").alias("b_" + c) for c in keyed.columns if c != "o_custkey"])
    kind = F.when(F.col("a_o_orderstatus") == "F", "sold_out").otherwise("initial_announcement")
    return both.select(F.col("a_event_id").alias("a"), M.match_score("a_", "b_", kind, F.lit(False)).alias("score"))


#: Columns of events that these posts leave empty.
_EMPTY = ("performance_time", "benefit_time", "priority_name", "priority_price", "same_day_price", "application_start_at", "application_deadline_at", "lottery_result_at", "payment_deadline_at", "ticket_sale_type", "open_time")
_USER_POSTS = """(SELECT *, event_type = 'error' AS gone, event_type = 'signup' AS reminds, row_number() OVER (PARTITION BY user_id ORDER BY strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), lpad(CAST(event_id AS VARCHAR), 12, '0')) AS n FROM events)"""


def _user_posts(spark: SparkSession, sf_dir: str, notes: Column | None = None) -> DataFrame:
    """Each event of a user as a post about the user's own live; one kind tells that tickets are gone, one reminds. ``notes``: in place of the kind of low values."""
    e = table(spark, sf_dir, "events")
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    columns = {
        "post_id": F.lpad(F.col("event_id").cast("string"), 12, "0"), "posted_at": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "source_kind": F.when(kind == "error", "sold_out").when(kind == "signup", "same_day_reminder").otherwise("ticket_update"),
        "classification": F.lit("event"), "confidence": F.lit(0.9).cast("double"), "source_url": F.concat(F.lit("https://x.com/"), user), "text": F.lit(""),
        **_strings(*G.FROZEN, *G.OPEN), **{c: F.lit(None).cast("int") for c in ("general_price", "priority_price", "same_day_price")},
        "event_date": F.date_add(F.to_date(F.lit("2030-01-01")), F.col("user_id").cast("int")).cast("string"), "event_name": F.concat(F.lit("NIGHT "), F.md5(user)), "venue": F.concat(F.lit("Hall "), (F.col("user_id") % 9).cast("string")),
        "ticket_url": F.concat(F.lit("https://tiget.net/"), user), "general_price": F.when(F.col("value") >= 10, F.floor("value").cast("int")), "notes": F.when(F.col("value") < 20, kind) if notes is None else notes, "start_time": F.when(F.col("value") >= 60, F.lit("18:00")),
        "ticket_status": F.when(kind == "error", "sold_out"), "event_dates": F.array().cast("array<string>"), "sales": F.array().cast(f"array<struct<{G.PERIOD}>>"),
    }
    names = [c.split()[0] for c in G.POST.replace(f"array<struct<{G.PERIOD}>>", "x").split(", ")]
    return e.select([columns[c].alias(c) for c in names])


_MERGED = f"""WITH p AS (SELECT *, CAST(user_id AS VARCHAR) AS u, lpad(CAST(event_id AS VARCHAR), 12, '0') AS pid, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS posted, CASE WHEN value >= 10 THEN CAST(floor(value) AS INTEGER) END AS price,
  CASE WHEN value < 20 THEN event_type END AS note, CASE WHEN gone THEN 'sold_out' WHEN reminds THEN 'same_day_reminder' ELSE 'ticket_update' END AS kind FROM {_USER_POSTS}),
 f AS (SELECT user_id, pid AS event_id, price AS p0 FROM p WHERE n = 1),
 s AS (SELECT p.user_id, p.n, p.price FROM p WHERE n > 1 AND NOT gone AND NOT reminds AND price IS NOT NULL),
 r AS (SELECT p.user_id, min(p.n) AS n FROM p WHERE reminds AND n > 1 AND price IS NOT NULL GROUP BY 1),
 last_sure AS (SELECT user_id, arg_max(price, n) AS price FROM s GROUP BY 1),
 t AS (SELECT user_id, u, arg_max(note, n) FILTER (WHERE note IS NOT NULL) AS notes, CAST(count(*) AS INTEGER) AS n_merged, coalesce(bool_or(gone AND n > 1), false) AS needs_review, CASE WHEN bool_or(gone) THEN 'sold_out' END AS ticket_status,
  CASE WHEN max(value) >= 60 THEN '18:00' END AS start_time, arg_max(kind, n) AS latest_kind, max(posted) AS latest_posted_at, string_agg(pid, ',' ORDER BY n) AS post_ids,
  string_agg(posted || ' ' || kind || ' https://x.com/' || u, chr(10) ORDER BY n) AS source_summary, CAST(DATE '2030-01-01' + CAST(user_id AS INTEGER) AS VARCHAR) AS day FROM p GROUP BY user_id, u)
SELECT f.event_id, coalesce(last_sure.price, f.p0, (SELECT price FROM p x WHERE x.user_id = f.user_id AND x.n = r.n)) AS general_price, t.notes, t.n_merged, t.needs_review, t.ticket_status, t.start_time, t.latest_kind, t.latest_posted_at, t.post_ids, t.source_summary,
 t.day AS event_date, t.day AS event_dates, 'NIGHT ' || md5(t.u) AS event_name, 'Hall ' || (t.user_id % 9) AS venue, 'https://tiget.net/' || t.u AS ticket_url, 'https://x.com/' || t.u AS source_urls, 'https://x.com/' || t.u AS latest_source_url,
 '' AS source_text, false AS manual_override, CAST(0 AS INTEGER) AS n_sales, {", ".join(f"CAST(NULL AS VARCHAR) AS {c}" for c in _EMPTY)}
FROM f LEFT JOIN last_sure USING (user_id) LEFT JOIN r ON r.user_id = f.user_id JOIN t ON t.user_id = f.user_id"""


def _flat(events: DataFrame) -> DataFrame:
    """All columns of events, lists as texts."""
    joined = {c: F.array_join(c, ",") for c in ("post_ids", "source_urls", "event_dates")}
    return events.withColumns(joined | {"n_sales": F.size("sales")} | {c: F.col(c).cast("string") for c in _EMPTY}).drop("sales")


@_query(_MERGED)
def merge_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts folded into events: who overwrites, who only fills blanks, what a sold-out post leaves alone."""
    return _flat(G.merge_posts(_user_posts(spark, sf_dir), None, AS_OF))


@_query(_MERGED)
def merge_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same posts as a stream that is stopped and goes on, in batches of any order: the same events as in one fold."""
    where = shared_folder(spark, "merge")
    posts = kept(_user_posts(spark, sf_dir))
    half = F.pmod(F.xxhash64("post_id"), F.lit(2))
    sign = posts.limit(1).select([F.date_format(F.to_timestamp(F.lit("2100-01-01")), "yyyy-MM-dd'T'HH:mm:ss").alias(c) if c == "posted_at" else F.lit(None).cast(kind).alias(c) for c, kind in posts.dtypes])
    for rows in (posts.filter(half == 0), posts.filter(half == 1), sign):  # the last tells that time has passed
        rows.coalesce(2).write.mode("append").parquet(f"{where}/posts")
        stream = Y.read_files(spark, f"{where}/posts", posts.schema, files_per_batch=2)
        Z.place_stream(stream, F.col("ticket_url"), f"{where}/log", f"{where}/checkpoint").awaitTermination()
    return _flat(Z.events_of(spark, posts, f"{where}/log", AS_OF))


@_query("""SELECT user_id AS "group", CAST(min_by(event_id, ts) AS VARCHAR) AS event_key, arg_max(event_type, ts) AS notes, count(*) AS n_posts FROM events GROUP BY user_id""")
def merge_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All posts of a user about one event, folded in order: the last note."""
    out = G.merge_posts(_user_posts(spark, sf_dir, notes=F.col("event_type")), None, AS_OF)
    return out.select(F.substring_index("ticket_url", "/", -1).cast("long").alias("group"), F.col("event_id").cast("long").cast("string").alias("event_key"), "notes", F.size("post_ids").cast("long").alias("n_posts"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schedule as events (``fold.EVENT``): a lottery that ends five days before, and a general sale that begins then."""
    s, day = schedule(spark, sf_dir), F.col("event_day")
    at = lambda n: F.concat(F.date_sub(day, n).cast("string"), F.lit("T12:00:00"))
    empty = {c: F.lit(None).cast("string") for c in ("result_at", "payment_deadline_at")}

    def period(kind: str, tier: str, price, start, deadline):
        cells = {"sale_type": F.lit(kind), "ticket_name": _none(), "ticket_tier": F.lit(tier), "price": price, "start_at": start, "deadline_at": deadline, **empty, "status": F.lit(G.UNKNOWN)}
        return F.struct(*[cells[c.split(":")[0]].alias(c.split(":")[0]) for c in G.PERIOD.split(",")])

    lottery = period("抽選", "VIP", F.col("priority_price"), at(9), at(5))
    sale = period("一般", "一般", F.col("general_price"), at(4), _none())
    third = F.pmod("event_id", F.lit(3))
    sales = F.when(third == 0, F.array(lottery)).when(third == 1, F.array(lottery, sale)).otherwise(F.array().cast(f"array<struct<{G.PERIOD}>>"))
    told = {
        "event_id": F.lpad(F.col("event_id").cast("string"), 9, "0"), **_strings(*G.FROZEN, *G.OPEN), "event_date": day.cast("string"), "event_name": F.col("event_name"), "venue": F.when(F.pmod("event_id", F.lit(5)) != 0, F.col("venue")),
        "start_time": F.lit("18:00"), "ticket_url": F.when(F.pmod("event_id", F.lit(5)) == 0, F.concat(F.lit("https://tiget.net/"), F.col("event_id").cast("string"))), "general_price": F.col("general_price"), "priority_price": F.when(third == 0, F.col("priority_price")), "same_day_price": F.lit(None).cast("int"),
        "ticket_status": F.when(F.col("o_orderstatus") == "F", "sold_out"), "event_dates": F.array(day.cast("string")), "sales": sales, "manual_override": F.lit(False), "needs_review": F.col("o_orderstatus") == "P",
        "post_ids": F.array(), "source_urls": F.array(), **_strings("source_summary", "latest_source_url", "latest_posted_at", "latest_kind", "source_text"), "n_merged": F.lit(1),
    }
    names = [c.split()[0] for c in G.EVENT.replace(f"array<struct<{G.PERIOD}>>", "x").split(", ")]
    return s.select([told[c].cast("array<string>").alias(c) if c in ("post_ids", "source_urls") else told[c].alias(c) for c in names])


_AT = lambda n: f"(month(event_day - {n}) || '/' || day(event_day - {n}) || ' 12:00')"
_YEN = lambda c: f"format('{{:,}}', {c}) || '円'"


@_query(f"""WITH e AS (SELECT *, event_id % 3 AS k, lpad(CAST(event_id AS VARCHAR), 9, '0') AS eid, CASE WHEN event_id % 5 = 0 THEN 'u' || event_id ELSE venue END AS place,
  CASE WHEN o_orderstatus = 'F' THEN '完売' ELSE '不明' END AS status FROM {_SCHEDULE}),
 r AS (SELECT *, row_number() OVER (PARTITION BY event_day, event_name, place ORDER BY CASE k WHEN 2 THEN 0 ELSE 3 END + CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END DESC, eid) AS r FROM e)
SELECT eid || ':' || event_day AS id, CAST(event_day AS VARCHAR) AS event_date, substr('月火水木金土日', isodow(event_day), 1) AS weekday, event_name,
 CASE k WHEN 2 THEN CASE WHEN status = '不明' THEN '不明 / ' ELSE '' END || '一般 ' || {_YEN('general_price')} || ' / ' || status
  ELSE CASE k WHEN 0 THEN '抽選' ELSE '抽選あり・一般販売あり' END || ' / 一般 ' || {_YEN('general_price')} || CASE k WHEN 0 THEN ' / 優先 ' || {_YEN('priority_price')} ELSE ' / VIP ' || {_YEN('priority_price')} END
   || CASE k WHEN 0 THEN ' / ' || month(event_day - 5) || '/' || day(event_day - 5) || '締切' ELSE '' END || CASE WHEN status = '不明' THEN '' ELSE ' / ' || status END END AS ticket_summary,
 CASE k WHEN 2 THEN '未取得' ELSE '抽選 ' || {_AT(9)} || '〜' || {_AT(5)} || CASE k WHEN 1 THEN ' / 一般販売 ' || {_AT(4)} || '〜' ELSE '' END END AS application_summary,
 CASE k WHEN 2 THEN '' WHEN 0 THEN '抽選 VIP' ELSE CASE WHEN event_day - 5 >= DATE '{TODAY}' OR event_day - 4 < DATE '{TODAY}' THEN '抽選 VIP' ELSE '一般' END END AS next_label, true AS is_ready FROM r WHERE r = 1""")
def web_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the page in full: of equal day, name and place the fullest, with summaries."""
    return U.web_page(_events(spark, sf_dir), F.lit(AS_OF)).select("id", "event_date", "weekday", "event_name", "ticket_summary", "application_summary", "next_label", "is_ready")


_HAS = """(SELECT event_id % 5 = 0 AS ticket_url, event_id % 3 <> 2 AS application_deadline, event_id % 3 <> 2 AS sale_period, true AS price, event_id % 5 <> 0 AS venue, false AS performance_time, false AS benefit_time,
 o_orderstatus = 'P' AS needs_review, true AS public_ready FROM """ + _SCHEDULE + ")"
_FIELDS = ("ticket_url", "application_deadline", "sale_period", "price", "venue", "performance_time", "benefit_time", "needs_review", "public_ready")


@_query(" UNION ALL ".join(f"SELECT '{scope}' AS scope, '{c}' AS field, count(*) FILTER (WHERE {c}) AS n_present, count(*) FILTER (WHERE NOT {c}) AS n_missing FROM {_HAS}" for scope in ("all", "ready") for c in _FIELDS))
def event_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    return Q.event_quality(events, R.readiness_reasons(events))


@_query(f"""SELECT lpad(CAST(event_id AS VARCHAR), 9, '0') AS event_id, 'missing event_name' AS reasons FROM {_SCHEDULE} WHERE event_id % 7 = 0 ORDER BY 1 LIMIT 10""")
def suspicious_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten events that aren't ready: a report that is cut by what it is."""
    events = _events(spark, sf_dir).withColumn("event_name", F.when(F.pmod(F.col("event_id").cast("int"), F.lit(7)) != 0, F.col("event_name")))
    return Q.suspicious(events, R.readiness_reasons(events)).select("event_id", F.array_join("reasons", "; ").alias("reasons"))


@_query("SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'labels', count(*) FROM labels")
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.table_counts(**{name: table(spark, sf_dir, name) for name in ("documents", "events", "labels")})


@_query("""SELECT event_id, string_agg(t || ' ' || d || ' ' || p, ',' ORDER BY d, t) AS shown FROM (SELECT l_orderkey AS event_id, CASE l_returnflag WHEN 'A' THEN '抽選' WHEN 'N' THEN '一般' ELSE '当日券' END AS t, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS d, min(CAST(l_linenumber AS VARCHAR)) AS p
 FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1""")
def display_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as sale periods, in order of deadline, one of each kind and deadline: the first tier."""
    kind = F.when(F.col("l_returnflag") == "A", "抽選").when(F.col("l_returnflag") == "N", "一般").otherwise("当日券")
    cells = {"sale_type": kind, "ticket_tier": F.col("l_linenumber").cast("string"), "deadline_at": F.to_date("l_shipdate").cast("string"), "start_at": _none()}
    held = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("event_id")).agg(F.collect_list(F.struct(*[c.alias(n) for n, c in cells.items()])).alias("sales"))
    line = lambda p: F.concat_ws(" ", p["sale_type"], p["deadline_at"], p["ticket_tier"])
    return held.select("event_id", F.array_join(F.transform(U.display_periods(F.col("sales")), line), ",").alias("shown"))


@_query(f"""SELECT d AS day, string_agg(event_id, ',' ORDER BY event_day, event_name, venue, event_id) AS event_ids, count(*) AS n FROM (SELECT s.*, deadline_day AS d FROM {_SCHEDULE} JOIN {_DAYS} x USING (event_id)) GROUP BY 1""")
def grouped_by_deadline(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _days(spark, sf_dir).select("event_id", "deadline_day")
    rows = schedule(spark, sf_dir).select("event_id", "event_day", "event_name", "venue").join(days, "event_id")
    return Q.grouped(rows, "deadline").select("day", F.array_join(F.col("event_ids").cast("array<string>"), ",").alias("event_ids"), "n")


@_query(f"""SELECT day, CASE min(CASE kind WHEN 'application' THEN 0 WHEN 'payment' THEN 1 ELSE 2 END) WHEN 0 THEN 'application' WHEN 1 THEN 'payment' ELSE 'live' END AS kind, event_id FROM
 (SELECT *, max(CASE WHEN kind = 'live' THEN 1 ELSE 0 END) OVER (PARTITION BY day) AS lives FROM ({_ENTRIES})) WHERE lives = 0 OR kind = 'live' GROUP BY day, event_id""")
def cell_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.cell_entries(Q.calendar_entries(_days(spark, sf_dir)))


@_query(f"""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN deadline_day ELSE payment_day END AS day, (CASE WHEN event_id % 2 = 0 THEN deadline_day ELSE payment_day END) IS NULL OR sold_out AS misses FROM {_DAYS}""")
def deadline_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day of a next deadline, else of the event's own; and whether a calendar warns."""
    even = F.pmod("event_id", F.lit(2)) == 0
    text = lambda c: F.concat(F.col(c).cast("string"), F.lit("T23:59:00+09:00"))
    df = _days(spark, sf_dir).withColumn("day", Q.deadline_day(F.when(even, text("deadline_day")).otherwise("soon"), F.when(~even, text("payment_day"))))
    return df.select("event_id", "day", Q.misses_deadline(F.col("day"), F.lit(""), F.col("sold_out")).alias("misses"))


@_query("""SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + to_months(k), '%Y-%m') AS month FROM orders, (SELECT unnest(range(0, 3)) AS k)""")
def month_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(Q.month_keys(F.date_format("o_orderdate", "yyyy-MM"), 3)).alias("month"))


@_query("""SELECT p_partkey, upper(p_name) || ' LIVE' AS title FROM part""")
def post_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title of a post without a label or quotes: the best line above its fields."""
    text = F.concat(F.lit("NEXT LIVE\n★☆★\npresents someone\n"), F.upper("p_name"), F.lit(" LIVE\nsmall words\n会場：X\nBIG LIVE FES"))
    df = T.once(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), {"lines": T.lines(T.spaces(F.col("text"), compose=False))})
    return df.select("p_partkey", X.title(F.col("lines"), F.col("text")).alias("title"))


_DETAIL = ("販売終了しました", "完売", "当日券あり", "販売中", "発売前", "こんにちは")


@_query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'ended' WHEN 1 THEN 'sold_out' WHEN 2 THEN 'same_day' WHEN 3 THEN 'on_sale' WHEN 4 THEN 'upcoming' END AS ticket_status, CASE WHEN o_orderkey % 6 = 2 THEN '当日券' ELSE '抽選' END AS ticket_sale_type,
 CASE WHEN month(d) = 2 AND day(d) = 29 AND year(d) > year(d - 20) THEN NULL ELSE CAST(d AS VARCHAR) || 'T' || lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':30:00' END AS lottery_result_at, '要予約' || chr(10) || 'No.' || o_custkey AS notes, 'https://x.com/account/status/' || o_orderkey AS source_url,
 'https://ticketdive.com/' || o_orderkey AS ticket_url FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def post_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of sales, labelled instants, notes and links of a post for each order."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    text = F.concat_ws(
        "\n", F.element_at(F.array(*map(F.lit, _DETAIL)), F.pmod(key, F.lit(6)).cast("int") + 1), F.lit("抽選です 要予約"),
        F.concat(F.lit("当落発表："), F.date_format("o_orderdate", "M/d"), F.lit(" "), F.lpad(F.pmod(key, F.lit(24)).cast("string"), 2, "0"), F.lit(":30")), F.concat(F.lit("※No."), F.col("o_custkey").cast("string")),
        F.concat(F.lit("https://x.com/a/status/1/photo/1 https://ticketdive.com/"), key.cast("string")),
    )
    posts = o.select(key, key.alias("post_id"), text.alias("text"), (F.date_sub(F.to_date("o_orderdate"), 20).cast("timestamp") + F.expr("INTERVAL 3 HOURS")).alias("posted_at"), F.lit("other").alias("source_kind"), F.lit(None).cast("int").alias("general_price"))
    told = ("ticket_status", "ticket_sale_type", "lottery_result_at", "notes", "source_url", "ticket_url")
    return X.with_details(posts, only=told).select("o_orderkey", *told)


@_query(f"SELECT doc_id, {first_of_sql('text', 'doc_id', R.NON_LIVE, 1, 'NULL')} AS reason FROM (SELECT doc_id, regexp_replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), '\\s+', '', 'g') AS text FROM documents)")
def non_live_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents with words that tell of no live after them, in capitals and spaced out: the first reason."""
    text = with_words(F.col("text"), F.col("doc_id"), R.NON_LIVE, 1, lambda word: " ".join(word.upper()))
    told = T.once(table(spark, sf_dir, "documents").select("doc_id", "text"), {"folded": T.folded(text, compose=False)})
    return told.select("doc_id", R.non_live_reason(F.col("folded")).alias("reason"))


@_query("""SELECT coalesce(n.k, o.k) AS k, coalesce(n.v, o.v) AS v, coalesce(o.first_at, n.first_at) AS first_at FROM (SELECT event_id AS k, event_type AS v, ts AS first_at FROM events) o
 FULL JOIN (SELECT doc_id AS k, lang AS v, TIMESTAMP '2030-01-01' AS first_at FROM documents) n ON o.k = n.k""")
def first_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert that keeps the first time of processing."""
    old = table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), F.col("event_type").alias("v"), F.col("ts").alias("first_at"))
    new = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), F.col("lang").alias("v"), F.expr("timestamp_ntz '2030-01-01'").alias("first_at"))
    return K.kept_first(old, new, "k", ["first_at"])


@_query("SELECT doc_id, coalesce(lang, 'xx') AS lang, 'x' AS source_type, doc_id AS source_id FROM documents")
def migrated_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return K.migrated(old, {"lang": ("string", F.lit("xx")), "source_type": ("string", F.lit("x")), "source_id": ("long", F.col("doc_id"))})


@_query("SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY 1")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed sink: one row a user, the latest, whatever batches the rows come in."""
    where = shared_folder(spark, "upsert")
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    e.repartition(4, "event_id").write.parquet(f"{where}/in")
    held = N.KeyedTable(f"{where}/state", "user_id long, event_type string, ts timestamp_ntz, event_id long", "user_id", ("ts", "event_id"), buckets=4, compact_every=3)
    Y.sync(Y.read_files(spark, f"{where}/in", e.schema, files_per_batch=1), f"{where}/checkpoint", held.sink()).awaitTermination()
    return held.read(spark).drop("event_id")


@_query("""SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'live' ELSE replace(lower(p_name), ' ', '') END AS alias FROM part""")
def alias_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles between words that titles may lack, nested up to fifty deep; of a title of such words alone the last one stays."""
    key = F.col("p_partkey").cast("int")
    title = F.when(key % 10 == 0, F.repeat(F.lit("LIVE "), key % 7 + 1)).otherwise(F.concat(F.repeat(F.lit("Oneman Live "), key % 3), F.repeat(F.lit("oneman "), key % 2), F.col("p_name"), F.repeat(F.lit(" live"), F.col("p_size"))))
    name = T.once(table(spark, sf_dir, "part").select("p_partkey", title.alias("title")), {"name": T.name_key(F.col("title"))})
    return name.select("p_partkey", M.alias_key(F.col("name"), ("oneman", "onemanlive"), ("live", "onemanlive")).alias("alias"))


@_query("""SELECT CAST(event_id AS VARCHAR) AS post_id, CASE WHEN event_id % 3 = 0 THEN 'long ' || event_type || ' ' || event_id ELSE event_type END AS text, CASE WHEN event_id % 7 = 0 THEN NULL ELSE date_trunc('second', ts) END AS posted_at,
 event_type AS api_text, CASE WHEN event_id % 3 = 0 THEN 'note_tweet' ELSE 'text' END AS full_text_source, 'post' AS row_kind FROM events
 UNION ALL SELECT CAST(user_id AS VARCHAR), NULL, NULL, NULL, NULL, CASE WHEN user_id % 2 = 0 THEN 'malformed JSON' ELSE 'no object' END FROM (SELECT DISTINCT user_id FROM events)""")
def payload_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of each user's events, of several shapes, fields held by an inner payload, times under other names; and what can't be read."""
    where, e = shared_folder(spark, "payloads"), table(spark, sf_dir, "events")
    key, iso = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    note = F.when(key % 3 == 0, F.struct(F.concat(F.lit("long "), "event_type", F.lit(" "), key.cast("string")).alias("text"), F.lit("x").alias("access_token")))
    inner = F.struct(key.cast("string").alias("id"), F.col("event_type").alias("text"), F.when(key % 7 == 0, "soon").when(key % 5 == 0, iso).alias("source_posted_at"), F.when((key % 5 != 0) & (key % 7 != 0), iso).alias("created_at"), note.alias("note_tweet"), F.struct(F.lit("b").alias("bearer"), F.lit(1).alias("n")).alias("more"))
    held = F.struct(key.cast("string").alias("id"), inner.alias("raw"))
    body = F.when(key % 2 == 0, F.to_json(inner)).otherwise(F.to_json(held))
    grouped = e.groupBy("user_id").agg(F.array_join(F.collect_list(body), ",").alias("all"))
    whole = F.concat(F.lit("["), F.col("all"), F.lit("]"))
    text = F.when(F.pmod("user_id", F.lit(4)) == 3, whole).otherwise(F.concat(F.lit('{"data":'), whole, F.lit("}")))
    bad = F.when(F.pmod("user_id", F.lit(2)) == 0, F.concat(F.lit('{"data": ['), F.col("user_id").cast("string"))).otherwise(F.col("user_id").cast("string"))
    grouped.select(F.explode(F.array(text, bad, F.lit(""))).alias("value")).write.text(where)
    items, errors = A.read_payloads(spark, where, lines=True)
    told = A.posts(items).select("post_id", "text", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"), "api_text", "full_text_source", F.lit("post").alias("row_kind"))
    broken = errors.select(F.regexp_extract("text", "([0-9]+)$", 1).alias("post_id"), *[F.lit(None).cast(k).alias(c) for c, k in (("text", "string"), ("posted_at", "timestamp_ntz"), ("api_text", "string"), ("full_text_source", "string"))], F.col("error").alias("row_kind"))
    return told.unionByName(broken)


@_query("SELECT doc_id AS k, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'known' ELSE 'old' END AS v FROM documents UNION ALL SELECT doc_id, 'known' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def backfill_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Older posts added to a state that already has some of them, which stay as they are."""
    state = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("k"), F.lit("known").alias("v"))
    return Y.backfill(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), F.lit("old").alias("v")), state, "k", [])


@_query(f"""WITH e AS (SELECT *, CASE WHEN event_id % 5 = 0 THEN 'u' || event_id ELSE venue END AS place FROM {_SCHEDULE}),
 r AS (SELECT *, row_number() OVER (PARTITION BY event_day, event_name, place ORDER BY CASE event_id % 3 WHEN 2 THEN 0 ELSE 3 END + CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END DESC, event_id) AS r FROM e),
 c AS (SELECT unnest(CASE event_id % 4 WHEN 0 THEN ['added', 'removed'] WHEN 1 THEN ['changed'] ELSE ['kept'] END) AS change FROM r WHERE r = 1)
SELECT change, count(*) AS n FROM c GROUP BY 1""")
def refresh_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dry run of the refresh: what would change against rows published before, of which some had other ids and some differ."""
    events = _events(spark, sf_dir)
    number = F.pmod(F.split("id", ":")[0].cast("int"), F.lit(4))
    n_parts = parts(spark.read.parquet(f"{sf_dir}/orders.parquet"))
    rows = kept(U.page_rows(events, F.lit(AS_OF), n_parts))
    before = rows.withColumn("n", number).withColumns({"id": F.when(F.col("n") == 0, F.concat(F.lit("old "), "id")).otherwise(F.col("id")), "venue": F.when(F.col("n") == 1, "elsewhere").otherwise(F.col("venue"))}).drop("n")
    return Y.refreshed(rows, before, shared_folder(spark, "public"), parts=n_parts)[1]


_EXPECTED = "CASE WHEN d0 = 1 AND n = 1 AND p > 1 THEN 'event' WHEN p < 5 AND v + t + u = 0 THEN 'non_event' ELSE 'needs_review' END"


@_query(f"SELECT expected, actual, count(*) AS n, expected = actual AS agrees FROM (SELECT {_EXPECTED} AS expected, split_part(class, ' ', 1) AS actual FROM {all_kinds_sql()}) GROUP BY 1, 2")
def classifier_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules say of posts against what these were made as: announcements with day and name, posts about nothing live, the rest to be reviewed."""
    has = lambda k, share: digit(F.col("post_id"), k) < share
    expected = F.when(has(1, 10) & has(2, 8) & (digit(F.col("post_id"), 6) > 1), "event").when(has(6, 5) & ~has(3, 8) & ~has(4, 6) & ~has(5, 4), "non_event").otherwise("needs_review")
    told = P.classify(X0.extract(all_kinds(spark, sf_dir), only=P.FEATURES)).withColumn("expected", expected)
    return Q.confusion(told, "expected", "classification")


@_query(f"""SELECT event_id, '抽選' AS sale_type, t.tier AS ticket_tier, CASE t.tier WHEN '一般' THEN general_price ELSE priority_price END AS price, CAST(event_day - 9 AS VARCHAR) || 'T12:00:00' AS start_at,
 CAST(event_day - 4 AS VARCHAR) || 'T01:30:00' AS deadline_at, CAST(event_day - 2 AS VARCHAR) || 'T18:00:00' AS result_at FROM {_SCHEDULE}, (SELECT unnest(['一般', 'VIP']) AS tier) t""")
def sale_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A heading whose dates stand in the next line, once for each priced ticket; the result's day from a line of its own."""
    s, day = schedule(spark, sf_dir), lambda n: F.date_format(F.date_sub("event_day", n), "M/d")
    text = F.concat_ws(
        "\n", F.lit("抽選受付"), F.concat(day(9), F.lit(" 12:00〜"), day(5), F.lit(" 25:30")), F.concat(F.lit("当落発表 "), day(2), F.lit(" 18:00")),
        F.concat(F.lit("一般 "), F.format_number("general_price", 0), F.lit("円 / VIP "), F.format_number("priority_price", 0), F.lit("円")),
    )
    posted = F.col("posted_day").cast("timestamp") + F.expr("INTERVAL 3 HOURS")
    posts = s.select("event_id", F.col("event_id").alias("post_id"), text.alias("text"), posted.alias("posted_at"), F.lit("other").alias("source_kind"), *[F.lit(None).cast("int").alias(c) for c in ("general_price", "priority_price", "same_day_price")], F.lit(None).cast("string").alias("priority_name"))
    held = C.with_sales(X.with_details(posts, only=C.FLAT)).select("event_id", F.explode("sales").alias("p"))
    return held.select("event_id", "p.sale_type", "p.ticket_tier", "p.price", "p.start_at", "p.deadline_at", "p.result_at")


def _raw_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's announcement, for every fifth one a second post a day later that all is gone, and for every third one that names no event."""
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    day = F.date_add(F.to_date(F.lit("1998-07-01")), F.pmod(key, F.lit(300)).cast("int"))
    md, url = F.date_format(day, "M/d"), F.concat(F.lit("https://ticketdive.com/event/"), key.cast("string"))
    name, venue = F.concat(F.lit("NIGHT "), F.substring(F.md5(key.cast("string")), 1, 16)), F.concat(F.lit("Hall "), F.col("c_nationkey").cast("string"))
    first = F.concat_ws(
        "\n", F.lit("NEXT LIVE"), md, F.concat(F.lit("『"), name, F.lit("』")), F.concat(F.lit("会場："), venue), F.lit("OPEN 17:30 / START 18:00"),
        F.concat(F.lit("一般：¥"), F.format_number(1000 + F.pmod(key, F.lit(5000)), 0), F.lit(" / 優先：¥"), F.format_number(7000 + F.pmod(key, F.lit(900)), 0)),
        F.concat(F.lit("抽選受付："), F.date_format(F.date_sub(day, 9), "M/d"), F.lit(" 12:00〜"), F.date_format(F.date_sub(day, 5), "M/d"), F.lit(" 25:30")), url,
    )
    gone = F.concat_ws("\n", F.lit("SOLD OUT"), md, F.concat(F.lit("『"), name, F.lit("』")), F.concat(F.lit("会場："), venue), url)
    told = F.array(F.struct(F.lit(0).alias("n"), first.alias("text")), F.when(key % 5 == 0, F.struct(F.lit(1).alias("n"), gone.alias("text"))), F.when(key % 3 == 0, F.struct(F.lit(2).alias("n"), F.lit("メンバー紹介 profile 03").alias("text"))))
    rows = c.select(key, day.alias("day"), F.explode(F.array_compact(told)).alias("t"))
    return rows.select((F.col("c_custkey") * 10 + F.col("t.n")).alias("post_id"), "t.text", (F.date_add(F.date_sub("day", 20), F.col("t.n")).cast("timestamp") + F.expr("INTERVAL 3 HOURS")).alias("posted_at"))


_DAYS_LEFT = lambda n: f"CAST(day - {n} AS VARCHAR)"
_SHORT = lambda n: f"(month(day - {n}) || '/' || day(day - {n}))"


@_query(f"""WITH c AS (SELECT c_custkey * 10 AS eid, DATE '1998-07-01' + CAST(c_custkey % 300 AS INTEGER) AS day, 'NIGHT ' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 16) AS event_name, 'Hall ' || c_nationkey AS venue,
  {_YEN('1000 + c_custkey % 5000')} AS low, {_YEN('7000 + c_custkey % 900')} AS high, 1000 + c_custkey % 5000 AS p, 7000 + c_custkey % 900 AS q, c_custkey % 5 = 0 AS gone, c_custkey AS k FROM customer)
SELECT eid || ':' || day AS id, CAST(eid AS VARCHAR) AS event_id, CAST(day AS VARCHAR) AS event_date, substr('月火水木金土日', isodow(day), 1) AS weekday, event_name, venue, '開演 18:00' AS live_summary,
 '抽選 / 一般 ' || low || ' / 優先 ' || high || ' / ' || {_SHORT(4)} || '締切' || CASE WHEN gone THEN ' / 完売' ELSE '' END AS ticket_summary, '抽選 ' || {_SHORT(9)} || ' 12:00〜' || {_SHORT(4)} || ' 01:30' AS application_summary,
 'https://ticketdive.com/event/' || k AS ticket_url, CASE WHEN gone THEN '完売' ELSE '不明' END AS ticket_status, gone AS needs_review, {_DAYS_LEFT(4)} || 'T01:30:00' AS application_deadline_at, '' AS payment_deadline_at,
 {_DAYS_LEFT(4)} || 'T01:30:00' AS next_deadline_at, '抽選' AS next_sale_type, '抽選 一般' AS next_label, true AS is_ready, '' AS not_ready_reasons,
 '抽選 一般 一般 ' || p || ' ' || {_DAYS_LEFT(9)} || 'T12:00:00 ' || {_DAYS_LEFT(4)} || 'T01:30:00 不明 true;抽選 優先 優先 ' || q || ' ' || {_DAYS_LEFT(9)} || 'T12:00:00 ' || {_DAYS_LEFT(4)} || 'T01:30:00 不明 false' AS sales FROM c""")
def posts_to_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw posts to the rows of the page: classified, read, folded into events, published; all columns, sale periods as text."""
    page = E.page_of(_raw_posts(spark, sf_dir), None, AS_OF)[1]
    line = lambda p: F.concat_ws(" ", *[p[c].cast("string") for c in ("sale_type", "ticket_name", "ticket_tier", "price", "start_at", "deadline_at", "status", "is_next_deadline")])
    return page.withColumns({"sales": F.array_join(F.transform("sales", line), ";"), "not_ready_reasons": F.array_join("not_ready_reasons", ";")})


@_query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS name, row_number() OVER (ORDER BY p_size, lower(p_name), p_partkey) AS position FROM part""")
def published_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as they are published: in order of size and name, upper and lower case alike; the place of each, from the files as written."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"))
    where = W.write_in_order(rows, shared_folder(spark, "ordered"), ["p_size", F.collate("name", "UTF8_LCASE"), "p_partkey"])
    return spark.read.parquet(where).select("p_partkey", "name", "position")


@_query("""SELECT event_id, event_type, CASE WHEN event_id <= m AND event_id % 3 = 0 THEN 'backfill' ELSE 'stream' END AS origin FROM events, (SELECT max(event_id) // 2 AS m FROM events)""")
def cursor_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive read by its last id: stopped, then older and newer posts come, then it goes on; the older ones are for the backfill."""
    where = shared_folder(spark, "archive")
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    half = e.agg((F.floor(F.max("event_id") / 2)).alias("m")).first().m
    late = (F.col("event_id") <= half) & (F.col("event_id") % 3 == 0)
    spark.dataSource.register(V.PostArchive)
    for rows in (e.filter((F.col("event_id") <= half) & ~late), e.filter(late | (F.col("event_id") > half))):
        rows.write.mode("append").parquet(f"{where}/posts")
        stream = spark.readStream.format("post_archive").option("path", f"{where}/posts").option("id", "event_id").schema(e.schema).load()
        stream.writeStream.format("parquet").option("path", f"{where}/seen").option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    seen = spark.read.schema(e.schema).parquet(f"{where}/seen").withColumn("origin", F.lit("stream"))
    older = spark.read.schema(e.schema).parquet(f"{where}/posts").withColumn("origin", F.lit("backfill"))
    return Y.backfill(older, seen, "event_id", [])
