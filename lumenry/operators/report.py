"""Reports and views over events: what is missing, the month grid, deadlines, lists as a visitor filters them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def missing_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, n_missing, n_rows), one row a field; nulls and empty texts are missing. One pass, one small row shuffled."""
    counts = [F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) == "").alias(c) for c in fields]
    one = df.agg(*counts, F.count("*").alias("_n"))
    return one.select(F.stack(F.lit(len(fields)), *[x for c in fields for x in (F.lit(c), F.col(c))]).alias("field", "n_missing"), F.col("_n").alias("n_rows"))


def top_missing(df: DataFrame, fields: list[str], k: int = 5) -> DataFrame:
    return missing_counts(df, fields).filter("n_missing > 0").orderBy(F.desc("n_missing"), "field").limit(k)


def calendar_entries(events: DataFrame) -> DataFrame:
    """(event_id, kind, day): the days of an event, its deadline and its payment deadline, as far as it has them."""
    kinds = F.array_compact(
        F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(kind).alias("kind"), F.col(c).alias("day"))) for kind, c in (("application", "deadline_day"), ("payment", "payment_day"), ("live", "event_day"))])
    )
    return events.select("event_id", "sold_out", F.explode(kinds).alias("e")).select("event_id", "sold_out", "e.kind", "e.day")


def month_grid(entries: DataFrame, year: int, month: int) -> DataFrame:
    """42 days from the Sunday on or before the first of a month, with counts of the entries of each.

    Sold-out events count once a day, however many entries they have there.
    """
    spark = entries.sparkSession
    first = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    start = F.date_sub(first, F.dayofweek(first) - 1)
    days = spark.range(42).select(F.date_add(start, F.col("id").cast("int")).alias("day"), (F.col("id")).alias("cell"))
    of_kind = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("application", "payment", "live")]
    near = entries.filter(F.col("day").between(start, F.date_add(start, 41)))
    counted = near.groupBy("day").agg(*of_kind, F.count_distinct(F.when(F.col("sold_out"), F.col("event_id"))).alias("n_sold_out"))
    out = days.join(counted, "day", "left").na.fill(0, ["n_application", "n_payment", "n_live", "n_sold_out"])
    return out.withColumn("in_month", F.month("day") == month)


def deadline_alerts(events: DataFrame, today: Column) -> DataFrame:
    """(bucket, event_id) of deadlines today and tomorrow, and of events to come without any."""
    bucket = (
        F.when(F.col("deadline_day") == today, "today").when(F.col("deadline_day") == F.date_add(today, 1), "tomorrow").when(F.col("deadline_day").isNull() & (F.col("event_day") >= today), "missing")
    )
    return events.select(bucket.alias("bucket"), "event_id").filter("bucket is not null")


def shown(events: DataFrame, which: str, today: Column) -> DataFrame:
    """The events of a visitor's filter. Those without a day pass all filters but the one for missing deadlines."""
    day = F.col("event_day")
    keep = {
        "all": F.lit(True),
        "upcoming": day.isNull() | (day >= today),
        "week": day.isNull() | ((day >= today) & (day < F.date_add(today, 7))),
        "month": day.isNull() | ((day >= today) & (F.trunc(day, "month") == F.trunc(today, "month"))),
        "missing_deadline": F.col("deadline_day").isNull() & (day.isNull() | (day >= today)),
    }[which]
    return events.filter(keep)


def urgency(days: Column) -> Column:
    return F.when(days.isNull(), "none").when(days < 0, "past").when(days == 0, "today").when(days == 1, "tomorrow").when(days <= 3, "soon").otherwise("later")


def grouped_by_day(events: DataFrame) -> DataFrame:
    """(event_day, event_ids sorted, n)."""
    return events.groupBy("event_day").agg(F.array_sort(F.collect_list("event_id")).alias("event_ids"), F.count("*").alias("n"))


#: What a quality report counts, by the condition that an event (``fold.EVENT``) has it.
def _checks() -> dict[str, Column]:
    any_period = lambda c: F.exists("sales", lambda p: p[c].isNotNull())
    told = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return {
        "ticket_url": told("ticket_url"),
        "application_deadline": told("application_deadline_at") | any_period("deadline_at"),
        "sale_period": any_period("start_at") | any_period("deadline_at"),
        "price": F.col("general_price").isNotNull() | F.col("priority_price").isNotNull() | F.col("same_day_price").isNotNull() | any_period("price"),
        "venue": told("venue"),
        "performance_time": told("performance_time"),
        "benefit_time": told("benefit_time"),
    }


def event_quality(events: DataFrame, reasons: Column) -> DataFrame:
    """(scope, field, n_present, n_missing): each field, over all events and over those that may be published; and counts of states.

    One pass; a few dozen numbers are shuffled.
    """
    ready = F.size(reasons) == 0
    states = {"needs_review": F.coalesce(F.col("needs_review"), F.lit(False)), "public_ready": ready}
    checks = {name: F.coalesce(c, F.lit(False)) for name, c in (_checks() | states).items()}
    flags = events.select(ready.alias("_ready"), *[c.alias(name) for name, c in checks.items()])
    one = flags.agg(F.count("*").alias("all"), F.count_if("_ready").alias("ready"), *[F.count_if(c).alias(f"all_{c}") for c in checks], *[F.count_if(F.col("_ready") & F.col(c)).alias(f"ready_{c}") for c in checks])
    rows = [F.struct(F.lit(scope).alias("scope"), F.lit(c).alias("field"), F.col(f"{scope}_{c}").alias("n_present"), (F.col(scope) - F.col(f"{scope}_{c}")).alias("n_missing")) for scope in ("all", "ready") for c in checks]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def post_counts(classified: DataFrame) -> DataFrame:
    """One row of what a run tells of its posts: fetched, parsed (about an event), skipped, and those of the parsed to be reviewed."""
    is_ = lambda code: F.col("classification").eqNullSafe(code)
    return classified.agg(F.count("*").alias("posts_fetched"), F.count_if(~is_("non_event")).alias("posts_parsed"), F.count_if(is_("non_event")).alias("non_event_skipped"), F.count_if(is_("needs_review")).alias("to_review"))


def suspicious(events: DataFrame, reasons: Column, most: int = 10) -> DataFrame:
    """The first ``most`` events that aren't published, with the reasons: examples to look at."""
    return events.withColumn("reasons", reasons).filter(F.size("reasons") > 0).orderBy("event_id").limit(most).select("event_id", "event_date", "event_name", "venue", "reasons")


def table_counts(**tables: DataFrame) -> DataFrame:
    """(name, n) of each table."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def iso_day(text: Column) -> Column:
    """The valid day at the beginning of a text, or null."""
    return F.try_to_date(F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"^\d{4}-\d{2}-\d{2}", 0), F.lit("")), "yyyy-MM-dd")


def deadline_day(next_deadline: Column, own_deadline: Column) -> Column:
    """The day by which to apply: that of the next period, else of the event's own deadline."""
    return F.coalesce(iso_day(next_deadline), iso_day(own_deadline))


def misses_deadline(deadline: Column, application: Column, needs_review: Column) -> Column:
    """Whether a calendar should warn: no day, nothing known about applying, or an event to be reviewed."""
    return deadline.isNull() | F.coalesce(application == "未取得", F.lit(False)) | F.coalesce(needs_review, F.lit(False))


def month_keys(first: Column, count: int) -> Column:
    """``count`` months from one on (yyyy-MM), as texts."""
    start = F.to_date(F.concat(first, F.lit("-01")))
    return F.transform(F.sequence(F.lit(0), F.lit(max(1, count) - 1)), lambda k: F.date_format(F.add_months(start, k), "yyyy-MM"))


def page_order(by: str = "event") -> list[Column]:
    """By day, name and venue, or first by deadline; rows without a day, or deadline, come last. Texts in binary order."""
    own = [F.asc_nulls_last("event_day"), F.col("event_name"), F.col("venue"), F.col("event_id")]
    return ([F.asc_nulls_last("deadline_day")] if by == "deadline" else []) + own


def in_page_order(rows: DataFrame, by: str = "event") -> DataFrame:
    return rows.orderBy(*page_order(by))


def grouped(rows: DataFrame, by: str = "event") -> DataFrame:
    """(day, event_ids in page order, n) by the event's day, or by its deadline; null is a group of its own, the last."""
    day = F.col("deadline_day" if by == "deadline" else "event_day")
    items = F.array_sort(F.collect_list(F.struct(F.col("event_day").isNull().alias("undated"), "event_day", "event_name", "venue", "event_id")))
    return rows.groupBy(day.alias("day")).agg(items.alias("i"), F.count("*").alias("n")).select("day", F.transform("i", lambda x: x["event_id"]).alias("event_ids"), "n").orderBy(F.asc_nulls_last("day"))


#: The order of kinds in a calendar cell.
KINDS = {"application": 0, "payment": 1, "live": 2}


def cell_entries(entries: DataFrame, mode: str = "all") -> DataFrame:
    """The entries that a cell of the calendar opens, each event once, in order of day, kind and event.

    In mode "all" the lives of a day, or all its entries where it has none; else those of the kind.
    """
    if mode == "all":
        lives = F.max((F.col("kind") == "live").cast("int")).over(Window.partitionBy("day"))
        chosen = entries.withColumn("_lives", lives).filter("_lives = 0 OR kind = 'live'").drop("_lives")
    else:
        chosen = entries.filter(F.col("kind") == (mode if mode in KINDS else "live"))
    rank = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("kind")]
    once = chosen.groupBy("day", "event_id").agg(F.min(F.coalesce(rank, F.lit(9))).alias("rank"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("rank") + 1).cast("int"))
    return once.orderBy("day", "rank", "event_id").select("day", kind.alias("kind"), "event_id")


def confusion(rows: DataFrame, expected: str, actual: str) -> DataFrame:
    """(expected, actual, n, agrees): labels against what a rule gave; nulls are a label of their own."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    return rows.groupBy(told(expected).alias("expected"), told(actual).alias("actual")).agg(F.count("*").alias("n")).withColumn("agrees", F.col("expected") == F.col("actual"))
