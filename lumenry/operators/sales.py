"""Sale periods of events: upserts by identity, what a post's flat fields take from them, and what is shown next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import dealt
from .posts import status_label

UNKNOWN = "不明"
#: What makes two periods the same one, besides the event.
IDENTITY = ("sale_type", "ticket_name", "start_at", "deadline_at")
#: Kinds of sale in the order in which a post's flat fields prefer them.
PREFERENCE = ("抽選", "一般", "先着", "当日券")


def told(value: Column) -> Column:
    """A value, or null where it says nothing."""
    text = value.cast("string")
    return F.when(~F.coalesce(text, F.lit("")).isin("", UNKNOWN), value)


def upserted_periods(periods: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """One row for each identity of each event: of each field the last value that says something, in order.

    periods: key, IDENTITY, the order columns and the fields. A grouped maximum of (order,
    value), so it is combined before it is shuffled.
    """
    def last(c: str) -> Column:
        held = told(F.col(c))
        return F.max(F.when(held.isNotNull(), F.struct(*order, held.alias("v"))))["v"].alias(c)

    identity = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{c}") for c in IDENTITY]
    keyed = periods.select("*", *identity)
    out = keyed.groupBy(key, *[f"_{c}" for c in IDENTITY]).agg(*[F.first(c).alias(c) for c in IDENTITY], *[last(c) for c in fields], F.count("*").alias("n_posts"))
    return out.drop(*[f"_{c}" for c in IDENTITY])


def without_dateless_twins(periods: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """Periods without dates give price and status to a dated one of their tier, and go; those without such a twin stay. ``parts``: over how many tasks events are dealt."""
    periods = dealt(periods, parts, key, "ticket_tier")
    dated = F.col("start_at").isNotNull() | F.col("deadline_at").isNotNull()
    same = Window.partitionBy(key, "ticket_tier")
    has_dated = F.max(dated.cast("int")).over(same) == 1
    price = F.coalesce("price", F.max(F.when(~dated, F.col("price"))).over(same))
    status = F.coalesce(told(F.col("status")), F.max(F.when(~dated, told(F.col("status")))).over(same))
    rows = periods.select("*", dated.alias("_dated"), has_dated.alias("_twin"), price.alias("_price"), status.alias("_status"))
    return rows.filter("_dated or not _twin").withColumn("price", F.col("_price")).withColumn("status", F.col("_status")).drop("_dated", "_twin", "_price", "_status")


def selected_period(periods: DataFrame, key: str) -> DataFrame:
    """The period that flat fields come from: by kind of sale, then the earliest deadline, then start."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, PREFERENCE)), F.coalesce("sale_type", F.lit(""))), F.lit(0))
    rank = F.when(rank == 0, len(PREFERENCE) + 1).otherwise(rank)
    order = Window.partitionBy(key).orderBy(rank, F.asc_nulls_last("deadline_at"), F.asc_nulls_last("start_at"), *[F.asc_nulls_last(c) for c in sorted(periods.columns)])
    return periods.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def with_next_flag(periods: DataFrame, key: str, as_of: Column) -> DataFrame:
    """Adds is_next_deadline: the period of the earliest deadline that isn't past, one for each event at most; and a shown status."""
    order = Window.partitionBy(key).orderBy(F.when(F.col("deadline_at") >= as_of, F.col("deadline_at")).asc_nulls_last(), F.asc_nulls_last("start_at"), F.asc_nulls_last("sale_type"))
    first = F.row_number().over(order) == 1
    return periods.withColumn("is_next_deadline", first & F.coalesce(F.col("deadline_at") >= as_of, F.lit(False))).withColumn("status_label", status_label(told(F.col("status"))))


def tier_expanded(periods: DataFrame, tickets: DataFrame, key: str) -> DataFrame:
    """Dated periods that name no tier, once for each priced ticket of their event; others as they are."""
    general = F.col("ticket_tier").isNull() | (F.col("ticket_tier") == UNKNOWN)
    dated = F.col("deadline_at").isNotNull() | F.col("start_at").isNotNull()
    held = tickets.select(key, F.col("ticket_tier").alias("_tier"), F.col("price").alias("_price"))
    rows = periods.filter(general & dated).join(held, [key], "left").select(*[c for c in periods.columns if c not in ("ticket_tier", "price")], F.coalesce("_tier", "ticket_tier").alias("ticket_tier"), F.coalesce("_price", "price").alias("price"))
    return periods.filter(~(general & dated)).unionByName(rows)


def best_prices(periods: DataFrame, key: str) -> DataFrame:
    """Flat prices of each event: the lowest of general and of priority-like tickets."""
    priority = F.col("ticket_tier").isin("優先", "VIP", "SS", "前方", "カメラ")
    return periods.groupBy(key).agg(F.min(F.when(F.col("ticket_tier") == "一般", F.col("price"))).alias("general_price"), F.min(F.when(priority, F.col("price"))).alias("priority_price"))
