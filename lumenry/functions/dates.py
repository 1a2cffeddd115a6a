"""Dates of announcements: years are inferred from the day of posting."""

from __future__ import annotations

import datetime as dt
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType

from .text import let

ZONE = "Asia/Tokyo"
MOST_DAYS = 14
#: Forms of a date, in the order in which they are tried.
FULL = r"(20\d{2})[年/\-.](\d{1,2})[月/\-.](\d{1,2})(?:日)?"
FORMS = (r"(?<!\d)(\d{1,2})月(\d{1,2})日?(?!\d)", r"(?<!\d)(\d{1,2})/(\d{1,2})(?!\d)", r"(?<!\d)(\d{1,2})\.(\d{1,2})(?!\d)")
#: What a text is read as, piece by piece: days with a year, with a month, bare numbers, remarks in parentheses, signs between days.
_PIECES = re.compile(
    r"(?P<year>20\d\d)[年/\-.](?P<ym>\d{1,2})[月/\-.](?P<yd>\d{1,2})日?|(?P<month>\d{1,2})(?P<by>[月/.])(?P<day>\d{1,2})(?!\d)日?"
    r"|(?P<number>\d+)日?|(?P<remark>[（(][^）)]*[）)])|(?P<to>[-ー–〜～~])|(?P<and>[,、・])|(?P<other>\S)"
)
_URL = re.compile(r"https?://\S+")


def local_date(at: Column) -> Column:
    """The calendar day of an instant in the schedule's zone."""
    return F.to_date(F.from_utc_timestamp(at, ZONE))


def day_of(year: Column, month: Column, day: Column) -> Column:
    """A date, or null where there is no such day. The arguments should be plain columns or bound by ``let``."""
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    longest = F.when(month.isin(4, 6, 9, 11), 30).when(month != 2, 31).when(leap, 29).otherwise(28)
    return F.when(month.between(1, 12) & (day >= 1) & (day <= longest), F.make_date(year, month, day))


def infer_year(month: Column, day: Column, posted: Column) -> Column:
    """The day in the year of posting, or in the next one if that is over 30 days before it."""
    def of(d: Column) -> Column:
        this = day_of(d["y"], d["m"], d["d"])
        return let(this, lambda t: F.when(t < d["least"], day_of(d["y"] + 1, d["m"], d["d"])).otherwise(t))

    return let(F.struct(F.year(posted).alias("y"), month.alias("m"), day.alias("d"), F.date_sub(posted, 30).alias("least")), of)


def number(digits: Column) -> Column:
    """A number of a few digits; 0 for an empty text, which is no month and no day. To cast an empty text raises an error and catches it, at the cost of many patterns."""
    return F.concat(F.lit("0"), digits).cast("int")


def _number(text: Column, pattern: str, group: int) -> Column:
    return number(F.regexp_extract(text, pattern, group))


def _full(text: Column) -> Column:
    parts = F.struct(*[_number(text, FULL, k).alias(f"p{k}") for k in (1, 2, 3)])
    return let(parts, lambda p: day_of(p["p1"], p["p2"], p["p3"]))


def event_date(text: Column, posted: Column) -> Column:
    """The first date that a text names, by the order of FULL and FORMS. A form is sought only where its sign stands in the text."""
    forms = [F.when(text.contains(sign), infer_year(_number(text, f, 1), _number(text, f, 2), posted)) for sign, f in zip("月/.", FORMS, strict=True)]
    return F.coalesce(F.when(text.contains("20"), _full(text)), *forms)


def _safe(year: int, month: int, day: int) -> dt.date | None:
    try:
        return dt.date(year, month, day)
    except ValueError:
        return None


def dates_in(text: str, posted: dt.date) -> list[dt.date]:
    """All dates of a text: full dates, ranges of up to MOST_DAYS days, lists of days, single days; each once.

    The text is cut into pieces once; a day with its month begins a range if a sign and
    another day follow, a list if further numbers follow, else it stands for itself.
    """
    pieces = list(_PIECES.finditer(_URL.sub(" ", text)))

    def inferred(month: str, day: str) -> dt.date | None:
        this = _safe(posted.year, int(month), int(day))
        return _safe(posted.year + 1, int(month), int(day)) if this and this < posted - dt.timedelta(30) else this

    def kind(k: int) -> str:
        return pieces[k].lastgroup if k < len(pieces) else ""

    def past(k: int) -> int:
        """The place of the next piece that is no remark."""
        return k + 1 if kind(k) == "remark" else k

    def number(k: int) -> str | None:
        """A bare day: a number of one or two digits that is no time and has no month or further part."""
        if kind(k) != "number" or len(pieces[k]["number"]) > 2 or kind(k + 1) == "other" and pieces[k + 1][0] in ":：/月":
            return None
        return pieces[k]["number"]

    full, ranges, lists, single = [], [], [], {"月": [], "/": [], ".": []}
    k = 0
    while k < len(pieces):
        m = pieces[k]
        k += 1
        if m["year"]:
            full.append(_safe(int(m["year"]), int(m["ym"]), int(m["yd"])))
        if not m["month"]:
            continue
        first, after = inferred(m["month"], m["day"]), past(k)
        end = None
        if kind(after) == "to":
            n = pieces[after + 1] if after + 1 < len(pieces) else None
            end = (n["month"], n["day"]) if n is not None and n["month"] else (m["month"], number(after + 1))
        if end is not None and end[1] is not None:
            k = after + 2
            last = first and _safe(first.year, int(end[0]), int(end[1]))
            if last and last < first:
                last = _safe(first.year + 1, int(end[0]), int(end[1]))
            n_days = (last - first).days if last else -1
            ranges += [first + dt.timedelta(j) for j in range(n_days + 1)] if 0 <= n_days <= MOST_DAYS else [first]
            continue
        days = [m["day"]]
        while m["by"] != "." and kind(after) == "and" and (n := number(after + 1)):
            days.append(n)
            k, after = after + 2, past(after + 2)
        if len(days) > 1:
            lists += [inferred(m["month"], d) for d in days]
        else:
            single[m["by"]].append(first)
    found = [*full, *ranges, *lists, *single["月"], *single["/"], *single["."]]
    return [d for d in dict.fromkeys(found) if d is not None]


@F.pandas_udf(ArrayType(DateType()))
def event_dates(text: pd.Series, posted: pd.Series) -> pd.Series:
    """``dates_in`` of each text. One pass of Python for a text is faster here than a dozen patterns in the JVM."""
    return pd.Series([None if a is None or pd.isna(b) else dates_in(a, b) for a, b in zip(text, posted)], dtype=object)


def weekday_label(day: Column) -> Column:
    return F.when(day.isNotNull(), F.element_at(F.array(*map(F.lit, "月火水木金土日")), F.weekday(day) + 1))  # a null place would give the last
