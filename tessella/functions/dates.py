"""Dates and freshness; now is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Number words of relative dates.
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "a": 1, "an": 1}


def at(now: str) -> Column:
    return F.to_timestamp_ntz(F.lit(now))


def posted_day(*c: Column) -> Column:
    """The first of the values that starts with an ISO date, as that date."""
    iso = [F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}"), F.left(x, F.lit(10))) for x in c]
    return F.coalesce(*iso, F.lit(""))


def lenient(c: Column) -> Column:
    """An ISO time or date; else the date it starts with; else null."""
    t = F.trim(c)
    return F.coalesce(F.try_to_timestamp(t), F.try_to_timestamp(F.left(t, F.lit(10))))


def seconds_between(early: Column, late: Column) -> Column:
    return F.unix_seconds(late.cast("timestamp")) - F.unix_seconds(early.cast("timestamp"))


def ago(value: Column, now: Column) -> Column:
    """'12m ago', '3h ago' for times; 'today', 'yesterday', '3d ago' for dates and times of other days; '' for neither."""
    t = lenient(value)
    s = F.greatest(F.lit(0), seconds_between(t, now))
    n = lambda x, unit: F.concat(F.floor(x).cast("string"), F.lit(unit))
    days = F.floor(s / 86400)
    by_day = F.when(days == 0, "today").when(days == 1, "yesterday").otherwise(n(days, "d ago"))
    timed = value.contains("T")
    return F.when(t.isNull(), "").when(timed & (s < 60), "just now").when(timed & (s < 3600), n(s / 60, "m ago")).when(timed & (s < 86400), n(s / 3600, "h ago")).otherwise(by_day)


def relative_day(value: Column, today: Column) -> Column:
    """A day as a label: 'today', 'yesterday', days, weeks and months ago, else month and day or year; a value that is
    no date is cut to ten characters."""
    t = F.coalesce(F.try_to_timestamp(F.left(value, F.lit(19))), F.try_to_timestamp(F.when(F.length(value) <= 10, value)))
    d = F.date_diff(today, F.to_date(t))
    n = lambda x, unit: F.concat(F.floor(x).cast("string"), F.lit(unit))
    label = (
        F.when(d < 0, F.date_format(t, "MMM dd")).when(d == 0, "today").when(d == 1, "yesterday").when(d < 7, n(d, "d ago"))
        .when(d < 30, n(d / 7, "w ago")).when(d < 365, n(d / 30, "mo ago")).otherwise(F.date_format(t, "MMM yyyy"))
    )
    return F.when(F.coalesce(value, F.lit("")) == "", "").when(t.isNull(), F.left(value, F.lit(10))).otherwise(label)


def just_posted(value: Column, now: Column, seconds: int = 1800) -> Column:
    """Whether a time (a date alone is none) is less than half an hour old, and not in the future."""
    s = seconds_between(lenient(value), now)
    return F.coalesce(value.contains("T") & (s >= 0) & (s < seconds), F.lit(False))


def fresh(value: Column, bucket: str, now: Column) -> Column:
    """Whether a posted value passes a freshness bucket; other buckets pass all.

    A date alone (without a T) passes only the day bucket, while it is less than two days old (also in the future); a
    time in the future and a value that is none fail.
    """
    limit = {"1h": 3600, "4h": 4 * 3600, "24h": 86400}.get(bucket)
    if limit is None:
        return F.lit(True)
    t = lenient(value)
    s = seconds_between(t, now)
    by_date = F.lit(bucket == "24h") & (s < 2 * 86400)
    return F.coalesce(F.when(~value.contains("T"), by_date).otherwise((s >= 0) & (s < limit)), F.lit(False))


def days_old(value: Column, today: Column) -> Column:
    return F.date_diff(today, F.try_to_date(F.left(value, F.lit(10)), "yyyy-MM-dd"))


def relative_date(text: Column, today: Column) -> Column:
    """'3 days ago', 'two weeks ago', 'yesterday' as a date; null where it is none."""
    t = F.lower(F.trim(text))
    word = F.regexp_extract(t, r"^(?:posted )?([a-z]+|\d+)\+?\s*(?:m(?:in|inute)?|h(?:our)?|d(?:ay)?|w(?:eek)?|mo(?:nth)?)s?\b", 1)
    unit = F.regexp_extract(t, r"^(?:posted )?(?:[a-z]+|\d+)\+?\s*(mo|m|h|d|w)", 1)
    number = F.coalesce(F.try_to_number(word, F.lit("999")).cast("int"), F.create_map(*[F.lit(x) for k, v in NUMBER_WORDS.items() for x in (k, v)])[word])
    days = F.when(number.isNull(), None).when(unit.isin("m", "h"), 0).when(unit == "d", number).when(unit == "w", number * 7).when(unit == "mo", number * 30)
    return F.when(t.rlike("today|just now"), today).when(t.contains("yesterday"), F.date_sub(today, 1)).otherwise(F.date_sub(today, days.cast("int")))


def business_hours(t: Column) -> Column:
    return (F.weekday(t) < 5) & F.hour(t).between(9, 16)
