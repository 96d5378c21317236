"""Timestamps from date parts, calendar labels, day and night."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(c: str) -> Column:
    return F.expr(f"try_cast(`{c}` AS int)")


def moment(second: str = "second") -> Column:
    """Year to second as a timestamp: an invalid day counts as the 1st, missing times as 0, an
    invalid year or month gives null, and so does a date that does not exist."""
    day = F.when(whole("day").between(1, 31), whole("day")).otherwise(1)
    ok = (whole("year") > 0) & whole("month").between(1, 12)
    parts = [F.coalesce(whole(c), F.lit(0)) for c in ("hour", "minute", second)]
    return F.when(ok, F.try_make_timestamp_ntz(whole("year"), whole("month"), day, *parts))


def moment_strict() -> Column:
    """Year to hour; null if any is missing."""
    return F.try_make_timestamp_ntz(whole("year"), whole("month"), whole("day"), whole("hour"), F.lit(0), F.lit(0))


def month_anchor(day: int = 15) -> Column:
    return F.make_date("year", "month", F.lit(day))


def jittered(date: Column, key: Column, reach: int = 10) -> Column:
    """A date moved by up to `reach` days, by a multiplicative hash of the key."""
    return F.date_add(date, (((key * 2654435761) % 4294967296) % (2 * reach + 1) - reach).cast("int"))


def is_day(hour: Column, first: int = 6, last: int = 17) -> Column:
    return hour.between(first, last)


def time_of_day(hour: Column) -> Column:
    return F.when(hour.between(6, 9), "early_morning").when(hour.between(10, 13), "midday").when(hour.between(14, 17), "afternoon").when(hour.between(18, 20), "dusk").otherwise("night")


def period_label(year: Column, month: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"))


def cyclic(hour: Column, month: Column) -> dict[str, Column]:
    """Hour and month on circles; a missing hour counts as 12, a missing month as 6."""
    h, m = 2 * math.pi * F.coalesce(hour, F.lit(12)) / 24, 2 * math.pi * F.coalesce(month, F.lit(6)) / 12
    return {"hour_sin": F.sin(h), "hour_cos": F.cos(h), "month_sin": F.sin(m), "month_cos": F.cos(m)}


def bin_label(ts: Column, rule: str) -> Column:
    """The label of a day (D), of a week ending on Sunday (W) or of a month by its last day (ME)."""
    d = F.to_date(ts)
    return {"D": d, "W": F.next_day(F.date_sub(d, 1), "SUN"), "ME": F.last_day(d)}[rule]
