"""Date fields, truncation, mixed intervals and format templates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def extract(field: str, ts: Column) -> Column:
    """Field of a timestamp without zone. Weeks start on Sunday = 0 (dow) or Monday = 1 (isodow)."""
    y = F.year(ts)
    day = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date"))
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.expr("0") + F.date_part(F.lit("SECOND"), ts).cast("double")
    table = {
        "century": F.ceil(y / 100), "millennium": F.ceil(y / 1000), "decade": F.floor(y / 10), "year": y, "quarter": F.quarter(ts),
        "month": F.month(ts), "week": F.weekofyear(ts), "day": F.dayofmonth(ts), "dow": F.dayofweek(ts) - 1,
        "isodow": F.weekday(ts) + 1, "doy": F.dayofyear(ts), "hour": F.hour(ts), "minute": F.minute(ts),
        "isoyear": F.date_part(F.lit("YEAROFWEEK"), ts), "epoch": day * 86400.0 + seconds, "julian": day + F.lit(2440588) + seconds / 86400,
    }
    return table[field]


def date_trunc(unit: str, ts: Column) -> Column:
    """Also decade, century and millennium (which begin in a year ending in 1)."""
    y = F.year(ts)
    first = {"decade": F.floor(y / 10) * 10, "century": F.floor((y - 1) / 100) * 100 + 1, "millennium": F.floor((y - 1) / 1000) * 1000 + 1}
    if unit in first:
        return F.make_date(first[unit].cast("int"), F.lit(1), F.lit(1)).cast("timestamp_ntz")
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def interval(months: Column | int = 0, days: Column | int = 0, micros: Column | int = 0) -> Column:
    """Mixed interval as a struct: months, days and microseconds do not convert into each other."""
    one = lambda v, t: (v if isinstance(v, Column) else F.lit(v)).cast(t)
    return F.struct(one(months, "int").alias("months"), one(days, "int").alias("days"), one(micros, "bigint").alias("micros"))


def _toward_zero(a: Column, b: int) -> Column:
    return (F.signum(a) * F.floor(F.abs(a) / b)).cast("bigint")


def justify_hours(i: Column) -> Column:
    """Every 24 hours become a day."""
    d = _toward_zero(i["micros"], 86_400_000_000)
    return interval(i["months"], i["days"] + d, i["micros"] - d * 86_400_000_000)


def justify_days(i: Column) -> Column:
    """Every 30 days become a month."""
    m = _toward_zero(i["days"], 30)
    return interval(i["months"] + m, i["days"] - m * 30, i["micros"])


def justify_interval(i: Column) -> Column:
    return justify_days(justify_hours(i))


def add_interval(ts: Column, i: Column) -> Column:
    """Timestamp plus interval: months first, then days, then microseconds."""
    moved = F.add_months(ts.cast("date"), i["months"])
    time_of_day = ts - ts.cast("date").cast("timestamp_ntz")
    total = F.date_add(moved, i["days"]).cast("timestamp_ntz") + time_of_day
    return total + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (i["micros"] / 1e6).cast("decimal(18,6)"))


# Template words and their date_format letters.
_TEMPLATE = {
    "YYYY": "yyyy", "YY": "yy", "MM": "MM", "Month": "MMMM", "Mon": "MMM", "DDD": "DDD", "DD": "dd", "Day": "EEEE", "Dy": "EEE",
    "HH24": "HH", "HH12": "hh", "HH": "hh", "MI": "mm", "SS": "ss", "MS": "SSS", "US": "SSSSSS", "AM": "a", "PM": "a", "Q": "Q",
}


def template(fmt: str) -> str:
    """date_format pattern of a to_char template; other letters become literals."""
    words = sorted(_TEMPLATE, key=len, reverse=True)
    out, i = [], 0
    while i < len(fmt):
        w = next((w for w in words if fmt.startswith(w, i)), None)
        if w:
            out.append(_TEMPLATE[w])
            i += len(w)
        elif m := re.match(r"[A-Za-z]+?(?=[^A-Za-z]|$)", fmt[i:]):
            out.append("'" + m[0] + "'")
            i += len(m[0])
        else:
            out.append(fmt[i])
            i += 1
    return "".join(out)


def to_char(ts: Column, fmt: str) -> Column:
    return F.date_format(ts, template(fmt))


def to_timestamp(text: Column, fmt: str) -> Column:
    return F.to_timestamp_ntz(text, F.lit(template(fmt)))
