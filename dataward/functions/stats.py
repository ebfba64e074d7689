"""Percentiles and periods."""

from __future__ import annotations

import math
import re
from calendar import monthrange
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BadRequestError


def percentile_disc(column: str, p: float) -> Column:
    """Nearest rank: the value at place ceil(p * n)."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{column}`)")


def floor_index(df: DataFrame, column: str, p: float) -> Column:
    """The value at place floor(p * n), counted from 0, of df's sorted values; null values take no part.

    The count comes first; then that place is the nearest rank of a share which the plan can hold as a
    constant, so no list of values is ever built.
    """
    n = df.select(F.count(column)).first()[0]
    place = min(math.floor(n * p), max(n - 1, 0))
    return percentile_disc(column, (place + 0.5) / max(n, 1))


_period = re.compile(r"(\d+)([hdwm])")


def period(text: str, month_days: int = 30) -> timedelta:
    """12h, 7d, 2w; a month is month_days long."""
    m = _period.fullmatch(text)
    if not m:
        raise BadRequestError(f"not a period: {text}")
    n, unit = int(m[1]), m[2]
    return {"h": timedelta(hours=n), "d": timedelta(days=n), "w": timedelta(weeks=n), "m": timedelta(days=month_days * n)}[unit]


def since(text: str, now: datetime, run_over: bool = False) -> datetime:
    """The moment that long ago; months follow the calendar.

    Where the month lacks the day, it is its last one or, with run_over, as many days into the next month.
    """
    m = _period.fullmatch(text)
    if not m or m[2] != "m":
        return now - period(text)
    year, month = divmod(now.year * 12 + now.month - 1 - int(m[1]), 12)
    first = now.replace(year=year, month=month + 1, day=1)
    days = now.day if run_over else min(now.day, monthrange(year, month + 1)[1])
    return first + timedelta(days=days - 1)
