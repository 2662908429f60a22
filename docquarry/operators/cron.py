"""Cron expressions: five fields with lists, ranges and steps; next run on the minute grid of a time zone."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LIMITS = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 6))
HORIZON_DAYS = 5 * 366


class CronError(ValueError):
    """An expression that cannot be read or never comes due."""


def parse_cron(expr: str) -> tuple[tuple[frozenset[int], ...], bool, bool]:
    """(values of each field, whether the day of the month is restricted, whether the day of the week is)."""
    parts = expr.split()
    if len(parts) != 5:
        raise CronError(f"five fields are needed: {expr!r}")
    sets = []
    for part, (low, high) in zip(parts, LIMITS):
        values: set[int] = set()
        for item in part.split(","):
            span, _, step = item.partition("/")
            a, _, b = span.partition("-")
            try:
                by = int(step) if step else 1
                start, stop = (low, high) if span == "*" else (int(a), int(b) if b else high if step else int(a))
            except ValueError:
                raise CronError(f"cannot read {item!r} in {expr!r}") from None
            if by < 1 or not low <= start <= stop <= high or ("/" in item and not step):
                raise CronError(f"{item!r} is out of range in {expr!r}")
            values |= set(range(start, stop + 1, by))
        sets.append(frozenset(values))
    return tuple(sets), parts[2] != "*", parts[4] != "*"


def next_run(expr: str, after: dt.datetime, tz: str = "UTC") -> dt.datetime:
    """The first run strictly after ``after`` (aware, or taken as UTC), in UTC. With both days restricted either will do."""
    (minutes, hours, dom, months, dow), by_dom, by_dow = parse_cron(expr)
    zone = ZoneInfo(tz)
    after = after if after.tzinfo else after.replace(tzinfo=dt.UTC)
    start = after.astimezone(dt.UTC).replace(second=0, microsecond=0) + dt.timedelta(minutes=1)
    day = start.astimezone(zone).date()
    for _ in range(HORIZON_DAYS):
        on_dom, on_dow = day.day in dom, (day.weekday() + 1) % 7 in dow
        if day.month in months and ((on_dom or on_dow) if by_dom and by_dow else on_dom and on_dow):
            runs = []
            for h in hours:
                for m in minutes:
                    for fold in (0, 1):
                        at = dt.datetime(day.year, day.month, day.day, h, m, tzinfo=zone, fold=fold).astimezone(dt.UTC)
                        local = at.astimezone(zone)
                        if (local.hour, local.minute) == (h, m) and at >= start:  # a time that the clock skips doesn't come
                            runs.append(at)
            if runs:
                return min(runs)
        day += dt.timedelta(days=1)
    raise CronError(f"{expr!r} never comes due")


def next_run_column(expr: Column, after: Column, tz: str = "UTC") -> Column:
    """Vectorised :func:`next_run` over timestamps (timestamp_ntz taken as UTC)."""

    @F.pandas_udf("timestamp_ntz")
    def run(e: pd.Series, a: pd.Series) -> pd.Series:
        cache: dict = {}
        out = []
        for x, t in zip(e, a):
            if x is None or pd.isna(t):
                out.append(None)
                continue
            k = x, t.floor("min")
            if k not in cache:
                cache[k] = next_run(x, t.to_pydatetime(), tz).replace(tzinfo=None)
            out.append(cache[k])
        return pd.Series(pd.to_datetime(out))

    return run(expr, after)
