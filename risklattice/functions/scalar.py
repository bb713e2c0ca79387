"""Casts, dates and small numeric expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG_ODDS_EPSILON = 1e-6


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c: Column | str) -> Column:
    """Double, or null where the text is no number."""
    return _col(c).cast("string").try_cast("double")


def to_day(c: Column | str) -> Column:
    """Date, or null where the text is no date."""
    return _col(c).cast("string").try_cast("date")


def week_start(c: Column | str) -> Column:
    """Monday of the week, as a date."""
    return F.date_trunc("week", _col(c)).cast("date")


def week_list(first: Column, last: Column) -> Column:
    """Array of week starts from ``first`` to ``last``, both included."""
    return F.sequence(first, last, F.expr("interval 7 days"))


def add_weeks(c: Column | str, n: int | Column) -> Column:
    days = F.lit(7 * n) if isinstance(n, int) else (n * 7)
    return F.date_add(_col(c), days.cast("int"))


def week_angle(c: Column | str) -> Column:
    """Angle of the ISO week in a 52-week year; week 53 overshoots a full turn on purpose."""
    return F.weekofyear(_col(c)).cast("double") * F.lit(2 * math.pi / 52)


def clip(c: Column | str, low: float, high: float) -> Column:
    return F.greatest(F.least(_col(c), F.lit(high)), F.lit(low))


def log_odds(p: Column | str, eps: float = LOG_ODDS_EPSILON) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (F.lit(1.0) - q))


def sigmoid(x: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(x)))


def ratio(num: Column, den: Column) -> Column:
    """Double division that is null where the denominator is zero."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def percent_text(rate: Column) -> Column:
    """Percentage for display: one decimal below ten per cent, none above; null stays null.

    The double's exact value is rounded, an exact half to the even digit, as C's printf does; Java's formatter would round the shortest
    decimal text half up. Ten times the value is a sum of two doubles without error, whose second part settles what looks like a half.
    """
    pct = rate.cast("double") * 100
    size = F.abs(pct)
    near, far = size * 8, size * 2
    tenths = near + far
    rest = (near - (tenths - (tenths - near))) + (far - (tenths - near))
    low = F.floor(tenths).cast("double")
    up = F.when(tenths - low != 0.5, tenths - low > 0.5).when(rest != 0, rest > 0).otherwise(low % 2 == 1)
    one = (low + up.cast("double")) / 10
    short = F.format_string("%.1f%%", F.when(pct < 0, -one).otherwise(one))
    return F.when(pct < 10, short).when(pct.isNotNull(), F.format_string("%.0f%%", F.rint(pct)))


def in_box(lon: Column | str, lat: Column | str, box: tuple[float, float, float, float]) -> Column:
    """Coordinates inside (min lon, min lat, max lon, max lat); null coordinates are outside."""
    inside = _col(lon).between(box[0], box[2]) & _col(lat).between(box[1], box[3])
    return F.coalesce(inside, F.lit(False))


def flag(c: Column) -> Column:
    """Boolean with null read as false."""
    return F.coalesce(c, F.lit(False))


def tiers(score: Column, base: Column, cuts: list[tuple[str, float]], lowest: str) -> Column:
    """First tier whose multiple of ``base`` the score reaches."""
    out = None
    for name, multiple in cuts:
        hit = score >= base * F.lit(float(multiple))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(lowest) if out is None else out.otherwise(lowest)


def lookup(key: Column, table: dict, default: Column | None = None) -> Column:
    mapped = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]
    return mapped if default is None else F.coalesce(mapped, default)
