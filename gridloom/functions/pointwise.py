"""Functions of a sample's value, of the evaluation time, and of labels.

Each registry maps a query function to a builder of column expressions; all of them stay in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.errors import PlanError
from gridloom.functions import ieee

DAY_NS, HOUR_NS, MINUTE_NS = 86_400_000_000_000, 3_600_000_000_000, 60_000_000_000

#: name -> (builder, least and most number of literal arguments)
MATH: dict[str, tuple[Callable[..., Column], int, int]] = {
    **{
        name: (getattr(F, spark), 0, 0)
        for name, spark in {
            "abs": "abs", "acos": "acos", "acosh": "acosh", "asin": "asin", "asinh": "asinh", "atan": "atan", "atanh": "atanh", "cos": "cos", "cosh": "cosh", "deg": "degrees",
            "exp": "exp", "rad": "radians", "sgn": "signum", "sin": "sin", "sinh": "sinh", "sqrt": "sqrt", "tan": "tan", "tanh": "tanh",
        }.items()
    },
    "ceil": (ieee.ceil, 0, 0),
    "floor": (ieee.floor, 0, 0),
    "ln": (lambda x: ieee.logarithm(F.ln, x), 0, 0),
    "log2": (lambda x: ieee.logarithm(F.log2, x), 0, 0),
    "log10": (lambda x: ieee.logarithm(F.log10, x), 0, 0),
    "clamp": (ieee.clamp, 2, 2),
    "clamp_min": (ieee.clamp_min, 1, 1),
    "clamp_max": (ieee.clamp_max, 1, 1),
    "round": (lambda x, unit=1.0: ieee.round_to(x, unit), 0, 1),
}


def _whole(t: Column, unit: int) -> Column:
    """floor(t / unit) in integers."""
    return F.call_function("div", t - F.pmod(t, F.lit(unit)), F.lit(unit))


def _date(t: Column) -> Column:
    return F.date_from_unix_date(_whole(t, DAY_NS).cast("int"))


#: Functions of the evaluation time (ns, UTC).
TIME: dict[str, Callable[[Column], Column]] = {
    "time": lambda t: t / F.lit(1e9),
    "timestamp": lambda t: t / F.lit(1e9),
    "day_of_month": lambda t: F.dayofmonth(_date(t)),
    "day_of_week": lambda t: F.pmod(_whole(t, DAY_NS) + 4, F.lit(7)),
    "day_of_year": lambda t: F.dayofyear(_date(t)),
    "days_in_month": lambda t: F.dayofmonth(F.last_day(_date(t))),
    "hour": lambda t: F.pmod(_whole(t, HOUR_NS), F.lit(24)),
    "minute": lambda t: F.pmod(_whole(t, MINUTE_NS), F.lit(60)),
    "month": lambda t: F.month(_date(t)),
    "year": lambda t: F.year(_date(t)),
}


def anchored(pattern: str) -> str:
    """A pattern that must match the whole text; the dot excludes only line feeds."""
    return rf"(?d)\A(?:{pattern})\z"


def label_replace(value: Column, old: Column, replacement: str, pattern: str) -> Column:
    """``replacement`` with its $1, $2, ... expanded where ``pattern`` matches the whole of ``value``, else ``old``."""
    try:
        groups = re.compile(pattern).groups
    except re.error as e:
        raise PlanError(f"bad regular expression {pattern!r}: {e}") from None
    parts: list[Column] = []
    for text, group in re.findall(r"([^$]+|\$(?!\d))|\$(\d+)", replacement):
        if text:
            parts.append(F.lit(text))
        elif int(group) <= groups:
            parts.append(F.regexp_extract(value, anchored(pattern), int(group)))
    return F.when(value.rlike(anchored(pattern)), F.concat(*parts) if parts else F.lit("")).otherwise(old)


def label_join(separator: str, values: list[Column]) -> Column:
    return F.concat_ws(separator, *values) if values else F.lit("")
