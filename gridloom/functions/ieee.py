"""IEEE-754 semantics for double columns, whatever Spark's ANSI mode does.

Plain operators raise or give null on division by zero, order NaN above everything, and turn
ceil and floor into integers; the query language wants none of this.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")
_WHOLE = float(2**53)


def lit(x: float) -> Column:
    return F.lit(float(x))


def divide(a: Column, b: Column) -> Column:
    negative = (F.when(b.cast("string") == "-0.0", lit(-1)).otherwise(lit(1))) * F.signum(a)
    return F.when(b != 0, a / F.nullif(b, lit(0))).when((a == 0) | F.isnan(a), lit(NAN)).when(negative > 0, lit(INF)).otherwise(lit(-INF))


def modulo(a: Column, b: Column) -> Column:
    return F.when(b != 0, a % F.nullif(b, lit(0))).otherwise(lit(NAN))


def power(a: Column, b: Column) -> Column:
    return F.when(a == 1, lit(1)).when((a == -1) & (F.abs(b) == INF), lit(1)).otherwise(F.pow(a, b))


def floor(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) >= _WHOLE), x).otherwise(F.floor(x).cast("double"))


def ceil(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) >= _WHOLE), x).otherwise(F.ceil(x).cast("double"))


def logarithm(f, x: Column) -> Column:
    return F.when(F.isnan(x), lit(NAN)).when(x == 0, lit(-INF)).when(x < 0, lit(NAN)).otherwise(f(x))


def clamp(x: Column, low: float, high: float) -> Column:
    if low > high or math.isnan(low) or math.isnan(high):
        return lit(NAN)
    return F.when(F.isnan(x), x).when(x < low, lit(low)).when(x > high, lit(high)).otherwise(x)


def clamp_min(x: Column, low: float) -> Column:
    return F.when(F.isnan(x), lit(low)).when(x < low, lit(low)).otherwise(x)


def clamp_max(x: Column, high: float) -> Column:
    return F.when(F.isnan(x), lit(high)).when(x > high, lit(high)).otherwise(x)


def round_to(x: Column, unit: float) -> Column:
    return x if unit == 0 else floor(x / lit(unit) + lit(0.5)) * lit(unit)


def compare(op: str, a: Column, b: Column) -> Column:
    """A comparison in which NaN is unequal to and not ordered with anything."""
    usual = ~F.isnan(a) & ~F.isnan(b)
    plain = {"==": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
    return (~usual | plain) if op == "!=" else (usual & plain)


ARITHMETIC = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": divide, "%": modulo, "^": power}


def fold(op: str, a: float, b: float) -> float:
    """An arithmetic operation or a comparison between two numbers."""
    if op in ("==", "!=", "<", ">", "<=", ">="):
        return float({"==": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op])
    if op == "/":
        if b:
            return a / b
        return NAN if a == 0 or math.isnan(a) else math.copysign(INF, a) * math.copysign(1, b)
    if op == "%":
        return math.fmod(a, b) if b and not math.isinf(a) else NAN
    if op == "^":
        try:
            return math.pow(a, b)
        except OverflowError:
            return INF
        except ValueError:
            return INF if a == 0 else NAN
    return {"+": a + b, "-": a - b, "*": a * b}[op]
