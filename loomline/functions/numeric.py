"""Floating-point functions with IEEE results where Spark's differ (errors, nulls, bigints)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F



def nan() -> Column:
    return F.lit(float("nan"))


def inf() -> Column:
    return F.lit(float("inf"))


def divide(a: Column, b: Column) -> Column:
    """a / b; a zero divisor gives a signed infinity, or NaN for 0/0. The sign of a zero divisor counts as plus."""
    return F.when(b == 0, F.when(F.isnan(a) | (a == 0), nan()).when(a > 0, inf()).otherwise(-inf())).otherwise(a / F.when(b != 0, b))


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of the dividend; NaN for a zero divisor or an infinite dividend."""
    return F.when((b == 0) | F.isnan(a) | F.isnan(b) | (F.abs(a) == inf()), nan()).when(F.abs(b) == inf(), a).otherwise(a % F.when(b != 0, b))


def whole(f) -> callable:
    """ceil or floor that leaves NaN, infinities and values beyond 2**53 as they are."""
    return lambda x: F.when(F.isnan(x) | (F.abs(x) >= 2.0**53), x).otherwise(f(F.when(F.abs(x) < 2.0**53, x)).cast("double"))


def logarithm(f) -> callable:
    return lambda x: F.when(F.isnan(x) | (x < 0), nan()).when(x == 0, -inf()).otherwise(f(x))


def rounded(x: Column, to: float = 1.0) -> Column:
    """Half away from zero, to the nearest multiple of ``to``."""
    y = x / to
    up = F.when(y >= 0, whole(F.floor)(y + 0.5)).otherwise(whole(F.ceil)(y - 0.5))
    return F.when(F.isnan(y) | (F.abs(y) >= 2.0**52), y).otherwise(up) * to


def sign(x: Column) -> Column:
    return F.when(F.isnan(x), 0.0).when(x > 0, 1.0).when(x < 0, -1.0).otherwise(0.0)


def asinh(x: Column) -> Column:
    a = F.abs(x)
    return F.when(F.isnan(x), nan()).otherwise(F.when(x < 0, -1.0).otherwise(1.0) * F.when(a == inf(), inf()).otherwise(F.log(a + F.sqrt(a * a + 1.0))))


def atanh(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) >= 1), nan()).otherwise(F.atanh(F.when(F.abs(x) < 1, x)))


def acosh(x: Column) -> Column:
    return F.when(F.isnan(x) | (x < 1), nan()).otherwise(F.acosh(x))


def compare(op: str, a: Column, b: Column) -> Column:
    """IEEE comparison: NaN equals nothing."""
    unordered = F.isnan(a) | F.isnan(b)
    plain = {"==": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
    return unordered | plain if op == "!=" else ~unordered & plain


def arithmetic(op: str, a: Column, b: Column) -> Column:
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: divide(a, b), "%": lambda: modulo(a, b), "^": lambda: F.pow(a, b)}[op]()


def fold(op: str, a: float, b: float) -> float:
    """The same operators on plain numbers."""
    if op == "/":
        return a / b if b else math.nan if a != a or a == 0 else math.copysign(math.inf, a)
    if op == "%":
        return math.fmod(a, b) if b and not math.isinf(a) and a == a and b == b else math.nan
    if op == "^":
        try:
            r = a**b
            return math.nan if isinstance(r, complex) else r
        except (OverflowError, ZeroDivisionError):
            return math.inf
    return {"+": a + b, "-": a - b, "*": a * b}[op] if op in "+-*" else float({"==": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op])


def utc(x: Column) -> Column:
    return F.timestamp_seconds(whole(F.floor)(x).cast("long"))


def date_part(f) -> callable:
    return lambda x: F.when(F.isnan(x) | (F.abs(x) > 2.5e11), nan()).otherwise(f(utc(F.when(F.abs(x) <= 2.5e11, x))).cast("double"))


#: Element-wise functions of one vector.
ELEMENTWISE = {
    "abs": F.abs, "ceil": whole(F.ceil), "floor": whole(F.floor), "exp": F.exp, "sqrt": F.sqrt, "round": rounded,
    "ln": logarithm(F.log), "log2": logarithm(F.log2), "log10": logarithm(F.log10),
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan,
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asinh": asinh, "acosh": acosh, "atanh": atanh,
    "deg": F.degrees, "rad": F.radians, "sgn": sign,
    "year": date_part(F.year), "month": date_part(F.month), "day_of_month": date_part(F.dayofmonth), "day_of_week": date_part(lambda t: F.dayofweek(t) - 1),
    "hour": date_part(F.hour), "minute": date_part(F.minute), "days_in_month": date_part(lambda t: F.dayofmonth(F.last_day(t))), "day_of_year": date_part(F.dayofyear),
}
DATE_PARTS = ("year", "month", "day_of_month", "day_of_week", "hour", "minute", "days_in_month", "day_of_year")
