"""Cell-wise functions as Column expressions. Nodata is NULL; results that IEEE calls NaN become NULL, infinities stay."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.errors import MinMaxSwapped

Value = Column | float | int | bool | str | None
INF = float("inf")


def col(x: Value) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def num(x: Value) -> Column:
    return col(x).cast("double")


def clean(x: Column) -> Column:
    """NaN becomes NULL."""
    return F.when(~F.isnan(x), x)


# Arithmetic


def add(x, y):
    return clean(num(x) + num(y))


def subtract(x, y):
    return clean(num(x) - num(y))


def multiply(x, y):
    return clean(num(x) * num(y))


def divide(x, y):
    """IEEE division, which never fails: x/0 is an infinity with the sign of x, 0/0 is NULL."""
    a, b = num(x), num(y)
    return F.when(b == 0, F.when(a == 0, None).otherwise(F.signum(a) * F.lit(INF))).otherwise(clean(F.try_divide(a, b)))


def mod(x, y):
    """Remainder with the sign of the divisor; NULL for the divisor 0."""
    a, b = num(x), num(y)
    return F.when(b != 0, a - b * F.floor(F.try_divide(a, b)))


def absolute(x):
    return F.abs(num(x))


def sgn(x):
    return F.signum(num(x))


def sqrt(x):
    return clean(F.sqrt(num(x)))


def power(base, p):
    return clean(F.pow(num(base), num(p)))


def exp(p):
    return F.exp(num(p))


def ln(x):
    a = num(x)
    return F.when(a == 0, F.lit(-INF)).otherwise(F.ln(a))


def log(x, base):
    return divide(ln(x), ln(base))


def floor(x):
    return _large(num(x), F.floor(num(x)))


def ceil(x):
    return _large(num(x), F.ceil(num(x)))


def _large(x: Column, whole: Column) -> Column:
    """From 2^52 on a double is whole already, and a bigint might not hold it."""
    return F.when(F.abs(x) >= 2.0**52, x).otherwise(whole.cast("double"))


def _int(x):
    a = num(x)
    return F.when(a < 0, ceil(a)).otherwise(floor(a))


def _round(x, p=0):
    """Half to even, after scaling in binary."""
    a = num(x)
    return F.rint(a) if p == 0 else clean(F.rint(a * F.lit(10.0**p)) / F.lit(10.0**p))


def sin(x):
    return clean(F.sin(num(x)))


def cos(x):
    return clean(F.cos(num(x)))


def tan(x):
    return clean(F.tan(num(x)))


def arcsin(x):
    return clean(F.asin(num(x)))


def arccos(x):
    return clean(F.acos(num(x)))


def arctan(x):
    return F.atan(num(x))


def sinh(x):
    return F.sinh(num(x))


def cosh(x):
    return F.cosh(num(x))


def tanh(x):
    return F.tanh(num(x))


def arsinh(x):
    return clean(F.asinh(num(x)))


def arcosh(x):
    return clean(F.acosh(num(x)))


def artanh(x):
    return clean(F.atanh(num(x)))


def arctan2(y, x):
    return F.atan2(num(y), num(x))


def e():
    return F.lit(math.e)


def pi():
    return F.lit(math.pi)


def nan(data=None):
    return F.lit(None).cast("double")


def constant(x):
    return col(x)


def clip(x, min, max):
    if not isinstance(min, Column) and not isinstance(max, Column) and min > max:
        raise MinMaxSwapped(f"{min} > {max}")
    a, low, high = num(x), num(min), num(max)
    return F.when(a.isNotNull() & low.isNotNull() & high.isNotNull(), F.greatest(F.least(a, high), low))


def linear_scale_range(x, inputMin, inputMax, outputMin=0, outputMax=1):
    low, high = (inputMin, inputMax) if inputMin <= inputMax else (inputMax, inputMin)
    return add(multiply(divide(subtract(clip(x, low, high), inputMin), float(inputMax) - inputMin), float(outputMax) - outputMin), outputMin)


def normalized_difference(x, y):
    return divide(subtract(x, y), add(x, y))


# Comparison


def eq(x, y, delta=None, case_sensitive=True, kinds: tuple[str, str] | None = None):
    """NULL if either is NULL. kinds: the types of both sides if they aren't literals: number, string, boolean or other.

    Values of different kinds are never equal, and neither are other kinds (dates). With delta, numbers are equal
    within delta plus 1e-5 of the second one.
    """
    a, b = col(x), col(y)
    kind = tuple(k or _kind(v) for k, v in zip(kinds or (None, None), (x, y)))
    known = [k for k in kind if k]
    some = a.isNotNull() & b.isNotNull()
    if "other" in known or len(known) == 2 and known[0] != known[1]:
        return F.when(some, F.lit(False))
    if "string" in known:
        return a == b if case_sensitive else F.lower(a) == F.lower(b)
    if delta is not None:
        return F.abs(num(a) - num(b)) <= F.lit(float(delta)) + F.lit(1e-5) * F.abs(num(b))
    return a == b


def _kind(x) -> str | None:
    if isinstance(x, bool):
        return "boolean"
    return "number" if isinstance(x, (int, float)) else "string" if isinstance(x, str) else None


def neq(x, y, delta=None, case_sensitive=True, kinds=None):
    return ~eq(x, y, delta, case_sensitive, kinds)


def gt(x, y):
    return col(x) > col(y)


def gte(x, y):
    return col(x) >= col(y)


def lt(x, y):
    return col(x) < col(y)


def lte(x, y):
    return col(x) <= col(y)


def between(x, min, max, exclude_max=False):
    a, low, high = col(x), col(min), col(max)
    inside = (a >= low) & ((a < high) if exclude_max else (a <= high))
    return F.when(a.isNotNull() & low.isNotNull() & high.isNotNull(), inside)


def is_nan(x):
    """On a column that isn't cleaned yet."""
    a = col(x)
    return a.isNull() | F.coalesce(F.isnan(a.try_cast("double")), F.lit(False))


def is_nodata(x):
    return col(x).isNull()


def is_infinite(x):
    return F.coalesce(F.abs(col(x).try_cast("double")) == F.lit(INF), F.lit(False))


def is_valid(x):
    return col(x).isNotNull() & ~is_infinite(x) & ~F.coalesce(F.isnan(col(x).try_cast("double")), F.lit(False))


# Logic: three values, as SQL has them


def truth(x) -> Column:
    return col(x).cast("boolean")


def _and(x, y):
    return truth(x) & truth(y)


def _or(x, y):
    return truth(x) | truth(y)


def xor(x, y):
    return truth(x) != truth(y)


def _not(x):
    return ~truth(x)


def _if(value, accept, reject=None):
    return F.when(truth(value), col(accept)).otherwise(col(reject))


# Text


def _text(op):
    def run(data, pattern, case_sensitive=True):
        d, p = col(data), col(pattern)
        if not case_sensitive:
            d, p = F.lower(d), F.lower(p)
        return F.when(F.length(d) > 0, op(d, p))

    return run


text_begins = _text(F.startswith)
text_contains = _text(F.contains)
text_ends = _text(F.endswith)


def text_concat(data, separator=""):
    """data: an array column, or a list of values. NULL and booleans are joined as lower-case words."""

    def word(v):
        if isinstance(v, Column):
            return F.coalesce(v.cast("string"), F.lit("none"))
        return F.lit("none" if v is None else str(v).lower() if isinstance(v, bool) else str(v))

    parts = F.array(*[word(v) for v in data]) if isinstance(data, (list, tuple)) else F.transform(data, lambda v: F.coalesce(v.cast("string"), F.lit("none")))
    return F.array_join(parts, "none" if separator is None else str(separator).lower() if isinstance(separator, bool) else str(separator))


# Dates: strings as in ISO 8601, or timestamps


def moment(x) -> Column:
    """A timestamp; texts without an offset are in UTC (the session's time zone must be UTC)."""
    return F.to_timestamp(col(x)) if isinstance(x, str) else col(x).cast("timestamp")


def date_between(x, min, max, exclude_max=False):
    return between(moment(x), moment(min), moment(max), exclude_max)


# Seconds of the units of fixed length.
SECONDS = {"millisecond": 0.001, "second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def date_difference(date1, date2, unit="second"):
    """date2 - date1. Months and years count the calendar borders between the dates."""
    a, b = moment(date1), moment(date2)
    if unit == "month":
        return ((F.year(b) * 12 + F.month(b)) - (F.year(a) * 12 + F.month(a))).cast("double")
    if unit == "year":
        return (F.year(b) - F.year(a)).cast("double")
    if unit not in SECONDS:
        raise ValueError(f"unknown unit: {unit}")
    return (F.unix_micros(b) - F.unix_micros(a)).cast("double") / F.lit(SECONDS[unit] * 1e6)


def date_shift(date, value, unit):
    """A text in the precision of the input, with its offset; months and years end on the last day a month has."""
    text = col(date).cast("string")
    suffix = F.regexp_extract(text, r"(Z|[+-]\d{2}:?\d{2})$", 1)
    timed = F.contains(text, F.lit("T"))
    suffix = F.when(timed, suffix).otherwise("")
    bare = F.when(timed, F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2})$", "")).otherwise(text)
    at = bare.cast("timestamp_ntz")
    n = col(value)
    if unit in ("month", "year"):
        # adding months clamps to the last day of the month; the time of day is kept
        day = F.add_months(at.cast("date"), (n * (12 if unit == "year" else 1)).cast("int"))
        moved = F.concat(day.cast("string"), F.lit(" "), F.date_format(at, "HH:mm:ss.SSSSSS")).cast("timestamp_ntz")
    elif unit in SECONDS:
        moved = F.timestamp_add("MICROSECOND", (n.cast("double") * F.lit(SECONDS[unit] * 1e6)).cast("bigint"), at)
    else:
        raise ValueError(f"unknown unit: {unit}")
    fraction = F.contains(text, F.lit(".")) | F.lit(unit == "millisecond")
    shown = F.when(~timed, F.date_format(moved, "yyyy-MM-dd")).when(fraction, F.date_format(moved, "yyyy-MM-dd'T'HH:mm:ss.SSS")).otherwise(F.date_format(moved, "yyyy-MM-dd'T'HH:mm:ss"))
    return F.concat(shown, suffix)
