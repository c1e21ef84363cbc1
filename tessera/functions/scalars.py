"""Operations of expressions as Spark columns.

Spark's own functions are used wherever they mean the same; guards stand where
they don't: division by zero is null, casts saturate, letters fold in ASCII only,
comparison of two values with ``eq`` is null-safe.  All are JVM-side except
rounding to a number of digits, and patterns, that come from a column.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import ValueType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MAX, _MIN = (1 << 63) - 1, -(1 << 63)
#: From here on every double is whole.
_WHOLE = float(1 << 52)


def literal(value: object, kind: ValueType) -> Column:
    if value is None:
        return F.lit(None).cast(kind.spark)
    return F.lit(value).cast(kind.spark) if kind.name in ("I64", "F64", "Row") else F.lit(value)


def _both(pick: Callable) -> Callable:
    # Spark's greatest and least skip nulls
    return lambda a, b: F.when(a.isNotNull() & b.isNotNull(), pick(a, b))


def _to_i64(x: Column) -> Column:
    return F.when(x >= float(1 << 63), F.lit(_MAX)).when(x <= -float(1 << 63), F.lit(_MIN)).otherwise(x.try_cast("long"))


def _whole(fn: Callable) -> Callable:
    # Spark's floor and ceil give bigint; huge and infinite values stay what they are
    return lambda x: F.when((F.abs(x) >= _WHOLE) | F.isnan(x), x).otherwise(fn(F.when(F.abs(x) < _WHOLE, x)).cast("double"))


@F.pandas_udf(T.DoubleType())
def _round_exact(x: pd.Series, digits: pd.Series) -> pd.Series:
    def one(v, n):
        if v is None or n is None or pd.isna(n) or math.isnan(v):
            return None
        if math.isinf(v) or abs(v) >= _WHOLE:
            return v
        return float(Decimal(v).quantize(Decimal(1).scaleb(-int(min(max(n, 0), 30))), rounding=ROUND_HALF_UP))

    return pd.Series([one(v, n) for v, n in zip(x, digits, strict=True)], dtype="float64")


def _round_known(x: Column, digits: int) -> Column:
    """The same for a known number of digits, in double arithmetic.

    A product's rounding error is itself a double, found by splitting the factors
    (Dekker), so the comparison with one half is exact; the quotient of two whole
    numbers below 2**53 is the double nearest to the decimal.
    """
    scale = float(10 ** max(0, digits))

    def halves(v: Column) -> tuple[Column, Column]:
        big = v * 134217729.0
        high = big - (big - v)
        return high, v - high

    def rounded(a: Column) -> Column:
        product = a * scale
        (ah, al), (sh, sl) = halves(a), halves(F.lit(scale))
        error = ((ah * sh - product) + ah * sl + al * sh) + al * sl
        whole = F.floor(product).cast("double")
        return (whole + F.when((product - whole) - 0.5 + error >= 0, F.lit(1.0)).otherwise(F.lit(0.0))) / scale

    a = F.abs(x)
    near = a * scale < _WHOLE * 2
    return F.when(F.isnan(x), F.lit(None)).when(~near, x).otherwise(F.signum(x) * rounded(F.when(near, a)))


def glob_regex(pattern: str) -> str:
    """Regular expression of a glob: ``*`` any text, ``?`` any character, ``[..]`` and ``[^..]`` sets."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        i += 1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[":
            j = i + (pattern[i : i + 1] == "^")
            end = pattern.find("]", j + 1)  # a "]" that comes first is a member
            if end < 0:
                return r"(?!)"  # an open set matches nothing
            members = "".join("-" if m == "-" and 0 < k < end - j - 1 else re.sub(r"([\\\[\]^&~\-])", r"\\\1", m) for k, m in enumerate(pattern[j:end]))
            out.append(f"[{'^' if j > i else ''}{members}]")
            i = end + 1
        else:
            out.append(re.escape(ch))
    return "".join(out)


@lru_cache(maxsize=10_000)
def _glob(pattern: str) -> re.Pattern:
    return re.compile(glob_regex(pattern), re.DOTALL)


@F.pandas_udf(T.BooleanType())
def _glob_column(text: pd.Series, pattern: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or p is None else _glob(p).fullmatch(t) is not None for t, p in zip(text, pattern, strict=True)], dtype="object")


def like_regex(pattern: str) -> str:
    """Regular expression of a LIKE pattern: ``%`` any text, ``_`` any character, ``\\`` takes the next as it is."""
    out, chars = [], iter(pattern)
    for ch in chars:
        if ch == "\\":
            ch = next(chars, "\\")
            out.append(re.escape(ch))
        else:
            out.append({"%": ".*", "_": "."}.get(ch) or re.escape(ch))
    return "".join(out)


def _java(pattern: str) -> str:
    # Python escapes more than Java knows
    return re.sub(r"\\([ '\"#%,/:;<=>@`~!&])", r"\1", pattern)


def _glob_any(a: Column, b: Column, constant: str | None) -> Column:
    return a.rlike(rf"(?s)\A(?:{_java(glob_regex(constant))})\z") if constant is not None else _glob_column(a, b)


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts)


#: name -> function of the argument columns
SIMPLE: dict[str, Callable[..., Column]] = {
    "eq": lambda a, b: a.eqNullSafe(b),
    "neq": lambda a, b: ~a.eqNullSafe(b),
    "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b,
    "gt": lambda a, b: a > b,
    "gte": lambda a, b: a >= b,
    "between": lambda a, low, high: a.between(low, high),
    "max2": _both(F.greatest),
    "min2": _both(F.least),
    "and": lambda a, b: a & b,
    "or": lambda a, b: a | b,
    "not": lambda a: ~a,
    "is_some": lambda a: a.isNotNull(),
    "is_none": lambda a: a.isNull(),
    "unwrap_or": lambda a, b: F.coalesce(a, b),
    "when_some": lambda missing, value: F.when(~missing, value),
    "add_i": lambda a, b: a + b,
    "sub_i": lambda a, b: a - b,
    "mul_i": lambda a, b: a * b,
    "add_f": lambda a, b: F.nanvl(a + b, F.lit(None).cast("double")),
    "sub_f": lambda a, b: F.nanvl(a - b, F.lit(None).cast("double")),
    "mul_f": lambda a, b: F.nanvl(a * b, F.lit(None).cast("double")),
    "div_f": lambda a, b: F.nanvl(F.try_divide(a, b), F.lit(None).cast("double")),
    # truncates toward zero: the remainder has the dividend's sign
    "div_i": lambda a, b: F.when(b == -1, -a).when(b != 0, F.call_function("div", a, F.when((b != 0) & (b != -1), b).otherwise(F.lit(1).cast("long")))),
    "modulo": lambda a, b: F.try_mod(a, b),
    "sign": lambda a: F.signum(a).cast("long"),
    "abs": lambda a: F.abs(a),
    "to_f64": lambda a: a.cast("double"),
    "to_i64": _to_i64,
    "floor": _whole(F.floor),
    "ceil": _whole(F.ceil),
    "round": lambda a, n: _round_exact(a, n),
    "contains": lambda a, b: ~F.instr(a, b).eqNullSafe(F.lit(0)),
    "replace": lambda a, b, c: F.replace(a, b, c),
    "ltrim": lambda a, b: F.ltrim(a, b),
    "rtrim": lambda a, b: F.rtrim(a, b),
    "trim": lambda a, b: F.trim(a, b),
    "concat": lambda a, b: F.concat(a, b),
    "lower": lambda a: F.translate(a, UPPER, LOWER),
    "upper": lambda a: F.translate(a, LOWER, UPPER),
    "char_len": lambda a: F.length(F.substring_index(a, "\0", 1)).cast("long"),
    "byte_len": lambda a: F.octet_length(a).cast("long"),
    "zero_blob": lambda n: F.unhex(F.repeat(F.lit("00"), F.greatest(n, F.lit(0)).cast("int"))),
    "to_second": lambda t: F.call_function("div", _micros(t), F.lit(1_000_000).cast("long")),
    "subsec_nanosecond": lambda t: (_micros(t) % 1_000_000) * 1000,
    "from_second": lambda n: F.timestamp_seconds(n),
    "add_nanosecond": lambda t, n: F.timestamp_micros(_micros(t) + F.call_function("div", n, F.lit(1000).cast("long"))),
    "to_nanos": lambda t: _nanos(_div(_micros(t) - F.pmod(_micros(t), F.lit(1_000_000)), 1_000_000), F.pmod(_micros(t), F.lit(1_000_000)) * 1000),
    "to_micros": lambda t: F.timestamp_micros(t["sec"] * 1_000_000 + _div(t["nano"].cast("long"), 1000)),
    "to_second_ns": lambda t: t["sec"] + ((t["sec"] < 0) & (t["nano"] > 0)).cast("long"),
    "subsec_nanosecond_ns": lambda t: t["nano"].cast("long") - F.when((t["sec"] < 0) & (t["nano"] > 0), F.lit(1_000_000_000)).otherwise(F.lit(0)).cast("long"),
    "add_nanosecond_ns": lambda t, n: _carry(t["sec"], t["nano"].cast("long") + F.pmod(n, F.lit(1_000_000_000)), n),
    "year": lambda d: F.year(d).cast("long"),
    "month": lambda d: F.month(d).cast("long"),
    "day": lambda d: F.dayofmonth(d).cast("long"),
    "first_of_month": lambda d, i: _in_range(F.add_months(F.trunc(d, "MM"), _near(i, 130_000))),
    "add_day": lambda d, n: _in_range(F.date_add(d, _near(n, 4_000_000))),
}


def _div(a: Column, by: int) -> Column:
    return F.call_function("div", a, F.lit(by).cast("long"))


def _near(n: Column, most: int) -> Column:
    """``n`` as an int; missing where no date is that far away."""
    return F.when(n.between(-most, most), n.try_cast("int"))


def _nanos(sec: Column, nano: Column) -> Column:
    return F.when(sec.isNotNull() & nano.isNotNull(), F.struct(sec.cast("long").alias("sec"), nano.cast("int").alias("nano")))


def _carry(sec: Column, nano: Column, added: Column) -> Column:
    whole = F.call_function("div", added - F.pmod(added, F.lit(1_000_000_000)), F.lit(1_000_000_000).cast("long"))
    over = (nano >= 1_000_000_000).cast("long")
    return _nanos(sec + whole + over, nano - over * 1_000_000_000)


def _in_range(d: Column) -> Column:
    return F.when(F.year(d).between(0, 9999), d)


def apply(name: str, args: list[Column], extra: object, constants: list[object]) -> Column:
    """Column of an operation; ``constants`` has the argument's value where it is a literal."""
    if name == "starts_with":
        return args[0].startswith(F.lit(extra))
    if name == "ends_with":
        return args[0].endswith(F.lit(extra))
    if name == "like":
        return args[0].rlike(rf"(?is)\A(?:{_java(like_regex(extra))})\z")
    if name == "glob":
        return _glob_any(args[0], args[1], constants[1] if isinstance(constants[1], str) else None)
    if name == "to_date_in_tz":
        return F.to_date(F.from_utc_timestamp(args[0], extra))
    if name == "round" and isinstance(constants[1], int) and constants[1] <= 22:
        return _round_known(args[0], constants[1])
    if name == "contains" and isinstance(constants[1], str):
        return args[0].contains(F.lit(constants[1]))
    return SIMPLE[name](*args)
