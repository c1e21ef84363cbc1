"""Value types: what may be compared, ordered, added, stored, and how Spark holds it."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T


@dataclass(frozen=True)
class ValueType:
    """A scalar type. ``option`` marks the type of values that may be missing."""

    name: str
    spark: str
    eq: bool = True
    ord: bool = True
    num: bool = False
    buff: bool = False
    option: bool = False
    table: Any = None  # the Table class of a row type

    def some(self) -> ValueType:
        """The type without the option."""
        return ValueType(**{**self.__dict__, "option": False})

    def or_none(self) -> ValueType:
        return ValueType(**{**self.__dict__, "option": True})

    @property
    def comparable(self) -> bool:
        return self.eq and not self.option

    @property
    def ordered(self) -> bool:
        return self.ord and not self.option

    def __str__(self) -> str:
        inner = f"Row[{self.table.__name__}]" if self.table is not None else self.name
        return f"Option[{inner}]" if self.option else inner


I64 = ValueType("I64", "bigint", num=True)
F64 = ValueType("F64", "double", num=True)
String = ValueType("String", "string", buff=True)
Bool = ValueType("Bool", "boolean")
Bytes = ValueType("Bytes", "binary", buff=True)
Timestamp = ValueType("Timestamp", "timestamp")
Date = ValueType("Date", "date")
#: Times with nanoseconds: seconds before, nanoseconds (0 to 999,999,999) after; they order as times do.
TimestampNs = ValueType("TimestampNs", "struct<sec:bigint,nano:int>")
SCALARS = (I64, F64, String, Bool, Bytes, Timestamp, TimestampNs, Date)


def row_type(table: Any) -> ValueType:
    """The type of references to rows of a table: equality only."""
    return ValueType("Row", "bigint", ord=False, table=table)


def Option(inner: Any) -> ValueType:  # noqa: N802
    """The option of a type or table; options don't nest."""
    kind = as_type(inner)
    if kind.option:
        raise TypeError("Option[Option[..]] is no type")
    return kind.or_none()


def as_type(kind: Any) -> ValueType:
    if isinstance(kind, ValueType):
        return kind
    python = {int: I64, float: F64, str: String, bool: Bool, bytes: Bytes, dt.datetime: Timestamp, dt.date: Date}
    if kind in python:
        return python[kind]
    if isinstance(kind, type) and getattr(kind, "_is_table", False):
        return row_type(kind)
    raise TypeError(f"{kind!r} is no value type")


def type_of(value: Any) -> ValueType:
    """The type of a Python literal."""
    for python, kind in ((bool, Bool), (int, I64), (float, F64), (str, String), (bytes, Bytes), (bytearray, Bytes), (dt.datetime, Timestamp), (dt.date, Date)):
        if isinstance(value, python):
            return kind
    raise TypeError(f"{type(value).__name__} is no literal type")


def spark_field(name: str, kind: ValueType) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind.spark), kind.option)
