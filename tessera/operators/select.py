"""Structured selections over expressions.

A selection is a list of expressions and a decoder.  Expressions, tuples, dicts,
dataclass instances, None and ``.map`` compose to any depth; equal expressions
share a column.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
from collections.abc import Callable
from typing import Any

from ..plans.expr import Expr, Lit, Op, lit
from ..types import I64, Timestamp


class Select:
    """Base of selections."""

    def exprs(self) -> list[tuple[str, Expr]]:
        """(suggested name, expression) in the order that ``decode`` takes values."""
        raise NotImplementedError

    def decode(self, values: list) -> Any:
        raise NotImplementedError

    def nodes(self) -> list[Any]:
        return [e.node for _, e in self.exprs()]

    def map(self, fn: Callable[[Any], Any]) -> Select:
        return MapSelect(self, fn)

    def unscoped(self, scope: Any) -> Select:
        return Unscoped(self, scope)


class ExprSelect(Select):
    def __init__(self, expr: Expr, name: str = "value"):
        self.expr, self.name = expr, name

    def exprs(self):
        return [(self.name, self.expr)]

    def decode(self, values):
        kind, value = self.expr.type, values[0]
        if value is not None and kind.table is not None:
            from ..sources.database import RowRef

            return RowRef(kind.table, value)
        if value is not None and kind.some() == Timestamp and isinstance(value, dt.datetime) and value.tzinfo is None:
            return value.replace(tzinfo=dt.UTC)
        return bytes(value) if isinstance(value, bytearray) else value


class UnitSelect(Select):
    def exprs(self):
        return [("unit", Expr(Lit(1, I64), I64))]

    def decode(self, values):
        return None


class PartsSelect(Select):
    """Several selections and a function that joins their values."""

    def __init__(self, parts: list[tuple[str, Select]], build: Callable[[list], Any]):
        self.parts, self.build = parts, build

    def exprs(self):
        out = []
        for name, part in self.parts:
            inner = part.exprs()
            plain = isinstance(part, (ExprSelect, UnitSelect)) and len(inner) == 1
            out += [(name if plain else f"{name}_{n}", e) for n, e in inner]
        return out

    def decode(self, values):
        out, at = [], 0
        for _, part in self.parts:
            n = len(part.exprs())
            out.append(part.decode(values[at : at + n]))
            at += n
        return self.build(out)


class MapSelect(Select):
    def __init__(self, inner: Select, fn: Callable[[Any], Any]):
        self.inner, self.fn = inner, fn

    def exprs(self):
        return self.inner.exprs()

    def decode(self, values):
        return self.fn(self.inner.decode(values))


class Unscoped(Select):
    """A selection that may leave a scope because something else guards it."""

    def __init__(self, inner: Select, scope: Any):
        self.inner, self.scope = inner, scope

    def exprs(self):
        from ..plans.scopes import _bare

        return [(n, Expr(_bare(e.node, self.scope), e.type)) for n, e in self.inner.exprs()]

    def decode(self, values):
        return self.inner.decode(values)


class OptionalSelect(Select):
    """A selection that is None where ``some`` is false; its columns are then null."""

    def __init__(self, some: Expr, inner: Select):
        self.some, self.inner = some, inner

    def exprs(self):
        missing = self.some.not_().node
        return [("some", self.some), *[(n, Expr(Op("when_some", (missing, e.node)), e.type.or_none())) for n, e in self.inner.exprs()]]

    def decode(self, values):
        return self.inner.decode(values[1:]) if values[0] else None


def as_select(value: Any) -> Select:
    if isinstance(value, Select):
        return value
    if value is None or value == ():
        return UnitSelect()
    if isinstance(value, tuple):
        return PartsSelect([(f"_{i}", as_select(v)) for i, v in enumerate(value)], tuple)
    if isinstance(value, dict):
        return PartsSelect([(k, as_select(v)) for k, v in value.items()], lambda vs: dict(zip(value, vs, strict=True)))
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        kind, fields = type(value), [f.name for f in dataclasses.fields(value)]
        return PartsSelect([(f, as_select(getattr(value, f))) for f in fields], lambda vs: kind(**dict(zip(fields, vs, strict=True))))
    return ExprSelect(lit(value))


def from_expr(kind: type, row: Expr) -> Select:
    """A dataclass filled from the row's columns of the same names.

    A field whose type is a dataclass is filled from the row that the column
    refers to; one marked ``field(metadata={"option": True})`` from an optional
    row, None if it is missing.
    """
    from ..plans.scopes import optional

    if row.type.option:
        return optional(lambda o: o.then_select(from_expr(kind, o.and_(row))))
    parts = []
    hints = {f.name: f for f in dataclasses.fields(kind)}
    types = _hints(kind)
    for name in hints:
        inner = types[name]
        value = row[name]
        nested = next((t for t in (inner, *getattr(inner, "__args__", ())) if dataclasses.is_dataclass(t)), None)
        parts.append((name, from_expr(nested, value) if nested else as_select(value)))
    return PartsSelect(parts, lambda vs: kind(**dict(zip(hints, vs, strict=True))))


def _hints(kind: type) -> dict[str, Any]:
    import typing

    return typing.get_type_hints(kind)
