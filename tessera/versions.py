"""Tables declared once for a range of versions; every version's schema follows from them.

    class Person(Versioned):
        name = Column(String)
        email = Column(String, since=1, unique=True)
        age = [Column(I64, until=2), Column(F64, since=2)]

    class Note(Versioned):
        __since__, __until__ = 1, 3
        author = Column(Person)

    first, second, third, fourth = schemas(Person, Note, last=3)

A range begins at ``since`` (from the first version where there is none) and ends
before ``until``.  A table continues itself from the version before; with
``__from__`` it continues another one in the first version that it has.
"""

from __future__ import annotations

import copy
from typing import Any

from .schema import Column, Schema, SchemaError, Table


class Versioned:
    """Base of declarations: what a Table may have, and ``__since__`` and ``__until__``."""

    _is_table = True
    __since__: int = 0
    __until__: int | None = None


def _within(since: int | None, until: int | None, version: int) -> bool:
    return (since or 0) <= version and (until is None or version < until)


def _checked(name: str, since: int | None, until: int | None, begin: int, end: int) -> None:
    at, to = since or begin, end if until is None else until
    if not begin <= at < to <= end:
        raise SchemaError(f"{name}: versions {at} up to {to} are empty or reach beyond {begin} up to {end}")


def _column(declared: Any, version: int) -> Column | None:
    fit = [c for c in (declared if isinstance(declared, list) else [declared]) if _within(c.since, c.until, version)]
    if not fit:
        return None
    if len(fit) > 1:
        raise SchemaError(f"two columns of one name in version {version}")
    column = copy.copy(fit[0])
    if isinstance(column.kind, type) and issubclass(column.kind, Versioned):
        column.kind = column.kind.__name__
    return column


def schemas(*declared: type[Versioned], last: int) -> list[Schema]:
    """The schemas of versions 0 to ``last``."""
    for d in declared:
        _checked(d.__name__, d.__since__, d.__until__, 0, last + 1)
        begin, end = d.__since__, last + 1 if d.__until__ is None else d.__until__
        for name, value in _columns(d).items():
            for c in value if isinstance(value, list) else [value]:
                _checked(f"{d.__name__}.{name}", c.since, c.until, begin, end)
    out: list[Schema] = []
    for version in range(last + 1):
        tables = []
        for d in (d for d in declared if _within(d.__since__, d.__until__, version)):
            columns = {name: c for name, value in _columns(d).items() if (c := _column(value, version))}
            space = {k: v for k, v in vars(d).items() if k in ("__primary_key__", "__primary_source__", "__no_reference__", "__table__", "__doc__")}
            for keys in ("__unique__", "__index__"):
                every = [k if isinstance(k, (tuple, list)) else (k,) for k in vars(d).get(keys, ())]
                # a key is there while its columns are
                space[keys] = [tuple(k) for k in every if set(k) <= set(columns)]
            before = vars(d).get("__from__") if version == d.__since__ else d
            if version and before is not None:
                space["__from__"] = out[-1].table(before.__name__)
            tables.append(type(Table)(d.__name__, (Table,), {**space, **columns}))
        out.append(Schema(*tables, version=version, previous=out[-1] if out else None))
    return out


def _columns(d: type[Versioned]) -> dict[str, Any]:
    return {k: v for k, v in vars(d).items() if isinstance(v, Column) or isinstance(v, list) and v and all(isinstance(c, Column) for c in v)}


__all__ = ["Versioned", "schemas"]
