"""Schema declaration: tables as classes, keys, versions, structural hash and differences."""

from __future__ import annotations

import hashlib
import inspect
import json
import re
from typing import Any

from pyspark.sql import types as T

from .types import ValueType, as_type, row_type, spark_field


class SchemaError(Exception):
    """A schema that can't be."""


class Column:
    """A column. ``source`` names it in external data, ``unique``/``index`` declare one-column keys.

    ``kind`` is a value type, a Python type, a table class, a table's name (for
    tables declared later) or an Option of those.  ``since`` and ``until`` are
    versions, for :mod:`tessera.versions`.
    """

    def __init__(self, kind: Any, *, source: str | None = None, unique: bool = False, index: bool = False, option: bool = False, since: int | None = None, until: int | None = None):
        if isinstance(kind, type) and not getattr(kind, "_is_table", False) and kind.__module__ != "builtins" and kind.__module__ != "datetime":
            raise SchemaError(f"{kind.__name__} is no column type; use a table class or a value type")
        self.kind, self.source, self.unique, self.index, self.option = kind, source, unique, index, option
        self.since, self.until = since, until  # versions, for declarations of several
        self.name = ""
        self.table: Any = None

    @property
    def type(self) -> ValueType:
        kind = self.kind
        if isinstance(kind, str):
            scope = self.table.__dict__.get("_schema")
            known = {t.__name__: t for t in (scope.tables if scope else ())} | {self.table.__name__: self.table}
            if kind not in known:
                raise SchemaError(f"{self.table.__name__}.{self.name}: there is no table {kind}")
            kind = known[kind]
        kind = as_type(kind)
        return kind.or_none() if self.option else kind

    @property
    def external(self) -> str:
        return self.source or self.name


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


class _TableMeta(type):
    def __new__(mcs, name, bases, space):
        columns = {k: v for k, v in space.items() if isinstance(v, Column)}
        cls = super().__new__(mcs, name, bases, {k: v for k, v in space.items() if k not in columns})
        if not bases:
            return cls
        cls._columns = columns
        cls._name = space.get("__table__", snake(name))
        cls._pk = space.get("__primary_key__", "id")
        cls._pk_source = space.get("__primary_source__", cls._pk)
        cls._referable = not space.get("__no_reference__", False)
        cls._from = space.get("__from__")
        cls._uniques = [tuple(u) if isinstance(u, (tuple, list)) else (u,) for u in space.get("__unique__", ())]
        cls._indices = [tuple(i) if isinstance(i, (tuple, list)) else (i,) for i in space.get("__index__", ())]
        for key, c in columns.items():
            c.name, c.table = key, cls
            cls._uniques += [(key,)] if c.unique else []
            cls._indices += [(key,)] if c.index else []
        if cls._pk in columns:
            raise SchemaError(f"{name}: column {cls._pk} is named like the primary key")
        for key in [*cls._uniques, *cls._indices]:
            for part in key:
                if part not in columns:
                    raise SchemaError(f"{name}: there is no column {part} to index")
        return cls

    def __getattr__(cls, name):
        raise AttributeError(f"{cls.__name__} has no attribute {name}")


class Table(metaclass=_TableMeta):
    """Base of tables.  A subclass has Columns and may set:

    ``__unique__``/``__index__`` (tuples of column names), ``__primary_key__``
    (default "id"), ``__no_reference__``, ``__from__`` (the table it continues from
    the version before), ``__table__`` (its stored name).
    """

    _is_table = True
    _columns: dict[str, Column] = {}

    @classmethod
    def column(cls, name: str) -> Column:
        if name not in cls._columns:
            raise SchemaError(f"{cls.__name__} has no column {name}")
        return cls._columns[name]

    @classmethod
    def type_of(cls, name: str) -> ValueType:
        return row_type(cls) if name == cls._pk else cls.column(name).type

    @classmethod
    def at(cls, **values: Any):
        """Rows whose columns equal ``values``; the columns must be a prefix of a declared key."""
        from .plans.scopes import IndexScan

        names = list(values)
        keys = [*cls._uniques, *cls._indices]
        if not any(sorted(k[: len(names)]) == sorted(names) for k in keys):
            raise SchemaError(f"{cls.__name__}: {names} is no prefix of a declared key")
        return IndexScan(cls, values)

    @classmethod
    def by(cls, **values: Any):
        """The row with this complete unique key, as an optional row."""
        from .plans.expr import lookup

        if not any(sorted(u) == sorted(values) for u in cls._uniques):
            raise SchemaError(f"{cls.__name__}: {sorted(values)} is no unique key")
        return lookup(cls, values)

    @classmethod
    def struct(cls) -> T.StructType:
        pk = T.StructField(cls._pk, T.LongType(), False)
        return T.StructType([pk, *[spark_field(k, c.type) for k, c in cls._columns.items()]])


class Schema:
    """One version of a set of tables; checks keys and references."""

    def __init__(self, *tables: type[Table], version: int = 0, previous: Schema | None = None):
        self.tables, self.version, self.previous = tables, version, previous
        for t in tables:
            t._schema = self
        names = [t._name for t in tables]
        if len(set(names)) != len(names):
            raise SchemaError("two tables have one name")
        for t in tables:
            if t._from is not None and previous is None:
                raise SchemaError(f"{t.__name__} continues a table, but there is no version before")
            for key, c in t._columns.items():
                kind = c.type
                if kind.table is not None:
                    if not kind.table._referable:
                        raise SchemaError(f"{t.__name__}.{key}: {kind.table.__name__} can't be referenced")
                    if kind.table not in tables:
                        raise SchemaError(f"{t.__name__}.{key}: {kind.table.__name__} is not in this version")
            for unique in t._uniques:
                for part in unique:
                    if t.column(part).type.option:
                        raise SchemaError(f"{t.__name__}: optional column {part} in a unique key")

    def table(self, name: str) -> type[Table]:
        for t in self.tables:
            if t._name == name or t.__name__ == name:
                return t
        raise SchemaError(f"there is no table {name}")

    def canonical(self) -> dict:
        """Structure without the order of columns and keys."""
        def kind(k: ValueType) -> str:
            return f"{'?' if k.option else ''}{'->' + k.table._name if k.table is not None else k.name}"

        return {
            t._name: {
                "primary_key": t._pk,
                "columns": {k: kind(c.type) for k, c in sorted(t._columns.items())},
                "unique": sorted({tuple(sorted(u)) for u in t._uniques}),
                "index": sorted({i for i in t._indices}),
            }
            for t in sorted(self.tables, key=lambda t: t._name)
        }

    def place(self, table: str, column: str | None = None) -> str | None:
        """File and line of a table's declaration, or of a column's in it."""
        declared = next((t for t in self.tables if t._name == table), None)
        try:
            lines, first = inspect.getsourcelines(declared)
            file = inspect.getsourcefile(declared)
        except (OSError, TypeError):
            return None
        at = next((i for i, line in enumerate(lines) if column and re.match(rf"\s*{re.escape(column)}\s*=", line)), 0)
        return f"{file}:{first + at}"

    def hash(self) -> str:
        return schema_hash(self.canonical())

    def references_to(self, table: type[Table]) -> list[tuple[type[Table], str]]:
        return [(t, k) for t in self.tables for k, c in t._columns.items() if c.type.table is table]


def schema_hash(canonical: dict) -> str:
    """Hash of tables, columns and unique keys; plain indices don't count."""
    bare = {t: {k: v for k, v in d.items() if k != "index"} for t, d in canonical.items()}
    return hashlib.blake2b(json.dumps(bare, sort_keys=True).encode(), digest_size=16).hexdigest()


class Difference(str):
    """A sentence about a table, and a column or key of it; ``place`` is where the declaration is, if it is known."""

    def __new__(cls, table: str, what: str, column: str | None = None):
        out = super().__new__(cls, what)
        out.table, out.column, out.place = table, column, None
        return out


def diff(stored: dict, declared: dict) -> list[Difference]:
    """What a stored schema has otherwise than a declared one; plain indices don't count."""
    out = []
    for t in sorted({*stored, *declared}):
        if t not in stored:
            out.append(Difference(t, f"table {t} is declared but not stored"))
            continue
        if t not in declared:
            out.append(Difference(t, f"table {t} is stored but not declared"))
            continue
        s, d = stored[t], declared[t]
        if s["primary_key"] != d["primary_key"]:
            out.append(Difference(t, f"table {t}: the primary key is stored as {s['primary_key']}, declared as {d['primary_key']}", d["primary_key"]))
        for c in sorted({*s["columns"], *d["columns"]}):
            a, b = s["columns"].get(c), d["columns"].get(c)
            if a is None:
                out.append(Difference(t, f"table {t}: column {c} ({b}) is declared but not stored", c))
            elif b is None:
                out.append(Difference(t, f"table {t}: column {c} ({a}) is stored but not declared", c))
            elif a != b:
                out.append(Difference(t, f"table {t}: column {c} is stored as {a}, declared as {b}", c))
        mine, theirs = {tuple(u) for u in s["unique"]}, {tuple(u) for u in d["unique"]}
        for keys, what in ((mine - theirs, "stored but not declared"), (theirs - mine, "declared but not stored")):
            out += [Difference(t, f"table {t}: unique {', '.join(u)} is {what}", u[0]) for u in sorted(keys)]
    return out
