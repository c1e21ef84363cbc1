"""Databases of versioned snapshots, and transactions over them.

A read transaction pins a snapshot.  A writing one stages the rows it adds,
changes or deletes, reads its own writes, and commits by writing those rows as
new layers of their tables, and one manifest; an exception leaves no trace.  One writer at a time holds the lock
of its process; writers of other processes meet at the manifest.
"""

from __future__ import annotations

import asyncio
import contextlib
import datetime as dt
import functools
import re
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from ..plans.scopes import IndexScan, Query, opened
from ..schema import Schema, SchemaError, diff, schema_hash

from . import external
from .store import FAN, WHOLE, CommitConflict, Store, temporary_folder


class Conflict(Exception):
    """A unique key is taken; ``row`` is the row that has it where the table has one unique key."""

    def __init__(self, table: Any, row: RowRef | None = None):
        super().__init__(f"a unique key of {table.__name__} is taken" + (f" by {row!r}" if row else ""))
        self.table, self.row = table, row


class Referenced(Exception):
    """A row that others refer to can't be deleted."""

    def __init__(self, table: Any, by: Any, column: str):
        super().__init__(f"a row of {table.__name__} is referenced by {by.__name__}.{column}")
        self.table, self.by, self.column = table, by, column


class Drift(Exception):
    """The stored schema isn't the declared one; ``differences`` say where, each with the place of the declaration."""

    def __init__(self, what: str, differences: list | None = None, schema: Schema | None = None):
        super().__init__(what)
        self.differences = differences or []
        for d in self.differences:
            d.place = schema.place(d.table, d.column) if schema else None


@dataclass(frozen=True)
class RowRef:
    """A reference to a row; equal by table and id, valid in the transaction that gave it."""

    table: Any
    id: int
    txn: Any = field(default=None, compare=False, repr=False)

    def _row_ref(self) -> RowRef:
        if self.txn is not None and not self.txn.open:
            raise RuntimeError("this row reference's transaction has ended")
        return self

    def __repr__(self) -> str:
        return f"{self.table._name}_{self.id}"

    def __lt__(self, other: RowRef) -> bool:
        return self.id < other.id


@dataclass(frozen=True)
class Config:
    """Where the snapshots are, whether commits check all references again, and how they are made durable.

    ``synchronous`` "full" waits until the manifest is on disk, "normal" until it has left this process.
    """

    folder: str | None = None
    check_references: bool = False
    synchronous: str = "full"

    @staticmethod
    def open(folder: str) -> Config:
        return Config(folder)

    @staticmethod
    def open_in_memory() -> Config:
        return Config(None)


class Database:
    """A schema over a store; created empty where the folder has no version."""

    def __init__(self, spark: SparkSession, schema: Schema, config: Config = Config()):  # noqa: B008
        self.spark, self.schema, self.config = spark, schema, config
        self.store = Store(spark, config.folder or temporary_folder(spark, "tessera-db"), config.synchronous)
        self._lock = threading.Lock()
        manifest = self.store.read()
        if manifest is None:
            self.store.commit(empty_manifest(schema))
        else:
            self._check(manifest)

    def _check(self, manifest: dict) -> None:
        if manifest["schema_version"] != self.schema.version:
            raise Drift(f"the database is at version {manifest['schema_version']}, the schema at {self.schema.version}")
        if found := diff(manifest["schema"], self.schema.canonical()):
            raise Drift("; ".join(found), found, self.schema)

    def transaction(self, fn: Callable[[Transaction], Any]) -> Any:
        """Results of ``fn`` on a pinned snapshot."""
        return self._run(fn, Transaction)

    def transaction_mut(self, fn: Callable[[WriteTransaction], Any]) -> Any:
        """Results of ``fn``, whose writes are committed when it returns and forgotten when it raises."""
        with self._lock:
            return self._run(fn, WriteTransaction, commit=True)

    transaction_mut_ok = transaction_mut

    def _run(self, fn: Callable, kind: type, commit: bool = False) -> Any:
        manifest = self.store.read()
        self._check(manifest)
        txn = kind(self, manifest)
        try:
            out = fn(txn)
            out = list(out) if hasattr(out, "__next__") else out
            if commit:
                txn._commit()
            return out
        finally:
            txn.open = False
            txn._close()

    def import_table(self, table: Any, df: DataFrame) -> None:
        """Replace a table's rows by ``df``, whose columns carry the declared external names; checks what :meth:`WriteTransaction.replace_table` does."""

        self.transaction_mut(lambda txn: txn.replace_table(table, external.conform(df, table)))


class AsyncDatabase:
    """The same transactions off the event loop's thread."""

    def __init__(self, database: Database):
        self.database = database

    async def transaction(self, fn: Callable) -> Any:
        return await asyncio.to_thread(self.database.transaction, fn)

    async def transaction_mut(self, fn: Callable) -> Any:
        return await asyncio.to_thread(self.database.transaction_mut, fn)

    transaction_mut_ok = transaction_mut


def empty_manifest(schema: Schema, version: int = 0) -> dict:
    return {
        "version": version, "schema_version": schema.version, "schema": schema.canonical(), "hash": schema_hash(schema.canonical()),
        "tables": {t._name: {"layers": [], "next_id": 1} for t in schema.tables},
    }


class LazyRow:
    """A row whose columns come at the first touch; references give lazy rows again."""

    def __init__(self, txn: Transaction, ref: RowRef, values: dict | None = None):
        object.__setattr__(self, "_txn", txn)
        object.__setattr__(self, "_ref", ref)
        object.__setattr__(self, "_values", values)

    def table_row(self) -> RowRef:
        return self._ref

    def _row_ref(self) -> RowRef:
        return self._ref

    def __getattr__(self, name: str) -> Any:
        kind = self._ref.table.column(name).type
        if self._values is None:
            object.__setattr__(self, "_values", self._txn._fetch(self._ref))
        value = self._values[name]
        if value is not None and kind.table is not None:
            return LazyRow(self._txn, RowRef(kind.table, value, self._txn))
        return value


class Transaction:
    """Queries against one snapshot."""

    def __init__(self, database: Database, manifest: dict):
        self.database, self.manifest, self.open = database, manifest, True
        self.spark, self.schema, self.store = database.spark, database.schema, database.store
        self._frames: dict[Any, DataFrame] = {}
        self._iterating = 0

    def _close(self) -> None:
        pass

    def source(self, table: Any) -> DataFrame:
        if not self.open:
            raise RuntimeError("the transaction has ended")
        if table is None:
            return external.one_row(self.spark)
        if table not in self.schema.tables:
            raise SchemaError(f"{table.__name__} is not in this schema")
        if table not in self._frames:
            self._frames[table] = self.store.load(self.manifest["tables"][table._name]["layers"], table.struct())
        return self._frames[table]

    def query(self, fn: Callable[[Query], Any]) -> Any:
        return external.run_query(self.source, fn)

    @contextlib.contextmanager
    def iterate(self, fn: Callable[[Query], Any]):
        """Stream results; the transaction takes no writes meanwhile."""
        with opened("query") as scope:
            self._iterating += 1
            try:
                yield fn(Query(scope, external.Runner(self.source)))
            finally:
                self._iterating -= 1

    def query_one(self, select: Any) -> Any:
        return external.query_one(self.source, select)

    def lazy(self, row: Any) -> LazyRow | None:
        """Lazy row of a reference or of a row expression; None for a missing one."""
        ref = row if isinstance(row, RowRef) else self.query_one(row)
        return None if ref is None else LazyRow(self, ref)

    def lazy_iter(self, target: Any) -> list[LazyRow]:
        """All rows of a table or ``Table.at``, their columns read in one query."""
        return [LazyRow(self, RowRef(t, r["id_"], self), r) for t, r in self._whole_rows(target)]

    def _whole_rows(self, target: Any):
        table = target.table if isinstance(target, IndexScan) else target

        def run(q: Query):
            row = q.join(target)
            return q.into_vec({"id_": row.__class__(row.node, row.type), **{c: row[c] for c in table._columns}})

        for r in self.query(run):
            yield table, {k: v.id if isinstance(v, RowRef) else v for k, v in r.items()}

    def _fetch(self, ref: RowRef) -> dict:
        row = self.source(ref.table).where(F.col(ref.table._pk) == ref.id).first()
        if row is None:
            raise KeyError(repr(ref))
        return {k: _plain(row[k]) for k in ref.table._columns}

    def spark_sql(self, sql: str, args: dict[str, Any] | None = None) -> DataFrame:
        """Any query over this snapshot's tables, by their stored names; ``args`` are its parameters, rows among them.

        The tables are common table expressions of the query, so session views of
        their names are neither used nor changed.
        """
        mine, views = uuid.uuid4().hex, []
        for t in self.schema.tables:
            if re.search(rf"(?i)\b{re.escape(t._name)}\b", sql):
                views.append(t._name)
                self.source(t).createOrReplaceTempView(f"{t._name}__{mine}")
        tables = ", ".join(f"`{v}` AS (SELECT * FROM `{v}__{mine}`)" for v in views)
        begin = re.match(r"(?is)\s*with\s+(recursive\s+)?", sql)
        whole = sql if not views else f"WITH {begin[1] or ''}{tables}, {sql[begin.end():]}" if begin else f"WITH {tables} {sql}"
        given = {k: v._row_ref().id if hasattr(v, "_row_ref") else v for k, v in (args or {}).items()}
        try:
            return self.spark.sql(whole, args=given or None)
        finally:
            for v in views:
                self.spark.catalog.dropTempView(f"{v}__{mine}")

    def plan(self, fn: Callable[[Query], DataFrame]) -> str:
        """Formatted physical plan of a query that gives a DataFrame."""
        df = self.query(fn)
        return df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def metadata(self, kind: str) -> DataFrame:
        """The catalog as rows: kind is "tables", "columns", "references" or "keys"."""
        s = self.manifest["schema"]
        rows = {
            "tables": ([(t, d["primary_key"]) for t, d in s.items()], "table string, primary_key string"),
            "columns": ([(t, c, k.lstrip("?"), k.startswith("?")) for t, d in s.items() for c, k in d["columns"].items()], "table string, column string, type string, optional boolean"),
            "references": ([(t, c, k.lstrip("?")[2:]) for t, d in s.items() for c, k in d["columns"].items() if "->" in k], "table string, column string, target string"),
            "keys": ([(t, ",".join(k), u) for t, d in s.items() for u, n in ((True, "unique"), (False, "index")) for k in d[n]], "table string, columns string, is_unique boolean"),
        }[kind]
        return self.spark.createDataFrame(*rows)


def _plain(value: Any) -> Any:
    if isinstance(value, bytearray):
        return bytes(value)
    if isinstance(value, dt.datetime) and value.tzinfo is None:
        return value.replace(tzinfo=dt.UTC)
    return value


class Mutable:
    """A row to be changed; written back when its block or the transaction ends, if it was touched."""

    def __init__(self, txn: WriteTransaction, ref: RowRef, values: dict):
        object.__setattr__(self, "_txn", txn)
        object.__setattr__(self, "_ref", ref)
        object.__setattr__(self, "_values", dict(values))
        object.__setattr__(self, "_dirty", set())
        object.__setattr__(self, "_guard", True)

    def __getattr__(self, name: str) -> Any:
        self._ref.table.column(name)
        return self._values[name]

    def __setattr__(self, name: str, value: Any) -> None:
        table = self._ref.table
        table.column(name)
        if self._guard and any(name in u for u in table._uniques):
            raise AttributeError(f"{name} is part of a unique key; change it in unique()")
        self._values[name] = self._txn._value(table, name, value)
        self._dirty.add(name)

    def __enter__(self) -> Mutable:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.into_table_row()

    def into_table_row(self) -> RowRef:
        if self._dirty:
            self._txn._write_back([self])
        return self._ref

    def unique(self, fn: Callable[[Mutable], Any]) -> Any:
        """Change unique columns in ``fn``; a conflict or an exception undoes what ``fn`` changed."""
        self.into_table_row()
        before, mark = dict(self._values), self._txn._mark()
        object.__setattr__(self, "_guard", False)
        try:
            out = fn(self)
            self._txn._check_unique(self._ref.table, self._values, but=self._ref.id)
            self.into_table_row()
            return out
        except BaseException:
            object.__setattr__(self, "_values", before)
            self._dirty.clear()
            self._txn._reset(mark)
            raise
        finally:
            object.__setattr__(self, "_guard", True)


class WriteTransaction(Transaction):
    """Queries and writes; deletes after ``downgrade``.

    A table's pending layers are (rows, keys of rows they replace or None); a
    table that is staged as a whole has none.
    """

    def __init__(self, database: Database, manifest: dict):
        super().__init__(database, manifest)
        self._next = {n: t["next_id"] for n, t in manifest["tables"].items()}
        self._new: dict[Any, list[tuple]] = {}
        self._keys: dict[Any, dict[tuple, dict[tuple, int]]] = {}
        self._layers: dict[Any, list[tuple[DataFrame | None, DataFrame | None]]] = {}
        self._whole: dict[Any, str | None] = {}
        self._guards: list[Mutable] = []
        self._scratch: list[str] = []
        self._weak = False

    # -- staging ------------------------------------------------------------
    def source(self, table: Any) -> DataFrame:
        if table is not None:
            self._settle(table)
        return super().source(table)

    def iterate(self, fn: Callable[[Query], Any]):
        for m in self._guards:
            m.into_table_row()
        for t in list(self._new):
            self._settle(t)
        return super().iterate(fn)

    def _mark(self) -> tuple:
        return dict(self._frames), {t: list(x) for t, x in self._layers.items()}, dict(self._whole)

    def _reset(self, mark: tuple) -> None:
        self._frames, self._layers, self._whole = mark

    def _writes(self) -> None:
        if self._iterating:
            raise RuntimeError("rows are being read; the transaction takes no writes until that ends")

    def _settle(self, table: Any) -> None:
        """Inserted rows join the staged frame at the first read."""
        if rows := self._new.pop(table, None):
            self._keys.pop(table, None)
            self._layer(table, self.spark.createDataFrame(rows, table.struct()))

    def _stage(self, table: Any, df: DataFrame, folder: str | None = None) -> None:
        """The whole table becomes ``df``, which ``folder`` has if it is written already."""
        self._writes()
        self._new.pop(table, None)
        self._keys.pop(table, None)
        self._frames[table] = df.select(*table.struct().names)
        self._layers.pop(table, None)
        self._whole[table] = folder

    def _layer(self, table: Any, rows: DataFrame | None, gone: DataFrame | None = None) -> None:
        """Rows are added after those with the keys ``gone`` are taken out."""
        self._writes()
        view, key = super().source(table), table._pk
        if gone is not None:
            gone = gone.select(F.col(key).cast("long").alias(key))
            view = view.join(gone.withColumnRenamed(key, "__gone"), F.col(key) == F.col("__gone"), "left_anti")
        rows = None if rows is None else rows.select(*table.struct().names)
        self._frames[table] = view if rows is None else view.unionByName(rows)
        if table in self._whole:
            self._whole[table] = None  # what is written is no longer all
        else:
            self._layers.setdefault(table, []).append((rows, gone))

    def _commit(self) -> None:
        for m in self._guards:
            m.into_table_row()
        for t in list(self._new):
            self._settle(t)
        if self.database.config.check_references:
            for t in {*self._layers, *self._whole}:
                self._check_references(t, self.source(t))
        tables = {**self.manifest["tables"]}
        for t, folder in self._whole.items():
            layers = [{"rows": folder or self.store.write(t._name, self._frames[t]), "level": WHOLE}]
            tables[t._name] = {"layers": layers, "next_id": self._next_id(t, peek=True)}
        for t, pending in self._layers.items():
            layers = list(tables[t._name]["layers"])
            if sum(gone is not None for _, gone in pending) > FAN:
                layers = [{"rows": self.store.write(t._name, self._frames[t]), "level": WHOLE}]
            else:
                for rows, gone in _joined(pending):
                    layer = {"rows": rows if rows is None else self.store.write(t._name, rows), "level": 0}
                    layers.append(layer if gone is None else layer | {"gone": self.store.write(t._name, gone)})
            tables[t._name] = {"layers": self.store.compacted(t._name, layers, t.struct()), "next_id": self._next_id(t, peek=True)}
        if self._whole or self._layers:
            self.store.commit(self.manifest | {"tables": tables})

    def _keep(self, df: DataFrame) -> DataFrame:
        """``df`` written once, so that a source that isn't repeatable is read once; it goes when the transaction ends."""
        self._scratch.append(self.store.write("scratch", df))
        return self.store.read_folder(self._scratch[-1], df.schema)

    def _close(self) -> None:
        for folder in self._scratch:
            self.store.drop(folder)

    def _next_id(self, table: Any, n: int = 1, peek: bool = False) -> int:
        at = self._next.get(table._name, 1)
        if not peek:
            self._next[table._name] = at + n
        return at

    def _value(self, table: Any, name: str, value: Any) -> Any:
        kind = table.column(name).type
        if value is None:
            if not kind.option:
                raise TypeError(f"{table.__name__}.{name} can't be missing")
            return None
        if kind.table is not None:
            ref = value._row_ref() if hasattr(value, "_row_ref") else value
            if not isinstance(ref, RowRef) or ref.table is not kind.table:
                raise TypeError(f"{table.__name__}.{name} refers to {kind.table.__name__}")
            return ref.id
        from ..types import type_of

        if type_of(value) != kind.some():
            raise TypeError(f"{table.__name__}.{name} is {kind}")
        if kind.name == "Timestamp" and value.tzinfo is None:
            return value.replace(tzinfo=dt.UTC)
        return value

    # -- inserts ------------------------------------------------------------
    def insert(self, table: Any, **values: Any) -> RowRef:
        """New row, or Conflict."""
        self._writes()
        if set(values) != set(table._columns):
            raise TypeError(f"{table.__name__} has columns {sorted(table._columns)}, not {sorted(values)}")
        row = {k: self._value(table, k, v) for k, v in values.items()}
        self._check_unique(table, row)
        ref = RowRef(table, self._next_id(table), self)
        self._new.setdefault(table, []).append((ref.id, *[row[k] for k in table._columns]))
        for unique in table._uniques:
            self._keys.setdefault(table, {}).setdefault(unique, {})[tuple(row[c] for c in unique)] = ref.id
        return ref

    def insert_ok(self, table: Any, **values: Any) -> RowRef:
        """New row of a table without unique keys."""
        if table._uniques:
            raise TypeError(f"{table.__name__} has unique keys; use insert")
        return self.insert(table, **values)

    def find_or_insert(self, table: Any, **values: Any) -> RowRef:
        """New row, or the one that has its unique key; the table has exactly one."""
        if len(table._uniques) != 1:
            raise TypeError(f"{table.__name__} has {len(table._uniques)} unique keys, not one")
        try:
            return self.insert(table, **values)
        except Conflict as taken:
            return taken.row

    def insert_many(self, table: Any, df: DataFrame) -> None:
        """Rows of a DataFrame with the table's columns; keys, missing values and references of the new rows are checked in bulk."""
        base = self._next_id(table, 0)
        kept = self._keep(df.select(*[F.col(c).cast(k.type.spark).alias(c) for c, k in table._columns.items()]))
        rows = with_dense_ids(kept, table._pk, base)
        self._check_rows(table, rows)
        for unique in table._uniques:
            there = self.source(table).select(*[F.col(c).alias(f"__{c}") for c in unique])
            same = functools.reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__{c}") for c in unique])
            if rows.join(there, same, "left_semi").limit(1).count():
                raise Conflict(table)
        self._next[table._name] = base + kept.count()
        self.source(table)
        self._layer(table, rows)

    def replace_table(self, table: Any, df: DataFrame) -> None:
        """All rows of a table, keys included; refused if a key repeats, a value or a referenced row is missing, or others refer to rows that go."""
        folder = self.store.write(table._name, df)
        rows = self.store.read_folder(folder, table.struct())
        try:
            if rows.groupBy(table._pk).count().where("count > 1").limit(1).count():
                raise Conflict(table)
            self._check_rows(table, rows)
            self._stage(table, rows, folder)
            for by, column in self.schema.references_to(table):
                self._check_references(by, self.source(by), (column,))
        except BaseException:
            self.store.drop(folder)
            raise
        self._next[table._name] = max(self._next_id(table, peek=True), (rows.agg(F.max(table._pk)).first()[0] or 0) + 1)

    def _check_rows(self, table: Any, rows: DataFrame) -> None:
        """Missing values, repeated unique keys and missing references among ``rows``."""
        sure = [table._pk, *[n for n, c in table._columns.items() if not c.type.option]]
        missing = rows.agg(*[F.max(F.col(n).isNull()).alias(n) for n in sure]).first()
        for n in sure:
            if missing[n]:
                raise TypeError(f"{table.__name__}.{n} can't be missing")
        for unique in table._uniques:
            if rows.groupBy(*unique).count().where("count > 1").limit(1).count():
                raise Conflict(table)
        self._check_references(table, rows)

    def _holder(self, table: Any, unique: tuple, row: dict, but: int | None) -> int | None:
        pending = self._keys.get(table, {}).get(unique, {}).get(tuple(row[c] for c in unique))
        if pending is not None and pending != but:
            return pending
        base = super().source(table)
        for c in unique:
            base = base.where(F.col(c) == F.lit(row[c]))
        found = base.where(F.col(table._pk) != (but if but is not None else -1)).select(table._pk).first()
        return found[0] if found else None

    def _check_unique(self, table: Any, row: dict, but: int | None = None) -> None:
        for unique in table._uniques:
            holder = self._holder(table, unique, row, but)
            if holder is not None:
                raise Conflict(table, RowRef(table, holder, self) if len(table._uniques) == 1 else None)

    def _check_keys(self, table: Any) -> None:
        for unique in table._uniques:
            if self.source(table).groupBy(*unique).count().where("count > 1").limit(1).count():
                raise Conflict(table)

    def _check_references(self, table: Any, rows: DataFrame, columns: tuple[str, ...] | None = None) -> None:
        for name, c in table._columns.items():
            target = c.type.table
            if target is not None and (columns is None or name in columns):
                # a table may refer to itself, to rows that come with these
                there = self.source(target).select(F.col(target._pk).alias("__there"))
                there = there.unionByName(rows.select(F.col(target._pk).alias("__there"))) if target is table else there
                if rows.where(F.col(name).isNotNull()).join(there, F.col(name) == F.col("__there"), "left_anti").limit(1).count():
                    raise Referenced(target, table, name)

    # -- updates ------------------------------------------------------------
    def mutable(self, row: Any) -> Mutable | None:
        """Guard of a row; None for a missing one."""
        ref = row._row_ref() if hasattr(row, "_row_ref") else self.query_one(row)
        if ref is None:
            return None
        m = Mutable(self, RowRef(ref.table, ref.id, self), self._fetch(ref))
        self._guards.append(m)
        return m

    def mutable_vec(self, target: Any) -> list[Mutable]:
        """Guards of all rows of a table or ``Table.at``; they are read in one query and written back in one."""
        out = [Mutable(self, RowRef(t, r["id_"], self), {k: v for k, v in r.items() if k != "id_"}) for t, r in self._whole_rows(target)]
        self._guards += out
        return out

    def _write_back(self, guards: list[Mutable]) -> None:
        """Replace the rows of touched guards; other touched guards of the table go along."""
        table = guards[0]._ref.table
        every = {id(g): g for g in [*guards, *[g for g in self._guards if g._ref.table is table]] if g._dirty}
        rows = [(g._ref.id, *[g._values[c] for c in table._columns]) for g in every.values()]
        new = self.spark.createDataFrame(rows, table.struct())
        self.source(table)
        self._layer(table, new, new.select(table._pk))
        for g in every.values():
            g._dirty.clear()

    def update_where(self, table: Any, condition: Any, **values: Any) -> None:
        """Set columns to DataFrame columns where a condition holds, in one job; unique keys and references are checked at the end."""
        df = self.source(table)
        self._stage(table, df.withColumns({k: F.when(condition, v).otherwise(F.col(k)).cast(table.column(k).type.spark) for k, v in values.items()}))
        if any(k in u for u in table._uniques for k in values):
            self._check_keys(table)
        self._check_references(table, self.source(table), tuple(values))

    # -- deletes ------------------------------------------------------------
    def downgrade(self) -> WriteTransaction:
        """Allow deletes."""
        self._weak = True
        return self

    def delete(self, ref: RowRef) -> bool:
        """Whether the row was there; Referenced if others point to it."""
        if not self._weak:
            raise RuntimeError("downgrade() the transaction before deleting")
        table = ref._row_ref().table
        for by, column in self.schema.references_to(table):
            if self.source(by).where(F.col(column) == ref.id).limit(1).count():
                raise Referenced(table, by, column)
        df = self.source(table)
        if not df.where(F.col(table._pk) == ref.id).limit(1).count():
            return False
        self._layer(table, None, self.spark.range(ref.id, ref.id + 1).withColumnRenamed("id", table._pk))
        self._guards = [g for g in self._guards if g._ref != ref]
        return True

    def delete_ok(self, ref: RowRef) -> bool:
        """Delete a row of a table that can't be referenced."""
        if ref.table._referable:
            raise TypeError(f"{ref.table.__name__} can be referenced; use delete")
        return self.delete(ref)


def _joined(pending: list[tuple]) -> list[tuple]:
    """Pending layers, those that only add rows joined with the one before."""
    out: list[tuple] = []
    for rows, gone in pending:
        if gone is None and out and out[-1][0] is not None and rows is not None:
            out[-1] = (out[-1][0].unionByName(rows), out[-1][1])
        else:
            out.append((rows, gone))
    return out


def with_dense_ids(df: DataFrame, name: str, start: int) -> DataFrame:
    """Number rows from ``start`` without bringing them together: per partition, after counting partitions."""
    from pyspark.sql import Window

    marked = df.withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", 33)
    sizes = marked.groupBy(part.alias("__part")).count()
    offsets = sizes.select("__part", (F.sum("count").over(Window.orderBy("__part")) - F.col("count")).alias("__before"))
    out = marked.withColumn("__part", part).join(F.broadcast(offsets), "__part")  # a row a partition
    return out.select((F.lit(start) + F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)).alias(name), *df.columns)


__all__ = ["AsyncDatabase", "CommitConflict", "Config", "Conflict", "Database", "Drift", "LazyRow", "Mutable", "Referenced", "RowRef", "Transaction", "WriteTransaction"]

