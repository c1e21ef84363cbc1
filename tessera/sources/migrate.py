"""Stepwise migration of a database through the versions of its schema.

A step maps old tables to new ones as DataFrame projections, so rows keep their
ids and nothing is read row by row.  All steps are staged; ``finish`` writes one
manifest.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import Schema, diff, schema_hash
from . import external
from .database import Config, Conflict, Database, Drift, RowRef, WriteTransaction, empty_manifest
from .store import WHOLE, Store


class Step:
    """One step from a schema to the next: queries on the old tables, definitions of the new ones."""

    def __init__(self, migrator: Migrator, old: Schema, new: Schema):
        self._migrator, self.old, self.new = migrator, old, new
        self.frames: dict[Any, DataFrame] = {}
        self.filled: set[Any] = set()

    def source(self, table: Any) -> DataFrame:
        return external.one_row(self._migrator.spark) if table is None else self._migrator.frames[table._name]

    def query(self, fn: Callable) -> Any:
        """Any query on the old tables."""
        return external.run_query(self.source, fn)

    def migrate(self, table: Any, where: Column | None = None, dangling: Callable[[], None] | None = None, **columns: Column | Callable[[DataFrame], Column]) -> None:
        """Rows of ``table`` from the one it continues, with their ids.

        Columns of the same name and type are kept, ``columns`` gives the others
        as expressions over the old row.  Rows outside ``where`` are left out;
        ``dangling`` is called if others refer to those.  A unique key that the
        new rows share is a Conflict.
        """
        old = table._from or self.old.table(table._name)
        df = self.source(old)
        df = df if where is None else df.where(where)
        out = [F.col(old._pk).alias(table._pk)]
        for name, c in table._columns.items():
            if name in columns:
                value = columns[name](df) if callable(columns[name]) else columns[name]
            elif name in old._columns and _storage(old.column(name).type) == _storage(c.type):
                value = F.col(name)
            else:
                raise Drift(f"{table.__name__}.{name} is new; say what it holds")
            out.append(value.cast(c.type.spark).alias(name))
        self.frames[table] = df.select(*out)
        self._check(table, old)
        self._migrator.dangling[table] = dangling

    def _check(self, table: Any, old: Any) -> None:
        """A Conflict names an old row whose new one takes another's key."""
        for unique in table._uniques:
            shared = self.frames[table].groupBy(*unique).agg(F.count(F.lit(1)).alias("__n"), F.max(table._pk).alias("__row")).where("__n > 1").first()
            if shared:
                raise Conflict(table, RowRef(old, shared["__row"]))

    def migrate_rest(self, table: Any, **columns: Any) -> None:
        """Add the old rows that earlier calls for ``table`` left out."""
        first, old = self.frames[table], table._from or self.old.table(table._name)
        missing = self.source(old).join(first.select(F.col(table._pk).alias(old._pk)), old._pk, "left_anti")
        kept = self._migrator.frames[old._name]
        self._migrator.frames[old._name] = missing
        try:
            self.migrate(table, **columns)
        finally:
            self._migrator.frames[old._name] = kept
        self.frames[table] = first.unionByName(self.frames[table])
        self._check(table, old)

    def fill(self, table: Any, df: DataFrame) -> None:
        """Rows of a new table, with the table's key and columns."""
        self.frames[table] = df.select(*[F.col(f.name).cast(f.dataType) for f in table.struct()])
        if self.frames[table].groupBy(table._pk).count().where("count > 1").limit(1).count():
            raise Conflict(table)
        self._check(table, table)
        self.filled.add(table)


def _storage(kind: Any) -> tuple:
    return (kind.name, kind.option)


@dataclass
class Migrator:
    """Walks a database up; ``finish`` gives it, or None if it is newer than the last schema."""

    spark: SparkSession
    schema: Schema
    config: Config
    store: Store = None
    manifest: dict = None
    moved: bool = False
    frames: dict[str, DataFrame] = field(default_factory=dict)
    dangling: dict[Any, Any] = field(default_factory=dict)

    @staticmethod
    def open(spark: SparkSession, schema: Schema, config: Config) -> Migrator | None:
        """None if the database is older than ``schema``."""
        store = Store(spark, config.folder)
        manifest = store.read()
        m = Migrator(spark, schema, config, store, manifest)
        if manifest is None:
            m.manifest, m.moved = empty_manifest(schema), True
        elif manifest["schema_version"] < schema.version:
            return None
        elif manifest["schema_version"] == schema.version and (found := diff(manifest["schema"], schema.canonical())):
            raise Drift("; ".join(found), found, schema)
        m.frames = {t._name: store.load(m.manifest["tables"].get(t._name, {"layers": []})["layers"], t.struct()) for t in schema.tables}
        return m

    @property
    def _here(self) -> bool:
        return self.manifest["schema_version"] == self.schema.version

    def migrate(self, new: Schema, fn: Callable[[Step], None] = lambda step: None) -> Migrator:
        """To the next version, if the database is at this one.

        Tables that ``fn`` doesn't define are kept where their columns are the
        same, created empty where they are new; tables that ``new`` lacks are
        dropped.
        """
        if not self._here:
            self.schema = new
            return self
        step = Step(self, self.schema, new)
        fn(step)
        for t in new.tables:
            if t in step.frames:
                continue
            old = t._from or next((o for o in self.schema.tables if o._name == t._name), None)
            if old is None:
                step.frames[t] = self.spark.createDataFrame([], t.struct())
            else:
                step.migrate(t)
        next_ids = {}
        for t in new.tables:
            old = t._from or next((o for o in self.schema.tables if o._name == t._name), None)
            next_ids[t._name] = self.manifest["tables"].get(old._name, {"next_id": 1})["next_id"] if old else 1
            if t in step.filled:
                next_ids[t._name] = max(next_ids[t._name], (step.frames[t].agg(F.max(t._pk)).first()[0] or 0) + 1)
        for t in new.tables:
            for name, c in t._columns.items():
                target = c.type.table
                if target is None:
                    continue
                there = step.frames[target].select(F.col(target._pk).alias("__there"))
                if step.frames[t].where(F.col(name).isNotNull()).join(there, F.col(name) == F.col("__there"), "left_anti").limit(1).count():
                    callback = self.dangling.get(target)
                    if callback is None:
                        raise Drift(f"{t.__name__}.{name} refers to rows that the migration leaves out")
                    callback()
                    raise Drift(f"{t.__name__}.{name} refers to rows that the migration leaves out")
        self.frames = {t._name: df for t, df in step.frames.items()}
        self.manifest = self.manifest | {
            "schema_version": new.version, "schema": new.canonical(), "hash": schema_hash(new.canonical()),
            "tables": {t._name: {"layers": [], "next_id": next_ids[t._name]} for t in new.tables},
        }
        self.schema, self.moved, self.dangling = new, True, {}
        return self

    def fixup(self, fn: Callable[[WriteTransaction], None]) -> Migrator:
        """Changes to a database that this migrator created or moved."""
        if not (self.moved and self._here):
            return self
        database = object.__new__(Database)
        database.spark, database.schema, database.config, database.store = self.spark, self.schema, self.config, self.store
        txn = WriteTransaction(database, self.manifest)
        txn._frames = {t: self.frames[t._name] for t in self.schema.tables}
        try:
            fn(txn)
            for m in txn._guards:
                m.into_table_row()
            for t in list(txn._new):
                txn._settle(t)
        finally:
            txn.open = False
        self.frames = {t._name: txn._frames[t] for t in self.schema.tables}
        for t in self.schema.tables:
            self.manifest["tables"][t._name]["next_id"] = txn._next_id(t, peek=True)
        return self

    def finish(self) -> Database | None:
        if not self._here:
            return None
        if self.moved:
            tables = {n: {"layers": [{"rows": self.store.write(n, df), "level": WHOLE}], "next_id": self.manifest["tables"][n]["next_id"]} for n, df in self.frames.items()}
            self.store.commit(self.manifest | {"tables": tables})
        return Database(self.spark, self.schema, self.config)
