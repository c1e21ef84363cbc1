"""Tables over files that other programs wrote, read in place."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text_forms import parsed


class ExternalSource:
    """``source(table)`` for a folder with one file or folder a table.

    Columns are renamed and cast to the declared types, so pruning and filters
    reach the files.  A table without a key of its own gets one from
    ``monotonically_increasing_id``, which is stable for the same files and
    settings; import the table where it must outlast those.
    """

    def __init__(self, spark: SparkSession, folder: str, pattern: str = "{folder}/{name}.parquet", format: str = "parquet"):
        self.spark, self.folder, self.pattern, self.format = spark, folder, pattern, format
        self._read: dict[Any, DataFrame] = {}

    def __call__(self, table: Any) -> DataFrame:
        if table is None:
            return one_row(self.spark)
        if table not in self._read:
            raw = self.spark.read.format(self.format).load(self.pattern.format(folder=self.folder, name=table._name))
            self._read[table] = conform(raw, table)
        return self._read[table]


def one_row(spark: SparkSession) -> DataFrame:
    return spark.range(1).select()


def conform(raw: DataFrame, table: Any) -> DataFrame:
    """``raw`` with the table's columns and types; the key is made up if the data has none.

    Texts for columns of times and dates must have the stored form.
    """
    key = F.col(table._pk_source).cast("long") if table._pk_source in raw.columns else F.monotonically_increasing_id()
    texts = {name for name, kind in raw.dtypes if kind == "string"}
    columns = []
    for name, c in table._columns.items():
        kind = c.type.spark
        value = parsed(F.col(c.external), kind) if c.external in texts and kind in ("timestamp", "date") else F.col(c.external).cast(kind)
        columns.append(value.alias(name))
    return raw.select(key.alias(table._pk), *columns)


class Runner:
    """Compiles and runs queries against a source."""

    def __init__(self, source: Callable[[Any], DataFrame]):
        self.source = source

    def frame(self, rows, order, select, take=None) -> DataFrame:
        from ..plans.compiler import compile_query

        named = select.exprs()
        names: list[str] = []
        for name, _ in named:
            base, n = name, 1
            while name in names:
                n += 1
                name = f"{base}_{n}"
            names.append(name)
        return compile_query(self.source, rows, order, [e.node for _, e in named], names, take)

    def rows(self, rows, order, select, take=None):
        """Decoded rows, streamed partition by partition; equal expressions travel once."""
        from ..plans.compiler import compile_query

        nodes = [e.node for _, e in select.exprs()]
        distinct = list(dict.fromkeys(nodes))
        place = [distinct.index(n) for n in nodes]
        df = compile_query(self.source, rows, order, distinct, [f"c{i}" for i in range(len(distinct))], take)
        for r in df.toLocalIterator():
            yield select.decode([r[i] for i in place])


def run_query(source: Callable[[Any], DataFrame], fn: Callable[[Any], Any]) -> Any:
    """Results of ``fn`` over a query scope; DataFrames stay lazy, iterators are read to the end."""
    from ..plans.scopes import Query, opened

    with opened("query") as scope:
        out = fn(Query(scope, Runner(source)))
        return list(out) if hasattr(out, "__next__") else out


def query_one(source: Callable[[Any], DataFrame], select: Any) -> Any:
    """The selection over a single row without tables."""
    rows = run_query(source, lambda q: q.into_vec(select() if callable(select) else select))
    if len(rows) != 1:
        raise RuntimeError(f"query_one gave {len(rows)} rows")
    return rows[0]
