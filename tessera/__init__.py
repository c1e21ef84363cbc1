"""A typed, composable query layer over Spark DataFrames.

Schemas are declared as Python classes, queries are built by joining tables,
following keys as attributes and nesting correlated aggregates and optional
lookups; a compiler turns them into flat DataFrame plans.

Names are loaded at their first use, so that a worker that needs one module
loads only that.
"""

from importlib import import_module

_WHERE = {
    "plans.expr": ("Expr", "TypeMismatch", "lit", "none", "some"),
    "plans.scopes": ("ScopeError", "aggregate", "optional"),
    "operators.select": ("from_expr",),
    "schema": ("Column", "Schema", "SchemaError", "Table"),
    "sources.database": ("AsyncDatabase", "Config", "Conflict", "Database", "Drift", "Referenced", "RowRef"),
    "sources.external": ("ExternalSource", "query_one", "run_query"),
    "sources.migrate": ("Migrator",),
    "versions": ("Versioned", "schemas"),
    "types": ("Bool", "Bytes", "Date", "F64", "I64", "Option", "String", "Timestamp", "TimestampNs"),
}
_MODULE = {name: module for module, names in _WHERE.items() for name in names}
__all__ = sorted(_MODULE)


def __getattr__(name: str):
    if name not in _MODULE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_MODULE[name]}"), name)
