"""From symbolic queries to flat DataFrames.

A frame is a DataFrame with a column for every scan's field, to which lookups and
aggregates are joined when an expression asks for them, each once.

An aggregate that depends on rows outside becomes a grouped frame joined back by
a left join.  Two ways to group it:

* By equality: if outer values occur only in conditions ``inner = outer``, the
  inner sides are the group keys and the outer sides the join keys.  The inner
  frame reads nothing but its own scans.
* By domain: otherwise the distinct outer values that the aggregate reads, taken
  from the frame outside, join its scans and are the group keys.  This covers
  inequalities and any depth of nesting.

A filter that an aggregate's rows exist, or don't, is a semi or anti join where
the equalities allow it.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from .expr import Agg, Field, Lit, Lookup, LookupField, Op, Rows, Scan, Scoped, children, outer_fields
from .ordered import ordered_join

Source = Callable[[Any], DataFrame]


def _conjuncts(filters: Iterable[Any]) -> list[Any]:
    out, todo = [], sorted(filters, key=_stable)
    while todo:
        f = todo.pop(0)
        if isinstance(f, Op) and f.name == "and":
            todo = [*f.args, *todo]
        elif f not in out:
            out.append(f)
    return out


def _stable(node: Any) -> tuple:
    """An order of filters that doesn't depend on hashes: by the scans they read, then by shape."""
    return (tuple(sorted((f.scan.number, f.column) for f in outer_fields(node))), type(node).__name__, getattr(node, "name", ""), str(getattr(node, "extra", "")))


#: Operations that give a value whatever their arguments are, and those that give one where all arguments are values.
#: All others can make a missing value: division by zero, results that aren't numbers, dates out of range.
_ALWAYS = frozenset({"eq", "neq", "is_some", "is_none"})
_KEEP = frozenset(
    "lt lte gt gte between and or not max2 min2 add_i sub_i mul_i sign abs to_f64 floor ceil starts_with ends_with contains replace ltrim rtrim trim "
    "glob like concat lower upper char_len byte_len to_second subsec_nanosecond to_date_in_tz year month day".split()
)


def _nullable(node: Any) -> bool:
    """Whether a value may be missing, as far as types and operations tell."""
    if isinstance(node, Scoped):
        return _nullable(node.arg)
    if isinstance(node, Lit):
        return node.value is None or node.value != node.value
    if isinstance(node, Field):
        return node.scan.table.type_of(node.column).option
    if isinstance(node, LookupField):
        return not node.lookup.sure or node.lookup.table.type_of(node.column).option
    if isinstance(node, Op):
        if node.name == "unwrap_or":
            return all(_nullable(a) for a in node.args)
        return node.name not in _ALWAYS and (node.name not in _KEEP or any(_nullable(a) for a in node.args))
    if isinstance(node, Agg):
        return node.function in ("avg", "max", "min")
    return True


class Frame:
    """A DataFrame under construction and the columns it has for nodes."""

    def __init__(self, source: Source, names: Iterable[int] | None = None):
        self.source, self.df, self.columns = source, None, {}
        # the scans and the filters that need nothing else; lookups and aggregates add columns to ``df`` only
        self.core: DataFrame | None = None
        self.names = names if names is not None else itertools.count()
        self.groups: dict[Rows, list[Agg]] = {}

    def _name(self, kind: str) -> str:
        return f"{kind}{next(self.names)}"

    # -- scans --------------------------------------------------------------
    def _scan(self, table: Any, kind: str) -> tuple[DataFrame, dict[str, str]]:
        prefix = self._name(kind)
        named = {c: f"{prefix}__{c}" for c in [table._pk, *table._columns]}
        return self.source(table).select(*[F.col(c).alias(n) for c, n in named.items()]), named

    def start(self, rows: Rows, filters: list[Any], domain: tuple[DataFrame, dict[Field, str]] | None = None) -> list[Any]:
        """Join the scans, and the domain, on the filters that only read those; gives the other filters."""
        local = set(rows.scans)
        parts: list[tuple[DataFrame, set]] = []
        if domain:
            self.columns |= domain[1]
            parts.append((domain[0], set(domain[1])))
        for scan in rows.scans:
            df, named = self._scan(scan.table, "t")
            fields = {Field(scan, c): n for c, n in named.items()}
            self.columns |= fields
            parts.append((df, set(fields)))
        simple, rest = [], []
        known = set(self.columns)
        for f in filters:
            (simple if self._plain(f, local, known) else rest).append(f)
        if not parts:
            self.df = self.source(None)
            return filters
        need = {f: {x for x in outer_fields(f)} for f in simple}
        # start from the domain or the first scan, then always join what a condition links
        self.df, have = parts.pop(0)
        placed: set[Any] = set()

        def usable(fields: set) -> list[Any]:
            return [f for f in simple if f not in placed and need[f] <= fields]

        first = usable(have)
        placed.update(first)
        for f in first:
            self.df = self.df.where(self.column(f))
        while parts:
            at = next((i for i, (_, fields) in enumerate(parts) if any(self._equi(f, have, fields) for f in usable(have | fields))), None)
            at = next((i for i, (_, fields) in enumerate(parts) if any(not need[f] <= fields for f in usable(have | fields))), 0) if at is None else at
            df, fields = parts.pop(at)
            own = usable(fields)
            placed.update(own)
            for f in own:
                df = df.where(self.column(f))
            both = usable(have | fields)
            placed.update(both)
            joined = self._join_in_order(df, both, have, fields)
            have |= fields
            on = functools.reduce(lambda a, b: a & b, [self.column(f) for f in both]) if both else None
            self.df = joined if joined is not None else self.df.join(df, on) if on is not None else self.df.crossJoin(df)
        return rest

    def _join_in_order(self, df: DataFrame, both: list[Any], have: set, fields: set) -> DataFrame | None:
        """The join with ``df`` where both an equality and a comparison link it and no equality gives a row one partner at most."""
        links = [f for f in both if self._equi(f, have, fields)]
        bounds = ((f, *b) for f in both if f not in links for b in self._bounds(f))
        mine = lambda n: set(outer_fields(n)) <= have
        here = lambda n: set(outer_fields(n)) <= fields
        found = next((b for b in bounds if outer_fields(b[1]) and outer_fields(b[2]) and ((mine(b[1]) and here(b[2])) or (here(b[1]) and mine(b[2])))), None)
        if not links or found is None or any(self._unique(a) for f in links for a in f.args):
            return None
        f, x, y, strict = found
        low = have if mine(x) else fields
        keys = []
        for link in links:
            a, b = link.args if set(outer_fields(link.args[0])) <= low else reversed(link.args)
            keys.append((self.column(a), self.column(b), link.name == "eq" and (_nullable(a) or _nullable(b))))
        rest = [self.column(r) for r in both if r not in links and (r is not f or f.name == "between")]
        left, right = (self.df, df) if low is have else (df, self.df)
        return ordered_join(left, right, keys, self.column(x), self.column(y), strict, rest, self._name)

    @staticmethod
    def _bounds(f: Any) -> list[tuple[Any, Any, bool]]:
        """What ``f`` says about order: the lower value, the higher one, and whether they differ."""
        if not isinstance(f, Op) or f.name not in ("lt", "lte", "gt", "gte", "between"):
            return []
        if f.name == "between":
            v, low, high = f.args
            return [(low, v, False), (v, high, False)]
        low, high = f.args if f.name in ("lt", "lte") else reversed(f.args)
        return [(low, high, f.name in ("lt", "gt"))]

    @staticmethod
    def _unique(node: Any) -> bool:
        return isinstance(node, Field) and (node.column == node.scan.table._pk or (node.column,) in node.scan.table._uniques)

    @staticmethod
    def _plain(node: Any, local: set, known: set) -> bool:
        if isinstance(node, (Agg, LookupField)):
            return False
        if isinstance(node, Field):
            return node in known
        return all(Frame._plain(c, local, known) for c in children(node))

    @staticmethod
    def _equi(f: Any, have: set, fields: set) -> bool:
        if not (isinstance(f, Op) and f.name in ("eq", "same")):
            return False
        a, b = (set(outer_fields(x)) for x in f.args)
        return bool(a and b) and ((a <= have and b <= fields) or (b <= have and a <= fields))

    # -- expressions --------------------------------------------------------
    def announce(self, nodes: Iterable[Any]) -> None:
        """Note the aggregates that will be asked for, so that those over equal rows share a pass."""
        todo, seen = list(nodes), set()
        while todo:
            node = todo.pop()
            if node in seen:
                continue
            seen.add(node)
            if isinstance(node, Agg):
                group = self.groups.setdefault(node.rows, [])
                if node not in group:
                    group.append(node)
            todo += children(node)

    def column(self, node: Any) -> Column:
        while isinstance(node, Scoped):
            node = node.arg
        if node in self.columns:
            return F.col(self.columns[node])
        if isinstance(node, Lit):
            return scalars.literal(node.value, node.kind)
        if isinstance(node, Op):
            args = [self.column(a) for a in node.args]
            if node.name in ("eq", "same") and (node.name == "same" or not any(_nullable(a) for a in node.args)):
                return args[0] == args[1]
            return scalars.apply(node.name, args, node.extra, [a.value if isinstance(a, Lit) else None for a in node.args])
        if isinstance(node, LookupField):
            self._look_up(node.lookup)
        elif isinstance(node, Agg):
            self._aggregate(node)
        return F.col(self.columns[node])

    def _look_up(self, lookup: Lookup) -> None:
        keys = [(c, self.column(v)) for c, v in lookup.key]
        df, named = self._scan(lookup.table, "u")
        on = functools.reduce(lambda a, b: a & b, [F.col(named[c]) == v for c, v in keys])
        self.df = self.df.join(df, on, "inner" if lookup.sure else "left")
        self.columns |= {LookupField(lookup, c): n for c, n in named.items()}

    # -- aggregates ---------------------------------------------------------
    def _aggregate(self, node: Agg) -> None:
        self.announce([node])
        group = [a for a in self.groups[node.rows] if a not in self.columns]
        outer = sorted({f for a in group for f in outer_fields(a)}, key=lambda f: (f.scan.number, f.column))
        if split := self._by_equality(node.rows, group):
            keys, filters = split
            inner = Frame(self.source, self.names)
            df, names, results = inner.grouped(node.rows, filters, [i for i, _ in keys], group)
            pairs = [(F.col(n), self.column(o), _nullable(i) or _nullable(o)) for n, (i, o) in zip(names, keys, strict=True)]
        else:
            values = [self.column(f) for f in outer]
            named = {f: self._name("d") for f in outer}
            # lookups and aggregates change no rows, so those joined so far add nothing to the domain
            domain = self.core.select(*[v.alias(named[f]) for f, v in zip(outer, values, strict=True)]).distinct()
            inner = Frame(self.source, self.names)
            df, names, results = inner.grouped(node.rows, _conjuncts(node.rows.filters), outer, group, (domain, named))
            pairs = [(F.col(n), v, _nullable(f)) for n, v, f in zip(names, values, outer, strict=True)]
        if pairs:
            on = functools.reduce(lambda a, b: a & b, [k.eqNullSafe(v) if missing else k == v for k, v, missing in pairs])
            self.df = self.df.join(df, on, "left")
        else:
            self.df = self.df.crossJoin(F.broadcast(df))  # one row
        for a, raw in zip(group, results, strict=True):
            name = self._name("a")
            default = {"sum": lambda c: F.coalesce(c, F.lit(0)), "count_distinct": lambda c: F.coalesce(c, F.lit(0)).cast("long"), "exists": lambda c: F.coalesce(c, F.lit(0)) > 0}
            self.df = self.df.withColumn(name, default.get(a.function, lambda c: c)(F.col(raw)))
            self.columns[a] = name

    @staticmethod
    def _by_equality(rows: Rows, group: list[Agg]) -> tuple[list[tuple[Any, Any]], list[Any]] | None:
        """(inner, outer) key pairs and the remaining filters, if no other place reads outer values."""
        if not rows.scans:
            return None
        local = set(rows.scans)
        foreign = lambda n: any(f.scan not in local for f in outer_fields(n))
        inner = lambda n: any(f.scan in local for f in outer_fields(n))
        keys, rest = [], []
        for f in _conjuncts(rows.filters):
            if not foreign(f):
                rest.append(f)
            elif isinstance(f, Op) and f.name in ("eq", "same"):
                a, b = f.args
                if inner(a) and not foreign(a) and not inner(b):
                    keys.append((a, b))
                elif inner(b) and not foreign(b) and not inner(a):
                    keys.append((b, a))
                else:
                    return None
                if f.name == "same":
                    # plain equality: rows without the value belong to no group
                    rest.append(Op("is_some", (keys[-1][0],)))
            else:
                return None
        return None if any(a.arg is not None and foreign(a.arg) for a in group) else (keys, rest)

    def grouped(self, rows: Rows, filters: list[Any], keys: list[Any], group: list[Agg], domain=None) -> tuple[DataFrame, list[str], list[str]]:
        """Frame with a row for each value of ``keys`` (one row without keys), the keys' and the results' columns."""
        self.build(rows, filters, [*keys, *[a.arg for a in group if a.arg is not None]], domain)
        by = [self.column(k) for k in keys]
        names, results, aggs = [self._name("k") for _ in keys], [], []
        for a in group:
            results.append(self._name("r"))
            aggs.append(self._aggregate_column(a, rows).alias(results[-1]))
        named = [c.alias(n) for c, n in zip(by, names, strict=True)]
        return (self.df.groupBy(*named).agg(*aggs) if keys else self.df.agg(*aggs)), names, results

    def _aggregate_column(self, a: Agg, rows: Rows) -> Column:
        if a.function == "exists":
            return F.count(F.lit(1))
        arg = a.arg
        while isinstance(arg, Scoped):
            arg = arg.arg
        value = self.column(arg)
        if a.function == "count_distinct":
            unique = isinstance(arg, Field) and len(rows.scans) == 1 and arg.scan is rows.scans[0] and arg.column == arg.scan.table._pk
            return F.count(value) if unique else F.count_distinct(value)
        return {"avg": F.avg, "max": F.max, "min": F.min, "sum": F.sum}[a.function](value)

    def build(self, rows: Rows, filters: list[Any], outs: list[Any], domain=None) -> None:
        """Scans joined and all filters applied."""
        rest = self.start(rows, filters, domain)
        self.core = self.df
        self.announce([*rest, *outs])
        wanted = set()
        todo = list(outs)
        while todo:
            n = todo.pop()
            wanted.add(n)
            todo += children(n)
        for f in rest:
            bare, before = self.core is self.df, len(self.columns)
            if not self._semi(f, wanted):
                condition = self.column(f)  # may join to self.df
                self.df = self.df.where(condition)
            self.core = self.df if bare and len(self.columns) == before else self.core

    def _semi(self, f: Any, wanted: set) -> bool:
        """Apply a filter for the (in)existence of an aggregate's rows as a semi (anti) join."""
        agg, how = (f, "left_semi") if isinstance(f, Agg) else (f.args[0], "left_anti") if isinstance(f, Op) and f.name == "not" else (None, "")
        if not isinstance(agg, Agg) or agg.function != "exists" or agg in wanted or agg in self.columns:
            return False
        split = self._by_equality(agg.rows, [agg])
        if not split or not split[0]:
            return False
        keys, filters = split
        inner = Frame(self.source, self.names)
        inner.build(agg.rows, filters, [i for i, _ in keys])
        names = [inner._name("k") for _ in keys]
        df = inner.df.select(*[inner.column(i).alias(n) for (i, _), n in zip(keys, names, strict=True)])
        outer = [self.column(o) for _, o in keys]
        on = [F.col(n).eqNullSafe(o) if _nullable(i) or _nullable(x) else F.col(n) == o for n, o, (i, x) in zip(names, outer, keys, strict=True)]
        self.df = self.df.join(df, functools.reduce(lambda a, b: a & b, on), how)
        return True


def compile_query(source: Source, rows: Rows, order: tuple, nodes: list[Any], names: list[str], take: int | None = None) -> DataFrame:
    """DataFrame of ``nodes`` under ``names``; ``source(None)`` is a frame of one row without columns."""
    frame = Frame(source)
    keys = [n for n, _ in order]
    frame.build(rows, _conjuncts(rows.filters), [*nodes, *keys])
    columns = {n: frame.column(n) for n in [*nodes, *keys]}
    df = frame.df
    if order:
        df = df.orderBy(*[columns[n].asc_nulls_first() if up else columns[n].desc_nulls_last() for n, up in order])
    if take is not None:
        df = df.limit(take)
    return df.select(*[columns[n].alias(name) for n, name in zip(nodes, names, strict=True)])
