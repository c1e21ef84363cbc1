"""What the compiler makes of queries, and what it refuses."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera import F64, I64, Column, ScopeError, String, Table, TypeMismatch, aggregate, optional
from tessera.catalog import TABLES, Customer, Document, Label, Lineitem, Nation, Order, Part, Region
from tessera.plans.scopes import Query, opened
from tessera.sources.external import ExternalSource, Runner, run_query


@pytest.fixture
def source(spark, sf):
    return ExternalSource(spark, sf)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_key_only_access_joins_nothing(source):
    df = run_query(source, lambda q: q.into_df({"customer": q.join(Order).customer}))
    assert "Join" not in plan_of(df)


def test_equal_lookups_are_one_join(source):
    def fn(q):
        x = q.join(Lineitem)
        return q.into_df({"a": x.order.customer.name, "b": x.order.customer.segment, "c": x.order.status})

    assert plan_of(run_query(source, fn)).count("Join Inner") == 2


def test_aggregates_over_equal_rows_are_one_pass(source):
    def fn(q):
        c = q.join(Customer)

        def stats(rows):
            o = rows.join(Order.at(customer=c))
            return rows.count_distinct(o), rows.sum(o.total), rows.exists()

        n, total, some = aggregate(stats)
        return q.into_df({"n": n, "total": total, "some": some})

    plan = plan_of(run_query(source, fn))
    assert plan.count("Join LeftOuter") == 1 and plan.count("Aggregate [") == 1


def test_existence_filters_are_semi_and_anti_joins(source):
    def fn(negate):
        def run(q):
            o = q.join(Order)

            def lines(rows):
                rows.join(Lineitem.at(order=o))
                return rows.exists()

            e = aggregate(lines)
            q.filter(e.not_() if negate else e)
            return q.into_df({"o": o})

        return run

    assert "LeftSemi" in plan_of(run_query(source, fn(False)))
    assert "LeftAnti" in plan_of(run_query(source, fn(True)))


def test_filters_and_columns_reach_the_files(source):
    def fn(q):
        p = q.join(Part)
        q.filter(p.size.gt(10))
        q.filter(p.name.starts_with("b"))
        return q.into_df({"name": p.name})

    text = run_query(source, fn)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(p_name,b)" in text and "p_retailprice" not in text


def test_no_product_where_conditions_link(source):
    def fn(q):
        a, b, c = q.join(Customer), q.join(Region), q.join(Nation)
        q.filter(c.region.eq(b))
        q.filter(a.nation.eq(c))
        return q.into_df({"a": a.name, "b": b.name})

    assert "Cross" not in plan_of(run_query(source, fn))


def test_topk_is_taken_while_sorting(source):
    df = run_query(source, lambda q: (lambda o: q.order_by().desc(o.total).into_df({"t": o.total}, take=3))(q.join(Order)))
    assert "TakeOrderedAndProject" in df._jdf.queryExecution().executedPlan().toString()


def test_snapshot_of_rows(source):
    def fn(q):
        def stats(rows):
            r = rows.join(Region)
            before = rows.count_distinct(r)
            rows.filter(r.name.eq("ASIA"))
            return before, rows.count_distinct(r)

        return q.into_vec(aggregate(stats))

    assert run_query(source, fn) == [(5, 1)]


def test_optional_snapshot(source):
    def fn(q):
        d = q.join(Document)

        def run(o):
            first = o.is_some()
            o.and_(Label.by(document=d))
            return first, o.is_some()

        return q.into_vec(optional(run))

    rows = run_query(source, fn)
    assert all(first for first, _ in rows) and {s for _, s in rows} == {True, False}


def test_results_are_decoded(source):
    def fn(q):
        n = q.join(Nation)
        q.filter(n.name.eq("NATION_3"))
        return q.into_vec({"name": n.name, "pair": (n.region.name, None), "n": aggregate(lambda r: r.count_distinct(r.join(Region)))})

    assert run_query(source, fn) == [{"name": "NATION_3", "pair": ("EUROPE", None), "n": 5}]


def test_map_and_optional_select(source):
    def fn(q):
        d = q.join(Document)
        select = optional(lambda o: o.then_select({"q": o.and_(Label.by(document=d)).quality}))
        return q.into_vec((d, select.map(lambda v: "none" if v is None else v["q"])))

    got = {v for _, v in run_query(source, fn)}
    assert "none" in got and 1 in got


def test_inner_expression_does_not_leave_its_scope(source):
    def fn(q):
        q.join(Region)
        leaked = aggregate(lambda rows: rows.join(Nation).name)
        return q.into_df({"x": leaked})

    with pytest.raises(ScopeError):
        run_query(source, fn)


def test_inner_expression_is_refused_outside_while_open(source):
    def fn(q):
        q.join(Region)

        def bad(rows):
            n = rows.join(Nation)
            q.filter(n.name.eq("X"))
            return rows.exists()

        aggregate(bad)

    with pytest.raises(ScopeError):
        run_query(source, fn)


def test_unwrapped_option_does_not_leave_its_scope(source):
    def fn(q):
        d = q.join(Document)
        label = optional(lambda o: o.and_(Label.by(document=d)))
        return q.into_df({"x": label.quality})

    with pytest.raises(ScopeError):
        run_query(source, fn)


def test_expression_of_an_ended_query(source):
    kept = []
    run_query(source, lambda q: kept.append(q.join(Region)))
    with pytest.raises(ScopeError):
        run_query(source, lambda q: q.into_df({"x": kept[0].name}))


def test_primary_key_is_no_value(source):
    with pytest.raises(AttributeError):
        run_query(source, lambda q: q.into_df({"x": q.join(Region).id}))


def test_options_have_no_order(source):
    with pytest.raises(TypeMismatch):
        run_query(source, lambda q: q.order_by().asc(Label.by(document=q.join(Document))))


OPS = st.sampled_from(["lt", "lte", "gt", "gte", "eq", "neq"])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(op=OPS, inner=OPS, size=st.integers(1, 50), nested=st.booleans(), threshold=st.integers(0, 3))
def test_random_nested_aggregates(spark, sf, op, inner, size, nested, threshold):
    """Correlated by any comparison, one or two levels deep, against plain Python."""
    source = ExternalSource(spark, sf)

    def fn(q):
        n = q.join(Nation)

        def outer_rows(rows):
            m = rows.join(Nation)
            rows.filter(getattr(m.name, op)(n.name))
            if not nested:
                return rows.count_distinct(m)

            def inner_rows(more):
                r = more.join(Region)
                more.filter(getattr(r.name, inner)(m.region.name))
                more.filter(getattr(r.name, op)(n.region.name))
                return more.count_distinct(r)

            rows.filter(aggregate(inner_rows).gte(threshold))
            return rows.count_distinct(m)

        return q.into_vec((n.name, aggregate(outer_rows)))

    regions = {r["r_regionkey"]: r["r_name"] for r in spark.read.parquet(f"{sf}/region.parquet").collect()}
    nations = [(r["n_name"], regions[r["n_regionkey"]]) for r in spark.read.parquet(f"{sf}/nation.parquet").collect()]
    compare = {"lt": str.__lt__, "lte": str.__le__, "gt": str.__gt__, "gte": str.__ge__, "eq": str.__eq__, "neq": str.__ne__}

    def count(n, region):
        found = [m for m in nations if compare[op](m[0], n)]
        if nested:
            found = [m for m in found if sum(compare[inner](r, m[1]) and compare[op](r, region) for r in regions.values()) >= threshold]
        return len(found)

    assert sorted(run_query(source, fn)) == sorted((n, count(n, r)) for n, r in nations)


def test_scopes_close_after_errors(source):
    with pytest.raises(ZeroDivisionError):
        run_query(source, lambda q: 1 / 0)
    with opened("query") as scope:
        assert scope.parent is None and Query(scope, Runner(source))


def test_catalogue_has_sql_for_every_query():
    from tessera import catalog

    assert set(catalog.queries()) == set(catalog.oracle_sql()) and len(TABLES.tables) == 10


class Dot(Table):
    kind = Column(I64)
    size = Column(I64)
    weight = Column(F64)
    name = Column(String)


DOTS = [
    (i, k, s, w, n)
    for i, (k, s, w, n) in enumerate(
        [(k, s, w, n) for k in (1, 2) for s, w, n in [(1, 0.5, "a"), (1, -0.0, ""), (2, 0.0, "b"), (7, math.inf, "B"), (-(1 << 62), math.nan, "ä"), ((1 << 62), -math.inf, "a"), (3, math.nan, "\U0001f600"), (0, -2.5, "z")]]
        + [(3, 5, 1.0, "c"), (4, 1, 1.0, "x"), (4, 9, 2.0, "y"), (0, 1, 0.0, "n"), (0, 2, 1.0, "o")]
        + [(5, i * 37 % 41, float(i % 11), str(i)) for i in range(60)]
    )
]


@pytest.fixture(scope="module")
def dots(spark):
    return lambda table: spark.createDataFrame(DOTS, "id long, kind long, size long, weight double, name string") if table is Dot else spark.range(1).select()


def float_key(v):
    """Spark's order of doubles: NaN equals itself and comes last, both zeros are equal."""
    return (1, 0.0) if v != v else (0, v + 0.0)


ORDERS = {
    "ints": (lambda a, b: [a.size.add(1).lt(b.size)], lambda a, b: a[2] + 1 < b[2]),
    "swapped": (lambda a, b: [b.size.gte(a.size)], lambda a, b: b[2] >= a[2]),
    "below": (lambda a, b: [a.size.gt(b.size)], lambda a, b: a[2] > b[2]),
    "floats": (lambda a, b: [a.weight.lt(b.weight)], lambda a, b: float_key(a[3]) < float_key(b[3])),
    "floats, equal ones too": (lambda a, b: [a.weight.lte(b.weight)], lambda a, b: float_key(a[3]) <= float_key(b[3])),
    "texts": (lambda a, b: [a.name.lt(b.name)], lambda a, b: a[4].encode() < b[4].encode()),
    "between": (lambda a, b: [b.size.between(a.size, a.size.add(2))], lambda a, b: a[2] <= b[2] <= a[2] + 2),
    "between two rows": (lambda a, b: [a.size.between(0, b.size)], lambda a, b: 0 <= a[2] <= b[2]),
    "two comparisons": (lambda a, b: [a.size.lt(b.size), a.weight.gt(b.weight), a.name.neq("a")], lambda a, b: a[2] < b[2] and float_key(a[3]) > float_key(b[3]) and a[4] != "a"),
    "values that miss": (lambda a, b: [a.weight.add(a.weight).lt(b.weight)], lambda a, b: a[3] == a[3] and float_key(a[3] * 2) < float_key(b[3])),
}


@pytest.mark.parametrize("name", list(ORDERS))
def test_equality_and_comparison_against_all_pairs(dots, name):
    conditions, holds = ORDERS[name]

    def fn(q):
        a, b = q.join(Dot), q.join(Dot)
        q.filter(a.kind.eq(b.kind))
        for c in conditions(a, b):
            q.filter(c)
        return q.into_df({"a": a, "b": b})

    got = sorted((r["a"], r["b"]) for r in run_query(dots, fn).collect())
    assert got == sorted((a[0], b[0]) for a in DOTS for b in DOTS if a[1] == b[1] and holds(a, b))


def test_comparison_with_missing_keys(dots):
    """Missing values are equal to each other in ``eq``; several equalities, and a third table by an equality of its own."""

    def fn(q):
        a, b, c = q.join(Dot), q.join(Dot), q.join(Dot)
        q.filter(a.weight.div(a.kind.to_f64()).eq(b.weight.div(b.kind.to_f64())))
        q.filter(a.kind.eq(b.kind))
        q.filter(a.size.lte(b.size))
        q.filter(c.name.eq(b.name))
        return q.into_df({"a": a, "b": b, "c": c})

    def ratio(r):
        return None if r[1] == 0 or r[3] != r[3] else r[3] / r[1] + 0.0

    got = sorted((r["a"], r["b"], r["c"]) for r in run_query(dots, fn).collect())
    want = sorted((a[0], b[0], c[0]) for a in DOTS for b in DOTS if ratio(a) == ratio(b) and a[1] == b[1] and a[2] <= b[2] for c in DOTS if c[4] == b[4])
    assert got == want and any(ratio(DOTS[a]) is None for a, _, _ in got)


def test_aggregate_by_equality_and_comparison(dots):
    def fn(q):
        a = q.join(Dot)

        def before(rows):
            b = rows.join(Dot)
            rows.filter(b.kind.eq(a.kind))
            rows.filter(b.size.lt(a.size))
            return rows.count_distinct(b), rows.max(b.size)

        n, most = aggregate(before)
        return q.into_df({"a": a, "n": n, "most": most})

    got = {r["a"]: (r["n"], r["most"]) for r in run_query(dots, fn).collect()}
    below = {a[0]: [b[2] for b in DOTS if b[1] == a[1] and b[2] < a[2]] for a in DOTS}
    assert got == {i: (len(found), max(found, default=None)) for i, found in below.items()}


def test_comparison_is_not_tested_for_all_pairs_of_a_key(spark, source):
    """A key's rows meet only where they are results: the join's pairs are its rows, with no comparison left to test."""

    def fn(q):
        a, b = q.join(Part), q.join(Part)
        q.filter(a.brand.eq(b.brand))
        q.filter(a.size.add(45).lt(b.size))
        return q.into_df({"a": a, "b": b})

    joins = [line for line in plan_of(run_query(source, fn)).splitlines() if "Join " in line]
    assert joins and not any("<" in j or ">" in j.replace("<=>", "") for j in joins)


def test_comparison_beside_a_unique_key_is_a_plain_join(source):
    def fn(q):
        c, o = q.join(Customer), q.join(Order)
        q.filter(o.customer.eq(c))
        q.filter(c.balance.lt(o.total))
        return q.into_df({"o": o})

    assert plan_of(run_query(source, fn)).count("Join ") == 1
