"""The benchmark tables as a schema, and one registered query with SQL for every operation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.select import from_expr
from .plans.expr import Expr, none, some
from .plans.scopes import Query, aggregate, optional
from .schema import Column, Schema, Table
from .sources.database import Config, Conflict, Database, Referenced
from .sources.external import ExternalSource, query_one, run_query
from .sources.migrate import Migrator
from .sources.store import temporary_folder
from .types import F64, I64, Date, String, Timestamp


class Region(Table):
    __primary_source__ = "r_regionkey"
    name = Column(String, source="r_name", unique=True)


class Nation(Table):
    __primary_source__ = "n_nationkey"
    name = Column(String, source="n_name", unique=True)
    region = Column(Region, source="n_regionkey", index=True)


class Customer(Table):
    __primary_source__ = "c_custkey"
    name = Column(String, source="c_name", unique=True)
    nation = Column(Nation, source="c_nationkey", index=True)
    balance = Column(F64, source="c_acctbal")
    segment = Column(String, source="c_mktsegment", index=True)


class Supplier(Table):
    __primary_source__ = "s_suppkey"
    name = Column(String, source="s_name")
    nation = Column(Nation, source="s_nationkey", index=True)
    balance = Column(F64, source="s_acctbal")


class Part(Table):
    __primary_source__ = "p_partkey"
    name = Column(String, source="p_name")
    brand = Column(String, source="p_brand", index=True)
    kind = Column(String, source="p_type")
    size = Column(I64, source="p_size")
    price = Column(F64, source="p_retailprice")


class Order(Table):
    __table__ = "orders"
    __primary_source__ = "o_orderkey"
    customer = Column(Customer, source="o_custkey", index=True)
    status = Column(String, source="o_orderstatus")
    total = Column(F64, source="o_totalprice")
    date = Column(Date, source="o_orderdate")
    time = Column(Timestamp, source="o_orderdate")
    priority = Column(String, source="o_orderpriority")


class Lineitem(Table):
    __primary_source__ = "(none)"
    __no_reference__ = True
    order = Column(Order, source="l_orderkey", index=True)
    part = Column(Part, source="l_partkey", index=True)
    supplier = Column(Supplier, source="l_suppkey", index=True)
    number = Column(I64, source="l_linenumber")
    quantity = Column(F64, source="l_quantity")
    price = Column(F64, source="l_extendedprice")
    discount = Column(F64, source="l_discount")
    tax = Column(F64, source="l_tax")
    flag = Column(String, source="l_returnflag")
    status = Column(String, source="l_linestatus")
    shipped = Column(Date, source="l_shipdate")


class Event(Table):
    __table__ = "events"
    __primary_source__ = "event_id"
    time = Column(Timestamp, source="ts")
    user = Column(Customer, source="user_id", index=True)
    kind = Column(String, source="event_type")
    value = Column(F64)


class Document(Table):
    __table__ = "documents"
    __primary_source__ = "doc_id"
    text = Column(String)
    lang = Column(String, index=True)
    source = Column(String)
    chars = Column(I64, source="n_chars")


class Label(Table):
    __table__ = "labels"
    __primary_source__ = "(none)"
    document = Column(Document, source="doc_id", unique=True)
    quality = Column(I64)
    toxic = Column(I64)


TABLES = Schema(Region, Nation, Customer, Supplier, Part, Order, Lineitem, Event, Document, Label)

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None):
    """Register a function of a query scope under its name."""

    def add(fn: Callable[[Query], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run_query(ExternalSource(spark, sf_dir), fn)

        _queries[fn.__name__] = run
        if sql:
            _sql[fn.__name__] = sql
        return fn

    return add


def values(name: str, table: type[Table], selected: Callable[[Expr], dict], sql: str) -> None:
    """Register a projection of a whole table."""

    def run(q: Query) -> DataFrame:
        return q.into_df(selected(q.join(table)))

    run.__name__ = name
    query(sql)(run)


def cents(x: Expr) -> Expr:
    """Hundredths as a whole number, so that sums don't depend on their order."""
    return x.mul(100.0).add(0.5).floor().to_i64()


CENTS = "CAST(floor({} * 100.0 + 0.5) AS BIGINT)"


# -- scans, projections, filters ----------------------------------------------
@query("SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def scan_project(q):
    n = q.join(Nation)
    return q.into_df({"name": n.name, "region": n.region.name})


@query("SELECT 1::BIGINT AS unit FROM region")
def select_unit(q):
    q.join(Region)
    return q.into_df(())


@query("SELECT l_linenumber::BIGINT AS number, l_quantity AS quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 30 AND NOT (l_returnflag = 'A' OR l_discount > 0.05) AND l_linenumber BETWEEN 2 AND 4")
def filter_predicates(q):
    x = q.join(Lineitem)
    q.filter(x.quantity.gte(10.0).and_(x.quantity.lt(30.0)))
    q.filter(x.flag.eq("A").or_(x.discount.gt(0.05)).not_())
    q.filter(x.number.between(2, 4))
    return q.into_df({"number": x.number, "quantity": x.quantity})


@query("SELECT d.doc_id AS doc, l.quality IS NOT DISTINCT FROM 1 AS good, l.quality IS DISTINCT FROM 1 AS other FROM documents d LEFT JOIN labels l USING (doc_id)")
def eq_neq_null_safe(q):
    d = q.join(Document)
    quality = optional(lambda o: o.then(o.and_(Label.by(document=d)).quality)).unwrap_or(-1)
    return q.into_df({"doc": d, "good": quality.eq(1), "other": quality.neq(1)})


@query("SELECT doc_id AS doc, quality::BIGINT AS quality FROM documents JOIN labels USING (doc_id)")
def filter_some(q):
    d = q.join(Document)
    label = q.filter_some(Label.by(document=d))
    return q.into_df({"doc": d, "quality": label.quality})


@query("SELECT doc_id AS doc, l.doc_id IS NOT NULL AS labelled, l.doc_id IS NULL AS bare FROM documents d LEFT JOIN labels l USING (doc_id)".replace("doc_id AS doc", "d.doc_id AS doc"))
def is_some_is_none(q):
    d = q.join(Document)
    label = Label.by(document=d)
    return q.into_df({"doc": d, "labelled": label.is_some(), "bare": label.is_none()})


# -- joins ---------------------------------------------------------------------
@query(
    "SELECT l_linenumber::BIGINT AS number, l_extendedprice AS price, o_orderstatus AS status, c_name AS customer, n_name AS nation, r_name AS region FROM lineitem "
    "JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
)
def fk_navigation(q):
    x = q.join(Lineitem)
    customer = x.order.customer
    return q.into_df({"number": x.number, "price": x.price, "status": x.order.status, "customer": customer.name, "nation": customer.nation.name, "region": customer.nation.region.name})


@query("SELECT c_name AS customer, o_orderkey AS ord FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'")
def index_scan_join(q):
    c = q.join(Customer.at(segment="BUILDING"))
    o = q.join(Order.at(customer=c))
    return q.into_df({"customer": c.name, "ord": o})


@query("SELECT a.p_partkey AS small, b.p_partkey AS large FROM part a, part b WHERE a.p_brand = b.p_brand AND a.p_size + 45 < b.p_size")
def theta_join(q):
    a, b = q.join(Part), q.join(Part)
    q.filter(a.brand.eq(b.brand))
    q.filter(a.size.add(45).lt(b.size))
    return q.into_df({"small": a, "large": b})


@query("SELECT a.n_name AS one, b.n_name AS two FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_name < b.n_name")
def self_join(q):
    a = q.join(Nation)
    b = q.join(Nation.at(region=a.region))
    q.filter(a.name.lt(b.name))
    return q.into_df({"one": a.name, "two": b.name})


@query("SELECT r_name AS region, n_name AS nation FROM region CROSS JOIN nation")
def cross_join(q):
    r, n = q.join(Region), q.join(Nation)
    return q.into_df({"region": r.name, "nation": n.name})


@query("SELECT o_orderkey AS ord, o_custkey AS customer FROM orders")
def join_elimination(q):
    o = q.join(Order)
    return q.into_df({"ord": o, "customer": o.customer})


@query("SELECT d.doc_id AS doc, coalesce(quality, -1)::BIGINT AS quality, coalesce(toxic, -1)::BIGINT AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_default(q):
    d = q.join(Document)
    get = lambda name: optional(lambda o: o.then(o.and_(Label.by(document=d))[name])).unwrap_or(-1)
    return q.into_df({"doc": d, "quality": get("quality"), "toxic": get("toxic")})


@query("SELECT n.n_name AS name, c.c_custkey IS NOT NULL AS taken FROM nation n LEFT JOIN customer c ON c.c_name = n.n_name")
def unique_lookup(q):
    n = q.join(Nation)
    return q.into_df({"name": n.name, "taken": Customer.by(name=n.name).is_some()})


@query("SELECT o_orderkey AS ord FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def semi_join(q):
    o = q.join(Order)

    def large(rows):
        x = rows.join(Lineitem.at(order=o))
        rows.filter(x.quantity.gt(45.0))
        return rows.exists()

    q.filter(aggregate(large))
    return q.into_df({"ord": o})


@query("SELECT o_orderkey AS ord FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_join(q):
    o = q.join(Order)

    def lines(rows):
        rows.join(Lineitem.at(order=o))
        return rows.exists()

    q.filter(aggregate(lines).not_())
    return q.into_df({"ord": o})


@query("SELECT doc_id AS doc FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_lookup(q):
    d = q.join(Document)
    q.filter(Label.by(document=d).is_none())
    return q.into_df({"doc": d})


# -- aggregates ----------------------------------------------------------------
def _orders_of(c):
    def add(rows):
        return rows.join(Order.at(customer=c))

    return add


@query("SELECT c_name AS customer, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey)::BIGINT AS orders, (SELECT count(DISTINCT o_orderpriority) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)::BIGINT AS kinds FROM customer")
def agg_count_distinct(q):
    c = q.join(Customer)
    count = aggregate(lambda rows: rows.count_distinct(_orders_of(c)(rows)))

    def kinds(rows):
        o = _orders_of(c)(rows)
        rows.filter(o.total.gt(250000.0))
        return rows.count_distinct(o.priority)

    return q.into_df({"customer": c.name, "orders": count, "kinds": aggregate(kinds)})


@query(f"SELECT o_orderkey AS ord, coalesce((SELECT sum({CENTS.format('l_extendedprice')}) FROM lineitem WHERE l_orderkey = o_orderkey), 0)::BIGINT AS cents, coalesce((SELECT sum(l_quantity) FROM lineitem WHERE l_orderkey = o_orderkey), 0.0) AS quantity FROM orders")
def agg_sum(q):
    o = q.join(Order)

    def sums(rows):
        x = rows.join(Lineitem.at(order=o))
        return rows.sum(cents(x.price)), rows.sum(x.quantity)

    price, quantity = aggregate(sums)
    return q.into_df({"ord": o, "cents": price, "quantity": quantity})


@query("SELECT o_orderkey AS ord, (SELECT avg(l_quantity) FROM lineitem WHERE l_orderkey = o_orderkey) AS quantity FROM orders")
def agg_avg(q):
    o = q.join(Order)
    return q.into_df({"ord": o, "quantity": aggregate(lambda rows: rows.avg(rows.join(Lineitem.at(order=o)).quantity))})


@query("SELECT o_orderkey AS ord, (SELECT max(l_shipdate)::DATE FROM lineitem WHERE l_orderkey = o_orderkey) AS latest, (SELECT min(l_extendedprice) FROM lineitem WHERE l_orderkey = o_orderkey) AS cheapest, (SELECT max(l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey) AS part FROM orders")
def agg_min_max(q):
    o = q.join(Order)

    def ends(rows):
        x = rows.join(Lineitem.at(order=o))
        return rows.max(x.shipped), rows.min(x.price), rows.max(x.part)

    latest, cheapest, part = aggregate(ends)
    return q.into_df({"ord": o, "latest": latest, "cheapest": cheapest, "part": part})


@query("SELECT o_orderkey AS ord, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS filled FROM orders")
def agg_exists(q):
    o = q.join(Order)

    def lines(rows):
        rows.join(Lineitem.at(order=o))
        return rows.exists()

    return q.into_df({"ord": o, "filled": aggregate(lines)})


@query(
    "SELECT n_name AS nation, count(s_suppkey)::BIGINT AS n, max(s_acctbal) AS most, min(s_acctbal) AS least, coalesce(sum(CAST(floor(s_acctbal * 100.0 + 0.5) AS BIGINT)), 0)::BIGINT AS cents "
    "FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name"
)
def agg_multi(q):
    n = q.join(Nation)

    def stats(rows):
        s = rows.join(Supplier.at(nation=n))
        return rows.count_distinct(s), rows.max(s.balance), rows.min(s.balance), rows.sum(cents(s.balance))

    count, most, least, total = aggregate(stats)
    return q.into_df({"nation": n.name, "n": count, "most": most, "least": least, "cents": total})


@query("SELECT c_custkey AS customer, (SELECT avg(n) FROM (SELECT o_custkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey)::DOUBLE AS n FROM orders) x WHERE o_custkey = c_custkey) AS lines FROM customer")
def agg_nested(q):
    c = q.join(Customer)

    def average(rows):
        o = rows.join(Order.at(customer=c))
        lines = aggregate(lambda inner: inner.count_distinct(inner.join(Lineitem.at(order=o))))
        return rows.avg(lines.to_f64())

    return q.into_df({"customer": c, "lines": aggregate(average)})


@query(
    "SELECT c_custkey AS customer, coalesce(max(n), NULL)::BIGINT AS most FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey, count(l_orderkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey "
    "LEFT JOIN (SELECT l_orderkey, s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) l ON l_orderkey = o_orderkey AND s_nationkey = c_nationkey GROUP BY o_custkey, o_orderkey) x ON o_custkey = c_custkey GROUP BY c_custkey"
)
def agg_skip_level(q):
    c = q.join(Customer)

    def most(rows):
        o = rows.join(Order.at(customer=c))

        def home(inner):
            x = inner.join(Lineitem.at(order=o))
            inner.filter(x.supplier.nation.eq(c.nation))
            return inner.count_distinct(x)

        return rows.max(aggregate(home))

    return q.into_df({"customer": c, "most": aggregate(most)})


@query("SELECT c_custkey AS customer, (SELECT count(*) FROM nation WHERE n_nationkey < c_nationkey)::BIGINT AS below FROM customer".replace("n_nationkey < c_nationkey", "n_name < (SELECT n_name FROM nation m WHERE m.n_nationkey = c_nationkey)"))
def agg_inequality(q):
    c = q.join(Customer)

    def before(rows):
        n = rows.join(Nation)
        rows.filter(n.name.lt(c.nation.name))
        return rows.count_distinct(n)

    return q.into_df({"customer": c, "below": aggregate(before)})


@query(
    "WITH a AS (SELECT o_custkey, avg(floor(o_totalprice)) AS m FROM orders GROUP BY 1) SELECT c_custkey AS customer, (SELECT count(*) FROM orders o WHERE o.o_custkey = c_custkey)::BIGINT AS n, "
    "(SELECT count(*) FROM orders o JOIN a USING (o_custkey) WHERE o_custkey = c_custkey AND floor(o_totalprice) > m)::BIGINT AS above FROM customer"
)
def agg_snapshot(q):
    c = q.join(Customer)

    def above(rows):
        o = rows.join(Order.at(customer=c))
        mean, n = rows.avg(o.total.floor()), rows.count_distinct(o)
        rows.filter(o.total.floor().gt(mean.unwrap_or(0.0)))
        return n, rows.count_distinct(o)

    n, over = aggregate(above)
    return q.into_df({"customer": c, "n": n, "above": over})


@query("SELECT c_custkey AS customer, avg(floor(o_totalprice)) AS mean FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1 HAVING count(*) >= 12 AND avg(floor(o_totalprice)) > 150000")
def agg_having(q):
    c = q.join(Customer)

    def stats(rows):
        o = rows.join(Order.at(customer=c))
        return rows.count_distinct(o), rows.avg(o.total.floor())

    n, mean = aggregate(stats)
    q.filter(n.gte(12))
    mean = q.filter_some(mean)
    q.filter(mean.gt(150000.0))
    return q.into_df({"customer": c, "mean": mean})


@query("SELECT count(*)::BIGINT AS n, sum(l_quantity) AS quantity, max(l_shipdate)::DATE AS latest FROM lineitem")
def agg_global(q):
    def stats(rows):
        x = rows.join(Lineitem)
        return {"n": rows.count_distinct(x), "quantity": rows.sum(x.quantity), "latest": rows.max(x.shipped)}

    return q.into_df(aggregate(stats))


@query("SELECT c_custkey AS customer, (SELECT count(*) FROM orders)::BIGINT AS every FROM customer")
def agg_uncorrelated(q):
    c = q.join(Customer)
    return q.into_df({"customer": c, "every": aggregate(lambda rows: rows.count_distinct(rows.join(Order)))})


@query("SELECT c_custkey AS customer, (SELECT min(o_orderkey) FROM orders o WHERE o.o_custkey = c_custkey AND o_orderdate = (SELECT min(o_orderdate) FROM orders p WHERE p.o_custkey = c_custkey)) AS first FROM customer")
def argmin_row(q):
    c = q.join(Customer)

    def first(rows):
        o = rows.join(Order.at(customer=c))
        earliest = rows.min(o.time)
        rows.filter(some(o.time).is_some())
        rows.filter(earliest.is_some().and_(o.time.eq(earliest.unwrap_or(o.time))))
        return rows.min(o)

    return q.into_df({"customer": c, "first": aggregate(first)})


@query("SELECT p_partkey AS part FROM part WHERE p_size = (SELECT min(p_size) FROM part)")
def argmin_same_scope(q):
    p = q.join(Part)

    def smallest(rows):
        return rows.min(rows.join(Part).size)

    q.filter(p.size.eq(aggregate(smallest).unwrap_or(0)))
    return q.into_df({"part": p})


@query("SELECT r_name AS region, count(DISTINCT c_custkey)::BIGINT AS customers FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def agg_through_navigation(q):
    r = q.join(Region)

    def customers(rows):
        c = rows.join(Customer)
        rows.filter(c.nation.region.eq(r))
        return rows.count_distinct(c)

    return q.into_df({"region": r.name, "customers": aggregate(customers)})


@query(
    "SELECT s_suppkey AS supplier, (SELECT count(DISTINCT l_partkey) FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey "
    "WHERE l_suppkey = s_suppkey AND o_orderdate >= TIMESTAMP '1997-01-01' AND p_size < 15)::BIGINT AS low FROM supplier"
)
def stock_level(q):
    import datetime as dt

    s = q.join(Supplier)

    def low(rows):
        x = rows.join(Lineitem.at(supplier=s))
        rows.filter(x.order.date.gte(dt.date(1997, 1, 1)))
        rows.filter(x.part.size.lt(15))
        return rows.count_distinct(x.part)

    return q.into_df({"supplier": s, "low": aggregate(low)})


# -- options -------------------------------------------------------------------
@query(
    "SELECT d.doc_id AS doc, quality IS NULL AS missing, quality IS NOT NULL AS there, CASE WHEN quality IS NOT NULL THEN quality + toxic END::BIGINT AS both, CASE WHEN quality IS NOT NULL THEN n_chars END::BIGINT AS chars "
    "FROM documents d LEFT JOIN labels l USING (doc_id)"
)
def optional_chain(q):
    d = q.join(Document)

    def parts(o):
        label = o.and_(Label.by(document=d))
        return {"doc": d, "missing": o.is_none(), "there": o.is_some(), "both": o.then(label.quality.add(label.toxic)), "chars": o.and_then(some(d.chars))}

    return q.into_df(optional(parts))


@query("SELECT d.doc_id AS doc, quality IS NOT NULL AS label_some, quality::BIGINT AS label_quality, toxic::BIGINT AS label_toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def optional_then_select(q):
    d = q.join(Document)

    def label(o):
        found = o.and_(Label.by(document=d))
        return o.then_select({"quality": found.quality, "toxic": found.toxic})

    return q.into_df({"doc": d, "label": optional(label)})


@query("SELECT doc_id AS doc, NULL::BIGINT AS nothing, 7::BIGINT AS seven FROM documents")
def option_literals(q):
    d = q.join(Document)
    return q.into_df({"doc": d, "nothing": none(I64), "seven": none(I64).unwrap_or(7)})


# -- order ---------------------------------------------------------------------
@query("SELECT o_orderkey AS ord, o_totalprice AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def order_topk(q):
    o = q.join(Order)
    number = aggregate(lambda rows: rows.count_distinct(rows.join(Lineitem.at(order=o))))
    # the order's own key has no order of its own: total, date and time are unique enough with the lines
    return q.order_by().desc(o.total).asc(o.time).asc(number).into_df({"ord": o, "total": o.total}, take=20)


@query("SELECT p_name AS name, n::BIGINT AS n FROM (SELECT p_name, p_partkey, p_retailprice, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS n FROM part) ORDER BY n DESC, p_name, p_retailprice LIMIT 20")
def order_by_aggregate(q):
    p = q.join(Part)
    n = aggregate(lambda rows: rows.count_distinct(rows.join(Lineitem.at(part=p))))
    return q.order_by().desc(n).asc(p.name).asc(p.price).into_df({"name": p.name, "n": n}, take=20)


# -- selections ----------------------------------------------------------------
@dataclass
class RegionInfo:
    name: str


@dataclass
class NationInfo:
    name: str
    region: RegionInfo = field(default=None)


@query("SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey".replace("AS region", "AS region_name"))
def from_row(q):
    return q.into_df(from_expr(NationInfo, q.join(Nation)))


@query("SELECT c_name AS _0, n_name AS _1__0, c_acctbal AS _1__1 FROM customer JOIN nation ON c_nationkey = n_nationkey")
def select_nested(q):
    c = q.join(Customer)
    return q.into_df((c.name, (c.nation.name, c.balance)))


# -- numbers -------------------------------------------------------------------
def _c(e: Callable[[Expr], dict]) -> Callable[[Expr], dict]:
    return lambda r: {"id": r, **e(r)}


values("num_add", Part, _c(lambda p: {"i": p.size.add(3), "f": p.price.add(0.5)}), "SELECT p_partkey AS id, p_size::BIGINT + 3 AS i, p_retailprice + 0.5 AS f FROM part")
values("num_sub", Part, _c(lambda p: {"i": p.size.sub(30), "f": p.price.sub(1000.25)}), "SELECT p_partkey AS id, p_size::BIGINT - 30 AS i, p_retailprice - 1000.25 AS f FROM part")
values("num_mul", Part, _c(lambda p: {"i": p.size.mul(7), "f": p.price.mul(1.5)}), "SELECT p_partkey AS id, p_size::BIGINT * 7 AS i, p_retailprice * 1.5 AS f FROM part")
values("num_div", Part, _c(lambda p: {"i": p.size.sub(25).div(4), "z": p.size.div(p.size.sub(p.size)), "f": p.price.div(p.size.to_f64().sub(10.0))}), "SELECT p_partkey AS id, trunc((p_size - 25) / 4.0)::BIGINT AS i, NULL::BIGINT AS z, p_retailprice / NULLIF(p_size - 10.0, 0.0::DOUBLE)::DOUBLE AS f FROM part")
values("num_modulo", Part, _c(lambda p: {"m": p.size.sub(25).modulo(7), "z": p.size.modulo(p.size.sub(p.size))}), "SELECT p_partkey AS id, ((p_size - 25) % 7)::BIGINT AS m, NULL::BIGINT AS z FROM part")
values("num_sign", Customer, _c(lambda c: {"s": c.balance.sign(), "i": c.balance.to_i64().sign()}), "SELECT c_custkey AS id, sign(c_acctbal)::BIGINT AS s, sign(trunc(c_acctbal))::BIGINT AS i FROM customer")
values("num_abs", Customer, _c(lambda c: {"f": c.balance.abs(), "i": c.balance.to_i64().abs()}), "SELECT c_custkey AS id, abs(c_acctbal) AS f, abs(trunc(c_acctbal))::BIGINT AS i FROM customer")
values("num_max_min", Customer, _c(lambda c: {"most": c.balance.max(1000.0), "least": c.balance.min(1000.0), "text": c.segment.max("HOUSEHOLD")}), "SELECT c_custkey AS id, greatest(c_acctbal, 1000.0::DOUBLE) AS most, least(c_acctbal, 1000.0::DOUBLE) AS least, greatest(c_mktsegment, 'HOUSEHOLD') AS text FROM customer")
values("num_to_f64", Part, _c(lambda p: {"f": p.size.to_f64()}), "SELECT p_partkey AS id, p_size::DOUBLE AS f FROM part")
values("num_to_i64", Customer, _c(lambda c: {"i": c.balance.to_i64(), "big": c.balance.mul(1e300).to_i64()}), "SELECT c_custkey AS id, trunc(c_acctbal)::BIGINT AS i, CASE WHEN c_acctbal > 0 THEN 9223372036854775807 WHEN c_acctbal < 0 THEN -9223372036854775808 ELSE 0 END::BIGINT AS big FROM customer")
values("num_floor", Customer, _c(lambda c: {"f": c.balance.floor(), "big": c.balance.mul(1e300).floor()}), "SELECT c_custkey AS id, floor(c_acctbal) AS f, c_acctbal * 1e300 AS big FROM customer")
values("num_ceil", Customer, _c(lambda c: {"f": c.balance.ceil()}), "SELECT c_custkey AS id, ceil(c_acctbal) AS f FROM customer")
values("num_round", Customer, _c(lambda c: {"two": c.balance.round_with_precision(2), "none": c.balance.round_with_precision(0)}), "SELECT c_custkey AS id, c_acctbal AS two, round(c_acctbal) AS none FROM customer")
values("num_between", Part, _c(lambda p: {"b": p.size.between(10, 20), "f": p.price.between(950.0, 1100.0)}), "SELECT p_partkey AS id, p_size BETWEEN 10 AND 20 AS b, p_retailprice BETWEEN 950 AND 1100 AS f FROM part")
values("compare_all", Part, _c(lambda p: {"a": p.size.lt(10), "b": p.size.lte(10), "c": p.size.gt(10), "d": p.size.gte(10), "e": p.brand.eq("Brand#11"), "f": p.brand.neq("Brand#11"), "g": p.name.lt("m")}), "SELECT p_partkey AS id, p_size < 10 AS a, p_size <= 10 AS b, p_size > 10 AS c, p_size >= 10 AS d, p_brand = 'Brand#11' AS e, p_brand <> 'Brand#11' AS f, p_name < 'm' AS g FROM part")

# -- texts ---------------------------------------------------------------------
_NOCASE = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
values("str_starts_with", Part, _c(lambda p: {"a": p.name.starts_with("b"), "b": p.kind.starts_with("STANDARD"), "c": p.kind.starts_with("s*")}), "SELECT p_partkey AS id, starts_with(p_name, 'b') AS a, starts_with(p_type, 'STANDARD') AS b, false AS c FROM part")
values("str_ends_with", Part, _c(lambda p: {"a": p.name.ends_with("n"), "b": p.kind.ends_with("?")}), "SELECT p_partkey AS id, ends_with(p_name, 'n') AS a, ends_with(p_type, '?') AS b FROM part")
values("str_contains", Document, _c(lambda d: {"a": d.text.contains("the"), "b": d.text.contains(d.lang), "c": d.text.contains("")}), "SELECT doc_id AS id, contains(text, 'the') AS a, contains(text, lang) AS b, true AS c FROM documents")
values("str_replace", Document, _c(lambda d: {"a": d.text.replace("the", "THE").byte_len(), "b": d.source.replace("src", "s"), "c": d.source.replace("", "x")}), "SELECT doc_id AS id, strlen(replace(text, 'the', 'THE'))::BIGINT AS a, replace(source, 'src', 's') AS b, source AS c FROM documents")
values("str_ltrim", Document, _c(lambda d: {"a": d.source.ltrim("scr"), "b": d.source.ltrim("")}), "SELECT doc_id AS id, ltrim(source, 'scr') AS a, source AS b FROM documents")
values("str_rtrim", Document, _c(lambda d: {"a": d.source.rtrim("0123456789")}), "SELECT doc_id AS id, rtrim(source, '0123456789') AS a FROM documents")
values("str_trim", Document, _c(lambda d: {"a": d.source.trim("s1")}), "SELECT doc_id AS id, trim(source, 's1') AS a FROM documents")
values("str_glob", Customer, _c(lambda c: {"a": c.name.glob("Customer#*[02468]"), "b": c.segment.glob("?U*"), "c": c.segment.glob(c.segment)}), "SELECT c_custkey AS id, c_name GLOB 'Customer#*[02468]' AS a, c_mktsegment GLOB '?U*' AS b, true AS c FROM customer")
values("str_like", Part, _c(lambda p: {"a": p.kind.like("%bra_s%"), "b": p.name.like("%E_"), "c": p.kind.like("100\\%")}), "SELECT p_partkey AS id, p_type ILIKE '%bra_s%' AS a, p_name ILIKE '%E_' AS b, false AS c FROM part")
values("str_concat", Part, _c(lambda p: {"a": p.brand.concat("/").concat(p.name)}), "SELECT p_partkey AS id, p_brand || '/' || p_name AS a FROM part")
values("str_lower", Document, _c(lambda d: {"a": d.text.lower()}), f"SELECT doc_id AS id, {_NOCASE.format('text')} AS a FROM documents")
values("str_upper", Document, _c(lambda d: {"a": d.text.upper()}), "SELECT doc_id AS id, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS a FROM documents")
values("str_char_len", Document, _c(lambda d: {"a": d.text.char_len()}), "SELECT doc_id AS id, length(text)::BIGINT AS a FROM documents")
values("str_byte_len", Document, _c(lambda d: {"a": d.text.byte_len()}), "SELECT doc_id AS id, strlen(text)::BIGINT AS a FROM documents")
values("zero_blob", Region, _c(lambda r: {"a": Expr.zero_blob(r.name.char_len()).byte_len()}), "SELECT r_regionkey::BIGINT AS id, length(r_name)::BIGINT AS a FROM region")

# -- times ---------------------------------------------------------------------
values("ts_to_second", Event, _c(lambda e: {"s": e.time.to_second()}), "SELECT event_id AS id, (epoch_us(ts) // 1000000)::BIGINT AS s FROM events")
values("ts_subsec", Event, _c(lambda e: {"ns": e.time.subsec_nanosecond()}), "SELECT event_id AS id, ((epoch_us(ts) % 1000000) * 1000)::BIGINT AS ns FROM events")
values("ts_from_second", Event, _c(lambda e: {"s": Expr.from_second(e.time.to_second().sub(10_000_000_000)).to_second()}), "SELECT event_id AS id, (epoch_us(ts) // 1000000 - 10000000000)::BIGINT AS s FROM events")
values("ts_add_nanosecond", Event, _c(lambda e: {"us": e.time.add_nanosecond(1_500_000_000).to_second()}), "SELECT event_id AS id, ((epoch_us(ts) + 1500000) // 1000000)::BIGINT AS us FROM events")
values("ts_nanoseconds", Event, _c(lambda e: {"s": e.time.to_nanos().add_nanosecond(999_999_999).to_second(), "ns": e.time.to_nanos().add_nanosecond(999_999_999).subsec_nanosecond()}), "SELECT event_id AS id, ((epoch_us(ts)::HUGEINT * 1000 + 999999999) // 1000000000)::BIGINT AS s, ((epoch_us(ts)::HUGEINT * 1000 + 999999999) % 1000000000)::BIGINT AS ns FROM events")
values("ts_to_date", Event, _c(lambda e: {"utc": e.time.to_date_in_tz("UTC"), "plus": e.time.to_date_in_tz("+05:00")}), "SELECT event_id AS id, ts::DATE AS utc, (ts + INTERVAL 5 HOUR)::DATE AS plus FROM events")
values("ts_compare", Event, _c(lambda e: {"a": e.time.lt(e.time.add_nanosecond(1000)), "b": e.time.max(e.time.add_nanosecond(-1000)).eq(e.time)}), "SELECT event_id AS id, true AS a, true AS b FROM events")
values("date_parts", Order, _c(lambda o: {"y": o.date.year(), "m": o.date.month(), "d": o.date.day()}), "SELECT o_orderkey AS id, year(o_orderdate)::BIGINT AS y, month(o_orderdate)::BIGINT AS m, day(o_orderdate)::BIGINT AS d FROM orders")
values("date_first_of_month", Order, _c(lambda o: {"a": o.date.first_of_month(0), "b": o.date.first_of_month(-13)}), "SELECT o_orderkey AS id, date_trunc('month', o_orderdate)::DATE AS a, (date_trunc('month', o_orderdate) - INTERVAL 13 MONTH)::DATE AS b FROM orders")
values("date_add_day", Order, _c(lambda o: {"a": o.date.add_day(45), "b": o.date.add_day(o.date.day().mul(-1)), "c": o.date.add_day(4_000_000)}), "SELECT o_orderkey AS id, (o_orderdate::DATE + 45)::DATE AS a, (o_orderdate::DATE - day(o_orderdate)::INT)::DATE AS b, NULL::DATE AS c FROM orders")


# -- writes and migrations, in a database of their own ---------------------------
def stored(sql: str | None):
    """Register a function of (spark, sf_dir, folder for a database)."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spark, sf_dir, temporary_folder(spark, fn.__name__))

        _queries[fn.__name__] = run
        if sql:
            _sql[fn.__name__] = sql
        return fn

    return add


WORLD = Schema(Region, Nation)


def _world(spark: SparkSession, sf_dir: str, folder: str) -> Database:
    db = Database(spark, WORLD, Config.open(folder))
    db.import_table(Region, spark.read.parquet(f"{sf_dir}/region.parquet"))
    db.import_table(Nation, spark.read.parquet(f"{sf_dir}/nation.parquet"))
    return db


def _nations(db: Database) -> DataFrame:
    def run(q):
        n = q.join(Nation)
        return q.into_df({"name": n.name, "region": n.region.name})

    return db.transaction(lambda txn: txn.query(run))


@stored("SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'ATLANTIS', 'ASIA'")
def write_insert(spark, sf_dir, folder):
    db = _world(spark, sf_dir, folder)

    def add(txn):
        asia = txn.query_one(Region.by(name="ASIA"))
        txn.insert(Nation, name="ATLANTIS", region=asia)
        try:
            txn.insert(Nation, name="NATION_2", region=asia)
            raise AssertionError("a unique key was taken twice")
        except Conflict as taken:
            assert taken.row is not None

    db.transaction_mut(add)
    return _nations(db)


@stored("SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'ATLANTIS', 'EUROPE'")
def write_find_or_insert(spark, sf_dir, folder):
    db = _world(spark, sf_dir, folder)

    def add(txn):
        europe = txn.query_one(Region.by(name="EUROPE"))
        one = txn.find_or_insert(Nation, name="ATLANTIS", region=europe)
        assert one == txn.find_or_insert(Nation, name="ATLANTIS", region=europe)

    db.transaction_mut(add)
    return _nations(db)


@stored("SELECT CASE WHEN n_name = 'NATION_2' THEN 'CATHAY' ELSE n_name END AS name, CASE WHEN n_name = 'NATION_3' THEN 'ASIA' ELSE r_name END AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def write_update(spark, sf_dir, folder):
    db = _world(spark, sf_dir, folder)

    def change(txn):
        with txn.mutable(txn.query_one(Nation.by(name="NATION_3"))) as moved:
            moved.region = txn.query_one(Region.by(name="ASIA"))
        renamed = txn.mutable(txn.query_one(Nation.by(name="NATION_2")))
        renamed.unique(lambda row: setattr(row, "name", "CATHAY"))

    db.transaction_mut(change)
    return _nations(db)


@stored("SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name <> 'NATION_1'")
def write_delete(spark, sf_dir, folder):
    db = _world(spark, sf_dir, folder)

    def drop(txn):
        txn.downgrade()
        gone = txn.query_one(Nation.by(name="NATION_1"))
        assert txn.delete(gone) and not txn.delete(gone)
        try:
            txn.delete(txn.query_one(Region.by(name="ASIA")))
            raise AssertionError("a referenced row was deleted")
        except Referenced:
            pass

    db.transaction_mut(drop)
    return _nations(db)


class NationNamed(Table):
    """The next version of Nation: its names in lower case, and their lengths."""

    __table__ = "nation"
    __from__ = Nation
    name = Column(String, unique=True)
    region = Column(Region, index=True)
    size = Column(I64)


@stored("SELECT n_nationkey::BIGINT AS id, lower(n_name) AS name, n_regionkey::BIGINT AS region, length(n_name)::BIGINT AS size FROM nation")
def migrate_step(spark, sf_dir, folder):
    _world(spark, sf_dir, folder)
    newer = Schema(Region, NationNamed, version=1, previous=WORLD)
    migrator = Migrator.open(spark, WORLD, Config.open(folder))
    return _renamed(migrator.migrate(newer, lambda step: step.migrate(NationNamed, name=F.lower("name"), size=F.length("name"))).finish())


def _renamed(db: Database) -> DataFrame:
    def run(q):
        n = q.join(NationNamed)
        return q.into_df({"id": n, "name": n.name, "region": n.region, "size": n.size})

    return db.transaction(lambda txn: txn.query(run))


@stored("SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE 'odd ' || n_name END AS name, n_regionkey::BIGINT AS region, length(n_name)::BIGINT AS size FROM nation")
def migrate_in_parts(spark, sf_dir, folder):
    _world(spark, sf_dir, folder)
    newer = Schema(Region, NationNamed, version=1, previous=WORLD)

    def parts(step):
        step.migrate(NationNamed, where=F.col("id") % 2 == 0, name=F.lower("name"), size=F.length("name"))
        step.migrate_rest(NationNamed, name=F.concat(F.lit("odd "), "name"), size=F.length("name"))

    return _renamed(Migrator.open(spark, WORLD, Config.open(folder)).migrate(newer, parts).finish())


@stored("SELECT upper(n_name) || '!' AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' UNION ALL SELECT n_name, 'ASIA' FROM nation WHERE n_regionkey = 2")
def write_many(spark, sf_dir, folder):
    """A change of many rows as one projection."""
    db = _world(spark, sf_dir, folder)

    def change(txn):
        asia = txn.query_one(Region.by(name="ASIA"))
        txn.update_where(Nation, F.col("region") != asia.id, name=F.concat(F.upper("name"), F.lit("!")))

    db.transaction_mut(change)
    return _nations(db)


@stored("SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'NEW ' || n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def write_bulk(spark, sf_dir, folder):
    db = _world(spark, sf_dir, folder)
    db.transaction_mut(lambda txn: txn.insert_many(Nation, txn.source(Nation).select(F.concat(F.lit("NEW "), "name").alias("name"), "region")))
    return _nations(db)


@stored("SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def write_rolled_back(spark, sf_dir, folder):
    db = _world(spark, sf_dir, folder)
    try:
        db.transaction_mut(lambda txn: (txn.insert(Nation, name="GONE", region=txn.query_one(Region.by(name="ASIA"))), 1 / 0))
    except ZeroDivisionError:
        pass
    return _nations(db)


@stored("SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def read_snapshot(spark, sf_dir, folder):
    """What a transaction reads stays as it was when it began, whatever is committed meanwhile."""
    db = _world(spark, sf_dir, folder)

    def read(txn):
        asia = txn.query_one(Region.by(name="ASIA"))
        db.transaction_mut(lambda other: other.insert(Nation, name="LATER", region=other.query_one(Region.by(name="ASIA"))))
        assert asia is not None

        def run(q):
            n = q.join(Nation)
            return q.into_df({"name": n.name, "region": n.region.name})

        return txn.query(run)

    return db.transaction(read)


@stored("SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey = 1")
def lazy_scan(spark, sf_dir, folder):
    db = _world(spark, sf_dir, folder)

    def read(txn):
        america = txn.query_one(Region.by(name="AMERICA"))
        return [(n.name, n.region.name) for n in txn.lazy_iter(Nation.at(region=america))]

    return spark.createDataFrame(db.transaction(read), "name string, region string")


@stored("SELECT 'nation' AS tbl, 'region' AS col, 'region' AS target")
def schema_references(spark, sf_dir, folder):
    db = Database(spark, WORLD, Config.open(folder))
    return db.transaction(lambda txn: txn.metadata("references")).selectExpr("table AS tbl", "column AS col", "target")


@stored("SELECT * FROM (VALUES ('nation', 'name', 'String', false), ('nation', 'region', '->region', false), ('region', 'name', 'String', false)) t(tbl, col, kind, opt)")
def schema_columns(spark, sf_dir, folder):
    db = Database(spark, WORLD, Config.open(folder))
    return db.transaction(lambda txn: txn.metadata("columns")).selectExpr("table AS tbl", "column AS col", "type AS kind", "optional AS opt")


@stored(
    "SELECT * FROM (VALUES ('nation', 'name', 'table nation: column name is stored as String, declared as I64', true), ('nation', 'region', 'table nation: column region (->region) is stored but not declared', true), "
    "('nation', 'size', 'table nation: column size (I64) is declared but not stored', true)) t(tbl, col, why, same)"
)
def schema_diff(spark, sf_dir, folder):
    """Differences of two schemas, by table and column; the order of tables makes none."""
    from .schema import diff

    stored_form, newer = WORLD.canonical(), {**WORLD.canonical()}
    newer["nation"] = newer["nation"] | {"columns": {"name": "I64", "size": "I64"}}
    same = WORLD.hash() == Schema(Nation, Region).hash()
    return spark.createDataFrame([(d.table, d.column, str(d), same) for d in diff(stored_form, newer)], "tbl string, col string, why string, same boolean")


@stored("SELECT count(*)::BIGINT AS n, min(n_name) AS first FROM nation")
def raw_sql(spark, sf_dir, folder):
    db = _world(spark, sf_dir, folder)
    return db.transaction(lambda txn: txn.spark_sql("SELECT count(*) AS n, min(name) AS first FROM nation"))


@stored("SELECT r_name AS name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey)::BIGINT AS nations FROM region WHERE r_name = 'ASIA'")
def one_row(spark, sf_dir, folder):
    """query_one: several values without a table of their own."""
    source = ExternalSource(spark, sf_dir)

    def values_of():
        asia = Region.by(name="ASIA")
        count = optional(lambda o: o.then(_nations_of(o.and_(asia))))
        return optional(lambda o: o.then(o.and_(asia).name)).unwrap_or(""), count.unwrap_or(0)

    name, nations = query_one(source, values_of())
    return spark.createDataFrame([(name, nations)], "name string, nations bigint")


def _nations_of(region):
    def count(rows):
        return rows.count_distinct(rows.join(Nation.at(region=region)))

    return aggregate(count)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queries["fk_navigation"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


from . import catalog_stored as _stored_queries  # noqa: E402, F401  (registers its queries)
