"""Registered queries over stored databases: order transactions, writes, migrations and the ways to read results."""

from __future__ import annotations

import asyncio
import datetime as dt
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import functions as F

from .catalog import WORLD, Customer, Lineitem, Nation, Order, Part, Region, _nations, _world, query, stored
from .operators.select import from_expr
from .plans.expr import lit
from .plans.scopes import aggregate
from .schema import Column, Schema, Table
from .sources.database import AsyncDatabase, Config, Conflict, Database, Drift, Referenced, RowRef
from .sources.external import ExternalSource, run_query
from .sources.migrate import Migrator
from .types import F64, I64, Option, String
from .versions import Versioned, schemas


# -- order transactions ----------------------------------------------------------
class Sale(Table):
    customer = Column(Customer, index=True)
    status = Column(String)
    total = Column(F64)


class Line(Table):
    __no_reference__ = True
    sale = Column(Sale, index=True)
    number = Column(I64)
    price = Column(F64)


class Pending(Table):
    __no_reference__ = True
    sale = Column(Sale, unique=True)
    district = Column(Region, index=True)


class Payment(Table):
    __no_reference__ = True
    customer = Column(Customer, index=True)
    amount = Column(F64)


SHOP = Schema(Region, Nation, Customer, Sale, Line, Pending, Payment)


def _shop(spark, sf_dir, folder) -> Database:
    db = Database(spark, SHOP, Config.open(folder))
    for t in (Region, Nation, Customer):
        db.import_table(t, spark.read.parquet(f"{sf_dir}/{t._name}.parquet"))
    return db


def _first_customers(txn, n: int) -> list[tuple[RowRef, float]]:
    def run(q):
        c = q.join(Customer)
        return list(q.order_by().asc(c.name).into_vec((c, c.balance), take=n))

    return txn.query(run)


_FIRST = "(SELECT row_number() OVER (ORDER BY c_name) AS k, * FROM customer ORDER BY c_name LIMIT {})"


@stored(f"SELECT (c.k - 1) * 3 + i AS id, c.k AS sale, c.c_name AS customer, i AS number, c.c_acctbal + i AS price FROM {_FIRST.format(4)} c, (SELECT unnest([1, 2, 3]) AS i) n")
def order_new(spark, sf_dir, folder):
    """An order with its lines and its place in the queue, for four customers, one transaction each."""
    db = _shop(spark, sf_dir, folder)
    for customer, balance in db.transaction(lambda txn: _first_customers(txn, 4)):

        def place(txn, customer=customer.id, balance=balance):
            who = RowRef(Customer, customer, txn)
            sale = txn.insert(Sale, customer=who, status="O", total=3 * balance + 6)
            for i in (1, 2, 3):
                txn.insert_ok(Line, sale=sale, number=i, price=balance + i)
            txn.insert(Pending, sale=sale, district=txn.lazy(who).nation.region)

        db.transaction_mut(place)

    def run(q):
        x = q.join(Line)
        return q.into_df({"id": x, "sale": x.sale, "customer": x.sale.customer.name, "number": x.number, "price": x.price})

    return db.transaction(lambda txn: txn.query(run))


@stored(f"SELECT c.c_custkey::BIGINT AS id, c.c_acctbal - coalesce(f.k, 0) * 10 AS balance, CASE WHEN f.k IS NOT NULL THEN 1 ELSE 0 END::BIGINT AS payments FROM customer c LEFT JOIN {_FIRST.format(3)} f USING (c_custkey)")
def order_payment(spark, sf_dir, folder):
    """Payments change balances and are noted."""
    db = _shop(spark, sf_dir, folder)

    def pay(txn):
        for k, (customer, _) in enumerate(_first_customers(txn, 3), 1):
            with txn.mutable(customer) as row:
                row.balance = row.balance - 10.0 * k
            txn.insert_ok(Payment, customer=customer, amount=10.0 * k)

    db.transaction_mut(pay)

    def run(q):
        c = q.join(Customer)
        return q.into_df({"id": c, "balance": c.balance, "payments": aggregate(lambda rows: rows.count_distinct(rows.join(Payment.at(customer=c))))})

    return db.transaction(lambda txn: txn.query(run))


@query(
    "WITH last AS (SELECT o_custkey, max(o_orderkey) AS o FROM orders GROUP BY 1) SELECT c_custkey::BIGINT AS customer, o_orderkey::BIGINT AS last, o_orderstatus AS status, "
    "count(l_orderkey)::BIGINT AS lines, coalesce(sum(l_quantity), 0) AS quantity FROM customer JOIN last ON o_custkey = c_custkey JOIN orders ON o_orderkey = o LEFT JOIN lineitem ON l_orderkey = o GROUP BY 1, 2, 3"
)
def order_status(q):
    """The last order of every customer that has one, and its lines."""
    c = q.join(Customer)
    last = q.filter_some(aggregate(lambda rows: rows.max(rows.join(Order.at(customer=c)))))

    def lines(rows):
        x = rows.join(Lineitem.at(order=last))
        return rows.count_distinct(x), rows.sum(x.quantity)

    n, quantity = aggregate(lines)
    return q.into_df({"customer": c, "last": last, "status": last.status, "lines": n, "quantity": quantity})


@stored(
    f"SELECT c.k AS sale, c.c_name AS customer, CASE WHEN c.k <= 2 THEN 'D' ELSE 'O' END AS status, c.c_acctbal + CASE WHEN c.k <= 2 THEN 100.0 * c.k ELSE 0 END AS balance, c.k > 2 AS pending FROM {_FIRST.format(4)} c"
)
def order_delivery(spark, sf_dir, folder):
    """The oldest pending order of each district is found, taken off the queue and delivered; its customer's balance takes its total."""
    db = _shop(spark, sf_dir, folder)

    def place(txn):
        regions = txn.query(lambda q: (lambda r: list(q.order_by().asc(r.name).into_vec(r, take=2)))(q.join(Region)))
        for k, (who, _) in enumerate(_first_customers(txn, 4), 1):
            sale = txn.insert_ok(Sale, customer=who, status="O", total=100.0 * k)
            txn.insert(Pending, sale=sale, district=regions[(k - 1) % 2])

    db.transaction_mut(place)

    def deliver(txn):
        txn.downgrade()

        def oldest(q):
            r = q.join(Region)

            def first(rows):
                return rows.min(rows.join(Pending.at(district=r)))

            return q.into_vec(q.filter_some(aggregate(first)))

        for entry in txn.query(oldest):
            sale = txn.lazy(entry).sale.table_row()
            assert txn.delete_ok(entry)
            with txn.mutable(sale) as row:
                row.status = "D"
                customer, total = RowRef(Customer, row.customer, txn), row.total
            with txn.mutable(customer) as row:
                row.balance = row.balance + total

    db.transaction_mut(deliver)

    def run(q):
        s = q.join(Sale)
        waits = aggregate(lambda rows: (rows.join(Pending.at(sale=s)), rows.exists())[1])
        return q.into_df({"sale": s, "customer": s.customer.name, "status": s.status, "balance": s.customer.balance, "pending": waits})

    return db.transaction(lambda txn: txn.query(run))


# -- ids and constraints ---------------------------------------------------------
def _ids(db: Database):
    def run(q):
        n = q.join(Nation)
        return q.into_df({"id": n, "name": n.name, "region": n.region.name})

    return db.transaction(lambda txn: txn.query(run))


@stored("SELECT n_nationkey::BIGINT AS id, n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT (SELECT max(n_nationkey) FROM nation) + 1, 'ATLANTIS', 'ASIA'")
def import_then_insert(spark, sf_dir, folder):
    """Ids go on after those of an import."""
    db = _world(spark, sf_dir, folder)
    db.transaction_mut(lambda txn: txn.insert(Nation, name="ATLANTIS", region=txn.query_one(Region.by(name="ASIA"))))
    return _ids(db)


@stored("SELECT n_nationkey::BIGINT AS id, n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def import_refused(spark, sf_dir, folder):
    """Repeated keys, missing values, references to missing rows, and losing referenced rows are all refused."""
    db = _world(spark, sf_dir, folder)
    nations, regions = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("nation", "region"))
    attempts = [
        (Nation, nations.union(nations.limit(1)), Conflict),
        (Nation, nations.withColumn("n_name", F.lit("one name")), Conflict),
        (Nation, nations.withColumn("n_name", F.lit(None).cast("string")), TypeError),
        (Nation, nations.withColumn("n_regionkey", F.lit(77)), Referenced),
        (Region, regions.where("r_regionkey > 0"), Referenced),
    ]
    for table, rows, why in attempts:
        try:
            db.import_table(table, rows)
        except why:
            continue
        raise AssertionError(f"{why.__name__} was due")
    return _ids(db)


@stored("SELECT n_nationkey::BIGINT AS id, n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def migrate_unique_across_parts(spark, sf_dir, folder):
    """A unique key holds over the parts of a migration together; the Conflict names an old row."""
    db = _world(spark, sf_dir, folder)
    newer = Schema(Region, _NationPlain, version=1, previous=WORLD)

    def parts(step):
        step.migrate(_NationPlain, where=F.col("id") % 2 == 0)
        step.migrate_rest(_NationPlain, name=F.when(F.col("id") == 1, F.lit("NATION_2")).otherwise(F.col("name")))

    try:
        Migrator.open(spark, WORLD, Config.open(folder)).migrate(newer, parts)
        raise AssertionError("a unique key was taken twice")
    except Conflict as taken:
        assert taken.row is not None and taken.row.table is Nation and taken.row.id in (1, 2)
    return _ids(db)


class _NationPlain(Table):
    __table__ = "nation"
    __from__ = Nation
    name = Column(String, unique=True)
    region = Column(Region, index=True)


@stored("SELECT i AS id, 'user ' || i AS name FROM (SELECT unnest([1::BIGINT, 2, 3]) AS i)")
def write_insert_ok(spark, sf_dir, folder):
    """Inserts into an empty table without unique keys; ids begin at 1."""

    class Person(Table):
        name = Column(String)

    db = Database(spark, Schema(Person), Config.open(folder))
    refs = db.transaction_mut(lambda txn: [txn.insert_ok(Person, name=f"user {i}") for i in (1, 2, 3)])
    assert [r.id for r in refs] == [1, 2, 3]
    return db.transaction(lambda txn: txn.spark_sql("SELECT id, name FROM person"))


@stored("SELECT n_nationkey::BIGINT AS id, CASE WHEN n_regionkey = 2 THEN lower(n_name) ELSE n_name END AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def write_mutable_vec(spark, sf_dir, folder):
    """All rows of an index prefix are changed and written back together."""
    db = _world(spark, sf_dir, folder)

    def change(txn):
        for row in txn.mutable_vec(Nation.at(region=txn.query_one(Region.by(name="ASIA")))):
            row.unique(lambda r: setattr(r, "name", r.name.lower()))

    db.transaction_mut(change)
    return _ids(db)


@stored("SELECT 2::BIGINT AS id, 'b' AS text")
def write_delete_ok(spark, sf_dir, folder):
    """Rows that nothing can refer to are deleted without a check."""

    class Note(Table):
        __no_reference__ = True
        text = Column(String)

    db = Database(spark, Schema(Note), Config.open(folder))
    one, two = db.transaction_mut(lambda txn: [txn.insert_ok(Note, text=t) for t in "ab"])

    def drop(txn):
        txn.downgrade()
        ref = RowRef(Note, one.id, txn)
        assert txn.delete_ok(ref) and not txn.delete_ok(ref)

    db.transaction_mut(drop)
    return db.transaction(lambda txn: txn.spark_sql("SELECT * FROM note"))


@stored("SELECT n_nationkey::BIGINT AS id, n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT (SELECT max(n_nationkey) FROM nation) + 1, 'ATLANTIS', 'ASIA'")
def write_async(spark, sf_dir, folder):
    """Transactions off the event loop's thread."""
    db = _world(spark, sf_dir, folder)
    wrapped = AsyncDatabase(db)

    async def run():
        await wrapped.transaction_mut(lambda txn: txn.insert(Nation, name="ATLANTIS", region=txn.query_one(Region.by(name="ASIA"))))
        return await wrapped.transaction(lambda txn: txn.query_one(Nation.by(name="ATLANTIS")))

    assert asyncio.run(run()) is not None
    return _ids(db)


@stored("SELECT r_name AS region, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey)::BIGINT AS nations FROM region")
def read_in_threads(spark, sf_dir, folder):
    """Several read transactions at once, each with a snapshot of its own."""
    db = _world(spark, sf_dir, folder)

    def count(name):
        def run(q):
            n = q.join(Nation)
            q.filter(n.region.name.eq(name))
            return len(list(q.into_vec(n)))

        return name, db.transaction(lambda txn: txn.query(run))

    names = db.transaction(lambda txn: txn.query(lambda q: q.into_vec(q.join(Region).name)))
    with ThreadPoolExecutor(4) as pool:
        return spark.createDataFrame(list(pool.map(count, names)), "region string, nations bigint")


@stored("SELECT n_name AS name FROM nation WHERE n_regionkey = 1 AND n_name <> 'NATION_1'")
def raw_sql_arguments(spark, sf_dir, folder):
    """Rows and values are parameters of SQL."""
    db = _world(spark, sf_dir, folder)

    def run(txn):
        america = txn.query_one(Region.by(name="AMERICA"))
        return txn.spark_sql("SELECT name FROM nation WHERE region = :region AND name <> :but", {"region": america, "but": "NATION_1"})

    return db.transaction(run)


@stored("SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 5")
def open_in_memory(spark, sf_dir, folder):
    """A database without a folder of its own."""
    db = Database(spark, WORLD, Config.open_in_memory())
    db.import_table(Region, spark.read.parquet(f"{sf_dir}/region.parquet"))
    db.import_table(Nation, spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_nationkey < 5"))
    return _nations(db)


@stored("SELECT 'normal' AS synchronous, true AS refused")
def config_knobs(spark, sf_dir, folder):
    """A commit checks all references again where the configuration says so."""
    config = Config(folder, check_references=True, synchronous="normal")
    db = Database(spark, WORLD, config)
    refused = False
    try:
        db.transaction_mut(lambda txn: txn._layer(Nation, spark.createDataFrame([(1, "lost", 9)], Nation.struct())))
    except Referenced:
        refused = True
    return spark.createDataFrame([(config.synchronous, refused)], "synchronous string, refused boolean")


# -- results ---------------------------------------------------------------------
@stored("SELECT r_name AS name, r_regionkey::BIGINT AS id FROM region")
def read_vec(spark, sf_dir, folder):
    """Rows as Python values: a reference and a text."""
    got = run_query(ExternalSource(spark, sf_dir), lambda q: (lambda r: q.into_vec((r.name, r)))(q.join(Region)))
    return spark.createDataFrame([(name, row.id) for name, row in got], "name string, id bigint")


@stored("SELECT n_name AS name FROM nation WHERE n_nationkey < 10")
def read_iter(spark, sf_dir, folder):
    """Rows one by one, while the transaction takes no writes."""
    db = _world(spark, sf_dir, folder)

    def run(txn):
        def names(q):
            n = q.join(Nation)
            return q.order_by().asc(n.name).into_iter((n, n.name))

        with txn.iterate(names) as rows:
            return [name for row, name in rows if row.id < 10]

    return spark.createDataFrame([(n,) for n in db.transaction(run)], "name string")


@stored("SELECT true AS scans_files, true AS pushes_filter")
def read_plan(spark, sf_dir, folder):
    """The physical plan of a query."""
    db = _world(spark, sf_dir, folder)

    def run(q):
        n = q.join(Nation)
        q.filter(n.name.eq("NATION_1"))
        return q.into_df({"name": n.name})

    text = db.transaction(lambda txn: txn.plan(run))
    return spark.createDataFrame([("Scan parquet" in text, "EqualTo(name,NATION_1)" in text)], "scans_files boolean, pushes_filter boolean")


@stored("SELECT r_name AS name, length(r_name)::BIGINT AS chars FROM region")
def read_map(spark, sf_dir, folder):
    """A function over decoded values."""
    from .operators.select import as_select

    def run(q):
        r = q.join(Region)
        return q.into_vec(as_select((r.name, r.name.char_len())).map(lambda v: {"name": v[0], "chars": v[1]}))

    got = run_query(ExternalSource(spark, sf_dir), run)
    return spark.createDataFrame([(v["name"], v["chars"]) for v in got], "name string, chars bigint")


@dataclass
class RegionName:
    name: str


@stored("SELECT i AS id, r_name AS region FROM (SELECT unnest(['ASIA', 'NOWHERE']) AS i) LEFT JOIN region ON r_name = i")
def from_optional_row(spark, sf_dir, folder):
    """A dataclass from a row that may be missing."""
    out = []
    for name in ("ASIA", "NOWHERE"):
        found = run_query(ExternalSource(spark, sf_dir), lambda q, name=name: q.into_vec(from_expr(RegionName, Region.by(name=name))))[0]
        out.append((name, None if found is None else found.name))
    return spark.createDataFrame(out, "id string, region string")


@stored("SELECT 1::BIGINT AS joins, 2::BIGINT AS columns")
def shared_lookups(spark, sf_dir, folder):
    """Equal lookups are one join, equal expressions one column of what travels."""
    source = ExternalSource(spark, sf_dir)

    def run(q):
        n = q.join(Nation)
        return q.into_df({"a": n.region.name, "b": n.region.name.concat("!"), "c": n.region.name.char_len()})

    plan = run_query(source, run)._jdf.queryExecution().optimizedPlan().toString()
    from .plans.scopes import Query, opened

    with opened("query") as scope:
        seen = []

        class Watching:
            def __init__(self, inner):
                self.inner = inner

            def rows(self, rows, order, select, take=None):
                seen.append(len({e.node for _, e in select.exprs()}))
                return self.inner.rows(rows, order, select, take)

        from .sources.external import Runner

        q = Query(scope, Watching(Runner(source)))
        n = q.join(Nation)
        same = list(q.into_vec((n.name, n.region.name, n.name)))
    assert all(a == c for a, _, c in same)
    return spark.createDataFrame([(plan.count("Join"), seen[0])], "joins bigint, columns bigint")


@query("SELECT r_name AS name, count(DISTINCT n_nationkey)::BIGINT AS nations, count(c_custkey)::BIGINT AS customers, max(c_acctbal) AS best FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def row_with_aggregates(q):
    """A row with several aggregates over what refers to it, as one nested selection."""
    r = q.join(Region)

    def nations(rows):
        return rows.count_distinct(rows.join(Nation.at(region=r)))

    def customers(rows):
        c = rows.join(Customer)
        rows.filter(c.nation.region.eq(r))
        return {"customers": rows.count_distinct(c), "best": rows.max(c.balance)}

    details = aggregate(customers)
    return q.into_df({"name": r.name, "nations": aggregate(nations), "customers": details["customers"], "best": details["best"]})


@query("SELECT p_partkey AS id, true AS zero, p_size = 25 AS shifted, false AS days, true AS parted FROM part")
def eq_computed_null(q):
    """Equality of values that an operation left missing is null-safe, negated too."""
    p = q.join(Part)
    zero = p.size.div(p.size.sub(p.size))
    q.filter(zero.eq(1).not_())
    q.filter(p.price.div(0.0).eq(p.price).not_())
    day = lit(dt.date(2024, 2, 29))
    return q.into_df({
        "id": p, "zero": zero.eq(p.size.modulo(0)), "shifted": p.size.sub(25).eq(0), "days": day.add_day(p.size.add(4_000_000_000)).eq(day),
        "parted": p.price.div(p.price.sub(p.price)).to_i64().eq(p.price.sub(p.price).div(0.0).to_i64()),
    })


# -- migrations ------------------------------------------------------------------
@stored("SELECT n_nationkey::BIGINT AS id, 'the ' || n_name AS title, (SELECT count(*) FROM nation b WHERE b.n_regionkey = a.n_regionkey)::BIGINT AS siblings FROM nation a")
def migrate_renamed_with_query(spark, sf_dir, folder):
    """A table renamed, another dropped, one created and filled from a query on the old ones; changes after the step."""
    _world(spark, sf_dir, folder)

    class Country(Table):
        __from__ = Nation
        title = Column(String, unique=True)
        siblings = Column(I64)

    class Log(Table):
        text = Column(String)

    newer = Schema(Country, Log, version=1, previous=WORLD)

    def step(s):
        def sizes(q):
            r = q.join(Region)
            return q.into_df({"r": r, "n": aggregate(lambda rows: rows.count_distinct(rows.join(Nation.at(region=r))))})

        counts = {row["r"]: row["n"] for row in s.query(sizes).collect()}
        sibling = F.create_map(*[F.lit(x) for kv in counts.items() for x in kv])
        s.migrate(Country, title=F.concat(F.lit("the "), "name"), siblings=lambda df: sibling[df["region"]])

    migrator = Migrator.open(spark, WORLD, Config.open(folder)).migrate(newer, step)
    db = migrator.fixup(lambda txn: txn.insert_ok(Log, text="moved")).finish()
    assert db.transaction(lambda txn: txn.query(lambda q: q.into_vec(q.join(Log).text))) == ["moved"]
    assert {r["table"] for r in db.transaction(lambda txn: txn.metadata("tables")).collect()} == {"country", "log"}
    return db.transaction(lambda txn: txn.spark_sql("SELECT id, title, siblings FROM country"))


@stored("SELECT true AS told, 0::BIGINT AS version")
def migrate_dangling(spark, sf_dir, folder):
    """References to rows that a step leaves out: the callback is called, nothing is committed."""
    db, told = _world(spark, sf_dir, folder), []

    class Some(Table):
        __table__ = "region"
        __from__ = Region
        name = Column(String, unique=True)

    class Kept(Table):
        __table__ = "nation"
        __from__ = Nation
        name = Column(String, unique=True)
        region = Column(Some, index=True)

    try:
        Migrator.open(spark, WORLD, Config.open(folder)).migrate(Schema(Some, Kept, version=1, previous=WORLD), lambda s: s.migrate(Some, where=F.col("id") > 0, dangling=lambda: told.append(True)))
        raise AssertionError("a reference dangles")
    except Drift:
        pass
    return spark.createDataFrame([(bool(told), db.store.read()["schema_version"])], "told boolean, version bigint")


@stored("SELECT true AS index_is_free, true AS column_is_not, 'table nation: column size (I64) is declared but not stored' AS why")
def schema_drift(spark, sf_dir, folder):
    """A plain index may be declared anew; a column may not."""
    _world(spark, sf_dir, folder)

    class Indexed(Table):
        __table__ = "nation"
        __index__ = [("region", "name")]
        name = Column(String, unique=True)
        region = Column(Region)

    class Wider(Table):
        __table__ = "nation"
        name = Column(String, unique=True)
        region = Column(Region, index=True)
        size = Column(I64)

    Database(spark, Schema(Region, Indexed), Config.open(folder))
    try:
        Database(spark, Schema(Region, Wider), Config.open(folder))
        why = ""
    except Drift as drift:
        why = str(drift)
    finally:
        Schema(Region, Nation)
    return spark.createDataFrame([(True, bool(why), why)], "index_is_free boolean, column_is_not boolean, why string")


class Person(Versioned):
    name = Column(String)
    mail = Column(Option(String), since=1)
    age = [Column(I64, until=2), Column(F64, since=2)]


class Remark(Versioned):
    __since__, __until__ = 1, 2
    author = Column(Person)


@stored("SELECT * FROM (VALUES (0, 'person', 'age', 'I64'), (0, 'person', 'name', 'String'), (1, 'person', 'age', 'I64'), (1, 'person', 'mail', '?String'), (1, 'person', 'name', 'String'), (1, 'remark', 'author', '->person'), (2, 'person', 'age', 'F64'), (2, 'person', 'mail', '?String'), (2, 'person', 'name', 'String')) t(version, tbl, col, kind)")
def schema_versions(spark, sf_dir, folder):
    """Schemas of all versions from tables and columns declared for ranges of them, and a database walked through them."""
    zero, one, two = schemas(Person, Remark, last=2)
    config = Config.open(folder)
    Database(spark, zero, config).transaction_mut(lambda txn: txn.insert_ok(zero.table("Person"), name="a", age=3))
    moved = Migrator.open(spark, zero, config).migrate(one, lambda s: s.migrate(one.table("Person"), mail=F.lit(None).cast("string")))
    last = moved.migrate(two, lambda s: s.migrate(two.table("Person"), age=F.col("age") + 0.5)).finish()
    assert last.transaction(lambda txn: txn.query(lambda q: q.into_vec(q.join(two.table("Person")).age))) == [3.5]
    rows = [(s.version, t, c, k) for s in (zero, one, two) for t, d in s.canonical().items() for c, k in d["columns"].items()]
    return spark.createDataFrame(rows, "version int, tbl string, col string, kind string")
