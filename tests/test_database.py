"""Transactions, constraints, migrations and the schema's own rules."""

import asyncio

import pytest
from pyspark.sql import functions as F

from tessera import Column, Config, Conflict, Database, F64, I64, Option, Referenced, Schema, SchemaError, String, Table
from tessera.schema import diff
from tessera.sources.database import AsyncDatabase, CommitConflict, Drift
from tessera.sources.migrate import Migrator
from tessera.sources.store import Store


def make():
    class User(Table):
        name = Column(String)

    class Image(Table):
        file_name = Column(String, unique=True)
        uploaded_by = Column(User, index=True)

    class Note(Table):
        __no_reference__ = True
        text = Column(Option(String))
        score = Column(F64)

    class Pair(Table):
        __unique__ = [("a", "b"), "c"]
        a = Column(I64)
        b = Column(I64)
        c = Column(I64)

    return User, Image, Note, Pair, Schema(User, Image, Note, Pair)


@pytest.fixture
def world(spark, tmp_path):
    user, image, note, pair, schema = make()
    return Database(spark, schema, Config.open(str(tmp_path / "db"))), user, image, note, pair


def test_insert_and_conflict(world):
    db, User, Image, Note, Pair = world

    def add(txn):
        u = txn.insert_ok(User, name="a")
        one = txn.insert(Image, file_name="x", uploaded_by=u)
        with pytest.raises(Conflict) as e:
            txn.insert(Image, file_name="x", uploaded_by=u)
        assert e.value.row == one
        assert txn.find_or_insert(Image, file_name="x", uploaded_by=u) == one
        txn.insert(Pair, a=1, b=2, c=3)
        with pytest.raises(Conflict) as e:
            txn.insert(Pair, a=1, b=3, c=3)
        assert e.value.row is None
        with pytest.raises(TypeError):
            txn.insert_ok(Image, file_name="y", uploaded_by=u)
        return txn.query(lambda q: q.into_vec(q.join(Image).uploaded_by.name))

    assert db.transaction_mut(add) == ["a"]
    assert db.transaction(lambda txn: txn.query_one(Image.by(file_name="x"))) is not None
    assert db.transaction(lambda txn: txn.query_one(Image.by(file_name="y"))) is None


def test_rollback(world):
    db, User, *_ = world

    def fail(txn):
        txn.insert_ok(User, name="gone")
        raise KeyError

    with pytest.raises(KeyError):
        db.transaction_mut(fail)
    assert db.transaction(lambda txn: txn.query(lambda q: q.into_vec(q.join(User).name))) == []


def test_mutable_and_unique(world):
    db, User, Image, *_ = world

    def run(txn):
        a, b = txn.insert_ok(User, name="a"), txn.insert_ok(User, name="b")
        x, y = txn.insert(Image, file_name="x", uploaded_by=a), txn.insert(Image, file_name="y", uploaded_by=a)
        m = txn.mutable(x)
        with pytest.raises(AttributeError):
            m.file_name = "z"
        m.uploaded_by = b
        with pytest.raises(Conflict):
            m.unique(lambda row: setattr(row, "file_name", "y"))
        assert m.file_name == "x" and m.uploaded_by == b.id
        with pytest.raises(ZeroDivisionError):
            m.unique(lambda row: (setattr(row, "file_name", "q"), 1 / 0))
        assert m.unique(lambda row: setattr(row, "file_name", "z")) is None
        assert m.into_table_row() == x
        for u in txn.mutable_vec(User):
            u.name = u.name.upper()
        txn.mutable(y)
        return x

    db.transaction_mut(run)
    got = db.transaction(lambda txn: txn.query(lambda q: (lambda i: q.into_vec((i.file_name, i.uploaded_by.name)))(q.join(Image))))
    assert sorted(got) == [("y", "A"), ("z", "B")]


def test_delete(world):
    db, User, Image, Note, _ = world

    def run(txn):
        u = txn.insert_ok(User, name="a")
        i = txn.insert(Image, file_name="x", uploaded_by=u)
        n = txn.insert_ok(Note, text=None, score=1.0)
        with pytest.raises(RuntimeError):
            txn.delete(i)
        txn.downgrade()
        with pytest.raises(Referenced):
            txn.delete(u)
        with pytest.raises(TypeError):
            txn.delete_ok(u)
        assert txn.delete_ok(n) and not txn.delete_ok(n)
        assert txn.delete(i) and txn.delete(u) and not txn.delete(u)

    db.transaction_mut(run)


def test_references_end_with_their_transaction(world):
    db, User, Image, *_ = world
    u = db.transaction_mut(lambda txn: txn.insert_ok(User, name="a"))
    with pytest.raises(RuntimeError):
        db.transaction_mut(lambda txn: txn.insert(Image, file_name="x", uploaded_by=u))


def test_no_writes_while_reading(world):
    db, User, *_ = world

    def run(txn):
        txn.insert_ok(User, name="a")
        with txn.iterate(lambda q: q.into_iter(q.join(User).name)) as names:
            assert next(names) == "a"
            with pytest.raises(RuntimeError):
                txn.insert_ok(User, name="b")

    db.transaction_mut(run)


def test_lazy(world):
    db, User, Image, *_ = world
    db.transaction_mut(lambda txn: txn.insert(Image, file_name="x", uploaded_by=txn.insert_ok(User, name="a")))

    def run(txn):
        image = txn.lazy(Image.by(file_name="x"))
        assert image.uploaded_by.name == "a" and image.table_row() == txn.query_one(Image.by(file_name="x"))
        assert txn.lazy(Image.by(file_name="no")) is None
        assert [i.file_name for i in txn.lazy_iter(Image)] == ["x"]
        assert txn.spark_sql("SELECT count(*) AS n FROM image").first()["n"] == 1
        assert "Scan parquet" in txn.plan(lambda q: q.into_df({"n": q.join(Image).file_name}))
        assert txn.metadata("references").count() == 1 and txn.metadata("tables").count() == 4

    db.transaction(run)


def test_bulk(world, spark):
    db, User, *_ , Pair = world

    def run(txn):
        txn.insert_many(User, spark.range(1000).select(F.col("id").cast("string").alias("name")))
        txn.update_where(User, F.col("name") == "7", name=F.lit("seven"))
        with pytest.raises(Conflict):
            txn.insert_many(Pair, spark.range(3).select(F.lit(1).alias("a"), F.lit(1).alias("b"), F.col("id").alias("c")))

    with pytest.raises(AssertionError):
        db.transaction_mut(lambda txn: (run(txn), (_ for _ in ()).throw(AssertionError)))
    db.transaction_mut(lambda txn: txn.insert_many(User, spark.range(1000).select(F.col("id").cast("string").alias("name"))))
    frame = db.transaction(lambda txn: txn.source(User).agg(F.count_distinct("id"), F.min("id"), F.max("id")).first())
    assert tuple(frame) == (1000, 1, 1000)


def test_two_writers_meet_at_the_manifest(world):
    db, *_ = world
    manifest = db.store.read()
    db.store.commit(manifest)
    with pytest.raises(CommitConflict):
        db.store.commit(manifest)


def test_async(world):
    db, User, *_ = world

    async def run():
        other = AsyncDatabase(db)
        await other.transaction_mut(lambda txn: txn.insert_ok(User, name="a"))
        return await other.transaction(lambda txn: txn.query(lambda q: q.into_vec(q.join(User).name)))

    assert asyncio.run(run()) == ["a"]


def test_drift(world, spark):
    db, User, Image, Note, Pair = world
    manifest = db.store.read()
    manifest["schema"]["user"]["columns"]["extra"] = "I64"
    db.store.commit(manifest)
    with pytest.raises(Drift, match="extra"):
        db.transaction(lambda txn: None)


def versions():
    class Foo(Table):
        name = Column(String)

    class Ref(Table):
        foo = Column(Foo)

    v0 = Schema(Foo, Ref)

    class FooNew(Table):
        __from__ = Foo
        __primary_key__ = "new_id"
        label = Column(String, unique=True)

    class Ref1(Table):
        __table__ = "ref"
        foo = Column(FooNew)

    class Log(Table):
        text = Column(String)

    return v0, Foo, Ref, Schema(FooNew, Ref1, Log, version=1, previous=v0), FooNew, Ref1, Log


def test_migration_keeps_ids(spark, tmp_path):
    v0, Foo, Ref, v1, FooNew, Ref1, Log = versions()
    config = Config.open(str(tmp_path / "db"))
    db = Database(spark, v0, config)

    def fill(txn):
        txn.downgrade()
        a, b = txn.insert_ok(Foo, name="a"), txn.insert_ok(Foo, name="b")
        txn.delete(a)
        txn.insert_ok(Ref, foo=b)

    db.transaction_mut(fill)
    migrator = Migrator.open(spark, v0, config).migrate(v1, lambda step: step.migrate(FooNew, label=F.concat("name", F.lit("!"))))
    migrator.fixup(lambda txn: txn.insert_ok(Log, text="moved"))
    new = migrator.finish()

    def read(q):
        r = q.join(Ref1)
        return q.into_vec((r.foo, r.foo.label))

    (row, label), = new.transaction(lambda txn: txn.query(read))
    assert (row.id, label) == (2, "b!")
    assert new.transaction(lambda txn: txn.query(lambda q: q.into_vec(q.join(Log).text))) == ["moved"]
    assert new.transaction_mut(lambda txn: txn.insert(FooNew, label="c")).id == 3
    again = Migrator.open(spark, v0, config)
    assert again is not None and again.finish() is None
    assert Migrator.open(spark, v0, config).migrate(v1).fixup(lambda txn: 1 / 0).finish() is not None
    with pytest.raises(Drift):
        Database(spark, v0, config)


def test_migration_conflict_and_dangling(spark, tmp_path):
    v0, Foo, Ref, v1, FooNew, Ref1, Log = versions()
    config = Config.open(str(tmp_path / "db"))

    def fill(txn):
        txn.insert_ok(Foo, name="a")
        txn.insert_ok(Ref, foo=txn.insert_ok(Foo, name="a"))

    Database(spark, v0, config).transaction_mut(fill)
    with pytest.raises(Conflict):
        Migrator.open(spark, v0, config).migrate(v1, lambda step: step.migrate(FooNew, label=F.col("name")))
    with pytest.raises(Drift, match="leaves out"):
        Migrator.open(spark, v0, config).migrate(v1, lambda step: step.migrate(FooNew, where=F.col("id") == 1, label=F.col("name")))
    seen = []
    with pytest.raises(Drift):
        Migrator.open(spark, v0, config).migrate(v1, lambda step: step.migrate(FooNew, where=F.col("id") == 1, dangling=lambda: seen.append(1), label=F.col("name")))
    assert seen
    with pytest.raises(Drift, match="new"):
        Migrator.open(spark, v0, config).migrate(v1, lambda step: step.migrate(FooNew))
    assert Store(spark, config.folder).read()["schema_version"] == 0


def test_older_database_gives_no_migrator(spark, tmp_path):
    v0, *_, v1, FooNew, Ref1, Log = versions()
    config = Config.open(str(tmp_path / "db"))
    Database(spark, v0, config)
    assert Migrator.open(spark, v1, config) is None


def test_hash_and_diff():
    class A(Table):
        __table__ = "a"
        x = Column(I64, unique=True)
        y = Column(String, index=True)

    class B(Table):
        __table__ = "a"
        y = Column(String)
        x = Column(I64, unique=True)

    class C(Table):
        __table__ = "a"
        x = Column(F64)

    a, b, c = Schema(A), Schema(B), Schema(C)
    assert a.hash() == b.hash() != c.hash()
    assert diff(a.canonical(), b.canonical()) == []
    assert len(diff(a.canonical(), c.canonical())) == 3


def test_schema_rules():
    class Leaf(Table):
        __no_reference__ = True
        name = Column(String)

    with pytest.raises(SchemaError):
        class P(Table):
            leaf = Column(Leaf)
        Schema(Leaf, P)
    with pytest.raises(SchemaError):
        class Q(Table):
            id = Column(I64)
    with pytest.raises(SchemaError):
        class R(Table):
            __unique__ = ["nothing"]
            name = Column(String)
    with pytest.raises(SchemaError):
        class S(Table):
            name = Column(Option(String), unique=True)
        Schema(S)
    with pytest.raises(TypeError):
        Option(Option(int))
    with pytest.raises(SchemaError):
        class T(Table):
            __from__ = Leaf
            name = Column(String)
        Schema(T)
    with pytest.raises(SchemaError):
        class U(Table):
            other = Column("Missing")
        Schema(U)
    with pytest.raises(SchemaError):
        class Plain:
            pass

        class V(Table):
            x = Column(Plain)


def test_empty_table_and_self_reference(spark, tmp_path):
    class Empty(Table):
        pass

    class Employee(Table):
        name = Column(String)
        boss = Column("Employee", option=True)

    db = Database(spark, Schema(Empty, Employee), Config.open(str(tmp_path / "db")))

    def run(txn):
        txn.insert_ok(Empty)
        ann = txn.insert_ok(Employee, name="Ann", boss=None)
        bob = txn.insert_ok(Employee, name="Bob", boss=ann)
        txn.insert_ok(Employee, name="Cid", boss=ann)
        txn.insert_ok(Employee, name="Dan", boss=bob)

        def reports(q):
            from tessera import aggregate

            e = q.join(Employee)

            def count(rows):
                other = rows.join(Employee)
                rows.filter(rows.filter_some(other.boss).eq(e))
                return rows.count_distinct(other)

            return q.into_vec((e.name, aggregate(count)))

        return sorted(txn.query(reports)), txn.query(lambda q: len(q.into_vec(q.join(Empty))))

    assert db.transaction_mut(run) == ([("Ann", 2), ("Bob", 1), ("Cid", 0), ("Dan", 0)], 1)


GOOD_TIMES = ["2000-01-01 10:20:30", "2000-01-01 10:20:31", "2000-01-01 10:20:31.1", "2000-01-01 10:20:31.000000001"]
BAD_TIMES = [
    "2000-01-01 10:20:30Z", "2000-01-01 10:20:31Z", "2000-01-01 10:20:31+00:01", "2000-01-01 10:20:31+00:00", "2000-01-01 10:20:31 ", "-2000-01-01 10:20:30", "-2000-01-01 10:20:31",
    "2000-01-01 10:20:30.", "2000-01-01 10:20:30.0", "2000-01-01 10:20:30. 1", "2000-01-01 10:20:30.10", "2000-01-01 10:20:31.0000000001", "2001-02-29 00:00:00",
]
GOOD_DATES = ["2000-01-01", "0000-01-30", "9999-12-31", "2000-02-29"]
BAD_DATES = ["2000-01-01 10:20:30", "2000-01-01 ", "2000-01-01Z", "2000-01-01+00:01", "2000-01-01+00:00", "-2000-01-01", "1900-02-29", "2000-04-31", "2000-13-01"]


def test_stored_texts(spark):
    from tessera.functions.text_forms import valid_date_text, valid_timestamp_text

    for good, bad, check in ((GOOD_TIMES, BAD_TIMES, valid_timestamp_text), (GOOD_DATES, BAD_DATES, valid_date_text)):
        frame = spark.createDataFrame([(t,) for t in [*good, *bad, None]], "t string")
        assert [r[0] for r in frame.select(check(F.col("t"))).collect()] == [True] * len(good) + [False] * (len(bad) + 1)


def test_import_checks_texts(spark, tmp_path):
    from tessera import Date

    class Day(Table):
        on = Column(Date)

    db = Database(spark, Schema(Day), Config(str(tmp_path / "db"), synchronous="normal"))
    db.import_table(Day, spark.createDataFrame([("2000-01-01",)], "on string"))
    with pytest.raises(Exception, match="no stored date"):
        db.import_table(Day, spark.createDataFrame([("2000-01-01Z",)], "on string"))


def test_references_are_checked_at_commit(spark, tmp_path):
    user, image, note, pair, schema = make()
    db = Database(spark, schema, Config(str(tmp_path / "db"), check_references=True))
    with pytest.raises(Referenced):
        db.transaction_mut(lambda txn: txn.insert_many(image, spark.createDataFrame([("x", 7)], "file_name string, uploaded_by long")))


def test_stream_is_appended_once(spark, tmp_path):
    from tessera.streaming.ingest import append_batch, ingest

    class Event(Table):
        kind = Column(String)
        value = Column(F64)

    db = Database(spark, Schema(Event), Config.open(str(tmp_path / "db")))
    rows = spark.range(50).select(F.lit("a").alias("kind"), F.col("id").cast("double").alias("value"))
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        ingest(source, db, Event, "events", str(tmp_path / "checkpoint")).awaitTermination()
    assert not append_batch(db, Event, "events", rows, 0)
    assert db.transaction(lambda txn: txn.source(Event).count()) == 50


def folders(db):
    import os

    return {d for d in os.listdir(db.store.folder) if os.path.isdir(os.path.join(db.store.folder, d))}


def test_a_commit_writes_only_what_changed(world, spark):
    """Inserts, changes and deletes add small layers; the rows that are there stay where they are."""
    db, User, Image, Note, Pair = world
    db.import_table(User, spark.range(1, 5001).selectExpr("id", "concat('u', id) AS name"))
    whole = folders(db)
    db.transaction_mut(lambda txn: txn.insert_ok(User, name="new"))
    layers = db.store.read()["tables"]["user"]["layers"]
    assert len(layers) == 2 and len(folders(db) - whole) == 1
    assert db.store.read_folder(layers[1]["rows"], User.struct()).count() == 1

    def change(txn):
        txn.downgrade()
        found = txn.spark_sql("SELECT id FROM user WHERE name IN ('u7', 'u8') ORDER BY id").collect()
        from tessera import RowRef

        with txn.mutable(RowRef(User, found[0]["id"], txn)) as m:
            m.name = "seven"
        assert txn.delete(RowRef(User, found[1]["id"], txn))

    db.transaction_mut(change)
    table = db.store.read()["tables"]["user"]["layers"]
    assert table[:2] == layers and all(x.get("gone") for x in table[2:])
    names = {r["name"] for r in db.transaction(lambda txn: txn.spark_sql("SELECT name FROM user")).collect()}
    assert names == {f"u{i}" for i in range(1, 5001)} - {"u7", "u8"} | {"seven", "new"}


def test_layers_are_merged_by_level(world, spark):
    """Fifty appends leave few layers; no row was written more than a few times; unused folders can be deleted."""
    db, User, *_ = world
    written = []
    write = db.store.write
    db.store.write = lambda name, df: written.append(df.count()) or write(name, df)
    for i in range(50):
        db.transaction_mut(lambda txn, i=i: txn.insert_ok(User, name=f"u{i}"))
    layers = db.store.read()["tables"]["user"]["layers"]
    assert len(layers) <= 2 * 8 and sum(written) <= 50 * 3
    before = {r["name"] for r in db.transaction(lambda txn: txn.spark_sql("SELECT name FROM user")).collect()}
    assert db.store.vacuum(keep=1) and len(db.store.versions()) == 1
    assert before == {r["name"] for r in db.transaction(lambda txn: txn.spark_sql("SELECT name FROM user")).collect()} == {f"u{i}" for i in range(50)}
    assert len(folders(db)) == len(layers)


def test_many_changes_in_one_transaction(world, spark):
    """More changes than layers may hold become one whole table."""
    db, User, *_ = world
    db.import_table(User, spark.range(1, 41).selectExpr("id", "concat('u', id) AS name"))

    def change(txn):
        from tessera import RowRef

        for i in range(1, 12):
            with txn.mutable(RowRef(User, i, txn)) as m:
                m.name = f"v{i}"
        txn.insert_ok(User, name="late")

    db.transaction_mut(change)
    assert len(db.store.read()["tables"]["user"]["layers"]) == 1
    names = sorted(r["name"] for r in db.transaction(lambda txn: txn.spark_sql("SELECT name FROM user")).collect())
    assert names == sorted([*(f"v{i}" for i in range(1, 12)), *(f"u{i}" for i in range(12, 41)), "late"])


def test_of_many_writers_one_wins(world):
    """A race for the next manifest has one winner, whatever the file system's rename does."""
    from concurrent.futures import ThreadPoolExecutor

    db, *_ = world
    manifest = db.store.read()

    def claim(_):
        try:
            return db.store.commit(manifest)
        except CommitConflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [v for v in pool.map(claim, range(16)) if v]
    assert len(won) == 1 and db.store.versions()[-1] == won[0]
    import os

    assert not [f for f in os.listdir(db.store.folder) if f.startswith(".part")]


def test_bulk_inserts_are_checked(world, spark):
    """New rows against each other, against the table and against what they refer to."""
    db, User, Image, Note, Pair = world
    user = db.transaction_mut(lambda txn: txn.insert_ok(User, name="a"))
    rows = lambda *x: spark.createDataFrame(x, "file_name string, uploaded_by long")
    db.transaction_mut(lambda txn: txn.insert_many(Image, rows(("x", user.id), ("y", user.id))))
    for bad, why in (((("z", user.id), ("z", user.id)), Conflict), ((("x", user.id),), Conflict), ((("q", 77),), Referenced), (((None, user.id),), TypeError)):
        with pytest.raises(why):
            db.transaction_mut(lambda txn, bad=bad: txn.insert_many(Image, rows(*bad)))
    got = db.transaction(lambda txn: txn.spark_sql("SELECT id, file_name FROM image")).collect()
    assert {r["id"] for r in got} == {1, 2} and sorted(r["file_name"] for r in got) == ["x", "y"]
    assert not [f for f in folders(db) if f.startswith("scratch")]


def test_spark_sql_leaves_session_views_alone(world, spark):
    db, User, *_ = world
    db.transaction_mut(lambda txn: txn.insert_ok(User, name="a"))
    spark.range(3).createOrReplaceTempView("user")
    try:
        got = db.transaction(lambda txn: txn.spark_sql("WITH x AS (SELECT * FROM user) SELECT count(*) AS n FROM x WHERE name = :name", {"name": "a"}).first()["n"])
        assert got == 1 and spark.table("user").count() == 3
    finally:
        spark.catalog.dropTempView("user")
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("user__")]


def test_drift_names_places(spark, tmp_path):
    """A difference says which table and column, and where that is declared."""
    import inspect

    class User(Table):
        name = Column(String)

    config = Config.open(str(tmp_path / "db"))
    Database(spark, Schema(User), config)

    class Wider(Table):
        __table__ = "user"
        name = Column(String)
        age = Column(I64)

    with pytest.raises(Drift) as drift:
        Database(spark, Schema(Wider), config)
    (found,) = drift.value.differences
    line = inspect.getsourcelines(Wider)[1] + 3
    assert (found.table, found.column) == ("user", "age") and found.place.endswith(f"test_database.py:{line}")
