"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions.

Every source has a target number of words and a schedule, the relative rate at
which its words are wanted over training time 0 to 1 (piecewise linear through
``schedule`` at equally spaced knots).  The integral of the schedule, scaled to
the target, is the source's cumulative demand; a copy of a document whose words
begin at word q of its source's stream is wanted at the time where the demand
reaches q.  That inverse is closed form: find the knot interval, solve one
quadratic.  Documents are then range-sorted by their positions.

Streams are cumulative sums inside a source in the order of the ids' hash.  A
source may hold a third of all rows, so the sum is taken in two levels: per hash
cell (pre-aggregated), then inside each cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ranked, word_count

#: Rows a cell of the two-level sum should hold.
CELL_ROWS = 2048
#: Sources whose table of one row each is broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 50_000
#: Most rows that are broadcast because they are there very often.
REPEATED = 10_000
#: Rates at times 0, 1/2 and 1 by weight 1, 2, 3: light sources early, heavy ones late.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))


def source_targets(sizes: DataFrame, *, limit: float = 3.0) -> DataFrame:
    """``(source, source_size, source_rows, weight, target)`` from rows ``(source, size)``.

    Sources by code point, null last, weigh 1, 2, 3, repeating.  All of the
    words are shared by weight; a target stops at ``limit`` times its source's
    size and the excess is shared among the rest by weight until none is above.
    Each round of sharing is one sum over the sources; the level only rises, so
    the rounds end, after a few.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    per = ranked(per, F.col("source").isNull(), F.col("source"))
    per = cut(per.select("source", "source_size", "source_rows", (F.col("rank") % 3 + 1).cast("int").alias("weight")))
    level, stopped = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("weight") * F.lit(level) > F.lit(limit) * F.col("source_size")
        row = per.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(over, F.lit(limit) * F.col("source_size")).otherwise(F.lit(0.0))).alias("taken"),
            F.sum(F.when(over, F.lit(0)).otherwise(F.col("weight"))).alias("left"), F.sum(over.cast("long")).alias("stopped"),
        ).first()
        if not row["left"] or row["stopped"] == stopped:
            break
        level, stopped = (row["all"] - row["taken"]) / row["left"], row["stopped"]
    return per.withColumn("target", F.least(F.lit(level or 0.0) * F.col("weight"), F.lit(limit) * F.col("source_size")))


def position_at(share: Column, rates: Column) -> Column:
    """Time at which the integrated, normalised schedule reaches ``share`` (0 to 1) of its total."""
    steps = F.size(rates) - 1
    area = F.transform(F.sequence(F.lit(0), steps - 1), lambda i: (F.get(rates, i) + F.get(rates, i + 1)) / 2)
    total = F.aggregate(area, F.lit(0.0), lambda a, x: a + x)
    want = share * total
    sums = F.transform(F.sequence(F.lit(0), steps), lambda i: F.aggregate(F.slice(area, F.lit(1), i), F.lit(0.0), lambda a, x: a + x))
    k = F.greatest(F.lit(0), F.least(steps - 1, F.size(F.filter(sums, lambda s: s <= want)) - 1))
    rest, a, b = want - F.get(sums, k), F.get(rates, k), F.get(rates, k + 1) - F.get(rates, k)
    # a*t + b*t*t/2 = rest, in the form that also holds for b = 0
    root = F.sqrt(F.greatest(F.lit(0.0), a * a + 2 * b * rest))
    t = F.when(a + root > 0, 2 * rest / (a + root)).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), (k + F.least(F.lit(1.0), t)) / steps)


def plan_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", limit: int = 3, schedules=SCHEDULES) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, copies, taken, position.

    ``copies`` is 0 to ``limit``; ``taken`` = copies * size.  Every document of a
    source is taken floor(target / size of the source) times and once more while
    the running sum's nearest point stays within the remainder, so a source misses
    its target by half a document at most.  ``position`` is the training time of
    the first copy, null if none is taken.  A null or empty text has size 0, a
    null source is a source of its own, repeated rows are rows of their own, an
    empty table gives an empty result.
    """
    base = docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"))
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":mix")).cast("binary"))
    return _plan(cut(base.withColumn("__h", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))), limit, schedules)


def _plan(base: DataFrame, limit: int, schedules) -> DataFrame:
    targets = cut(source_targets(base, limit=limit))
    cells = F.greatest(F.lit(1), F.ceil(F.col("source_rows") / CELL_ROWS)).cast("long")
    named = targets.withColumn("__cells", cells).withColumn("__key", F.struct(F.col("source").isNull(), F.coalesce("source", F.lit(""))))
    named = named.drop("source")
    # a join by source alone would bring a hot source's rows to one task
    named = F.broadcast(named) if targets.count() <= BROADCAST_SOURCES else named
    rows = base.withColumn("__key", F.struct(F.col("source").isNull(), F.coalesce("source", F.lit("")))).join(named, "__key")
    # cells are hash ranges: their order is the order of the hash, which has 60 bits
    rows = rows.withColumn("__cell", F.floor(F.shiftrightunsigned("__h", 29) * F.col("__cells") / float(1 << 31)).cast("long"))
    sums = rows.groupBy("__key", "__cell").agg(F.sum("size").alias("__in_cell"))
    sums = sums.withColumn("__start", F.sum("__in_cell").over(Window.partitionBy("__key").orderBy("__cell")) - F.col("__in_cell"))
    rows = rows.join(cut(sums.drop("__in_cell")), ["__key", "__cell"])
    inside = Window.partitionBy("__key", "__cell").orderBy("__h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.col("__start") + F.sum("size").over(inside) - F.col("size")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rows = rows.withColumns({"__from": start, "__passes": passes.cast("int")})
    rest = F.col("target") - F.col("__passes") * F.col("source_size")
    copies = F.least(F.lit(limit), F.col("__passes") + (F.col("__from") + F.col("size") / 2 <= rest).cast("int"))
    rates = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in schedules])
    rows = rows.withColumns({"copies": copies, "__rates": F.get(rates, F.col("weight") - 1)})
    share = F.when(F.col("target") > 0, F.least(F.lit(1.0), F.col("__from") / F.col("target"))).otherwise(F.lit(0.0))
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"),
        F.when(F.col("copies") > 0, position_at(share, F.col("__rates"))).alias("position"),
        "__from", "__rates", "__h",
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The plan of :func:`plan_mix`, range-sorted by position; documents that are not taken come last."""
    planned = plan_mix(docs, **options)
    return planned.orderBy(F.col("position").isNull(), "position", "__h").drop("__from", "__rates", "__h")


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", limit: int = 3, schedules=SCHEDULES) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, range-sorted by the position of each copy.

    Columns are those of ``docs``.
    """
    id_, source = docs[id_col].cast("string"), docs[source_col]
    # rows that agree in id, source and text are interchangeable
    tagged = docs.withColumns({
        "__h": F.shiftrightunsigned(F.xxhash64(F.coalesce(id_, F.lit("")), F.lit("mix"), F.xxhash64(docs[text_col]), source, source.isNull()), 4),
        "__size": word_count(docs[text_col]),
    })
    base = cut(tagged.select(docs[id_col].alias("doc_id"), source.alias("source"), F.col("__size").alias("size"), "__h"))
    plan = _plan(base, limit, schedules)
    dealt = plan.groupBy(F.col("__h").alias("__twin")).agg(
        F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__same"), F.min("__from").alias("__from"), F.first("__rates").alias("__rates"),
        F.first("source_size").alias("__total"), F.first("target").alias("__target"),
    ).where(F.col("__copies") > 0)
    dealt = cut(dealt)
    # rows that are there very often are taken out without gathering them; there are REPEATED such rows at most
    often = F.col("__same") > max(1000, base.count() // REPEATED)
    one = tagged.join(dealt.where(~often), F.col("__h") == F.col("__twin"))
    # the first of equal rows takes all copies; the join has brought them together
    one = one.withColumn("__n", F.row_number().over(Window.partitionBy("__h").orderBy(F.lit(0)))).where(F.col("__n") == 1).drop("__n")
    if not dealt.where(often).isEmpty():
        one = one.unionByName(tagged.join(F.broadcast(dealt.where(often)), F.col("__h") == F.col("__twin")).dropDuplicates(["__h"]))
    one = one.withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1)))
    # where equal rows are several, their copies are spread over the passes as a single row's would be
    at = F.col("__from") + F.floor(F.col("__copy") / F.col("__same")) * F.col("__total")
    share = F.when(F.col("__target") > 0, F.least(F.lit(1.0), at / F.col("__target"))).otherwise(F.lit(0.0))
    one = one.withColumn("__position", position_at(share, F.col("__rates")))
    return one.orderBy("__position", "__h", "__copy").select(*docs.columns)
