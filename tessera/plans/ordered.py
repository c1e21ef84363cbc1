"""Joins on equalities and a comparison that don't compare all rows the equalities link.

Catalyst joins on the equalities and tests the comparison for every pair, which
grows with the square of the rows that share a key.  Here the distinct values of
both sides are numbered in order within their key.  A number is below another
where they agree in all bits above one in which the first has 0 and the second 1,
so a row joins by equality on that bit's level and the bits above: each pair
meets at one level, and no pair meets that isn't a result.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_join(
    low: DataFrame, high: DataFrame, keys: list[tuple[Column, Column, bool]], x: Column, y: Column, strict: bool, rest: list[Column], name: Callable[[str], str]
) -> DataFrame:
    """Pairs with equal keys, ``x < y`` (``x <= y`` unless ``strict``) and all of ``rest``.

    ``x`` and the first of each key are columns of ``low``, ``y`` and the second
    of ``high``; the third tells whether missing keys are equal.  A missing value
    or NaN compares as in Spark.  A row is copied for levels that have rows of
    both sides, at most as many as the number of its key's distinct values has bits.
    """
    key, value, side, place, level, node = [name("j") for _ in keys], *[name("j") for _ in range(5)]
    sides = []
    for df, own, v in ((low, [k for k, _, _ in keys], x), (high, [k for _, k, _ in keys], y)):
        named = {name("j"): c for c in [*own, v]}
        needed = [n for n, safe in zip(named, [*[s for _, _, s in keys], False], strict=True) if not safe]
        there = functools.reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in needed])
        sides.append((df.withColumns(named).where(there), list(named)))
    values = [df.select(*[F.col(n).alias(a) for n, a in zip(named, [*key, value], strict=True)], F.lit(i).alias(side)) for i, (df, named) in enumerate(sides)]
    # of equal values the one that isn't to be below the other comes later
    order = Window.partitionBy(*key).orderBy(value, F.desc(side) if strict else F.asc(side))
    count = F.count(F.lit(1))
    numbered = values[0].union(values[1]).distinct().select(
        *key, value, side, (count.over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1).alias(place), F.length(F.bin(count.over(Window.partitionBy(*key)))).alias(level)
    )
    levels = F.filter(F.sequence(F.lit(0), F.col(level) - 1), lambda i: F.getbit(F.col(place), i) == F.col(side))
    at = numbered.select(*key, value, side, place, F.explode(levels).alias(level)).withColumn(node, F.call_function("shiftright", F.col(place), F.col(level) + 1))
    meet = Window.partitionBy(*key, level, node)
    nodes = at.withColumn(place, F.max(side).over(meet) - F.min(side).over(meet)).where(F.col(place) == 1)

    def equal(pairs: list[tuple[str, str]]) -> Column:
        safe = [s for _, _, s in keys] + [False] * (len(pairs) - len(keys))
        return functools.reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) if s else F.col(a) == F.col(b) for (a, b), s in zip(pairs, safe, strict=True)])

    placed, links = [], []
    for i, (df, named) in enumerate(sides):
        found = [name("j") for _ in [*key, value, level, node]]
        mine = nodes.where(F.col(side) == i).select(*[F.col(n).alias(a) for n, a in zip([*key, value, level, node], found, strict=True)])
        placed.append(df.join(mine.hint("merge"), equal(list(zip(named, found[: len(named)], strict=True)))).drop(*found[: len(named)]))
        links.append([*named[:-1], *found[len(named) :]])
    on = functools.reduce(lambda a, b: a & b, rest, equal(list(zip(*links, strict=True))))
    # few rows may give very many pairs: the shuffle has a fixed number of parts, which adaptive execution doesn't put together by the rows' size
    session = low.sparkSession
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism)
    left, right = (df.repartition(parts, *link) for df, link in zip(placed, links, strict=True))
    return left.join(right.hint("merge"), on).drop(*links[0], *links[1], sides[0][1][-1], sides[1][1][-1])
