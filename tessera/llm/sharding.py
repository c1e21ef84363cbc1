"""Sharding by histogram sort, with DataFrame functions only.

Rows are ordered by (hash of the text, hash of the id).  The cut points between
shards are found by counting: each round counts exact bytes and rows per cell of
a radix grid over the key ranges that still hold an undecided cut, and only the
cell that holds the cut is split further.  At most ``(shards - 1) * 2**STEP``
counts reach the driver in a round, whatever the input.  When every cut is within
the tolerance, or its cell holds a single row, the rows move once.

Cuts fall between different texts where the tolerance allows it, so copies of a
text share a shard; a group of copies too large for that is split by the ids'
hash.

What one task sorts is a run: a range of texts' hashes, or where copies of a text
weigh more, a part of it by the ids' hash.  Runs hold about ``RUN_BYTES``; their
number grows with the input.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, top_bits, unsigned

#: Bits of the key that the first and each later round decide.
FIRST, STEP = 12, 8
#: Bytes of a sorted run, and runs up to which their table of one row each is broadcast; more are joined by the rows' one exchange.
RUN_BYTES, BROADCAST_RUNS = 1 << 19, 100_000
#: Cuts that are searched at a time.
FAN = 64
_WORD = 1 << 64


class _Cut:
    """One undecided cut: the cell it lies in and the best edge met so far."""

    def __init__(self, goal: float):
        self.goal, self.prefix, self.below = goal, 0, 0
        self.best, self.edge, self.open = math.inf, 0, True

    def offer(self, edge: int, bytes_below: int) -> None:
        # an edge between texts wins a tie with one inside a group of copies, as it is met first
        if abs(bytes_below - self.goal) < self.best:
            self.best, self.edge = abs(bytes_below - self.goal), edge


def find_cuts(digest: DataFrame, shards: int, tolerance: float) -> tuple[list[int], int]:
    """128-bit keys of the ``shards - 1`` cuts, in order, and the number of bytes.

    ``digest`` has ``__g``, ``__d`` (64-bit hashes) and ``__size``.  A row
    belongs at or above a cut if its key is not below it.
    """
    total = 0
    cuts: list[_Cut] = []
    bits = 0
    while not bits or any(c.open for c in cuts):
        # all open cuts have decided the same number of bits
        to = min(64 if bits < 64 else 128, bits + (STEP if bits else FIRST))
        live = sorted({c.prefix for c in cuts if c.open}) if bits else [0]
        part = (top_bits(F.col("__g"), to) if to <= 64 else top_bits(F.col("__d"), to - 64)).bitwiseAND(F.lit((1 << (to - bits)) - 1)).alias("c")
        rows = digest.withColumn("w", F.lit(0))
        if bits:
            g = lambda p: _signed(p >> max(0, bits - 64), min(bits, 64))
            d = lambda p: _signed(p & ((1 << (bits - 64)) - 1), bits - 64) if bits > 64 else 0
            cells = digest.sparkSession.createDataFrame([(g(p), d(p), i) for i, p in enumerate(live)], "p long, q long, w int")
            inside = (top_bits(F.col("__g"), min(bits, 64)) == F.col("p")) & ((top_bits(F.col("__d"), bits - 64) if bits > 64 else F.lit(0).cast("long")) == F.col("q"))
            rows = digest.join(F.broadcast(cells), inside)  # a row a cut at most
        grid: dict[int, list[tuple[int, int, int]]] = {}
        for r in rows.select("w", part, "__size").groupBy("w", "c").agg(F.sum("__size").alias("b"), F.count(F.lit(1)).alias("n")).collect():
            grid.setdefault(r["w"], []).append((r["c"], r["b"], r["n"]))
        if not bits:
            total = sum(x[1] for x in grid.get(0, []))
            if not grid:
                return [0] * (shards - 1), 0
            cuts = [_Cut(total * k / shards) for k in range(1, shards)]
        slack = tolerance * max(1, total) / shards
        sorted_grid = {w: sorted(cells) for w, cells in grid.items()}
        index = {p: i for i, p in enumerate(live)}
        for c in (c for c in cuts if c.open):
            below, c.open = c.below, False
            for number, b, n in sorted_grid.get(index[c.prefix], []):
                prefix = (c.prefix << (to - bits)) | number
                c.offer(prefix << (128 - to), below)
                c.offer((prefix + 1) << (128 - to), below + b)
                if below <= c.goal < below + b:
                    if c.best > slack and n > 1 and to < 128:
                        c.prefix, c.below, c.open = prefix, below, True
                    break
                below += b
        bits = to
    edges, most = [], 0
    for c in cuts:
        most = max(most, c.edge)
        edges.append(most)
    return edges, total


def _signed(value: int, bits: int) -> int:
    return value - _WORD if bits == 64 and value >= 1 << 63 else value


def shard_of(cuts: list[int]) -> Column:
    """Number of cuts at or below a row's key."""

    def known(keys: list[int]) -> Column:
        rows = [{"g": (k >> 64) - (1 << 63), "d": k % _WORD - (1 << 63)} for k in keys]
        return F.from_json(F.lit(json.dumps(rows)), "array<struct<g:bigint,d:bigint>>")

    def reached(keys: Column) -> Column:
        g, d = unsigned(F.col("__g")), unsigned(F.col("__d"))
        return F.size(F.filter(keys, lambda c: (c["g"] < g) | ((c["g"] == g) & (c["d"] <= d))))

    inner = [c for c in cuts if c < 1 << 128]  # no row lies at or above the others
    if not inner:
        return F.lit(0)
    if len(inner) <= FAN:
        return reached(known(inner))
    group = F.greatest(F.lit(0), reached(known(inner[::FAN])) - 1)
    return group * FAN + reached(F.slice(known(inner), group * FAN + 1, F.lit(FAN)))


def histogram_shard(
    docs: DataFrame, shards: int, *, id_col: str = "doc_id", text_col: str = "text", size: Column | None = None, tolerance: float = 0.01, run_bytes: int = RUN_BYTES, broadcast_runs: int = BROADCAST_RUNS
) -> DataFrame:
    """``docs`` with ``shard`` (0 to ``shards - 1``) and ``slot`` (0, 1, ... in each shard).

    Every cut is within ``tolerance`` of a shard's mean size (UTF-8 bytes plus 1
    unless given), or at the nearest row where a row is larger than that; copies
    of a text that weigh less than twice the tolerance are never parted.  Slots
    follow the order of the texts' hashes, within a run too large for one task
    that of the ids' hashes first.  A null text is empty, a null id hashes like
    any value, rows that agree in id and text stay together, an empty table gives
    an empty result.  Columns named ``shard`` or ``slot`` are replaced, all others
    pass through.
    """
    size = F.coalesce(F.octet_length(docs[text_col]), F.lit(0)).cast("long") + 1 if size is None else size
    keyed = docs.drop("shard", "slot") if {"shard", "slot"} & set(docs.columns) else docs
    keyed = keyed.withColumns(
        {"__size": size, "__g": F.xxhash64(F.coalesce(docs[text_col], F.lit(""))), "__d": F.xxhash64(docs[id_col].cast("string"), F.lit("id"))}
    )
    digest = cut(keyed.select("__g", "__d", "__size"))
    cuts, total = find_cuts(digest, shards, tolerance)

    bits = max(0, total // run_bytes).bit_length()
    placed = {"__shard": shard_of(cuts), "__run": top_bits(F.col("__g"), bits)}
    runs = digest.withColumns(placed)
    # runs that copies of a text overfill are split by the ids' hash; of those there are fewer than runs
    hot = runs.groupBy("__shard", "__run").agg(F.sum("__size").alias("b")).where(F.col("b") > 2 * run_bytes).select(
        "__shard", "__run", F.ceil(F.log2(F.col("b") / run_bytes)).cast("int").alias("__more")
    )
    hot = _small(cut(hot), broadcast_runs)
    sub = F.when(F.col("__more").isNull(), F.lit(0).cast("long")).otherwise(F.expr("shiftrightunsigned(__d, 64 - __more)"))
    where = ["__shard", "__run", "__sub"]
    sized = runs.join(hot, ["__shard", "__run"], "left").select("__shard", "__run", sub.alias("__sub")).groupBy(*where).count()
    offsets = cut(sized.select(*where, (F.sum("count").over(Window.partitionBy("__shard").orderBy("__run", "__sub")) - F.col("count")).alias("__offset")))
    moved = keyed.withColumns(placed).join(hot, ["__shard", "__run"], "left").withColumn("__sub", sub)
    # the join's keys are the runs' own, so it needs no other exchange than they do
    moved = moved.join(_small(offsets, broadcast_runs), where, "left")
    order = Window.partitionBy(*where).orderBy("__g", "__d", docs[id_col])
    out = moved.withColumn("slot", F.col("__offset") + F.row_number().over(order) - 1)
    return out.select(*[c for c in docs.columns if c not in ("shard", "slot")], F.col("__shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))


def _small(df: DataFrame, most: int) -> DataFrame:
    """Broadcast if it has at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
