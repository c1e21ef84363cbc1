"""Byte n-gram counts in shards, and scoring texts by joins with them.

A window's shard follows from the last ``SHARED`` bytes of its context, so every
context of that length or longer lies in one shard with all its children and all
their suffixes; shorter contexts, at most ``256 ** SHARED`` grams, are summed over
the shards and broadcast.  A shard therefore scores a window alone, down all
levels, without a join a level.

What moves are packed arrays, never a row for each window: a counting task hands
on one row of sorted codes for each shard, and a scoring task one row of codes
and text numbers.  They meet in sorted order, a shard's counts before what asks
for them, so a task holds one shard's counts and one batch of requests.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngrams
from .common import cut

#: Bytes of context that decide a window's shard.
SHARED = 3
#: Distinct windows that a counting task holds, and windows to look up that a scoring task holds, before it hands them on.
FLUSH_GRAMS, FLUSH_REQUESTS = 1_500_000, 1_000_000
#: Texts, and bytes of them, whose sums are put together at a time.
FLUSH_TEXTS, FLUSH_BYTES = 8192, 1 << 25
#: Bytes of text whose requests one copy of a shard answers; beyond that a shard's counts are there in several copies.
PER_COPY = 1 << 24
#: Kinds of rows.
OWN, WINDOWS, WORDS = 10, 11, 12
TRIE, LOW, STEPS, FEW = 0, 1, 2, 3

_STREAM = ["flush", "shard", "kind", "asks", "a", "b", "c"]
_STREAM_TYPE = "flush long, shard int, kind int, asks int, a binary, b binary, c binary"
_TABLE = ["shard", "kind", "code", "n", "ways", "a", "b"]
_TABLE_TYPE = "shard int, kind int, code long, n long, ways long, a binary, b binary"


def pack(values: np.ndarray, ordered: bool = False) -> bytes:
    """An integer array as compressed bytes: differences if sorted, lowest bytes first."""
    values = np.ascontiguousarray(values)
    if ordered and len(values):
        values = np.concatenate([values[:1], np.diff(values)])
    planes = values.view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack(blob: bytes, dtype: Any, ordered: bool = False) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(blob), np.uint8)
    size = np.dtype(dtype).itemsize
    values = np.ascontiguousarray(flat.reshape(size, -1).T).reshape(-1).view(dtype)
    return np.cumsum(values, dtype=dtype) if ordered else values


def shard_count(size: int) -> int:
    """Shards for so many bytes of text: distinct windows grow slower than the text, and so do the shards."""
    return max(8, math.isqrt(max(0, size) >> 14))


def copies(size: int, shards: int) -> int:
    """Copies of each shard's counts that so many bytes of text need."""
    return max(1, -(-size // (shards * PER_COPY)))


def shard_of(codes: np.ndarray, order: int, shards: int) -> np.ndarray:
    context = (codes >> np.uint64(8)) & np.uint64((1 << 8 * min(SHARED, order)) - 1)
    return (((context * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def by_shard(codes: np.ndarray, order: int, shards: int, *others: np.ndarray) -> Iterator[tuple]:
    """(shard, codes, ...) with the codes of each shard sorted."""
    at = np.argsort(codes)
    at = at[np.argsort(shard_of(codes[at], order, shards), kind="stable")]
    codes = codes[at]
    which = shard_of(codes, order, shards)
    first = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]])) if len(which) else []
    for a, b in zip(first, [*first[1:], len(codes)], strict=True):
        yield int(which[a]), codes[a:b], *(x[at[a:b]] for x in others)


def suffix_levels(grams: np.ndarray, raw: np.ndarray, top: int, last: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(grams, counts, distinct bytes before) for contexts of ``top - 1`` down to ``last`` bytes, from the grams one longer."""
    out = []
    for k in range(top - 1, last - 1, -1):
        grams, inverse = np.unique(grams & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
        raw = np.bincount(inverse, raw, len(grams)).astype(np.int64)
        out.append((grams, raw, np.bincount(inverse, minlength=len(grams)).astype(np.int64)))
    return out


def step_of(counts: np.ndarray) -> np.ndarray:
    """Eighths of powers of two."""
    return np.floor(np.log2(counts) * 8).astype(np.int64)


def table_rows(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    kinds = {"shard": pa.int32(), "kind": pa.int32(), "code": pa.int64(), "n": pa.int64(), "ways": pa.int64(), "a": pa.binary(), "b": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[c]) if c in columns else pa.nulls(n, kinds[c]) for c in _TABLE], _TABLE)


def stream_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], _STREAM)


class GramSink:
    """Counts windows in a task; gives rows of sorted codes and counts by shard."""

    def __init__(self, order: int, shards: int):
        self.order, self.shards, self.counter = order, shards, ngrams.Counter(FLUSH_GRAMS)

    def add(self, texts: Iterable[bytes | None]) -> Iterator[pa.RecordBatch]:
        for codes, _ in ngrams.chunks(texts, self.order):
            if full := self.counter.add(codes):
                yield self._rows(*full)

    def rest(self) -> Iterator[pa.RecordBatch]:
        codes, counts = self.counter.take()
        if len(codes):
            yield self._rows(codes, counts)

    def _rows(self, codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        parts = [(s, pack(c, True), pack(n)) for s, c, n in by_shard(codes, self.order, self.shards, counts)]
        return table_rows(shard=[p[0] for p in parts], kind=[TRIE] * len(parts), a=[p[1] for p in parts], b=[p[2] for p in parts])


@dataclass
class Counts:
    """Counted windows: a table with a row a shard, the short levels, and what was noted of counts.

    ``low`` has (grams, counts, distinct bytes before) for contexts of 0, 1, ...
    bytes; ``few`` sums what ``note`` gave, ``steps`` the windows by size of count.
    """

    order: int
    shards: int
    table: DataFrame
    low: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    few: dict[int, int]
    steps: dict[int, int]

    def frequent_from(self, most: int) -> int:
        """A count that at most ``most`` windows reach, as small as the steps allow."""
        left, least = most, None
        for step in sorted(self.steps, reverse=True):
            if self.steps[step] > left:
                return least or 1 << 62
            left, least = left - self.steps[step], math.ceil(2 ** (step / 8) - 1e-9)
        return 1


def merge(parts: DataFrame, order: int, note: Callable[[np.ndarray, np.ndarray], dict[int, int]] | None = None) -> DataFrame:
    """One row a shard from the counting tasks' rows (kind TRIE), and what the other kinds of rows say."""
    low = min(SHARED, order)

    def give(shard: int, counter: ngrams.Counter) -> Iterator[pa.RecordBatch]:
        codes, counts = counter.take()
        yield table_rows(shard=[shard], kind=[TRIE], n=[len(codes)], a=[pack(codes, True)], b=[pack(counts)])
        steps, rows = np.unique(step_of(counts), return_counts=True)
        yield table_rows(shard=np.full(len(steps), shard), kind=np.full(len(steps), STEPS), code=steps, n=rows)
        if low:
            grams, raw, ways = suffix_levels(codes, counts, order, low - 1)[-1]
            yield table_rows(shard=np.full(len(grams), shard), kind=np.full(len(grams), LOW), code=grams.view(np.int64), n=raw, ways=ways)
        if note:
            few = note(codes, counts)
            yield table_rows(shard=[shard] * len(few), kind=[FEW] * len(few), code=list(few), n=list(few.values()))

    def run(batches):
        shard, counter = None, None
        for batch in batches:
            for at, a, b in zip(batch.column("shard").to_pylist(), batch.column("a"), batch.column("b"), strict=True):
                if at != shard:
                    if counter:
                        yield from give(shard, counter)
                    shard, counter = at, ngrams.Counter(1 << 62)
                counter.add_counts(unpack(a.as_py(), np.uint64, True), unpack(b.as_py(), np.int64))
        if counter:
            yield from give(shard, counter)

    return parts.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, _TABLE_TYPE)


def counted(parts: DataFrame, order: int, shards: int, note=None) -> Counts:
    """Merge and keep what counting tasks gave; the short levels and sums reach the driver."""
    merged = cut(merge(parts, order, note))
    sums = merged.where(F.col("kind").isin(STEPS, FEW)).groupBy("kind", "code").agg(F.sum("n")).collect()
    low: list = []
    if order:
        found = merged.where(F.col("kind") == LOW).groupBy("code").agg(F.sum("n").alias("n"), F.sum("ways").alias("ways")).toArrow()
        grams, raw, ways = (found.column(i).to_numpy() for i in range(3))
        at = np.argsort(grams)
        grams, raw, ways = grams[at].view(np.uint64), raw[at], ways[at]
        low = [(grams, raw, ways), *suffix_levels(grams, raw, min(SHARED, order) - 1, 0)][::-1]
    pick = lambda kind: {r[1]: r[2] for r in sums if r[0] == kind}
    return Counts(order, shards, merged.where(F.col("kind") == TRIE).select("shard", "n", "a", "b"), low, pick(FEW), pick(STEPS))


class Frequent:
    """The broadcast windows and their log probabilities; the table for lookups is built where texts are scored."""

    def __init__(self, codes: np.ndarray, logp: np.ndarray):
        self.codes, self.logp, self.table = codes, logp, None

    def __getstate__(self):
        return self.codes, self.logp

    def __setstate__(self, state):
        self.__init__(*state)

    def find(self, codes: np.ndarray) -> np.ndarray:
        if self.table is None:
            self.table = ngrams.CodeTable(self.codes)
        return self.table.find(codes)


def frequent(counts: Counts, most: int, model: Callable[[np.ndarray, np.ndarray], Any]) -> Frequent:
    """The most frequent windows, at most ``most``, with log probabilities from their shards' models."""
    least = counts.frequent_from(most)

    def run(batches):
        for batch in batches:
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                codes, n = unpack(a.as_py(), np.uint64, True), unpack(b.as_py(), np.int64)
                often = codes[n >= least]
                if len(often):
                    logp = model(codes, n).logp(often)
                    yield pa.RecordBatch.from_arrays([pa.array([pack(often, True)]), pa.array([logp.astype(np.float64).tobytes()])], ["a", "b"])

    found = counts.table.select("a", "b").mapInArrow(run, "a binary, b binary").toArrow()
    parts = [(unpack(a.as_py(), np.uint64, True), np.frombuffer(b.as_py())) for a, b in zip(found.column(0), found.column(1), strict=True)]
    return Frequent(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else Frequent(np.empty(0, np.uint64), np.empty(0))


class Asking:
    """Sums of a task's texts over broadcast windows; rows that ask shards for all others."""

    def __init__(self, often: Frequent, order: int, shards: int):
        self.often, self.order, self.shards = often, order, shards
        self.flush, self.texts, self.bytes = TaskContext.get().partitionId() << 32, 0, 0
        self.codes, self.rows, self.size = [], [], 0

    def add(self, texts: list[bytes | None]) -> tuple[np.ndarray, list[tuple]]:
        """Each text's sum over broadcast windows, and rows to hand on."""
        out, rows = np.zeros(len(texts)), []
        for codes, owners in ngrams.chunks(texts, self.order):
            number = np.repeat(np.array([i for i, _ in owners], np.uint32), [n for _, n in owners])
            place = self.often.find(codes)
            hit = place >= 0
            if len(self.often.logp):
                out += np.bincount(number[hit], self.often.logp[place[hit]], len(texts))
            if not hit.all():
                self.codes.append(codes[~hit])
                self.rows.append(number[~hit] + np.uint32(self.texts))
                self.size += len(self.codes[-1])
            if self.size >= FLUSH_REQUESTS:
                rows += self.ask()
        self.texts += len(texts)
        self.bytes += sum(len(t or b"") for t in texts)
        return out, rows

    def ask(self) -> list[tuple]:
        if not self.size:
            return []
        found = by_shard(np.concatenate(self.codes), self.order, self.shards, np.concatenate(self.rows))
        self.codes, self.rows, self.size = [], [], 0
        return [(self.flush, s, WINDOWS, 1, pack(codes, True), pack(rows), None) for s, codes, rows in found]

    @property
    def full(self) -> bool:
        return self.texts >= FLUSH_TEXTS or self.bytes >= FLUSH_BYTES

    def end(self, own: list[pa.RecordBatch]) -> list[tuple]:
        """All that is left of these texts, with their own rows; begins the next ones."""
        rows = self.ask()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, own[0].schema) as out:
            for batch in own:
                out.write_batch(batch)
        rows.append((self.flush, self.flush % 65_521, OWN, 1, zstandard.compress(sink.getvalue().to_pybytes(), 1), None, None))
        self.flush, self.texts, self.bytes = self.flush + 1, 0, 0
        return rows


def answered(stream: DataFrame, tables: list[DataFrame], model: Callable[[np.ndarray, np.ndarray], Any], words: Callable[[int], float] | None = None, several: int = 1) -> DataFrame:
    """Every asking row with its answer, own rows as they are.

    ``tables`` have (shard, kind, a, b): windows with counts, or words with
    counts, of which there are ``several`` copies.  ``words`` gives the value of a
    word's count.
    """
    stream = stream.withColumn("copy", F.pmod(F.xxhash64("flush"), F.lit(several)).cast("int"))
    for t in tables:
        copy = F.explode(F.sequence(F.lit(0), F.lit(several - 1))).alias("copy")
        stream = stream.unionByName(t.select(F.lit(None).cast("long").alias("flush"), "shard", "kind", F.lit(0).alias("asks"), "a", "b", F.lit(None).cast("binary").alias("c"), copy))

    def reply(row: dict, state: dict) -> tuple | None:
        kind, at = row["kind"], (row["shard"], row["kind"])
        if kind == OWN:
            return row["flush"], row["kind"], row["a"], None, None
        if kind == WINDOWS:
            if not row["asks"]:
                state.clear()
                state[at] = model(unpack(row["a"], np.uint64, True), unpack(row["b"], np.int64))
                return None
            if at not in state:
                state.clear()
                state[at] = model(np.empty(0, np.uint64), np.empty(0, np.int64))
            codes, number = unpack(row["a"], np.uint64, True), unpack(row["b"], np.uint32)
            first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            logp = np.repeat(state[at].logp(codes[first]), np.diff(np.append(first, len(codes))))
            rows, inverse = np.unique(number, return_inverse=True)
            return row["flush"], kind, pack(rows, True), np.bincount(inverse, logp, len(rows)).tobytes(), None
        names = zstandard.decompress(row["a"]).split(b" ")
        if not row["asks"]:
            state.clear()
            state[at] = dict(zip(names, unpack(row["b"], np.int64).tolist(), strict=True))
            return None
        if at not in state:
            state.clear()
            state[at] = {}
        count = state[at].get
        number, times = unpack(row["b"], np.uint32), unpack(row["c"], np.uint32)
        n = np.array([count(w, 0) for w in names], np.int64)
        distinct, back = np.unique(n, return_inverse=True)
        value = np.array([words(int(x)) for x in distinct])[back] * times
        rows, inverse = np.unique(number, return_inverse=True)
        known = np.bincount(inverse, np.where(n > 0, times, 0), len(rows)).astype(np.int64)
        return row["flush"], kind, pack(rows, True), np.bincount(inverse, value, len(rows)).tobytes(), pack(known)

    def run(batches):
        state: dict = {}
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                if done := reply({c: batch.column(c)[i].as_py() for c in _STREAM}, state):
                    out.append(done)
            if out:
                kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["flush", "kind", "a", "b", "c"])

    # a shard's counts come before the rows that ask for them
    return stream.repartition("shard", "copy").sortWithinPartitions("shard", "copy", "kind", "asks").mapInArrow(run, "flush long, kind int, a binary, b binary, c binary")


def summed(answers: DataFrame, finish: Callable[[pa.Table, dict[int, np.ndarray], np.ndarray], pa.Table], schema: str) -> DataFrame:
    """``finish(own rows, {kind: sums}, known words)`` of each group of texts, as rows of ``schema``."""

    def run(table: pa.Table) -> pa.Table:
        kinds, own = table.column("kind").to_pylist(), None
        for i, kind in enumerate(kinds):
            if kind == OWN:
                own = pa.ipc.open_stream(zstandard.decompress(table.column("a")[i].as_py())).read_all()
        sums, known = {k: np.zeros(own.num_rows) for k in (WINDOWS, WORDS)}, np.zeros(own.num_rows, np.int64)
        for i, kind in enumerate(kinds):
            if kind == OWN:
                continue
            rows = unpack(table.column("a")[i].as_py(), np.uint32, True)
            sums[kind][rows] += np.frombuffer(table.column("b")[i].as_py())
            if kind == WORDS:
                known[rows] += unpack(table.column("c")[i].as_py(), np.int64)
        return finish(own, sums, known)

    return answers.groupBy("flush").applyInArrow(run, schema)
