"""Benchmark decontamination with one Aho-Corasick automaton.

Texts and items become numbers of normalised words, a few letters each.  Every
window of an item holds one of the item's blocks, which are ``window // 3`` words
long and as far apart as that allows; the automaton's patterns are these blocks,
and whole items shorter than a window.  A text is scanned once.  Where a block is
found, the windows around it are looked up by a rolling hash and compared word by
word.  Matches are mapped back to words and, for texts that have any, to character
offsets of the original.

Blocks over word numbers take about one node a word of the benchmark, where all
windows over characters would take some hundred.  The benchmark travels to the
workers as a broadcast, whose size is checked first: beyond ``max_bytes`` of
benchmark text the items are split into several broadcasts below that size, each
scans the texts in a pass of its own, and the passes' spans are merged per
document.  A worker holds one automaton at a time.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Benchmark text that one automaton may hold; a worker takes about 30 times as much.
MAX_BYTES = 32 << 20

#: Word characters are 0-9, a-z and everything above 0x7F; the rest separates.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_ORIGINAL_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_SPAN = pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("item", pa.string())])
_RESULT = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(_SPAN))])
SCHEMA = "n_words long, spans array<struct<first_word:long,end_word:long,start:long,end:long,item:string>>"

#: Letters of one place of a word's number.  Each place has letters of its own, so no match begins inside a number.
_BASE = 64

_built: dict[str, Index] = {}


def words_of(text: str | bytes | None) -> list[bytes]:
    """Lower-cased words of a text; null has none."""
    if text is None:
        return []
    return (text.encode() if isinstance(text, str) else text).translate(_TABLE).split()


def _hashes(words: np.ndarray, window: int, odd: int) -> np.ndarray:
    """Hash of every ``window`` words."""
    n = max(0, len(words) - window + 1)
    out = np.zeros(n, np.uint64)
    for j in range(window):
        out = (out * np.uint64(odd)) ^ (words[j : j + n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        out ^= out >> np.uint64(29)
    return out


class Index:
    """The automaton of (item, text) pairs and the windows around its blocks."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window, self.block = window, max(1, window // 3)
        self.items, self.words = [], {}
        parts, patterns = [], {}  # pattern: [whether it is a block, items that are no longer]
        apart = window - self.block + 1
        for item, text in items:
            found = words_of(text)
            if not found:
                continue
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in found]
            self.items.append(item)
            parts.append(np.array(ids, np.int32))
            if len(ids) < window:
                patterns.setdefault(tuple(ids), [False, []])[1].append(len(self.items) - 1)
                continue
            for at in range(0, len(ids) - self.block + 1, apart):
                patterns.setdefault(tuple(ids[at : at + self.block]), [False, []])[0] = True
        self.stream = np.concatenate(parts) if parts else np.empty(0, np.int32)
        sizes = np.array([len(p) for p in parts], np.int64)
        begin = np.cumsum(sizes) - sizes
        # places of all whole windows, and their items
        many = np.maximum(0, sizes - window + 1)
        owner = np.repeat(np.arange(len(parts), dtype=np.int32), many)
        place = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(many.sum())
        self.odd = 0x100000001B3
        while True:
            every = _hashes(self.stream, window, self.odd)
            hashes = every[place] if len(place) else np.empty(0, np.uint64)
            order = np.lexsort((owner, hashes))
            self.hashes, self.place, self.owner = hashes[order], place[order], owner[order]
            same = np.flatnonzero(self.hashes[1:] == self.hashes[:-1])
            if all((self.stream[self.place[same] + j] == self.stream[self.place[same + 1] + j]).all() for j in range(window)):
                break
            self.odd += 2  # two windows share a hash: another one
        self.places, self.automaton = 1, None
        while _BASE**self.places <= len(self.words):
            self.places += 1
        spell = [self._letters(n) for n in range(len(self.words) + 1)]
        self.spelled = dict(zip(self.words, spell[1:], strict=True))
        self.unknown = spell[0]
        if patterns:
            self.automaton = ahocorasick.Automaton()
            for key, (block, short) in patterns.items():
                self.automaton.add_word("".join([spell[n] for n in key]), (len(key), block, sorted({self.items[i] for i in short})))
            self.automaton.make_automaton()

    def _letters(self, number: int) -> str:
        return "".join(chr(48 + place * _BASE + number // _BASE**place % _BASE) for place in range(self.places))

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[int, int, int, int, str]]]:
        """Number of words, and (first word, end word, start, end, item) of every occurrence of a window."""
        words = words_of(text)
        if not words or self.automaton is None:
            return len(words), []
        found, near = [], []
        for last, (size, block, short) in self.automaton.iter("".join(map(self.spelled.get, words, repeat(self.unknown)))):
            end = last // self.places + 1
            if block:
                near.append(end - size)
            found += [(end - size, end, item) for item in short]
        if near and len(words) >= self.window:
            array = np.fromiter(map(self.words.get, words, repeat(0)), np.int32, len(words))
            # windows that hold a found block
            reach = np.array(near)[:, None] - np.arange(self.window - self.block + 1)
            starts = np.unique(reach[(reach >= 0) & (reach <= len(words) - self.window)])
            hashes = _hashes(array, self.window, self.odd)[starts]
            at = np.searchsorted(self.hashes, hashes)
            to = np.searchsorted(self.hashes, hashes, "right")
            hit = np.flatnonzero(to > at)
            starts, at, to = starts[hit], at[hit], to[hit]
            equal = np.ones(len(starts), bool)
            for j in range(self.window):
                equal &= array[starts + j] == self.stream[self.place[at] + j]
            for s, a, b in zip(starts[equal].tolist(), at[equal].tolist(), to[equal].tolist(), strict=True):
                found += [(s, s + self.window, item) for item in dict.fromkeys(self.items[i] for i in self.owner[a:b])]
        if not found:
            return len(words), []
        offsets = [m.span() for m in _ORIGINAL_WORD.finditer(text.decode())]
        return len(words), [(a, b, offsets[a][0], offsets[b - 1][1], item) for a, b, item in found]


def _scanner(items_broadcast, window: int):
    key = uuid.uuid4().hex  # a worker builds the automaton once

    @F.arrow_udf(SCHEMA)
    def hits(texts: pa.Array) -> pa.Array:
        if key not in _built:
            _built.clear()
            _built[key] = Index(items_broadcast.value, window)
        index = _built[key]
        out = []
        for text in texts.cast(pa.binary()):
            n, spans = index.scan(text.as_py())
            out.append({"n_words": n, "spans": [dict(zip(("first_word", "end_word", "start", "end", "item"), s, strict=True)) for s in spans]})
        return pa.array(out, _RESULT)

    return hits


def _packs(benchmark: DataFrame, id_col: str, text_col: str, max_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """Benchmark items in packs below ``max_bytes``, read one after the other: the driver holds one."""
    items = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    pack: list[tuple[str, str]] = []
    used = 0
    for r in items.toLocalIterator():
        size = len(r["text"].encode())
        if pack and used + size > max_bytes:
            yield pack
            pack, used = [], 0
        pack.append((r["id"], r["text"]))
        used += size
    yield pack


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, max_bytes: int = MAX_BYTES
) -> DataFrame:
    """``docs`` with n_words, spans, n_hit, items, contaminated.

    ``spans`` lists every occurrence of a window: its words, its character
    offsets in the original text (end exclusive) and the item.  ``n_hit`` counts
    words inside any; ``items`` are the items' ids as strings, sorted.  A null
    text has no words; items with a null id or without words are no items;
    repeated items share their windows; empty tables give empty results, an empty
    benchmark leaves every text clean.  Existing columns of these names are
    replaced.
    """
    spark = docs.sparkSession
    plain = docs.drop("n_words", "spans", "n_hit", "items", "contaminated")
    out, passes = plain, 0
    for pack in _packs(benchmark, item_col, item_text_col, max_bytes):
        out = out.withColumn(f"__hits{passes}", _scanner(spark.sparkContext.broadcast(pack), window)(docs[text_col]))
        passes += 1
    spans = F.concat(*[F.col(f"__hits{i}.spans") for i in range(passes)])
    out = out.withColumns({"n_words": F.col("__hits0.n_words"), "spans": spans})
    return out.select(
        *[c for c in plain.columns], "n_words", "spans", covered(F.col("spans")).alias("n_hit"),
        F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["item"]))).alias("items"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def covered(spans: Column) -> Column:
    """Words inside the union of the spans: swept in order of their first words."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["first_word"].alias("a"), s["end_word"].alias("b"))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0).cast("long"), s["b"] - F.greatest(acc["to"], s["a"]))).alias("n"), F.greatest(acc["to"], s["b"]).alias("to")
    )
    return F.aggregate(ordered, zero, step, lambda acc: acc["n"])
