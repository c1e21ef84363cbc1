"""Language-model scoring by prediction by partial matching over byte contexts.

The trie of byte contexts up to ``ORDER`` is counted over all training texts.
A byte's probability is its count in the longest context that has been seen, or
an escape from there times its probability in the next shorter one, where the
bytes that the longer context could have given are excluded.  As a longer
context's bytes are a subset of the shorter one's, an exclusion is a difference
of two sums, so whole arrays of bytes are scored at once.

The escape mass of a context is its number of distinct bytes (method C).  Every
node of the trie takes part: the most frequent of the longest windows, at most
``max_nodes``, are broadcast with their probabilities, all others are looked up in
their shard (see :mod:`ngram_shards`), which escapes on its own as far as needed.

The word-level baseline of :func:`score` is exact: the most frequent words, at
most ``max_words``, are broadcast, all others are looked up in shards of words.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter as Words
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ngram_shards as shards
from . import ngrams
from .common import LOWER, cut

ORDER = 6
#: Windows and words that are broadcast at most; the others are looked up in shards.
MAX_NODES = 1_000_000
MAX_WORDS = 200_000
#: Bytes of the longest word that is broadcast.
LONGEST = 256
#: Distinct words that a counting task holds, and words to look up that a scoring task holds, before it hands them on.
FLUSH_WORDS = 500_000
#: Texts that a task works on at a time.
SLICE = 512


class Level:
    """Grams of one length with counts; their contexts with the sum and number of children and what those weigh one level down."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, k: int, short: Level | None):
        codes = codes.astype(np.uint64)
        contexts, inverse = np.unique(codes >> np.uint64(8), return_inverse=True)
        self.grams, self.contexts, self.counts = ngrams.CodeTable(codes), ngrams.CodeTable(contexts), counts.astype(float)
        self.kept = np.bincount(inverse, counts, len(contexts))
        self.children = np.bincount(inverse, minlength=len(contexts)).astype(float)
        # the mass to exclude there
        self.below = np.zeros(len(contexts))
        if short is not None:
            place = short.grams.find(codes & np.uint64((1 << 8 * k) - 1))
            self.below = np.bincount(inverse, short.counts[place], len(contexts))


def levels(low: list[tuple]) -> list[Level]:
    """Levels of the shortest contexts from (grams, counts, ...)."""
    out: list[Level] = []
    for k, (grams, counts, *_) in enumerate(low):
        out.append(Level(grams, counts, k, out[-1] if out else None))
    return out


class Trie:
    """PPM over windows with counts, and the short levels; without the latter they follow from the windows."""

    def __init__(self, order: int, codes: np.ndarray, counts: np.ndarray, low: list[Level] | None = None):
        self.order, self.levels = order, list(low or ())
        found = [(codes, counts), *[x[:2] for x in shards.suffix_levels(codes, counts, order, len(self.levels))]]
        for k, (grams, n) in zip(range(len(self.levels), order + 1), found[::-1], strict=True):
            self.levels.append(Level(grams, n, k, self.levels[-1] if self.levels else None))
        top = self.levels[-1]
        of = top.contexts.find(codes.astype(np.uint64) >> np.uint64(8))
        self.direct = np.log10(top.counts / (top.kept + top.children)[of]) if len(of) else np.empty(0)

    def logp(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of every window, given the bytes before it."""
        place = self.levels[-1].grams.find(codes)
        out = self.direct[place] if len(self.direct) else np.zeros(len(codes))
        missed = np.flatnonzero(place < 0)
        if len(missed):
            rare, inverse = np.unique(codes[missed], return_inverse=True)
            out[missed] = self._escaped(rare)[inverse]
        return out

    def _escaped(self, codes: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(codes)), np.arange(len(codes))
        gone_mass, gone_symbols = np.zeros(len(codes)), np.zeros(len(codes))
        for k in range(self.order, -1, -1):
            level = self.levels[k]
            if not len(left) or not len(level.kept):
                continue
            sub = codes & np.uint64((1 << 8 * (k + 1)) - 1)
            at = level.contexts.find(sub >> np.uint64(8))
            known = at >= 0
            mass = level.kept[at] - gone_mass
            escape = level.children[at] - gone_symbols
            gram = level.grams.find(sub)
            hit = known & (gram >= 0)
            out[left[hit]] += np.log10(level.counts[gram[hit]] / (mass[hit] + escape[hit]))
            go = known & ~hit & (escape > 0)
            out[left[go]] += np.log10(escape[go] / (mass[go] + escape[go]))
            gone_mass = np.where(known, level.below[at], gone_mass)[~hit]
            gone_symbols = np.where(known, level.children[at], gone_symbols)[~hit]
            codes, left = codes[~hit], left[~hit]
        out[left] -= np.log10(256 - gone_symbols)
        return out


def adaptive_code_length(text: bytes, order: int = ORDER) -> float:
    """Bits of a text under PPM that starts empty and learns from the text itself, with exclusion, method C."""
    seen: dict[bytes, dict[int, int]] = {}
    bits, past = 0.0, bytes([ngrams.PAD]) * order
    for symbol in [*text, ngrams.END]:
        excluded: set[int] = set()
        contexts = [past[order - k :] for k in range(order, -1, -1)]
        for ctx in contexts:
            here = {s: c for s, c in seen.get(ctx, {}).items() if s not in excluded}
            if not here:
                continue
            whole = sum(here.values()) + len(here)
            if symbol in here:
                bits -= math.log2(here[symbol] / whole)
                break
            bits -= math.log2(len(here) / whole)
            excluded |= here.keys()
        else:
            bits += math.log2(256 - len(excluded))
        for ctx in contexts:
            children = seen.setdefault(ctx, {})
            children[symbol] = children.get(symbol, 0) + 1
        past = (past + bytes([symbol]))[len(past) + 1 - order :] if order else b""
    return bits


def normal(text: bytes | None) -> list[bytes]:
    """Lower-cased words."""
    return text.translate(LOWER).split() if text else []


def _word_rows(words: dict[bytes, int], parts: int) -> pa.RecordBatch:
    """Rows (shard, words, counts) of kind WORDS."""
    at: dict[int, list[bytes]] = {}
    for w in words:
        at.setdefault(zlib.crc32(w) % parts, []).append(w)
    rows = [(s, zstandard.compress(b" ".join(ws), 1), shards.pack(np.array([words[w] for w in ws], np.int64))) for s, ws in at.items()]
    return shards.table_rows(shard=[r[0] for r in rows], kind=[shards.WORDS] * len(rows), a=[r[1] for r in rows], b=[r[2] for r in rows])


def _corpus_counts(training: DataFrame, order: int, parts: int) -> DataFrame:
    """Rows of windows (kind TRIE) and of words (kind WORDS) with counts, by shard, in one scan; "" is the end of a text."""

    def run(batches):
        words, grams = Words(), shards.GramSink(order, parts)
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            texts = []
            for t in batch.column(0).cast(pa.binary()):
                found = normal(t.as_py())
                words.update(found)
                words[b""] += 1
                texts.append(b" ".join(found))
                if len(words) > FLUSH_WORDS:
                    yield _word_rows(words, parts)
                    words.clear()
            yield from grams.add(texts)
        if words:
            yield _word_rows(words, parts)
        yield from grams.rest()

    return training.mapInArrow(run, shards._TABLE_TYPE)


def _words(parts: DataFrame) -> DataFrame:
    """One row a shard of words: (shard, n, ways, a, b) with ``n`` tokens and ``ways`` words, and rows of kind STEPS."""

    def give(shard: int, words: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
        names, counts = list(words), np.array(list(words.values()), np.int64)
        yield shards.table_rows(shard=[shard], kind=[shards.WORDS], n=[int(counts.sum())], ways=[len(names)], a=[zstandard.compress(b" ".join(names), 1)], b=[shards.pack(counts)])
        steps, rows = np.unique(shards.step_of(counts), return_counts=True)
        yield shards.table_rows(shard=np.full(len(steps), shard), kind=np.full(len(steps), shards.STEPS), code=steps, n=rows)

    def run(batches):
        shard, words = None, Words()
        for batch in batches:
            for at, a, b in zip(batch.column("shard").to_pylist(), batch.column("a"), batch.column("b"), strict=True):
                if at != shard and words:
                    yield from give(shard, words)
                    words = Words()
                shard = at
                for w, n in zip(zstandard.decompress(a.as_py()).split(b" "), shards.unpack(b.as_py(), np.int64).tolist(), strict=True):
                    words[w] += n
        if words:
            yield from give(shard, words)

    return parts.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, shards._TABLE_TYPE)


def _frequent_words(table: DataFrame, least: int) -> dict[bytes, int]:
    """Words with at least ``least`` occurrences, but for very long ones, which are looked up."""

    def run(batches):
        for batch in batches:
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                counts = shards.unpack(b.as_py(), np.int64)
                often = np.flatnonzero(counts >= least)
                names = zstandard.decompress(a.as_py()).split(b" ") if len(often) else []
                often = [i for i in often.tolist() if len(names[i]) <= LONGEST]
                if often:
                    yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in often], pa.binary()), pa.array(counts[often])], ["w", "n"])

    found = table.select("a", "b").mapInArrow(run, "w binary, n long").toArrow()
    return dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True))


def _asking_rows(docs: DataFrame, order: int, parts: int, shared) -> DataFrame:
    """Each group of texts with its broadcast sums, and rows that ask shards for its rare windows and words."""

    def run(batches):
        often_words, often = shared.value
        asking, own = shards.Asking(often, order, parts), []
        names, rows, times = [], [], []

        def ask_words():
            at: dict[int, list[int]] = {}
            for i, w in enumerate(names):
                at.setdefault(zlib.crc32(w) % parts, []).append(i)
            number, often_ = np.array(rows, np.uint32), np.array(times, np.uint32)
            out = [(asking.flush, s, shards.WORDS, 1, zstandard.compress(b" ".join([names[i] for i in which]), 1), shards.pack(number[which]), shards.pack(often_[which])) for s, which in at.items()]
            names.clear(), rows.clear(), times.clear()
            return out

        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            n, out = batch.num_rows, []
            tokens, known, base, flat = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), []
            for i, t in enumerate(batch.column(1).cast(pa.binary())):
                words = normal(t.as_py())
                flat.append(b" ".join(words))
                counts = Words(words)
                counts[b""] = 1
                tokens[i] = len(words) + 1
                total = 0.0
                for w, many in counts.items():
                    if c := often_words.get(w):
                        known[i] += many
                        total += many * c
                    else:
                        names.append(w)
                        rows.append(asking.texts + i)
                        times.append(many)
                base[i] = total
            score, found = asking.add(flat)
            out += found
            if len(names) >= FLUSH_WORDS:
                out += ask_words()
            own.append(pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens), pa.array(known), pa.array(base), pa.array(score)], ["doc_id", "n_tokens", "n_known", "base_score", "score"]))
            if asking.full:
                out += ask_words() if names else []
                out += asking.end(own)
                own = []
            if out:
                yield shards.stream_rows(out)
        if own:
            yield shards.stream_rows([*(ask_words() if names else []), *asking.end(own)])

    return docs.mapInArrow(run, shards._STREAM_TYPE)


def score(docs: DataFrame, training: Column, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, max_nodes: int = MAX_NODES, max_words: int = MAX_WORDS) -> DataFrame:
    """One row a document: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    ``training`` says which rows of ``docs`` are learned from.  Texts are
    lower-cased (A-Z) and split into words; the model's text is the words joined
    by blanks and an end.  A null text is empty: its one token is the end.  Ids
    of any type and null ones pass through; repeated rows come back as often as
    they are there; without training rows every word is unknown and every byte
    uniform; an empty table gives an empty result.  Other columns take no part.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col], F.lit(""))
    learned = docs.where(training).select(text.alias("text"))
    size, every = docs.agg(F.sum(F.when(training, F.octet_length(text))), F.sum(F.octet_length(text))).first()
    parts = shards.shard_count(size or 0)
    given = cut(_corpus_counts(learned, order, parts))
    grams = shards.counted(given.where(F.col("kind") == shards.TRIE), order, parts)
    words = cut(_words(given.where(F.col("kind") == shards.WORDS)))
    totals = words.groupBy("kind", F.when(F.col("kind") == shards.STEPS, F.col("code")).alias("code")).agg(F.sum("n"), F.sum("ways")).collect()
    total, distinct = next(((r[2], r[3]) for r in totals if r["kind"] == shards.WORDS), (0, 0))
    word_table = words.where(F.col("kind") == shards.WORDS)
    steps = shards.Counts(order, parts, word_table, [], {}, {r["code"]: r[2] for r in totals if r["kind"] == shards.STEPS})
    denominator = math.log10(total + 0.5 * (distinct + 1))
    often_words = {w: math.log10(c + 0.5) - denominator for w, c in _frequent_words(word_table, steps.frequent_from(max_words)).items()}
    low = spark.sparkContext.broadcast(grams.low)
    built: list[list[Level]] = []

    def model(codes: np.ndarray, counts: np.ndarray) -> Trie:
        if not built:
            built.append(levels(low.value))
        return Trie(order, codes, counts, built[0])

    shared = spark.sparkContext.broadcast((often_words, shards.frequent(grams, max_nodes, model)))
    stream = _asking_rows(docs.select(docs[id_col].alias("doc_id"), text.alias("text")), order, parts, shared)
    tables = [grams.table.withColumn("kind", F.lit(shards.WINDOWS)), word_table]
    answers = shards.answered(stream, tables, model, lambda c: math.log10(c + 0.5) - denominator, shards.copies(every or 0, parts))

    def finish(own: pa.Table, sums: dict[int, np.ndarray], known: np.ndarray) -> pa.Table:
        plus = lambda name, x: pa.array(own.column(name).to_numpy() + x)
        return pa.table({
            "doc_id": own.column("doc_id"), "n_tokens": own.column("n_tokens"), "n_known": plus("n_known", known), "train_tokens": pa.array(np.full(own.num_rows, total or 0)),
            "base_score": plus("base_score", sums[shards.WORDS]), "score": plus("score", sums[shards.WINDOWS]),
        })

    kind = docs.schema[id_col].dataType.simpleString()
    return shards.summed(answers, finish, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
