"""Quality classifier: interpolated modified Kneser-Ney over byte n-grams of trusted text.

Counts of trusted texts are summed in shards by context (see :mod:`ngram_shards`).
A shard has all that a window's continuation counts, totals and interpolation
weights need; discounts come from the counts of counts of all shards.  Documents'
windows are joined with the shards' counts, which gives each document's
perplexity; it is compared with a quantile of held-out trusted texts of its
language.

All trusted texts give counts and thresholds, and all their n-grams are kept.
The ids' hash deals them to two halves with a model each: a trusted text is
scored by the half that it is not in, any other text by the model of both.  The
most frequent windows, at most ``max_grams``, are broadcast with their
probabilities and need no join.
"""

from __future__ import annotations

import gc
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ngram_shards as shards
from . import ngrams
from .common import cut, free

ORDER = 6
#: Where a caller asks for a sample: how many texts of each language at least, but no more than half, give the counts.
OF_LANGUAGE = 200
#: Trusted ids that are broadcast at most; more meet the texts by a shuffle.
BROADCAST_TRUSTED = 400_000
#: Windows that are broadcast at most; the others are looked up in shards.
MAX_GRAMS = 2_000_000
#: A text of a language is rejected above this quantile of trusted perplexities, widened by MARGIN in log space.
QUANTILE, MARGIN = 0.99, 0.1
#: A quantile's rank is right to one part in so many.
RANKS = 100_000
#: Held-out trusted texts a language needs for thresholds of its own; with fewer, those of all languages hold.
OWN_LANGUAGE = 40
#: Bytes of average text that every perplexity is smoothed with: a few words tell little about quality.
SMOOTHING = 120
#: Texts that a task works on at a time.
SLICE = 512


def adjusted(level: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams and their counts: distinct bytes before them, or occurrences where a pad, which nothing precedes, comes first."""
    grams, raw, ways = level
    return grams, np.where((grams >> np.uint64(8 * k)) & np.uint64(255) == ngrams.PAD, raw, ways)


def shard_levels(codes: np.ndarray, counts: np.ndarray, order: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(k, grams, counts) of a shard's windows, for contexts from ``SHARED`` bytes to ``order``; the longest keep their occurrences."""
    least = min(shards.SHARED, order)
    shorter = zip(range(order - 1, least - 1, -1), shards.suffix_levels(codes, counts, order, least), strict=True)
    return [*[(k, *adjusted(level, k)) for k, level in shorter][::-1], (order, codes, counts)]


def few(order: int):
    """Counts of counts 1 to 4 of a shard, by 8 * k + count."""

    def note(codes: np.ndarray, counts: np.ndarray) -> dict[int, int]:
        return {8 * k + i: int((n == i).sum()) for k, _, n in shard_levels(codes, counts, order) for i in (1, 2, 3, 4)}

    return note


class Level:
    """Discounted probabilities of grams and interpolation weights of their contexts."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, cut_off: tuple[float, float, float]):
        contexts, inverse = np.unique(grams >> np.uint64(8), return_inverse=True)
        cost = np.where(n == 1, cut_off[0], np.where(n == 2, cut_off[1], cut_off[2]))
        total = np.bincount(inverse, n, len(contexts))
        self.grams, self.contexts = ngrams.CodeTable(grams), ngrams.CodeTable(contexts)
        self.own = np.maximum(n - cost, 0) / total[inverse]
        self.weight = np.bincount(inverse, cost, len(contexts)) / total


class KneserNey:
    """Modified Kneser-Ney over k = 0 to order bytes of context; unseen bytes are uniform."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def logp(self, codes: np.ndarray) -> np.ndarray:
        """Natural log probability of the last byte of every window."""
        p = np.full(len(codes), 1 / 256)
        for k, level in enumerate(self.levels):
            sub = codes & np.uint64((1 << 8 * (k + 1)) - 1)
            at, gram = level.contexts.find(sub >> np.uint64(8)), level.grams.find(sub)
            if len(level.own):
                p = np.where(at >= 0, level.weight[at] * p, p) + np.where(gram >= 0, level.own[gram], 0.0)
        return np.log(p)


@dataclass(frozen=True)
class Model:
    """Counts in shards, discounts by length of context, and the broadcast windows."""

    counts: shards.Counts
    discounts: list[tuple[float, float, float]]
    often: shards.Frequent

    def of_shard(self):
        """Gives the model of a shard's windows; what it holds of the corpus is a broadcast."""
        return _of_shard(self.counts, self.discounts)


def _of_shard(counts: shards.Counts, cut_off: list):
    shared, order = counts.table.sparkSession.sparkContext.broadcast(counts.low), counts.order
    low: list[Level] = []

    def model(codes: np.ndarray, n: np.ndarray) -> KneserNey:
        if not low:
            low.extend(Level(*adjusted(level, k), cut_off[k]) for k, level in enumerate(shared.value))
        return KneserNey([*low, *[Level(grams, m, cut_off[k]) for k, grams, m in shard_levels(codes, n, order)]])

    return model


@dataclass(frozen=True)
class Models:
    """Counts of all counted texts, those of the two halves (none with a sample), and the trusted ids, counted in the first half or not.

    A model's broadcast windows are there only while it scores.
    """

    full: shards.Counts
    halves: tuple[shards.Counts, shards.Counts] | None
    trusted: DataFrame

    def held(self) -> DataFrame:
        """Trusted ids whose texts are scored by a model that has not counted them."""
        return self.trusted if self.halves else self.trusted.where(~F.col("__counted"))


@dataclass(frozen=True)
class Classifier:
    """Models, the mean negative log probability a byte of held-out texts, and the largest accepted log perplexity by language."""

    models: Models
    mean: float
    by_language: dict[str, float]
    otherwise: float


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and above, from the counts of counts; 1/2, 1 and 3/2 where those are missing."""
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.05), i - 0.05) for i, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


def train(texts: DataFrame, *, order: int = ORDER, max_grams: int = MAX_GRAMS) -> Model:
    """Fit on the one text column."""
    return _model(_counts(texts, order, shards.shard_count(texts.agg(F.sum(F.octet_length(texts.columns[0]))).first()[0] or 0)), max_grams)


def _counts(texts: DataFrame, order: int, parts: int) -> shards.Counts:
    def run(batches):
        grams = shards.GramSink(order, parts)
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            yield from grams.add([t.as_py() for t in batch.column(0).cast(pa.binary())])
        yield from grams.rest()

    return shards.counted(texts.mapInArrow(run, shards._TABLE_TYPE), order, parts, few(order))


def _model(counts: shards.Counts, max_grams: int) -> Model:
    order, n = counts.order, dict(counts.few)
    for k, level in enumerate(counts.low):
        times = adjusted(level, k)[1]
        n |= {8 * k + i: int((times == i).sum()) for i in (1, 2, 3, 4)}
    cut_off = [discounts(*(n.get(8 * k + i, 0) for i in (1, 2, 3, 4))) for k in range(order + 1)]
    return Model(counts, cut_off, shards.frequent(counts, max_grams, _of_shard(counts, cut_off)))


def score(docs: DataFrame, model: Model, *, text_col: str = "text", size: int | None = None) -> DataFrame:
    """``docs`` without the text and with ``__nll`` and ``__bytes``: the negative log probability of a text and its end, and their bytes.

    ``size`` is the texts' number of bytes, where it is known.
    """
    carried = [c for c in docs.columns if c != text_col]
    order, parts = model.counts.order, model.counts.shards
    shared = docs.sparkSession.sparkContext.broadcast(model.often)
    if size is None:
        size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    several = shards.copies(size, parts)

    def run(batches):
        gc.collect()  # windows of a model that this process has scored with before
        asking, own = shards.Asking(shared.value, order, parts), []
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            texts = [t.as_py() for t in batch.column(len(carried)).cast(pa.binary())]
            sums, out = asking.add(texts)
            size = pa.array([len(t or b"") + 1 for t in texts], pa.int64())
            own.append(pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(-sums), size], [*carried, "__nll", "__bytes"]))
            if asking.full:
                out += asking.end(own)
                own = []
            if out:
                yield shards.stream_rows(out)
        if own:
            yield shards.stream_rows(asking.end(own))

    def finish(own: pa.Table, sums: dict[int, np.ndarray], known: np.ndarray) -> pa.Table:
        return own.set_column(len(carried), "__nll", pa.array(own.column("__nll").to_numpy() - sums[shards.WINDOWS]))

    stream = docs.select(*carried, text_col).mapInArrow(run, shards._STREAM_TYPE)
    answers = shards.answered(stream, [model.counts.table.withColumn("kind", F.lit(shards.WINDOWS))], model.of_shard(), several=several)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text_col)
    return shards.summed(answers, finish, f"{kinds}, __nll double, __bytes long")


def _keyed(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Rows with the same key have the same text and language; a null id stays null."""
    return docs.select(docs[id_col].alias("__id"), docs[lang_col].alias("__lang"), F.xxhash64(docs[text_col]).alias("__hash"), docs[text_col].alias("__text"))


def _trusted(rows: DataFrame, trusted: DataFrame, id_col: str, sample: int | None) -> DataFrame:
    """(member, language, counted) of the trusted ids with a text: in the first half or not; with a sample, counted ones give the counts, the others the thresholds."""
    ids = trusted.select(trusted[id_col].alias("__member")).where(F.col("__member").isNotNull()).distinct()
    members = cut(rows.where(F.col("__text").isNotNull()).select("__id", "__lang").join(ids, F.col("__id") == F.col("__member")).select("__member", "__lang").distinct())
    draw = F.pmod(F.xxhash64("__member", F.lit("trusted")), F.lit(1 << 20)) / float(1 << 20)
    if sample is None:
        return members.select("__member", F.col("__lang").alias("__of"), (draw < 0.5).alias("__counted"))
    sizes = members.groupBy("__lang").agg(F.count(F.lit(1)).alias("__n"))
    total = sizes.agg(F.sum("__n")).first()[0] or 0
    share = F.least(F.lit(0.5), F.greatest(F.lit(sample / max(1, total)), OF_LANGUAGE / F.col("__n")))
    # a row a language
    drawn = members.join(sizes.select(F.col("__lang").alias("__of"), share.alias("__share")), F.col("__lang").eqNullSafe(F.col("__of")))
    return cut(drawn.select("__member", F.col("__lang").alias("__of"), (draw < F.col("__share")).alias("__counted")))


def _is_member() -> Column:
    return (F.col("__id") == F.col("__member")) & F.col("__lang").eqNullSafe(F.col("__of"))


def _marked(rows: DataFrame, trusted: DataFrame, how: str) -> tuple[DataFrame, dict[bool | None, int]]:
    """``rows`` with __counted of the trusted ids, and the bytes of text by it; shuffled and kept where the ids are too many to broadcast."""
    some = trusted.limit(BROADCAST_TRUSTED + 1).count() <= BROADCAST_TRUSTED
    flagged = lambda r: r.join(F.broadcast(trusted) if some else trusted, _is_member(), how).select(*r.columns, "__counted")
    sizes = flagged(rows.select("__id", "__lang", F.octet_length("__text").alias("__size"))).groupBy("__counted").agg(F.sum("__size")).collect()
    found = flagged(rows) if some else cut(flagged(rows))
    free(rows.sparkSession)
    return found, {r[0]: r[1] or 0 for r in sizes}


def _fit_models(rows: DataFrame, drawn: DataFrame, order: int, sample: int | None) -> Models:
    texts, sizes = _marked(rows.where(F.col("__text").isNotNull()), drawn, "inner")
    if sample is not None:
        return Models(_counts(cut(texts.where("__counted").select("__text")), order, shards.shard_count(sizes.get(True, 0))), None, drawn)
    parts = shards.shard_count(sum(sizes.values()))
    one, other = (_counts(texts.where(F.col("__counted") == half).select("__text"), order, parts) for half in (True, False))
    free(rows.sparkSession)
    both = shards.counted(one.table.unionByName(other.table), order, parts, few(order))
    free(rows.sparkSession)
    return Models(both, (one, other), drawn)


def _scored(rows: DataFrame, models: Models) -> DataFrame:
    """:func:`score` of ``rows``: trusted texts by the half that they are not in, others by the model of all."""
    if not models.halves:
        return cut(score(rows, _model(models.full, MAX_GRAMS), text_col="__text"))
    flagged, sizes = _marked(rows, models.trusted, "left")
    out = None
    for half, counts, most in ((True, models.halves[1], MAX_GRAMS // 2), (False, models.halves[0], MAX_GRAMS // 2), (None, models.full, MAX_GRAMS)):
        if half in sizes or (half is None and out is None):
            part = flagged.where(F.col("__counted").eqNullSafe(F.lit(half))).drop("__counted")
            done = cut(score(part, _model(counts, most), text_col="__text", size=sizes.get(half, 0)))
            out = done if out is None else out.unionByName(done)
            # what one part has shuffled goes before the next
            free(rows.sparkSession)
    return out


def _thresholds(models: Models, held: DataFrame, quantile: float, margin: float) -> Classifier:
    """From (__lang, __nll, __bytes) of held-out trusted texts."""
    mean = held.agg(F.sum("__nll") / F.sum("__bytes")).first()[0]
    if mean is None:
        return Classifier(models, 0.0, {}, math.inf)
    # summaries that tasks merge: no task holds a language's values
    level = F.percentile_approx(_smooth(mean), quantile, RANKS).alias("level")
    by = held.where(F.col("__lang").isNotNull()).groupBy("__lang").agg(F.count(F.lit(1)).alias("n"), level).where(F.col("n") >= OWN_LANGUAGE).collect()
    return Classifier(models, mean, {r["__lang"]: r["level"] + margin for r in by}, held.agg(level).first()[0] + margin)


def _smooth(mean: float) -> Column:
    return (F.col("__nll") + SMOOTHING * mean) / (F.col("__bytes") + SMOOTHING)


def _decided(scored: DataFrame, classifier: Classifier) -> DataFrame:
    limit = F.lit(classifier.otherwise)
    for language, level in sorted(classifier.by_language.items()):
        limit = F.when(F.col("__lang") == language, F.lit(level)).otherwise(limit)
    smooth = _smooth(classifier.mean)
    return scored.select("__id", "__lang", "__hash", smooth.alias("log_perplexity"), limit.alias("threshold"), (smooth <= limit).alias("accepted"))


def fit(
    docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int | None = None, order: int = ORDER,
    quantile: float = QUANTILE, margin: float = MARGIN,
) -> Classifier:
    """Fit on the rows of ``docs`` whose ids ``trusted`` (one id column) lists.

    All trusted texts give counts, and all give thresholds by what the half of
    them that a text is not in says of it.  With ``sample``, about so many texts,
    drawn by the hash of their ids, give the counts, more where a language would
    have fewer than ``OF_LANGUAGE``; all others give the thresholds.  Repeated and
    null ids count once and never.  Without trusted texts every text is accepted.
    """
    rows = _keyed(docs, id_col, text_col, lang_col)
    models = _fit_models(rows, _trusted(rows, trusted, id_col, sample), order, sample)
    held = rows.where(F.col("__text").isNotNull()).join(models.held(), _is_member()).select("__id", "__lang", "__text")
    return _thresholds(models, _scored(held, models), quantile, margin)


def judge(
    docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int | None = None, order: int = ORDER,
    quantile: float = QUANTILE, margin: float = MARGIN,
) -> DataFrame:
    """:func:`fit` and :func:`classify` on the same documents, each scored once.

    One row a document: __id, __lang, __hash (of the text), log_perplexity,
    threshold, accepted.
    """
    rows = _keyed(docs, id_col, text_col, lang_col)
    models = _fit_models(rows, _trusted(rows, trusted, id_col, sample), order, sample)
    scored = _scored(rows.withColumn("__some", F.col("__text").isNotNull()), models)
    held = scored.where("__some").join(models.held(), _is_member())
    return _decided(scored, _thresholds(models, held, quantile, margin))


def marked(docs: DataFrame, decisions: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with log_perplexity, threshold and accepted from :func:`judge`'s rows; existing columns of these names are replaced."""
    made = ["log_perplexity", "threshold", "accepted"]
    # equal rows agree in what is decided
    once = decisions.groupBy("__id", "__lang", "__hash").agg(*[F.min(c).alias(f"__{c}") for c in made])
    plain = docs.drop(*made)
    same = docs[id_col].eqNullSafe(F.col("__id")) & docs[lang_col].eqNullSafe(F.col("__lang")) & (F.xxhash64(docs[text_col]) == F.col("__hash"))
    return plain.join(once, same).select(*[plain[c] for c in plain.columns], *[F.col(f"__{c}").alias(c) for c in made])


def classify(docs: DataFrame, classifier: Classifier, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with log_perplexity, threshold and accepted.

    Log perplexities are a byte's, smoothed toward the mean of trusted text so
    that short texts are not judged by a few bytes; empty and null texts sit at
    about that mean and are accepted.  A null or rare language uses the threshold
    of all languages.  Existing columns of these names are replaced.
    """
    rows = _keyed(docs, id_col, text_col, lang_col)
    return marked(docs, _decided(_scored(rows, classifier.models), classifier), id_col=id_col, text_col=text_col, lang_col=lang_col)
