"""Toxic passages as maximum-scoring segments, calibrated by extreme-value statistics.

Token scores are log-odds between toxic and other labelled texts under an
informative Dirichlet prior; only tokens whose log-odds differ from zero
significantly keep a score of their own, all others share the pooled (negative)
one.  A linear-time scan finds every maximal scoring segment of a text.  The best
segment's score S in n words is judged as a local-alignment score would be: with
lambda from the background distribution of token scores, K from unlabelled-toxic
training texts, E = K n exp(-lambda S) segments of that score are expected by
chance.  A logistic fit on the training labels turns lambda S - ln(1 + K n) into a
probability.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Labelled texts that the model is fitted on at most (in expectation; drawn by the hash of the id).
SAMPLE = 20_000
#: Mass of the prior as a share of all counts, the z-score a token needs, and the extra cost of a neutral word.
PRIOR_SHARE, MIN_Z, DRIFT = 0.05, 3.3, 0.1
#: Chance hits a document that a reported passage may have.
MAX_E = 0.01

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Model:
    """Everything a worker needs: token scores, the neutral score, lambda, K and the logistic fit."""

    scores: dict[bytes, float]
    neutral: float
    lam: float
    k: float
    slope: float
    intercept: float

    def evidence(self, best: float, n: int) -> float:
        """lambda S - ln(1 + K n), 0 at least."""
        return max(0.0, self.lam * best - math.log1p(self.k * n)) if best > 0 else 0.0

    def probability(self, best: float, n: int) -> float:
        return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, self.intercept + self.slope * self.evidence(best, n)))))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def segments(hits: list[tuple[int, float]], neutral: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, end word, score) of a sequence.

    ``hits`` are (position, score) of the words with a score of their own; every
    other word scores ``neutral`` <= 0.  Linear in ``hits``: a segment keeps a
    link to the last one that starts from a lower running sum, so no pair of
    segments is looked at twice.
    """
    kept: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum at end, link
    total, at = 0.0, 0
    for position, score in hits:
        total += neutral * (position - at)
        at = position + 1
        if score <= 0:
            total += score
            continue
        first, left, right = position, total, total + score
        total = right
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= left:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= right:
                kept.append((first, position + 1, left, right, j))
                break
            first, left = kept[j][0], kept[j][2]
            link = kept[j][4]
            del kept[j:]
            j = link
    return [(a, b, r - l) for a, b, l, r, _ in kept]


def passages(words: list[bytes], model: Model) -> list[tuple[int, int, float]]:
    scores = model.scores
    hits = [(i, scores[w]) for i, w in enumerate(words) if w in scores]
    return segments(hits, model.neutral) if any(s > 0 for _, s in hits) else []


def _token_counts(sample: DataFrame) -> DataFrame:
    """(token, toxic, n, docs) of the labelled sample; every batch is summed before the shuffle."""

    def count(batches):
        for batch in batches:
            seen: dict[tuple[bytes, int], list[int]] = {}
            for text, toxic in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), strict=True):
                words = words_of(text.as_py())
                for w in set(words):
                    seen.setdefault((w, toxic), [0])[0] += 1
            keys = list(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.binary()), pa.array([k[1] for k in keys], pa.int32()), pa.array([seen[k][0] for k in keys], pa.int64())], ["token", "toxic", "n"]
            )

    return sample.select("text", "toxic").mapInArrow(count, "token binary, toxic int, n long").groupBy("token").agg(
        F.coalesce(F.sum(F.when(F.col("toxic") == 1, F.col("n"))), F.lit(0)).alias("bad"),
        F.coalesce(F.sum(F.when(F.col("toxic") == 0, F.col("n"))), F.lit(0)).alias("good"),
    )


def log_odds(counts: DataFrame, min_z: float, prior_share: float) -> DataFrame:
    """(token, bad, good, score, z) of the tokens whose log-odds are significant.

    The prior of a token is ``prior_share`` of its own counts in both kinds of texts.  A
    significant token needs about min_z squared occurrences, so there are at most
    (tokens in the sample) / min_z**2 of them: that bounds the broadcast.
    """
    sums = counts.agg(F.sum("bad").alias("__bad"), F.sum("good").alias("__good"))
    x = counts.join(F.broadcast(sums))  # one row of totals
    alpha, mass = prior_share * (F.col("bad") + F.col("good")), prior_share * (F.col("__bad") + F.col("__good"))
    one = lambda y, total: F.log((y + alpha) / (total + mass - y - alpha))
    score = one(F.col("bad"), F.col("__bad")) - one(F.col("good"), F.col("__good"))
    z = score / F.sqrt(1 / (F.col("bad") + alpha) + 1 / (F.col("good") + alpha))
    return x.select("token", "bad", "good", score.alias("score"), z.alias("z"), "__bad", "__good").where(F.abs("z") >= min_z)


def _decay(freqs: np.ndarray, scores: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1; 1 if the scores have none."""
    if not (scores > 0).any() or (freqs * scores).sum() >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    while (freqs * np.exp(np.minimum(high * scores, 600))).sum() < 1 and high < 512:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (low, mid) if (freqs * np.exp(np.minimum(mid * scores, 600))).sum() > 1 else (mid, high)
    return (low + high) / 2


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope (0 at least) and intercept by Newton steps, lightly regularised."""
    beta = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -50, 50)))
        grad = design.T @ (w * (y - p)) - np.array([0.01, 0.01]) * beta
        hess = (design * (w * p * (1 - p))[:, None]).T @ design + np.diag([0.01, 0.01])
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(beta[0])), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, min_z: float = MIN_Z, prior_share: float = PRIOR_SHARE) -> Model:
    """Fit on ``docs`` joined with ``labels`` (0 or 1; other values, and ids labelled both ways, are ignored).

    At most about ``sample`` labels are used, chosen by the ids' hash; these are
    few enough to be broadcast.  Two thirds of them give the token scores, the
    rest the calibration.  Without labels of both kinds the model has no tokens
    and gives the base rate.
    """
    known = labels.select(labels[id_col].alias("__id"), labels[label_col].cast("int").alias("toxic")).where(F.col("__id").isNotNull() & F.col("toxic").isin(0, 1))
    known = known.groupBy("__id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("__other")).where(F.col("toxic") == F.col("__other")).drop("__other")
    n = known.count()
    share = min(1.0, sample / max(1, n))
    draw = F.pmod(F.xxhash64("__id", F.lit("toxicity")), F.lit(1 << 20))
    known = known.where(draw < share * (1 << 20))
    picked = docs.select(docs[id_col].alias("__id"), docs[text_col].alias("text")).join(F.broadcast(known), "__id")
    half = F.pmod(F.xxhash64("__id", F.lit("half")), F.lit(3))
    picked = picked.withColumn("__part", half)
    found = log_odds(_token_counts(picked.where(F.col("__part") != 0)), min_z, prior_share).toArrow().to_pylist()
    scores = {r["token"]: r["score"] for r in found}
    if found:
        bad, good = found[0]["__bad"], found[0]["__good"]
        rest_bad = bad - sum(r["bad"] for r in found)
        rest_good = good - sum(r["good"] for r in found)
        neutral = min(0.0, math.log(max(rest_bad, 1) / max(bad, 1)) - math.log(max(rest_good, 1) / max(good, 1))) - DRIFT
        alphas = np.array([(r["bad"] + r["good"]) * prior_share for r in found] + [0.0])
        freqs = np.array([float(r["good"]) for r in found] + [float(max(rest_good, 1))]) + alphas
        lam = _decay(freqs / freqs.sum(), np.array([r["score"] for r in found] + [neutral]))
    else:
        neutral, lam = -DRIFT, 1.0
    draft = Model(scores, neutral, lam, 0.0, 0.0, 0.0)
    best = picked.where(F.col("__part") == 0).select("toxic", scored("text", docs.sparkSession.sparkContext.broadcast(draft)).alias("s"))
    grid = best.groupBy("toxic", F.round("s.best", 1).alias("best"), F.floor(F.log2(F.col("s.n") + 1) * 2).alias("size")).agg(F.count(F.lit(1)).alias("w"), F.avg("s.n").alias("n")).collect()
    if not grid:
        return Model(scores, neutral, lam, 0.0, 0.0, math.log(0.01))
    # K from the chance hits seen in non-toxic texts: E = K n exp(-lambda S) summed over them
    chance = [r for r in grid if r["toxic"] == 0]
    level = 1 / lam
    hits = sum(r["w"] for r in chance if r["best"] >= level)
    k = (hits + 0.5) / (sum(r["w"] * r["n"] for r in chance) * math.exp(-lam * level) + 1.0)
    model = Model(scores, neutral, lam, k, 0.0, 0.0)
    x = np.array([model.evidence(r["best"], r["n"]) for r in grid])
    slope, intercept = _logistic(x, np.array([float(r["toxic"]) for r in grid]), np.array([float(r["w"]) for r in grid]))
    return Model(scores, neutral, lam, k, slope, intercept)


_RESULT = "best double, n long, score double, passages array<struct<start:long,end:long,score:double,expected:double>>"


def scored(text_col, model_broadcast, max_e: float = MAX_E):
    """Column of (best, n, score, passages): passages with character offsets whose expected chance hits are at most ``max_e``."""
    passage = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())])
    kind = pa.struct([("best", pa.float64()), ("n", pa.int64()), ("score", pa.float64()), ("passages", pa.list_(passage))])

    @F.arrow_udf(_RESULT)
    def run(texts: pa.Array) -> pa.Array:
        model, out = model_broadcast.value, []
        for t in texts.cast(pa.binary()):
            text = t.as_py()
            words = words_of(text)
            found = passages(words, model)
            best, n = max((s for *_, s in found), default=0.0), len(words)
            spans = []
            if found:
                expected = [(a, b, s, model.k * n * math.exp(-model.lam * s)) for a, b, s in found]
                expected = [x for x in expected if x[3] <= max_e]
                at = [m.span() for m in _WORD.finditer(text.decode())] if expected else []
                spans = [{"start": at[a][0], "end": at[b - 1][1], "score": s, "expected": e} for a, b, s, e in expected]
            out.append({"best": best, "n": n, "score": model.probability(best, n), "passages": spans})
        return pa.array(out, kind)

    return run(text_col)


def score_toxicity(docs: DataFrame, model: Model, *, text_col: str = "text", max_e: float = MAX_E) -> DataFrame:
    """``docs`` with ``toxicity`` = (best, n, score, passages).

    A null or empty text has no words, no passage and the score of a text without
    evidence; an empty table gives an empty result; an existing column of this
    name is replaced, others pass through.
    """
    return docs.drop("toxicity").withColumn("toxicity", scored(docs[text_col], docs.sparkSession.sparkContext.broadcast(model), max_e))
