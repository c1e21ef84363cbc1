"""Secret scanning: keyword, access-key and hex rules, and sliding-window entropy.

The entropy scan looks at candidate strings, maximal runs of one character class.
A window moves over a run; its Shannon entropy follows from the counts of its
characters, which change by one in and one out at each step.  Windows at or above
the class's threshold are joined to a span.  Placeholders and other well-known
harmless shapes are taken out of a run by an allow-list, what is around them is
scanned; spans of letters alone need both cases mixed.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run below 20 characters holds no longer one
HEX = re.compile(r"[0-9a-f]{24,}")  # the maximal runs of 24 and more
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")


@dataclass(frozen=True)
class CharClass:
    """A run of ``pattern`` is scanned with ``window`` characters; spans need ``bits`` of entropy a character."""

    kind: str
    pattern: re.Pattern
    window: int
    bits: float


CLASSES = (
    CharClass("entropy_hex", re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{20,}(?![0-9A-Za-z])"), 20, 2.9),
    CharClass("entropy_base64", re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 20, 3.75),
)
#: What one of these matches is no secret, nor is what touches it up to a separator, less than a window away.
ALLOW = (
    re.compile(r"(?i)example|sample|dummy|placeholder|changeme|change_me|your[_-]|x{6,}|test[_-]?(key|token)"),
    re.compile(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"),
    re.compile(r"^[0-9]+$"),
    re.compile(r"(?i)0123456789|abcdefghij|qwertyuiop"),
    re.compile(r"^(.{1,8})\1{2,}.{0,8}$"),
)
_HEX_RUN = bytes(104 if b in b"0123456789abcdefABCDEF" else 32 for b in range(256))
_SEPARATOR = re.compile(r"[+/_=-]")
#: Share of capitals that letters without digits need: random ones have a half, words and names joined by capitals few.
CAPITALS = (0.25, 0.75)


def hot_windows(run: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Spans of joined windows of ``run`` whose entropy is at least ``bits``, by incremental counts."""
    if len(run) < window:
        return []
    plogp = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    mass = 0.0  # sum of c * log2(c); the entropy is log2(window) - mass / window
    limit = (math.log2(window) - bits) * window + 1e-9
    spans: list[list[int]] = []
    for i, ch in enumerate(run):
        c = counts.get(ch, 0)
        mass += plogp[c + 1] - plogp[c]
        counts[ch] = c + 1
        if i >= window:
            out = run[i - window]
            c = counts[out]
            mass += plogp[c - 1] - plogp[c]
            counts[out] = c - 1
        if i >= window - 1 and mass <= limit:
            if spans and i + 1 - window <= spans[-1][1]:
                spans[-1][1] = i + 1
            else:
                spans.append([i + 1 - window, i + 1])
    return [(a, b) for a, b in spans]


def stretches(run: str, window: int, allow: tuple[re.Pattern, ...]) -> list[tuple[int, int]]:
    """The parts of ``run`` that the allow-list leaves."""
    gone = []
    for m in (m for pattern in allow for m in pattern.finditer(run)):
        a, b = max(0, m.start() - window + 1), min(len(run), m.end() + window - 1)
        before = [x.end() for x in _SEPARATOR.finditer(run, a, m.start())]
        after = _SEPARATOR.search(run, m.end(), b)
        gone.append((before[-1] if before else a, after.start() if after else b))
    out, at = [], 0
    for a, b in sorted(gone):
        if a > at:
            out.append((at, a))
        at = max(at, b)
    return [*out, (at, len(run))] if at < len(run) else out


def mixed(value: str) -> bool:
    """Whether ``value`` has a digit, or letters of both cases as random ones would."""
    letters = [c for c in value if c.isalpha()]
    return any(c.isdigit() for c in value) or CAPITALS[0] <= sum(c.isupper() for c in letters) / max(1, len(letters)) <= CAPITALS[1]


def scan(text: bytes | None, classes: tuple[CharClass, ...] = CLASSES, allow: tuple[re.Pattern, ...] = ALLOW) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a UTF-8 text in code points, by start, then kind."""
    if not text:
        return []
    low, text_str, found = text.translate(LOWER), None, []
    if any(k in low for k in KEYWORDS):
        text_str = text.decode()
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text_str) if len(m[2]) >= 6]
    if b"AKIA" in text:
        text_str = text_str or text.decode()
        found += [("access", *m.span()) for m in ACCESS.finditer(text_str)]
    if b"h" * 20 in text.translate(_HEX_RUN):
        text_str = text_str or text.decode()
        found += [("hex", *m.span()) for m in HEX.finditer(text_str)]
    base = sorted((a, b) for _, a, b in found)
    text_str = text_str or text.decode()
    taken: set[tuple[int, int]] = set()
    for cls in classes:
        for m in cls.pattern.finditer(text_str):
            for start, stop in stretches(m[0], cls.window, allow):
                run = m[0][start:stop]
                for a, b in hot_windows(run, cls.window, cls.bits):
                    a = 0 if a < cls.window else a  # a remainder shorter than a window belongs to the secret
                    b = len(run) if len(run) - b < cls.window else b
                    span = (m.start() + start + a, m.start() + start + b)
                    if mixed(run[a:b]) and span not in taken and not any(x <= span[0] and span[1] <= y for x, y in base):
                        taken.add(span)
                        found.append((cls.kind, *span))
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(found, key=lambda s: (s[1], rank.get(s[0], len(rank)), s[2]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, *, text_col: str = "text", classes=CLASSES, allow=ALLOW) -> DataFrame:
    """``docs`` with ``secrets``, an array of (kind, start, end, value) by start, then kind.

    Offsets are code points, the end exclusive.  The rules' spans always stay; an
    entropy span inside one of them is left out.  A null or empty text has none,
    an empty table gives an empty result; an existing column of this name is
    replaced, others pass through.
    """

    @F.arrow_udf("array<struct<kind:string,start:long,end:long>>")
    def spans(texts: pa.Array) -> pa.Array:
        return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in scan(t.as_py(), classes, allow)] for t in texts.cast(pa.binary())], _SPANS)

    plain = docs.drop("secrets")
    out = plain.withColumn("__spans", spans(docs[text_col]))
    value = lambda s: F.substring(docs[text_col], (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    named = F.transform("__spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), value(s).alias("value")))
    return out.withColumn("secrets", named).drop("__spans")
