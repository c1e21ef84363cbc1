"""Personal data: fixed rules and bootstrapped contextual extraction, with DataFrame functions only.

Rules find emails, IP addresses, card and phone numbers.  Their finds are the
seeds of a bootstrap: the word before a seed is a lexical pattern, patterns and
the identifiers they introduce form a bipartite graph, and scores flow through it
a fixed number of times: a pattern is as reliable as the identifiers it meets, an
identifier as likely as any of its patterns says.  What is believed nearly surely
counts as a seed from then on, so that identifiers of a kind that no rule knows
bring patterns of their own.  Identifiers that no rule covers but reliable
patterns introduce are reported as kind "context".  All sums count distinct
identifiers, so copies of a text add nothing.

Match positions come from two arrays, the text between the matches and the
matches; both engines' passes run only where a cheap test found a character that
every match needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

KINDS = ("email", "ip", "card", "phone")
# Possessive forms of the rules: nothing after a quantifier could give characters back.  A match starts at
# the head of a run of its characters or, for emails, where the last match ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$"
#: A word with a digit or "@", the groups of digits that go on after it, and the word before it, if that has none of the match before.
_CANDIDATE = (
    r"(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++)?(?<![^\x20\x09-\x0D])[^0-9@\x20\x09-\x0D]*+[0-9@][^\x20\x09-\x0D]*+"
    r"(?:(?<=[0-9)])\x20[0-9(][0-9().-]*+(?![^\x20\x09-\x0D]))*+"
)
#: Digits an identifier without "@" needs, rounds of scoring, distinct seeds a pattern needs, the belief that makes a seed,
#: the one to report at, and characters above which an identifier is told by its hash.
MIN_DIGITS, ROUNDS, MIN_SEEDS, PROMOTE, ACCEPT, LONG = 5, 6, 3, 0.85, 0.8, 64

_SPAN = "array<struct<start:int,end:int,value:string>>"


def find_all(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of the leftmost non-overlapping matches, in code points.

    Every match and the text before it are walked once; sums of lengths are
    offsets.  They are walked in about as many parts as a part has matches, as
    an array that grows is copied at each step.
    """
    none = F.array().cast(_SPAN)
    size = lambda x: F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(x))).cast("int"))

    def step(acc, s):
        start = acc["at"] + s["gap"]
        end = start + F.length(s["value"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), s["value"].alias("value")))).alias("out"))

    def part(acc, steps):
        done = F.aggregate(steps, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return F.struct(done["at"].alias("at"), F.concat(acc["out"], F.array(done["out"])).alias("out"))

    def bound(value, use):
        """``use`` of a value that is computed once: what a lambda is given is not computed again where it is read."""
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def spans(steps):
        parts = F.transform(F.sequence(F.lit(0), F.size(steps) - 1, size(steps)), lambda at: F.slice(steps, at + 1, size(steps)))
        empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
        return F.aggregate(parts, empty, part, lambda acc: F.flatten(acc["out"]))

    def walked(found):
        # the last piece has no match after it
        between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        steps = F.zip_with(F.transform(between, lambda x: F.length(x)), found, lambda gap, value: F.struct(gap.alias("gap"), value.alias("value")))
        return F.when(F.size(found) > 0, bound(steps, spans)).otherwise(none)

    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), walked)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def rule_spans(text: Column) -> dict[str, Column]:
    """Per kind, the array of (start, end, value) that pass the kind's test; empty for a null text."""
    none = F.array().cast(_SPAN)
    some = lambda test, pattern, ok: F.coalesce(F.when(test, F.filter(find_all(text, pattern), ok)), none)
    digit = text.rlike("[0-9]")
    size = lambda s: F.length(_digits(s["value"]))
    return {
        "email": some(text.contains("@"), EMAIL, lambda s: F.lit(True)),
        "ip": some(digit & text.contains("."), IP, lambda s: s["value"].rlike(_OCTETS)),
        "card": some(digit, CARD, lambda s: size(s).between(16, 19) & F.call_function("luhn_check", _digits(s["value"]))),
        "phone": some(text.contains("+"), PHONE, lambda s: size(s).between(8, 15)),
    }


def _candidates(text: Column) -> Column:
    """Array of (start, end, value, left): identifiers stripped of punctuation at both ends, and the letters of the word before."""

    def one(s):
        left = F.regexp_replace(ascii_lower(F.regexp_extract(s["value"], r"^([^0-9@\x20\x09-\x0D]*)[\x20\x09-\x0D]", 1)), r"[\x00-\x60\x7B-\x7F]", "")
        word = F.regexp_extract(s["value"], r"^(?:[^0-9@\x20\x09-\x0D]*[\x20\x09-\x0D]+)?(.+)$", 1)
        tail = F.length(F.regexp_extract(word, r"([^0-9A-Za-z]*)$", 1))
        core = F.regexp_replace(F.regexp_replace(word, r"[^0-9A-Za-z]+$", ""), r"^[^0-9A-Za-z+]+", "")
        end = s["end"] - tail
        return F.struct((end - F.length(core)).alias("start"), end.alias("end"), core.alias("value"), left.alias("left"))

    found = F.transform(find_all(text, _CANDIDATE), one)
    ok = lambda c: (F.length(_digits(c["value"])) >= MIN_DIGITS) | c["value"].contains("@")
    none = F.array().cast("array<struct<start:int,end:int,value:string,left:string>>")
    return F.coalesce(F.when(text.rlike("[0-9@]"), F.filter(found, ok)), none)


def score_graph(edges: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, promote: float = PROMOTE) -> DataFrame:
    """(value, seed, belief) of the identifiers of edges (left, value, seed) after ``rounds`` of scoring.

    A pattern's score is the mean belief of its distinct identifiers, together
    with one doubtful one, and 0 with fewer than ``min_seeds`` identifiers among
    them that are seeds or believed at ``promote``; an identifier that is no seed
    is believed at one minus the product of its patterns' doubts.  Scores stay in
    log form, so both are plain sums.
    """
    beliefs = cut(edges.groupBy("value").agg(F.max("seed").alias("seed")).withColumn("belief", F.col("seed").cast("double")))
    for _ in range(rounds):
        weighed = edges.select("left", "value").join(beliefs, "value")
        sure = F.sum((F.col("belief") >= promote).cast("int"))
        patterns = weighed.groupBy("left").agg(F.when(sure >= min_seeds, F.sum("belief") / (F.count(F.lit(1)) + 1)).otherwise(F.lit(0.0)).alias("score")).where(F.col("score") > 0)
        doubt = edges.select("left", "value").join(patterns, "left").groupBy("value").agg(F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("score"))))).alias("doubt"))
        belief = F.when(F.col("seed"), F.lit(1.0)).otherwise(1 - F.coalesce("doubt", F.lit(1.0)))
        beliefs = cut(beliefs.drop("belief").join(doubt, "value", "left").select("value", "seed", belief.alias("belief")))
    return beliefs


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """One row a document: doc_id, email, ip, card, phone, context, each an array of (start, end, value).

    Offsets are code points, the end exclusive.  ``context`` has identifiers that
    overlap no rule's find, believed at ``accept`` or more, wherever they occur.
    A null or empty text has no finds, repeated rows stay, an empty table gives an
    empty result, other columns take no part.
    """
    text = docs[text_col]
    rules = rule_spans(text)
    rows = docs.select(docs[id_col].alias("doc_id"), *[c.alias(k) for k, c in rules.items()], _candidates(text).alias("__found"))
    rows = cut(rows.withColumn("__row", F.monotonically_increasing_id()))
    base = F.concat(*[F.col(k) for k in KINDS])
    hits = lambda c: F.exists(base, lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"]))
    tagged = F.transform("__found", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["value"].alias("text"), c["left"].alias("left"), hits(c).alias("seed")))
    key = F.when(F.length("text") <= LONG, F.col("text")).otherwise(F.concat(F.lit("#"), F.sha2("text", 256)))
    seen = rows.where(F.size("__found") > 0).select("__row", F.inline(tagged)).withColumn("value", key)
    edges = cut(seen.groupBy("left", "value").agg(F.max("seed").alias("seed")).where(F.col("left") != ""))
    believed = score_graph(edges).where((F.col("belief") >= accept) & ~F.col("seed")).select("value")
    new = seen.where(~F.col("seed")).join(believed, "value", "left_semi")
    extra = new.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("text").alias("value")))).alias("context"))
    out = rows.join(extra, "__row", "left")
    return out.select("doc_id", *KINDS, F.coalesce("context", F.array().cast(_SPAN)).alias("context"))


def listed(spans: Column, kind: str) -> Column:
    """kind:start:end of every span, in an array."""
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))
