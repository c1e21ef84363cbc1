"""Every scalar operation against literal values."""

import datetime as dt
import math

import pytest

from tessera.plans.expr import Expr, lit, none, some
from tessera.sources.external import one_row, query_one

MAX, MIN = (1 << 63) - 1, -(1 << 63)
LOW = -1.7976931348623157e308
UTC = dt.UTC


def ts(seconds):
    return lit(dt.datetime(1970, 1, 1, tzinfo=UTC) + dt.timedelta(seconds=seconds))


D = dt.date(2300, 3, 6)
LATE = lit(dt.datetime(9999, 12, 31, 23, 59, 58, 999_999, tzinfo=UTC))
VECTORS = [
    (lit(1).add(2), 3), (lit(1.0).add(2.0), 3.0), (lit(1).sub(2), -1), (lit(2).mul(3), 6), (lit(5).div(3), 1), (lit(-5).div(3), -1), (lit(1.0).div(2.0), 0.5),
    (lit(5).modulo(3), 2), (lit(-5).modulo(3), -2), (lit(5).div(0), None), (lit(5.0).div(0.0), None), (lit(5).modulo(0), None), (lit(7).div(-1), -7),
    (lit(2).sign(), 1), (lit(-5.0).sign(), -1), (lit(-0.0).sign(), 0), (lit(2).abs(), 2), (lit(-5.0).abs(), 5.0),
    (lit(2).lt(3), True), (lit(1).lt(1), False), (lit(3.0).lt(1.0), False), (lit(2).lte(2), True), (lit(2).gt(2), False), (lit(2).gte(3), False), (lit(3.0).gte(3.0), True),
    (lit(2).max(3), 3), (lit(5.0).min(3.0), 3.0), (lit(2).between(2, 3), True), (lit(3).between(2, 3), True), (lit(5).between(2, 3), False), (lit(1).between(2, 3), False),
    (lit(False).lt(True), True), (lit("a").lt("b"), True), (lit(b"\x01").lt(b"\x02"), True),
    (lit(1).eq(1), True), (lit(1.5).eq(1.5), True), (lit("x").eq("y"), False), (lit(b"x").neq(b"y"), True), (lit(True).neq(True), False),
    (lit(True).not_(), False), (lit(True).and_(False), False), (lit(True).or_(False), True),
    (some(10).unwrap_or(5), 10), (none(str).unwrap_or("foo"), "foo"), (some(10).is_some(), True), (none(int).is_some(), False), (none(int).is_none(), True),
    (lit(10).to_f64(), 10.0), (lit(10.9).to_i64(), 10), (lit(-10.9).to_i64(), -10), (lit(342143124.0).to_i64(), 342143124), (lit(LOW).to_i64(), MIN),
    (lit(-math.inf).to_i64(), MIN), (lit(math.inf).to_i64(), MAX), (lit(10.9).floor(), 10.0), (lit(-10.9).floor(), -11.0), (lit(10.9).ceil(), 11.0), (lit(-10.9).ceil(), -10.0),
    (lit(LOW).floor(), LOW), (lit(-math.inf).floor(), -math.inf), (lit(LOW).ceil(), LOW), (lit(-math.inf).ceil(), -math.inf),
    (lit(10.85).round_with_precision(0), 11.0), (lit(-10.85).round_with_precision(0), -11.0), (lit(10.85).round_with_precision(1), 10.8), (lit(-10.85).round_with_precision(1), -10.8),
    (lit(LOW).round_with_precision(1), LOW), (lit(-math.inf).round_with_precision(1), -math.inf), (lit(2.5).round_with_precision(-3), 3.0),
    (lit("hello world").starts_with("hello"), True), (lit("hello world").starts_with("Hello"), False), (lit("hello world").ends_with("world"), True), (lit("hello world").ends_with("World"), False),
    (lit("a*b").starts_with("a*"), True), (lit("axb").starts_with("a*"), False), (lit("rhubarb").contains("bar"), True), (lit("rhubarb").contains("Bar"), False), (lit("x").contains(""), True),
    (lit("very,cool,list").replace(",", "::"), "very::cool::list"), (lit("rarar").replace("rar", "rer"), "rerar"), (lit("abc").replace("", "x"), "abc"),
    (lit("abacda").ltrim("ab"), "cda"), (lit("adcaba").rtrim("ab"), "adc"), (lit("ffzfzf").trim("f"), "zfz"),
    (lit("hello world").glob("?ello*"), True), (lit("hello world").glob("Hell*"), False), (lit("a]b").glob("a[]]b"), True), (lit("axb").glob("a[^y]b"), True), (lit("a.b").glob("a?b"), True),
    (lit("é").glob("?"), True), (lit("a-b").glob("a[a-]b"), True), (lit("ab\nc").glob("ab*"), True), (lit("abc").glob("a[b"), False),
    (lit("hello").like("HELLO%"), True), (lit("hello").like("he_o%"), False), (lit("É").like("é"), False), (lit("100%").like("100\\%"), True), (lit("1000").like("100\\%"), False),
    (lit("Hello, ").concat("World"), "Hello, World"), (lit("WHAT É").lower(), "what É"), (lit("what é").upper(), "WHAT é"),
    (lit("€").char_len(), 1), (lit("what").char_len(), 4), (lit("€").byte_len(), 3), (lit("what").byte_len(), 4), (lit(b"\x01\x02").byte_len(), 2),
    (Expr.zero_blob(40), bytes(40)), (Expr.zero_blob(-1), b""),
    (ts(123.713).to_second(), 123), (ts(123.713).subsec_nanosecond(), 713_000_000), (ts(-123.713).to_second(), -123), (ts(-123.713).subsec_nanosecond(), -713_000_000),
    (Expr.from_second(4322).to_second(), 4322), (Expr.from_second(-4322).to_second(), -4322), (Expr.from_second(4322).add_nanosecond(713_000_000).subsec_nanosecond(), 713_000_000),
    (ts(123713).to_date_in_tz("Europe/Amsterdam"), dt.date(1970, 1, 2)), (ts(1).eq(ts(1)), True), (ts(1).lt(ts(2)), True),
    (ts(123.713).to_nanos().to_second(), 123), (ts(-123.713).to_nanos().to_second(), -123), (ts(-123.713).to_nanos().subsec_nanosecond(), -713_000_000),
    (ts(1).to_nanos().add_nanosecond(1).subsec_nanosecond(), 1), (ts(0).to_nanos().add_nanosecond(-1).to_second(), 0), (ts(0).to_nanos().add_nanosecond(-1).subsec_nanosecond(), -1),
    (ts(0).to_nanos().add_nanosecond(-1_000_000_001).to_second(), -1), (ts(1.5).to_nanos().add_nanosecond(2_700_000_001).to_second(), 4), (ts(1.5).to_nanos().add_nanosecond(2_700_000_001).subsec_nanosecond(), 200_000_001),
    (ts(1).to_nanos().lt(ts(1).to_nanos().add_nanosecond(1)), True), (ts(-1).to_nanos().add_nanosecond(1).gt(ts(-1).to_nanos()), True), (ts(5).to_nanos().to_micros().eq(ts(5)), True),
    (ts(123713).to_nanos().to_date_in_tz("Europe/Amsterdam"), dt.date(1970, 1, 2)),
    (lit(D).year(), 2300), (lit(D).month(), 3), (lit(D).day(), 6), (lit(D).first_of_month(0), dt.date(2300, 3, 1)), (lit(D).first_of_month(1), dt.date(2300, 4, 1)),
    (lit(D).first_of_month(12), dt.date(2301, 3, 1)), (lit(D).first_of_month(-1), dt.date(2300, 2, 1)), (lit(D).add_day(30), dt.date(2300, 4, 5)), (lit(D).add_day(10_000_000), None),
    (lit(D).add_day(3_000_000_000), None), (lit(D).add_day(MIN), None), (lit(D).first_of_month(3_000_000_000), None), (lit(D).first_of_month(-1_000_000), None), (lit(dt.date(9999, 12, 31)).add_day(1), None),
    (LATE.to_nanos().to_second(), 253402300798), (LATE.to_nanos().subsec_nanosecond(), 999_999_000), (LATE.to_nanos().to_micros().eq(LATE), True),
    (lit(5).div(0).eq(lit(1).div(0)), True), (lit(5).div(0).eq(1).not_(), True), (lit(D).add_day(4_000_000_000).eq(D), False), (lit(1.0).div(0.0).to_i64().neq(1), True), (lit(5).modulo(0).eq(lit(7).modulo(0)), True),
]


def test_vectors(spark):
    got = query_one(lambda table: one_row(spark), tuple(e for e, _ in VECTORS))
    for (expr, want), value in zip(VECTORS, got, strict=True):
        assert value == want and type(value) is type(want), (expr.node, value, want)


@pytest.mark.parametrize("bad", [
    lambda: lit(1).add(1.0), lambda: lit("a").add("b"), lambda: none(int).eq(none(int)), lambda: none(int).lt(1), lambda: lit(1).lower(), lambda: lit(1.0).modulo(2.0),
    lambda: lit(1).unwrap_or(2), lambda: lit(1).floor(), lambda: lit(1).and_(True), lambda: bool(lit(True)), lambda: lit("a").eq(1),
])
def test_types_are_checked(bad):
    with pytest.raises(TypeError):
        bad()


def test_overflow_is_an_error(spark):
    with pytest.raises(Exception, match="OVERFLOW"):
        query_one(lambda table: one_row(spark), lit(MAX).add(1))


def test_rounding_is_exact(spark):
    """Doubles next to and on ties, against decimal arithmetic on their binary values."""
    import random
    from decimal import ROUND_HALF_UP, Decimal

    from pyspark.sql import functions as F

    from tessera.functions import scalars

    rng = random.Random(3)
    given = [0.0, -0.0, 0.5, 1.5, 2.5, -0.5, 1e300, -1e300, 5e-324, 4503599627370495.5, 9007199254740991.0, 0.1 + 0.2, math.inf, -math.inf]
    for _ in range(3000):
        k, n = rng.randrange(0, 10 ** rng.randrange(1, 12)), rng.randrange(0, 10)
        x = (10 * k + 5) / 10 ** (n + 1)  # what the decimal tie is stored as
        given += [x, math.nextafter(x, 0), math.nextafter(x, math.inf), -x, rng.uniform(-1e6, 1e6), rng.random() * 10.0 ** rng.randrange(-12, 17)]
    frame = spark.createDataFrame([(x,) for x in given], "x double")
    digits = (0, 1, 2, 3, 6, 9, 15, 22)
    for r in frame.select("x", *[scalars.apply("round", [F.col("x"), F.lit(n)], None, [None, n]).alias(f"r{n}") for n in digits]).collect():
        x = r["x"]
        for n in digits:
            want = x if math.isinf(x) or abs(x) >= 2**52 else float(Decimal(x).quantize(Decimal(1).scaleb(-n), rounding=ROUND_HALF_UP)) if abs(x) < 1e5 else None
            assert want is None or r[f"r{n}"] == want, (x, n, r[f"r{n}"], want)
