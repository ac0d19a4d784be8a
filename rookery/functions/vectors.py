"""Column functions on vectors (array<double>) and their codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then) -> Column:
    """then(value), with value worked out once; a lambda would repeat an outer expression per element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def as_doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalise(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    return let(norm(v), lambda n: F.transform(v, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n)))


def truncate(v: Column, dim: int) -> Column:
    """The first dim components, renormalised; raises where the vector is shorter."""
    checked = F.when(F.size(v) >= dim, v).otherwise(F.raise_error(F.lit(f"cannot truncate to {dim} dimensions")).cast("array<double>"))
    return l2_normalise(F.slice(checked, 1, dim))


def binary_word(v: Column, word: int = 0) -> Column:
    """Bits of components 64*word .. 64*word+63 as a bigint, 1 where > 0, first component highest."""
    part = F.slice(v, 64 * word + 1, 64)
    bits = F.transform(part, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(63) - i)).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))


def binary_words(v: Column, dim: int) -> Column:
    return F.array(*[binary_word(v, w) for w in range(-(-dim // 64))])


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two bigint codes."""
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def hamming_words(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)


def int8_encode(v: Column, lows: Column, spans: Column) -> Column:
    """round-half-even((x - low) / span * 255) - 128 within -128..127."""
    scaled = F.zip_with(F.arrays_zip(v.alias("v"), lows.alias("l")), spans, lambda p, s: (p["v"].cast("double") - p["l"]) / s * 255)
    return F.transform(scaled, lambda x: F.greatest(F.lit(-128.0), F.least(F.lit(127.0), F.bround(x) - 128)).cast("tinyint"))


def int8_decode(codes: Column, lows: Column, spans: Column) -> Column:
    """(c + 128) / 255 * span + low."""
    return F.zip_with(F.arrays_zip(codes.alias("c"), lows.alias("l")), spans, lambda p, s: (p["c"].cast("double") + 128) / 255 * s + p["l"])
