"""Vectors as array columns, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.text import _c, ascii_tokens

_ZERO = 0.0


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(_ZERO), lambda acc, x: acc + x)


def let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once per row, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def doubles(c) -> Column:
    return _c(c).cast("array<double>")


def dot(a, b) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a) -> Column:
    return F.sqrt(_sum(F.transform(doubles(a), lambda x: x * x)))


def normalised(a) -> Column:
    """Divided by its length; the zero vector stays."""
    return let(doubles(a), lambda v: let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)))


def clamp01(c) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(c)))


def resample(a, size) -> Column:
    """Linear interpolation to ``size`` points over the same span; a vector of that size stays as it is."""
    d = F.lit(size) if isinstance(size, int) else _c(size)

    def points(v: Column) -> Column:
        n = F.size(v)

        def at(i: Column) -> Column:
            pos = F.when(d > 1, i.cast("double") * (n - 1) / (d - 1)).otherwise(F.lit(0.0))
            lo = F.least(F.floor(pos), n - 1).cast("int")
            hi = F.least(lo + 1, n - 1)
            w = pos - lo
            return F.get(v, lo) * (1 - w) + F.get(v, hi) * w

        return F.when(n == d, v).otherwise(F.transform(F.sequence(F.lit(0), d - 1), at))

    return let(doubles(a), points)


def cosine_unit(a, b) -> Column:
    """Cosine mapped to [0, 1]; 0.0 if either vector is zero. Vectors of different sizes are resampled to the larger."""
    d = F.greatest(F.size(_c(a)), F.size(_c(b)))
    return let(resample(a, d), lambda x: let(resample(b, d), lambda y: cosine_same_size(x, y)))


def cosine_same_size(a, b) -> Column:
    """As ``cosine_unit`` for vectors known to have one size."""
    return let(norm(a) * norm(b), lambda n: F.when(n == 0, F.lit(0.0)).otherwise(clamp01((dot(a, b) / n + 1) / 2)))


def raw_cosine(a, b) -> Column:
    """Cosine over the common leading components, with 1e-8 added to each length."""
    k = F.least(F.size(_c(a)), F.size(_c(b)))
    x, y = F.slice(doubles(a), F.lit(1), k), F.slice(doubles(b), F.lit(1), k)
    return dot(x, y) / ((norm(x) + 1e-8) * (norm(y) + 1e-8))


def euclidean_similarity(a, b) -> Column:
    d = F.sqrt(_sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))
    return 1 / (1 + d)


def minus(a, b) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def sign_code(a, dims: int = 8) -> Column:
    """A character per leading component: 1 where it is not negative."""
    return F.array_join(F.transform(F.slice(_c(a), 1, dims), lambda x: F.when(x >= 0, "1").otherwise("0")), "")


def average_hash(a) -> Column:
    """16 hexadecimal digits of 64 values: a bit is set where the value is at least their mean. Other sizes give null."""
    def code(v: Column) -> Column:
        bits = let(_sum(v) / F.size(v), lambda mean: F.array_join(F.transform(v, lambda x: F.when(x >= mean, "1").otherwise("0")), ""))
        return F.when(F.size(v) == 64, F.lower(F.lpad(F.conv(bits, 2, 16), 16, "0")))

    return let(doubles(a), code)


def hamming(a, b) -> Column:
    """Differing bits of two hexadecimal strings of 16 digits; null where their sizes differ."""
    a, b = _c(a), _c(b)

    def half(c: Column, at: int) -> Column:
        return F.conv(F.substring(c, at, 8), 16, 10).cast("long")

    bits = F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))
    return F.when((F.length(a) == F.length(b)) & (F.length(a) == 16), bits)


def mean_vector(*vectors) -> Column:
    """The mean of those of several vectors of one size that are there; null where none is."""
    present = F.array_compact(F.array(*[doubles(v) for v in vectors]))
    total = F.aggregate(
        F.slice(present, F.lit(2), F.greatest(F.size(present) - 1, F.lit(0))), F.element_at(F.slice(present, 1, 1), 1),
        lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y),
    )
    return F.when(F.size(present) > 0, F.transform(total, lambda x: x / F.size(present)))


def parse_vector(c) -> Column:
    """A vector written as a JSON array, or as numbers parted by commas or white space; null if any part is no finite number."""
    t = F.trim(_c(c))
    inner = F.regexp_replace(t, r"^\[|\]$", "")
    parts = F.transform(F.filter(F.split(inner, r"[,\s]+"), lambda x: x != ""), lambda x: x.try_cast("double"))
    ok = (F.size(parts) > 0) & ~F.exists(parts, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(ok, parts)


def fitted(a, size) -> Column:
    """Cut to ``size`` components; a missing vector becomes zeros."""
    size = F.lit(size) if isinstance(size, int) else _c(size)
    return F.coalesce(F.slice(doubles(a), F.lit(1), size), F.array_repeat(F.lit(0.0), size))


def token_vector(c, dims: int = 64) -> Column:
    """Counts of tokens hashed to ``dims`` places (sum of position x code point), scaled to length 1; zeros without tokens."""
    places = F.transform(
        ascii_tokens(c),
        lambda w: F.aggregate(
            F.transform(F.split(w, ""), lambda ch, i: (i + 1) * F.ascii(ch)), F.lit(0), lambda acc, x: acc + x
        ) % dims,
    )
    counts = let(places, lambda p: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.size(F.filter(p, lambda q: q == k)).cast("double")))
    return normalised(counts)


def line_points(a, b, steps: int) -> Column:
    """``steps`` vectors from a to b at even distances."""
    x, y = doubles(a), doubles(b)
    return F.transform(
        F.sequence(F.lit(0), F.lit(steps - 1)),
        lambda k: F.zip_with(x, y, lambda p, q: p + (q - p) * (k / F.lit(float(max(steps - 1, 1))))),
    )
