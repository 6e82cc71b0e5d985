"""Array (vector) column expressions built from Spark higher-order functions.

All math is in double. None of these needs Python: they run in the JVM next
to the scan. Dense all-pairs work does not use them (see operators.vectors).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class names of the three-way sentence-pair task, by class id.
CLASS_NAMES = ["entailment", "neutral", "contradiction"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def norm(a) -> Column:
    return F.sqrt(_sum(F.transform(_c(a), lambda x: x * x)))


def l2sq(a, b) -> Column:
    """V1: squared Euclidean distance (what a flat L2 index reports)."""
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)))


def l2(a, b) -> Column:
    """V1: Euclidean distance."""
    return F.sqrt(l2sq(a, b))


def cosine(a, b) -> Column:
    """V2: cosine similarity; 0.0 when either vector has zero length."""
    den = norm(a) * norm(b)
    return F.when(den == 0, F.lit(0.0)).otherwise(dot(a, b) / den)


def _per_element(arr: Column, value: Column) -> Column:
    """``value`` repeated to the array's length: lets a lambda use a per-row
    scalar without re-evaluating it for every element."""
    return F.array_repeat(value, F.size(arr))


def l2_normalize(a) -> Column:
    a = _c(a)
    return F.zip_with(a, _per_element(a, norm(a)), lambda x, n: F.when(n == 0, x).otherwise(x / n))


def parse_vector(c) -> Column:
    """``"[0.1  2.   3e-4]"`` -> array<double> (all pieces kept)."""
    pieces = F.split(F.trim(F.translate(_c(c), "[]", "")), r"\s+")
    return F.transform(F.filter(pieces, lambda x: x != F.lit("")), lambda x: x.cast("double"))


def format_vector(c) -> Column:
    """Print a vector the way the source's CSV holds it, ``[x  y]``, each element in
    the shortest text that reads back as the same double."""
    return F.concat(F.lit("["), F.array_join(F.transform(_c(c), lambda x: x.cast("string")), "  "), F.lit("]"))


def softmax(c) -> Column:
    """Numerically stable softmax of a logit array."""
    arr = _c(c)
    ex = F.zip_with(arr, _per_element(arr, F.array_max(arr)), lambda x, m: F.exp(x - m))
    return F.zip_with(ex, _per_element(ex, _sum(ex)), lambda x, s: x / s)


def argmax(c) -> Column:
    """0-based position of the largest element; the first one wins ties."""
    arr = _c(c)
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def class_score(c, k: int) -> Column:
    """Score of class ``k`` (0-based)."""
    return F.element_at(_c(c), k + 1)


def label_name(c) -> Column:
    """P20: class id -> class name."""
    return F.element_at(F.array(*[F.lit(n) for n in CLASS_NAMES]), _c(c).cast("int") + 1)


def pool_first(hidden) -> Column:
    """The first token's vector of a [seq, dim] array."""
    return F.element_at(_c(hidden), 1)


def pool_mean(hidden, mask=None) -> Column:
    """Mean of token vectors (only where ``mask`` is 1 when given)."""
    h = _c(hidden)
    if mask is not None:
        h = F.filter(F.arrays_zip(h.alias("v"), _c(mask).alias("m")), lambda z: z["m"] == 1)
        h = F.transform(h, lambda z: z["v"])
    dim = F.size(F.element_at(h, 1))
    zero = F.array_repeat(F.lit(0.0).cast("double"), dim)
    total = F.aggregate(h, zero, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))
    n = F.size(h)
    return F.transform(total, lambda x: x / n)


def joint_vector(a, b) -> Column:
    """Image vector followed by text vector."""
    return F.concat(_c(a), _c(b))


def round_vec(c, places: int = 6) -> Column:
    return F.transform(_c(c), lambda x: F.round(x, places))
