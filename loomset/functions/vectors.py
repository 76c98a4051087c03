"""Vector arithmetic on array columns, and scores built from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-9


def doubles(v: Column) -> Column:
    """An array as doubles, in which all sums are taken."""
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(v, v))


def normalized(v: Column, epsilon: float = EPSILON) -> Column:
    """v over its length plus epsilon."""
    # the length stands outside the function of an element, so that it is taken once a vector
    return F.zip_with(v, F.array_repeat(norm(v) + epsilon, F.size(v)), lambda x, length: x / length)


def combined(terms: list[tuple[str, Column]]) -> Column:
    """Fold of (operator, vector) from the left without precedence; the first operator does not count."""
    steps = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y}
    return reduce(lambda a, t: F.zip_with(a, t[1], steps[t[0]]), terms[1:], terms[0][1])


def hump(pop: Column, peak: float, width: float) -> Column:
    """Gaussian of log popularity around peak: 1 for peak, less for rarer and for more frequent items."""
    return F.exp(-F.pow(F.ln(F.greatest(pop, F.lit(1)).cast("double")) - F.ln(F.lit(float(peak))), F.lit(2.0)) / (2.0 * width * width))


def neg_log_sigmoid(x: Column) -> Column:
    """-ln(1 / (1 + exp(-x))) without overflow."""
    return F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def half_up(x: Column, digits: int) -> Column:
    """x to so many digits, halves up, by scaling."""
    return F.floor(x * float(10**digits) + 0.5) / float(10**digits)
