"""Arithmetic on item vectors: the nearest item to a sum, difference or product of others."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.functions.vectors import dot, doubles
from loomset.operators.recommend import popularity_filter

MAX_TERMS = 4
MIN_POP = 500


def combine_terms(vectors: list[tuple[str, list[float]]]) -> list[float]:
    """Unit vector of terms (operator, vector) from the left without precedence; the first operator does not count."""
    total = list(vectors[0][1])
    for op, v in vectors[1:]:
        total = [a + b if op == "+" else a - b if op == "-" else a * b for a, b in zip(total, v, strict=True)]
    length = math.sqrt(sum(x * x for x in total))
    if length < 1e-9:
        raise ValueError("the terms cancel out")
    return [x / length for x in total]


def analogy(items: DataFrame, terms: list[tuple[int, str]], exclude_input: bool = True, min_pop: int = MIN_POP, max_pop: int | None = None, limit: int = 1) -> DataFrame:
    """(ix, pop, score): the best items of (ix, pop, v) for 1 to 4 terms (ix, operator + - or *)."""
    if not 1 <= len(terms) <= MAX_TERMS or any(op not in ("+", "-", "*") for _, op in terms):
        raise ValueError("1 to 4 terms with + - or *")
    wanted = {i for i, _ in terms}
    known = {r["ix"]: r["v"] for r in items.where(F.col("ix").isin(list(wanted))).select("ix", doubles(F.col("v")).alias("v")).collect()}
    if wanted - set(known):
        raise ValueError(f"unknown items: {sorted(wanted - set(known))}")
    target = combine_terms([(op, known[i]) for i, op in terms])
    left = popularity_filter(items.where(~F.col("ix").isin(list(wanted))) if exclude_input else items, min_pop, max_pop)
    score = dot(doubles(F.col("v")), F.array(*map(F.lit, target)))
    return left.select("ix", "pop", score.alias("score")).orderBy(F.col("score").desc(), "ix").limit(limit)
