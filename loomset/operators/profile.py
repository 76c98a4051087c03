"""Profile of a corpus: cardinalities, lengths, shares, fragmentation of titles, the long tail."""

from __future__ import annotations

import math
from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomset.functions.vectors import half_up

#: Upper bounds and labels of collection lengths and of tracks per pair.
LENGTH_BUCKETS = ((50, "a. <=50"), (250, "b. 51-250"), (1000, "c. 251-1000"), (5000, "d. 1001-5000"), (None, "e. >5000"))
TRACK_BUCKETS = ((1, "1"), (2, "2"), (5, "3-5"), (10, "6-10"), (None, ">10"))
TAIL = (1, 3, 5, 10, 20, 50)


def cardinalities(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table."""
    counts = [df.agg(F.count("*").alias(f"n_{name}")) for name, df in tables.items()]
    return reduce(lambda a, b: a.join(b), counts)  # rows of one count each


def quantiles(df: DataFrame, column: str, points: dict[str, float], digits: int = 1) -> DataFrame:
    """One row: count, mean to so many digits, exact interpolated quantiles and maximum of a column."""
    c = F.col(column)
    # exact percentiles count equal values before the shuffle, so memory follows the number of different values
    return df.agg(F.count("*").alias("n"), half_up(F.avg(c), digits).alias("mean"), *(F.percentile(c, p).alias(name) for name, p in points.items()), F.max(c).alias("max"))


def wide_quantiles(df: DataFrame, column: str, points: dict[str, float], bins: int = 4_096) -> DataFrame:
    """One row of exact interpolated quantiles of a column with any number of different values; null and NaN do not count.

    Passes narrow the range in which each wanted rank lies: one counts rows by bins of equal width with their least and
    most value, the next looks into a rank's bin alone, until one value is left. A pass collects at most `bins` rows a
    rank, so memory does not follow the data. df is read by each pass: it should be a written table. No rows: nulls.
    """
    x = F.col("x")
    rows = df.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    finite = F.abs(x) < math.inf
    n, low, high, least, most = rows.agg(F.count("*"), F.count_if(x == -math.inf), F.count_if(x == math.inf), F.min(F.when(finite, x)), F.max(F.when(finite, x))).first()
    ranks = {f(p * (n - 1)) for p in points.values() for f in (math.floor, math.ceil)} if n else set()
    # by rank: least and most value of its range, rows before the range
    at = {r: (-math.inf, -math.inf, 0) if r < low else (math.inf, math.inf, 0) if r >= n - high else (least, most, low) for r in ranks}
    while ranges := sorted({v for v in at.values() if v[0] < v[1]}):
        parts = []
        for i, (a, b, _) in enumerate(ranges):
            scale = 1.0 if math.isfinite(b - a) else 0.5
            share = (x * scale - a * scale) / F.lit(b * scale - a * scale)
            parts.append(F.when(x.between(a, b), F.struct(F.lit(i).alias("i"), F.least(F.floor(share * bins), F.lit(bins - 1)).alias("bin"))))
        counted = defaultdict(list)
        for r in rows.groupBy(F.coalesce(*parts).alias("b")).agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("z")).where("b is not null").select("b.*", "n", "a", "z").collect():
            counted[ranges[r["i"]]].append((r["bin"], r["n"], r["a"], r["z"]))
        for rank, own in at.items():
            before = own[2]
            for _, size, a, z in sorted(counted.get(own, ())):
                if rank < before + size:
                    at[rank] = (a, z, before)
                    break
                before += size

    def value(p: float) -> float | None:
        if not n:
            return None
        place = p * (n - 1)
        a, z = at[math.floor(place)][0], at[math.ceil(place)][0]
        return a if a == z else a * (math.ceil(place) - place) + z * (place - math.floor(place))

    return df.sparkSession.createDataFrame([tuple(value(p) for p in points.values())], ", ".join(f"`{name}` double" for name in points))


def bucket(c: Column, bounds: tuple) -> Column:
    """The label of the first bound that c does not exceed."""
    out = None
    for most, label in bounds:
        if most is None:
            return out.otherwise(label) if out is not None else F.lit(label)
        out = F.when(c <= most, label) if out is None else out.when(c <= most, label)
    return out


def shares(df: DataFrame, column: str, bounds: tuple, weighted: bool) -> DataFrame:
    """(bucket, n, total, pct): rows and sum of a column by bucket, and the bucket's share in percent of the sum
    (weighted) or of the rows."""
    by = df.groupBy(bucket(F.col(column), bounds).alias("bucket")).agg(F.count("*").alias("n"), F.sum(column).alias("total"), F.min(column).alias("least"))
    part = F.col("total" if weighted else "n")
    return by.select("bucket", "n", "total", half_up(F.lit(100.0) * part / F.sum(part).over(Window.partitionBy()), 2).alias("pct")).orderBy("bucket")


def variant_groups(keys: DataFrame) -> DataFrame:
    """(creator_id, title_key, variants): releases of one creator under one title key."""
    return keys.groupBy("creator_id", "title_key").agg(F.count("*").alias("variants"))


def largest_groups(keys: DataFrame, creator: DataFrame, limit: int = 15) -> DataFrame:
    """The largest groups of variants with their creator's name."""
    groups = variant_groups(keys).orderBy(F.col("variants").desc(), "creator_id", "title_key").limit(limit)
    return groups.join(creator.select(F.col("id").alias("creator_id"), F.col("name").alias("creator")), "creator_id").select("creator", "creator_id", "title_key", "variants")


def tail_counts(df: DataFrame, column: str, steps: tuple[int, ...] = TAIL) -> DataFrame:
    """One row: how many values reach each step."""
    return df.agg(*(F.count_if(F.col(column) >= s).alias(f"ge{s}") for s in steps))
