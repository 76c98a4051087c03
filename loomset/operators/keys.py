"""Contiguous keys without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomset.operators.scratch import materialized


def contiguous_index(df: DataFrame, key: str, name: str, partitions: int | None = None) -> DataFrame:
    """df with `name`, 0 .. n-1 in the order of key (unique; null last).

    Rows are dealt by ranges of the key, sorted within each and written once with their place in their range; ranges
    before add their sizes. Only the sizes, one row a range, meet in one task.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col(key).asc_nulls_last()
    dealt = materialized(df.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("__at", F.monotonically_increasing_id()), "keys")
    part = F.shiftright("__at", 33)  # the upper bits number the range, the lower 33 the row in it
    sizes = dealt.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("__part", before.alias("__before")))  # one row a range
    place = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.join(offsets, part == F.col("__part")).select(*df.columns, place.cast("long").alias(name))


def dense_index(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with `name`, the dense rank of key less one, null keys last: the distinct keys are indexed and joined back."""
    keys = contiguous_index(df.select(key).distinct(), key, name)
    joined = df.join(keys.withColumnRenamed(key, "__key"), F.col(key).eqNullSafe(F.col("__key")), "left")
    return joined.select(*df.columns, name)


def shared_index(keys: dict[str, DataFrame], partitions: int | None = None) -> dict[str, DataFrame]:
    """{name: (key, name)}: the keys of every table of one column (unique; null last) numbered 0 .. n-1 by themselves.

    All keys, and nothing but keys, are dealt by ranges of (table, key), sorted and written in one pass; one row for each
    range and table gives all offsets.
    """
    types = sorted({df.dtypes[0][1] for df in keys.values()})
    rows = None
    for kind, df in enumerate(keys.values()):
        (column, own), = df.dtypes
        typed = [(F.col(column) if t == own else F.lit(None).cast(t)).alias(f"k{i}") for i, t in enumerate(types)]
        part = df.select(F.lit(kind).alias("kind"), *typed)
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        return {}
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("kind"), *(F.col(f"k{i}").asc_nulls_last() for i in range(len(types)))]
    dealt = materialized(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "keys")
    part = F.shiftright("at", 33)
    sizes = dealt.groupBy("kind", part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select(F.col("kind").alias("of"), "part", (before - F.col("first")).alias("shift"))
    out = {}
    for kind, (name, df) in enumerate(keys.items()):
        (column, own), = df.dtypes
        held = dealt.where(F.col("kind") == kind).join(F.broadcast(shifts.where(F.col("of") == kind)), part == F.col("part"))  # one row a range
        out[name] = held.select(F.col(f"k{types.index(own)}").alias(column), (F.col("at") + F.col("shift")).alias(name))
    return out


def assert_contiguous(df: DataFrame, name: str) -> int:
    """The number of rows of df, whose `name` must be 0 .. n-1, each once."""
    n, least, most, different = df.agg(F.count("*"), F.min(name), F.max(name), F.count_distinct(name)).first()
    if n and (least, most, different) != (0, n - 1, n):
        raise ValueError(f"{name} runs from {least} to {most} with {different} values over {n} rows")
    return n
