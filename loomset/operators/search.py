"""Accent-folded substring search, by scan or by a stored index of trigrams, and matching of a title with a fallback."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.functions.text import fold_text
from loomset.operators.recommend import popularity_filter
from loomset.operators.scratch import materialized

#: Characters of a gram, grams looked up for each term, and candidates up to which they are broadcast.
GRAM, PER_TERM, BROADCAST_CANDIDATES = 3, 2, 1_000_000
#: Characters whose grams are taken at once; a longer text stands alone.
_CHARS = 500_000


def search(df: DataFrame, query: str, hay: str = "hay", limit: int = 20, min_pop: int = 0, max_pop: int | None = None, key: str = "ix") -> DataFrame:
    """The most popular rows whose folded text holds every term of the query; no term: no row."""
    terms = fold_text(query).split()
    if not terms:
        return df.limit(0)
    every = reduce(lambda a, b: a & b, (F.contains(F.col(hay), F.lit(t)) for t in terms), F.lit(True))
    return popularity_filter(df.where(every), min_pop, max_pop).orderBy(F.col("pop").desc(), key).limit(limit)


def grams(hay: Column) -> Column:
    """The different runs of GRAM characters of a text, in time linear in its length; null or shorter: an empty array."""
    chars = F.split(F.coalesce(hay, F.lit("")), "")
    starts = F.when(F.size(chars) >= GRAM, F.sequence(F.lit(0), F.size(chars) - GRAM)).otherwise(F.array().cast("array<int>"))
    # the array of characters is bound once; a lambda's body would split the text again for each gram
    bound = F.transform(F.array(F.struct(chars.alias("c"), starts.alias("s"))), lambda x: F.transform(x["s"], lambda i: F.array_join(F.slice(x["c"], i + 1, F.lit(GRAM)), "")))
    return F.array_distinct(F.get(bound, F.lit(0)))


def _text_grams(texts: list[str]) -> tuple[np.ndarray, pa.Array]:
    """(text, gram): the different grams of each text, as grams() has them."""
    sizes = np.array([len(t) for t in texts], np.int64)
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    n = max(0, len(chars) - GRAM + 1)
    code = np.zeros(n, np.int64)
    for i in range(GRAM):
        code = code << 21 | chars[i : i + n]
    text = np.repeat(np.arange(len(texts)), sizes)[:n]
    inside = np.arange(n) + GRAM <= np.cumsum(sizes)[text] if n else np.zeros(0, bool)
    codes, which = np.unique(code[inside], return_inverse=True)
    own = np.unique(text[inside] * max(1, len(codes)) + which)
    names = pa.array(["".join(chr(c >> 21 * i & 0x1FFFFF) for i in reversed(range(GRAM))) for c in codes.tolist()], pa.string())
    return own // max(1, len(codes)), names.take(pa.array(own % max(1, len(codes))))


def _held_grams(df: DataFrame, hay: str, key: str) -> DataFrame:
    """(gram, key): the different grams of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, a = [t or "" for t in batch.column(1).to_pylist()], 0
            while a < len(texts):
                b, total = a + 1, len(texts[a])
                while b < len(texts) and total + len(texts[b]) <= _CHARS:
                    total, b = total + len(texts[b]), b + 1
                row, gram = _text_grams(texts[a:b])
                keys = batch.column(0).take(pa.array(row + a))
                for i in range(0, len(row), 100_000):
                    yield pa.RecordBatch.from_arrays([gram.slice(i, 100_000), keys.slice(i, 100_000)], names=["gram", "key"])
                a = b

    named = df.select(F.col(key).alias("key"), F.col(hay).alias("hay"))
    return named.mapInArrow(run, f"gram string, key {named.schema['key'].dataType.simpleString()}")


def write_gram_index(df: DataFrame, path: str, hay: str = "hay", key: str = "ix") -> None:
    """Write which rows hold which gram below path: (gram, key) in ranges of both, and (gram, n).

    A frequent gram fills several ranges. Lookups read the row groups of their grams alone.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # ranges are found from a first pass over the grams, so they are written before
    held = materialized(_held_grams(df, hay, key), "grams")
    held.repartitionByRange(n, "gram", "key").sortWithinPartitions("gram", "key").write.parquet(f"{path}/rows")
    spark.read.parquet(f"{path}/rows").groupBy("gram").agg(F.count("*").alias("n")).sortWithinPartitions("gram").write.parquet(f"{path}/counts")


def gram_candidates(spark: SparkSession, path: str, query: str) -> tuple[DataFrame, int] | None:
    """((key), most): the keys of rows that hold the rarest grams of each term, and a bound of their number.

    None if no term has a gram, so that every row is a candidate. Only the counts of the query's own grams are collected.
    """
    by_term = [{t[i : i + GRAM] for i in range(len(t) - GRAM + 1)} for t in fold_text(query).split()]
    asked = sorted(set().union(*by_term))
    if not asked:
        return None
    counts = {r["gram"]: r["n"] for r in spark.read.parquet(f"{path}/counts").where(F.col("gram").isin(asked)).collect()}
    chosen = sorted({g for own in by_term for g in sorted(own, key=lambda g: (counts.get(g, 0), g))[:PER_TERM]})
    rows = spark.read.parquet(f"{path}/rows").where(F.col("gram").isin(chosen))
    return rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") == len(chosen)).select("key"), min(counts.get(g, 0) for g in chosen)


def indexed_search(df: DataFrame, path: str, query: str, hay: str = "hay", limit: int = 20, min_pop: int = 0, max_pop: int | None = None, key: str = "ix") -> DataFrame:
    """search() over the rows that write_gram_index() names for the query's rarest grams: the same rows, fewer texts tested."""
    found = gram_candidates(df.sparkSession, path, query)
    if found is not None:
        keys, most = found
        keys = keys.withColumnRenamed("key", key)
        df = df.join(F.broadcast(keys) if most <= BROADCAST_CANDIDATES else keys, key, "left_semi")
    return search(df, query, hay, limit, min_pop, max_pop, key)


def match_title(df: DataFrame, owner: Column, title: Column, owner_is: str, title_is: str, size: str, key: str) -> DataFrame:
    """The row of that owner and title, else of that owner and a title that begins so; of several the largest."""
    tier = F.when(title == title_is, 0).when(F.startswith(title, F.lit(title_is)), 1)
    return df.where(owner == owner_is).withColumn("tier", tier).where("tier is not null").orderBy("tier", F.col(size).desc(), key).limit(1)
