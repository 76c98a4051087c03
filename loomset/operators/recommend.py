"""Two-stage recommendation from several seeds: candidates by each seed, then z-scored re-ranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomset.functions.vectors import dot, doubles, hump
from loomset.operators.retrieval import top_of_vectors


@dataclass(frozen=True)
class Params:
    """Weights and filters of one request. The defaults."""

    k: int = 5
    n_candidates: int = 1000
    w_album: float = 0.6
    w_artist: float = 0.15
    w_pop: float = 0.25
    w_consistency: float = 0.5
    dup_penalty: float = 0.1
    pop_peak: float = 30.0
    pop_width: float = 1.0
    exclude_same_artist: bool = False
    min_pop: int = 0
    max_pop: int | None = None


def zscore(c: Column, over: Window) -> Column:
    """c less its mean over its population deviation; 0 where that is 1e-8 or less."""
    s = F.stddev_pop(c).over(over)
    return F.when(s > 1e-8, (c - F.avg(c).over(over)) / s).otherwise(F.lit(0.0))


def zscores(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with the z-score over all rows of each named column: the means and deviations are one row joined back."""
    stats = df.agg(*(f(c).alias(f"__{k}_{c}") for c in set(columns.values()) for k, f in (("avg", F.avg), ("std", F.stddev_pop))))
    joined = df.join(F.broadcast(stats))  # one row
    return joined.select(*df.columns, *(F.when(F.col(f"__std_{c}") > 1e-8, (F.col(c) - F.col(f"__avg_{c}")) / F.col(f"__std_{c}")).otherwise(F.lit(0.0)).alias(n) for n, c in columns.items() if n not in df.columns))


def popularity_filter(df: DataFrame, min_pop: int, max_pop: int | None) -> DataFrame:
    """Rows with pop in a range; a minimum of 0 and a maximum of None demand nothing."""
    if min_pop > 0:
        df = df.where(F.col("pop") >= min_pop)
    return df if max_pop is None else df.where(F.col("pop") <= max_pop)


def scored_candidates(items: DataFrame, creators: DataFrame, seeds: list[int], p: Params) -> DataFrame:
    """All candidates of a request with their scores.

    items: (ix, creator, pop, v), creators: (creator, v), vectors normalized. seeds may repeat and count as often. An
    item without a creator adds no creator cosine and never counts as a repetition. The repetitions of a creator before
    an item in the preliminary order are its row number among that creator's candidates, so no loop is needed.
    """
    vectors = items.where(F.col("ix").isin(seeds)).select("ix", F.col("creator").alias("s_creator"), doubles(F.col("v")).alias("s_v"))
    known = {r["ix"]: r for r in vectors.collect()}  # one row a seed
    missing = [s for s in seeds if s not in known]
    if missing:
        raise ValueError(f"unknown items: {missing}")
    owners = sorted({r["s_creator"] for r in known.values()} - {None})
    valid = popularity_filter(items.where(~F.col("ix").isin(seeds)), p.min_pop, p.max_pop)
    if p.exclude_same_artist and owners:
        valid = valid.where(F.col("creator").isNull() | ~F.col("creator").isin(owners))
    pool = top_of_vectors(valid.select("ix", "v"), {s: known[s]["s_v"] for s in sorted(known)}, p.n_candidates).select("ix").distinct()
    cand = valid.join(F.broadcast(pool) if p.n_candidates * len(known) <= 100_000 else pool, "ix")

    own_creator = {r["creator"]: r["v"] for r in creators.where(F.col("creator").isin(owners)).select("creator", doubles(F.col("v")).alias("v")).collect()} if owners else {}
    seed_vectors = [F.array(*map(F.lit, known[s]["s_v"])) for s in seeds]
    creator_vectors = [F.array(*map(F.lit, own_creator[c])) for c in (known[s]["s_creator"] for s in seeds) if c in own_creator]
    cand = cand.join(creators.select("creator", doubles(F.col("v")).alias("c_v")), "creator", "left").withColumn("v", doubles(F.col("v")))
    cand = cand.withColumn("cosines", F.array(*(dot(F.col("v"), s) for s in seed_vectors)))
    total = F.aggregate("cosines", F.lit(0.0), lambda a, x: a + x)
    mean = total / len(seeds)
    spread = F.sqrt(F.aggregate(F.transform("cosines", lambda x: (x - F.col("mean")) * (x - F.col("mean"))), F.lit(0.0), lambda a, x: a + x) / len(seeds))
    creator_sum = sum((F.coalesce(dot(F.col("c_v"), c), F.lit(0.0)) for c in creator_vectors), F.lit(0.0))
    cand = cand.withColumn("raw", total).withColumn("mean", mean).withColumn("spread", spread)
    cand = cand.select("ix", "creator", "pop", "raw", "spread", F.array_min("cosines").alias("worst"), creator_sum.alias("c_raw"), hump(F.col("pop"), p.pop_peak, p.pop_width).alias("pop_boost"))
    every = Window.partitionBy()  # at most n_candidates rows a seed
    cand = cand.withColumn("ca", F.col("raw") - F.lit(p.w_consistency * len(seeds)) * F.col("spread"))
    fixed = p.w_album * zscore(F.col("ca"), every) + p.w_pop * F.col("pop_boost")
    cand = cand.withColumn("prelim", fixed + p.w_artist * zscore(F.col("c_raw"), every)).withColumn("fixed", fixed)
    if p.dup_penalty > 0 and p.w_artist > 0:
        before = F.row_number().over(Window.partitionBy("creator").orderBy(F.col("prelim").desc(), "ix")) - 1 + F.col("creator").isin(owners).cast("int")
        cand = cand.withColumn("occ", F.when(F.col("creator").isNotNull(), before).otherwise(0))
    else:
        cand = cand.withColumn("occ", F.lit(0))
    cand = cand.withColumn("dup", p.dup_penalty * F.col("occ")).withColumn("cr", F.col("c_raw") - F.col("dup"))
    cand = cand.withColumn("score", F.col("fixed") + p.w_artist * zscore(F.col("cr"), every))
    n = float(len(seeds))
    return cand.withColumn("rank_album", F.row_number().over(Window.orderBy(F.col("raw").desc(), "ix"))).select(
        "ix", "creator", "pop", "score", (F.col("raw") / n).alias("cos_album"), (F.col("cr") / n).alias("cos_artist"), "spread",
        (p.w_consistency * F.col("spread")).alias("cons"), "worst", "dup", "pop_boost", "rank_album", F.col("occ").cast("long").alias("occ"),
    )


def recommend(items: DataFrame, creators: DataFrame, seeds: list[int], p: Params = Params()) -> DataFrame:
    """The k best candidates with place and shift, by how much re-ranking moved them up from their raw rank."""
    best = scored_candidates(items, creators, seeds, p).orderBy(F.col("score").desc(), "ix").limit(p.k)
    place = F.row_number().over(Window.orderBy(F.col("score").desc(), "ix"))
    return best.withColumn("place", place).withColumn("shift", F.col("rank_album") - F.col("place"))
