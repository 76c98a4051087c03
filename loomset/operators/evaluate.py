"""Holdout by collection, adjacency lists, popularity-stratified recall and popularity bias."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomset.functions.vectors import doubles, normalized
from loomset.operators.keys import contiguous_index
from loomset.operators.retrieval import top_by_block
from loomset.operators.search import match_title
from loomset.operators.train import triple_loss

#: Popularity strata, lower bounds inclusive.
STRATA = ((0, "a. <10"), (10, "b. 10-49"), (50, "c. 50-199"), (200, "d. 200-999"), (1000, "e. >=1000"))
#: The final evaluation's lengths of answers, and how many probes it takes.
FINAL_KS, FINAL_PROBES = (10, 50, 100), 5_000


def holdout_split(pairs: DataFrame, holdout: int, seed: int = 7, collection: str = "collection_ix") -> tuple[DataFrame, DataFrame]:
    """(train, held): the pairs of so many collections, the first by a seeded hash, are held out."""
    chosen = pairs.select(collection).distinct().orderBy(F.xxhash64(F.col(collection), F.lit(seed)), collection).limit(holdout)
    return pairs.join(chosen, collection, "left_anti"), pairs.join(chosen, collection, "left_semi")


def adjacency(pairs: DataFrame, collection: str = "collection_ix", item: str = "item") -> DataFrame:
    """(collection, items, start): each collection's items in order, and where its slots begin among all slots."""
    lists = pairs.groupBy(collection).agg(F.sort_array(F.collect_list(item)).alias("items"))
    n = F.size("items")
    # the running sum over all collections goes by ranges: each range's sum is one row
    ranged = contiguous_index(lists, collection, "__at").withColumn("__range", F.floor(F.col("__at") / 4096))
    inside = F.sum(n).over(Window.partitionBy("__range").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - n
    sums = ranged.groupBy("__range").agg(F.sum(n).alias("__n"))
    before = sums.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return ranged.withColumn("__inside", inside).join(before, "__range").select(collection, "items", (F.col("__before") + F.col("__inside")).cast("long").alias("start"))


def item_frequency(pairs: DataFrame, n_items: int, item: str = "item") -> DataFrame:
    """(item, freq) for items 0 .. n_items-1, 0 where there is none."""
    spark = pairs.sparkSession
    return spark.range(n_items).withColumnRenamed("id", item).join(pairs.groupBy(item).agg(F.count("*").alias("freq")), item, "left").fillna(0, ["freq"])


def stratum(freq: Column, strata: tuple = STRATA) -> Column:
    """The label of the highest stratum whose lower bound freq reaches."""
    out = F.lit(strata[0][1])
    for low, label in strata[1:]:
        out = F.when(freq >= low, label).otherwise(out)
    return out


def probes(adj: DataFrame) -> DataFrame:
    """(query, seed, targets) of collections with two items or more: the smallest item is the seed."""
    first = adj.columns[0]
    return adj.where(F.size("items") >= 2).select(F.col(first).alias("query"), F.get("items", F.lit(0)).alias("seed"), F.array_except(F.slice("items", 2, 1_000_000_000), F.array()).alias("targets"))


def neighbours(tests: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(seed, top array<bigint>): the k nearest items of each different seed in probes(), itself left out."""
    seeds = tests.select(F.col("seed").alias("ix")).distinct().join(vectors, "ix").select(F.col("ix").alias("query"), "v")
    top = top_by_block(vectors, seeds, k)
    return top.groupBy(F.col("query").alias("seed")).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "ix"))), lambda x: x["ix"]).alias("top"))


def hits(tests: DataFrame, top: DataFrame) -> DataFrame:
    """(query, seed, target, hit) of every target of every probe with neighbours."""
    return tests.join(top, "seed").select("query", "seed", F.explode("targets").alias("target"), "top").select("query", "seed", "target", F.array_contains("top", F.col("target")).cast("int").alias("hit"))


def recall(found: DataFrame) -> DataFrame:
    """One row: hits, targets and recall over all targets together."""
    return found.agg(F.sum("hit").alias("hits"), F.count("*").alias("targets"), F.try_divide(F.sum("hit"), F.count("*")).alias("recall"))


def recall_by_stratum(found: DataFrame, freq: DataFrame, by: str, item: str = "item") -> DataFrame:
    """(stratum, hits, targets, recall) by the popularity of the seed or the target."""
    # counted by item before the join, so that a frequent item's rows never meet in one task
    counted = found.groupBy(by).agg(F.sum("hit").alias("hits"), F.count("*").alias("targets"))
    joined = counted.join(freq.select(F.col(item).alias(by), "freq"), by, "left").withColumn("stratum", stratum(F.coalesce("freq", F.lit(0))))
    return joined.groupBy("stratum").agg(F.sum("hits").alias("hits"), F.sum("targets").alias("targets"), (F.sum("hits") / F.sum("targets")).alias("recall"))


def most_popular(freq: DataFrame, k: int, item: str = "item") -> DataFrame:
    """The k items of the largest frequency, ties to the smaller."""
    return freq.orderBy(F.col("freq").desc(), item).limit(k)


def popularity_baseline(tests: DataFrame, freq: DataFrame, k: int, item: str = "item") -> DataFrame:
    """(hits, targets, recall) if every probe is answered with the same k most popular items."""
    tops = [r[item] for r in most_popular(freq, k, item).collect()]  # k items
    return recall(tests.select("seed", F.explode("targets").alias("target")).withColumn("hit", F.col("target").isin(tops).cast("int")))


def final_evaluation(tests: DataFrame, vectors: DataFrame, freq: DataFrame, ks: tuple[int, ...] = FINAL_KS, sample: int | None = FINAL_PROBES, seed: int = 12345, item: str = "item") -> DataFrame:
    """(k, hits, pop_hits, targets, recall, pop_recall, lift) of each k over a fixed sample of the probes.

    The sample is the first so many probes by a hash of query and seed, so runs of different lengths are compared on the
    same probes; with no more probes than that, or with None, it is all of them. Neighbours are searched once, for the largest k.
    """
    kept = tests if sample is None else tests.orderBy(F.xxhash64(F.lit(seed), "query"), "query").limit(sample)
    tops = [r[item] for r in most_popular(freq, max(ks), item).collect()]  # the largest k items
    found = kept.join(neighbours(kept, vectors, max(ks)), "seed").select("top", F.explode("targets").alias("target"))
    place, popular = F.array_position("top", F.col("target")), F.array_position(F.array(*map(F.lit, tops)), F.col("target"))
    by = found.select(F.explode(F.array(*map(F.lit, ks))).alias("k"), place.alias("place"), popular.alias("popular")).groupBy("k")
    hits = lambda c: F.count_if((F.col(c) > 0) & (F.col(c) <= F.col("k")))
    counted = by.agg(hits("place").alias("hits"), hits("popular").alias("pop_hits"), F.count("*").alias("targets"))
    return counted.select(F.col("k").cast("long").alias("k"), "hits", "pop_hits", "targets", (F.col("hits") / F.col("targets")).alias("recall"), (F.col("pop_hits") / F.col("targets")).alias("pop_recall"), (F.col("hits") / F.greatest("pop_hits", F.lit(1))).alias("lift"))


def popularity_ranks(freq: DataFrame, item: str = "item") -> DataFrame:
    """(item, rank): 0 for the most popular, ties by item."""
    ranked = freq.withColumn("__key", F.struct(-F.col("freq"), item))
    return contiguous_index(ranked, "__key", "rank").select(item, "rank")


def popularity_bias(top: DataFrame, ranks: DataFrame, n_items: int, item: str = "item") -> DataFrame:
    """One row: mean popularity rank of the neighbours and its percentile among n_items."""
    given = top.select("seed", F.explode("top").alias(item)).join(ranks, item)
    return given.agg(F.avg("rank").alias("mean_rank"), (F.lit(100.0) * F.avg("rank") / n_items).alias("percentile"))


def same_creator_share(top: DataFrame, creators: DataFrame, item: str = "item") -> DataFrame:
    """One row: share of neighbours with their seed's creator, over seeds that have one."""
    own = creators.select(F.col(item).alias("seed"), F.col("creator").alias("a")).where("a is not null")
    pairs = top.join(own, "seed").select("a", F.explode("top").alias(item)).join(creators, item, "left")
    return pairs.agg(F.avg(F.coalesce((F.col("creator") == F.col("a")).cast("double"), F.lit(0.0))).alias("share"), F.count("*").alias("n"))


def recall_evaluator(tests: DataFrame, k: int):
    """A function of a table (ix, v) that gives recall at k over probes(), for choosing the epoch to keep."""
    kept = tests.persist()

    def score(vectors: DataFrame) -> float:
        unit = vectors.select("ix", normalized(doubles(F.col("v"))).alias("v"))
        return float(recall(hits(kept, neighbours(kept, unit, k))).first()["recall"] or 0.0)

    return score


def loss_evaluator(triples: DataFrame):
    """A function of a table (ix, v) that gives minus the mean loss over fixed triples (anchor, pos, neg)."""
    kept = triples.persist()
    return lambda vectors: -float(triple_loss(kept, vectors).first()["loss"])


def nearest_to_title(rows: DataFrame, vectors: DataFrame, owner: str, title: str, k: int = 8) -> DataFrame:
    """The k nearest items to the row of an owner and title, with their names; no such row: none.

    rows: (ix, owner, title, n_tracks).
    """
    found = match_title(rows, F.col("owner"), F.col("title"), owner, title, "n_tracks", "ix").select(F.col("ix").alias("query"))
    query = found.join(vectors.withColumnRenamed("ix", "query"), "query").select("query", "v")
    return top_by_block(vectors, query, k).join(rows, "ix").select("place", "ix", "owner", "title", "score").orderBy("place")
