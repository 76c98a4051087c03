"""Mix sources to target weights: fixed-length blocks, multinomial counts per output shard, permuted block slots."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomset.llm.common import SPACE, broadcast_or_shuffle, free_name, row_key, scratch_root, text_of, written

BLOCK_WORDS = 256
MAX_REPEATS = 3
#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Slots of an output shard, and shards at least.
SHARD_SLOTS, LEAST_SHARDS = 1 << 17, 64
_CHUNK_ROWS, _LEAST_CHUNKS = 20_000, 256
#: Row keys with their numbers of copies are broadcast up to so many rows (12 bytes each).
BROADCAST_ROWS = 1_000_000
_ROUNDS = 4


def word_count(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("bigint")


def capped_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) from one row a source (source, source_size).

    The sources in order of their code points (null last) have the weights in turn and share the sum of all sizes; a
    target stops at cap times its source's size and the excess is shared again by weight until none is above. That is
    target = min(cap * size, level * weight) for one level, found by ordering the sources by cap * size / weight: those
    before some place are at their caps, the rest share what is left. Sources without words have target 0.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")).cast("double")
    ranked = sizes.withColumn("weight", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    up = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    ranked = ranked.withColumn("capped", F.coalesce(F.sum("most").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("open", F.sum("weight").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    level = (F.sum("source_size").over(every) - F.col("capped")) / F.col("open")
    # the first place whose own cap is not reached at the level that holds if all before it are capped
    found = F.min(F.when(F.col("weight") * level <= F.col("most"), F.struct(F.col("most") / F.col("weight"), level))).over(every)
    return ranked.select("source", "source_size", F.least("most", F.col("weight") * found["col2"]).alias("target"))


def _network(x: np.ndarray, half: int, key: int, back: bool = False) -> np.ndarray:
    """A balanced Feistel network on 2 * half bits, or its inverse."""
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> shift, x & mask
    for k in reversed(range(_ROUNDS)) if back else range(_ROUNDS):
        seen = left if back else right
        mixed = (seen + np.uint64((key + (k + 1) * 0x9E3779B97F4A7C15) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ mixed >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
        mixed = (mixed ^ mixed >> np.uint64(29)) & mask
        left, right = (right ^ mixed, left) if back else (right, left ^ mixed)
    return left << shift | right


def permuted(index: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """The images of indices under a pseudorandom permutation of 0 .. n-1 (or its inverse): cycle-walked Feistel."""
    half = max(1, math.ceil((n - 1).bit_length() / 2))
    x = _network(index.astype(np.uint64), half, key, back)
    while (out := x >= n).any():
        x[out] = _network(x[out], half, key, back)
    return x.astype(np.int64)


def source_plan(size: int, target: float, block: int, key: int) -> tuple[int, int, int]:
    """(blocks, slots, last): how many blocks a source fills, how many slots take round(target) words, and how many
    words the last slot takes of its block. The slots run through the permuted blocks again and again."""
    words, blocks = round(target), math.ceil(size / block)
    if not words:
        return blocks, 0, 0
    passes, rest = divmod(words, size)
    short = size - (blocks - 1) * block
    if not rest:
        last = int(permuted(np.array([blocks - 1]), blocks, key)[0])
        return blocks, passes * blocks, short if last == blocks - 1 else block
    at = int(permuted(np.array([blocks - 1]), blocks, key, back=True)[0])  # the slot of the short block
    upto = lambda m: m * block - (block - short) * (at < m)
    slots = math.ceil(rest / block)
    slots += upto(slots) < rest
    return blocks, passes * blocks + slots, rest - upto(slots - 1)


def shard_counts(slots: np.ndarray, shards: int, seed: int) -> Iterator[np.ndarray]:
    """By output shard how many slots each source has there: all shards are of one size, or one slot more.

    Each shard's counts are a multinomial draw of its size by the share of what every source has left; what a source
    has not left is drawn again among the others, and the last shards take the rest. So the sums are exactly slots.
    """
    rng, left = np.random.default_rng(seed), slots.astype(np.int64)
    total = int(left.sum())
    for shard in range(shards):
        missing = total // shards + (shard < total % shards)
        counts = np.zeros(len(left), np.int64)
        while missing:
            open_ = left - counts
            counts += np.minimum(rng.multinomial(missing, open_ / open_.sum()), open_)
            missing = total // shards + (shard < total % shards) - int(counts.sum())
        left = left - counts
        yield counts


def _slots(targets: DataFrame, block: int, shard_slots: int, seed: int) -> DataFrame:
    """(source, shard, slot, block, words): the slots of all output shards; words: null for a whole block.

    The source counts of all shards are drawn in one task, which holds one number a source and gives a row for each
    shard and source in it; slots are mapped to blocks shard by shard.
    """

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)), key=lambda r: (r[0] is None, r[0] or ""))
        if not rows:
            return
        names, keys = pa.array([r[0] for r in rows], pa.string()), np.array([r[1] for r in rows], np.int64)
        plan = np.array([source_plan(size, target, block, key) for _, key, size, target in rows], np.int64)
        shards = max(LEAST_SHARDS, math.ceil(int(plan[:, 1].sum()) / shard_slots))
        first = np.zeros(len(rows), np.int64)
        for shard, counts in enumerate(shard_counts(plan[:, 1], shards, seed)):
            own = np.flatnonzero(counts)
            if len(own):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(own)), pa.array(keys[own]), pa.array(plan[own, 0]), pa.array(plan[own, 1]), pa.array(plan[own, 2]), pa.array(np.full(len(own), shard, np.int32)), pa.array(first[own]), pa.array(counts[own])], names=["source", "key", "blocks", "slots", "last", "shard", "first", "n"])
            first += counts

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot, n, key = (batch.column(i).to_numpy() for i in (2, 3, 4))
            out = np.empty(len(slot), np.int64)
            for k, own in set(zip(key.tolist(), n.tolist(), strict=True)):
                rows = (key == k) & (n == own)
                out[rows] = permuted(slot[rows] % own, own, k)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out), batch.column(5)], names=["source", "shard", "slot", "block", "words"])

    keyed = targets.where("source_size > 0").select("source", F.xxhash64(F.col("source"), F.lit(seed)).alias("key"), "source_size", "target")
    drawn = keyed.coalesce(1).mapInArrow(draw, "source string, key bigint, blocks bigint, slots bigint, last bigint, shard int, first bigint, n bigint")
    spread = drawn.repartition("source", "shard").withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
    named = spread.select("source", "shard", "slot", "blocks", "key", F.when(F.col("slot") == F.col("slots") - 1, F.col("last")).alias("words"))
    return named.mapInArrow(place, "source string, shard int, slot bigint, block bigint, words bigint")


def mixture(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_REPEATS, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix as (rows, slots, targets).

    A token of the blocks is a word. rows: (doc_id, row_key, source, chunk, rank, size, first): each document's words lie from first on among its source's
    words. slots: (source, shard, slot, block, words). targets: (source, source_size, target).
    Null texts and texts without words have size 0 and are never taken; null is a source of its own, after the others.
    Repeated rows count each. The same rows give the same mix, however they are partitioned.
    """
    scratch_root(docs.sparkSession)
    narrow = written(docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("row_key"), F.col(source).cast("string").alias("source"), word_count(text_of(text)).alias("size")), "mixing-rows")
    chunks = max(_LEAST_CHUNKS, math.ceil(narrow.count() / _CHUNK_ROWS))
    # a source's words run by chunk, so that no task needs all rows of a source in order
    by = Window.partitionBy("source", "chunk").orderBy("doc_id", "row_key")
    ranked = narrow.withColumn("chunk", F.pmod("row_key", F.lit(chunks)).cast("int")).withColumn("rank", F.row_number().over(by)).withColumn("before", F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    totals = narrow.withColumn("chunk", F.pmod("row_key", F.lit(chunks)).cast("int")).groupBy("source", "chunk").agg(F.sum("size").alias("n")).checkpoint()
    begins = totals.select(F.col("source").alias("s"), F.col("chunk").alias("c"), F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begin"))
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c"))
    rows = ranked.join(begins, same).select("doc_id", "row_key", "source", "chunk", "rank", "size", (F.col("begin") + F.col("before")).alias("first"))
    targets = capped_targets(totals.groupBy("source").agg(F.sum("n").alias("source_size")), weights, cap).checkpoint()
    return rows, _slots(targets, block, shard_slots, seed), targets


def taken_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_REPEATS, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 7) -> DataFrame:
    """(doc_id, row_key, size, source_size, target, taken) for each row of docs: the words the mix takes, repeats counted."""
    rows, slots, targets = mixture(docs, doc_id, text, source, weights, cap, block, shard_slots, seed)
    use = slots.groupBy(F.col("source").alias("s"), F.col("block").alias("b")).agg(F.count("*").alias("times"), F.min("words").alias("words"))
    places = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("first") / block), F.floor((F.col("first") + F.col("size") - 1) / block)))
    pieces = rows.withColumn("block", F.explode_outer(places))
    lo, hi = F.greatest("first", F.col("block") * block), F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * block)
    pieces = pieces.withColumn("n", hi - lo).withColumn("lo", lo - F.col("block") * block)
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))
    # of a slot that is cut short, its first words are taken
    part = F.when(F.col("words").isNotNull(), F.greatest(F.lit(0), F.least(F.col("n"), F.col("words") - F.col("lo")))).otherwise(0)
    got = F.coalesce(F.col("n") * (F.col("times") - F.col("words").isNotNull().cast("int")) + part, F.lit(0))
    summed = pieces.join(use, same, "left").select("doc_id", "row_key", "source", "chunk", "rank", "size", got.alias("got")).groupBy("source", "chunk", "rank").agg(F.first("doc_id").alias("doc_id"), F.first("row_key").alias("row_key"), F.first("size").alias("size"), F.sum("got").alias("taken"))
    wanted = broadcast_or_shuffle(targets.withColumnRenamed("source", "s"), 100_000)
    return summed.join(wanted, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "row_key", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """Rows of docs as often as the mix takes them: taken / size times, the fraction settled by a hash of the row.

    Columns are those of docs. Rows without words are never taken. Texts are shuffled only if more than BROADCAST_ROWS
    rows are taken.
    """
    share = F.col("taken") / F.col("size")
    chance = F.pmod(F.xxhash64(F.col("row_key"), F.lit("mix")), F.lit(1 << 30)) / (1 << 30)
    found = taken_words(docs, doc_id, text, source, **how).where("taken > 0").groupBy("row_key").agg(F.avg(share).alias("share"))
    times = written(found.select("row_key", (F.floor("share") + (chance < F.col("share") - F.floor("share")).cast("int")).cast("int").alias("n")).where("n > 0"), "mixing-times")
    key = free_name(docs, "__key")
    n = free_name(docs, "__n")
    copy = free_name(docs, "__copy")
    kept = docs.withColumn(key, row_key(doc_id, text)).join(broadcast_or_shuffle(times.toDF(key, n), BROADCAST_ROWS), key)
    return kept.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(docs.columns)
