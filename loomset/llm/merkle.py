"""Merkle manifest of a table: sorted leaf runs, level-partitioned node files, proofs by merging runs with their nodes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomset.llm.common import broadcast_or_shuffle, scratch_root, written

#: Levels that one pass over a level's files adds: a run of 2^10 nodes meets in one task.
RUN_LEVELS = 10
#: Sizes of (range, tree) pairs, or trees, up to which they are broadcast.
BROADCAST_ROWS = 200_000
_NODE = "tree string, pos bigint, n bigint, hash string, level int"
_ABOVE = "left array<string>, right array<string>, subroot string, root string"


def leaf_digest(*fields: Column) -> Column:
    """Lowercase hex sha256 of the fields one after the other: `-` for null, else the bytes' number, `:` and the value."""
    parts = []
    for f in fields:
        s = f.cast("string")
        parts.append(F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)))
    return F.sha2(F.concat(*parts), 256)


def fold(leaf: Column, left: Column, right: Column) -> Column:
    """The root that a leaf's digest and its siblings lead to; where a level has no sibling, both are empty."""
    return F.aggregate(F.arrays_zip(left.alias("l"), right.alias("r")), leaf, lambda own, s: F.sha2(F.concat(s["l"], own, s["r"]), 256))


def proof_digest(left: Column, right: Column) -> Column:
    """sha256 of all siblings, level by level."""
    return F.sha2(F.array_join(F.zip_with(left, right, lambda a, b: F.concat(a, b)), ""), 256)


def _height(n: int) -> int:
    """Levels above n nodes until one remains."""
    return max(n - 1, 0).bit_length()


def _height_of(n: Column) -> Column:
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1)))


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (tree, ...) with pos, 0 .. n-1 in each tree by `order`, and n. No tree is sorted or counted in one task.

    Equal rows are told apart by where they were read, so many copies of a row spread over several ranges.
    """
    spark = rows.sparkSession
    by = ["tree", *order, "__salt"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = rows.withColumn("__salt", F.monotonically_increasing_id())
    runs = written(salted.repartitionByRange(n, *by).sortWithinPartitions(*by).drop("__salt").withColumn("at", F.monotonically_increasing_id()), "merkle-runs")
    runs = runs.withColumn("part", F.shiftright("at", 33))
    own = Window.partitionBy("tree")
    before = F.coalesce(F.sum("here").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = runs.groupBy("part", "tree").agg(F.count("*").alias("here"), F.min("at").alias("first"))
    offsets = sizes.select("part", "tree", (before - F.col("first")).alias("shift"), F.sum("here").over(own).alias("n"))
    return runs.join(broadcast_or_shuffle(offsets, BROADCAST_ROWS), ["part", "tree"]).withColumn("pos", F.col("at") + F.col("shift")).select(*rows.columns, "pos", "n")


def _levels(level: int) -> Callable[[pa.Table], pa.Table]:
    """Of a run of nodes of `level`: the nodes that it has on the next RUN_LEVELS levels."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        tree, n, pos, now = table["tree"][0].as_py(), table["n"][0].as_py(), table["pos"][0].as_py(), table["hash"].to_pylist()
        places, hashes, levels = [], [], []
        for up in range(level + 1, min(level + RUN_LEVELS, _height(n)) + 1):
            now = [hashlib.sha256("".join(now[i : i + 2]).encode()).hexdigest() for i in range(0, len(now), 2)]
            pos >>= 1
            places.extend(range(pos, pos + len(now)))
            hashes += now
            levels += [up] * len(now)
        k = len(places)
        return pa.table([pa.array([tree] * k, pa.string()), pa.array(places, pa.int64()), pa.array([n] * k, pa.int64()), pa.array(hashes, pa.string()), pa.array(levels, pa.int32())], names=["tree", "pos", "n", "hash", "level"])

    return run


def _nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_NODE).parquet(path)


def _grow(leaves: DataFrame, path: str) -> int:
    """Write all levels above leaves (tree, pos, n, hash) to path, a folder a level; returns the most leaves of a tree."""
    spark = leaves.sparkSession
    most = leaves.agg(F.max("n")).first()[0] or 0
    spark.createDataFrame([], _NODE).write.partitionBy("level").parquet(path)
    for level in range(0, _height(most), RUN_LEVELS):
        below = leaves if level == 0 else _nodes(spark, path).where(F.col("level") == level)
        runs = below.where(F.col("n") > 1 << level).select("tree", "pos", "n", "hash", F.shiftright("pos", RUN_LEVELS).alias("run"))
        runs.groupBy("tree", "run").applyInArrow(_levels(level), _NODE).write.mode("append").partitionBy("level").parquet(path)
    return most


def _tops(leaves: DataFrame, path: str) -> DataFrame:
    """(tree, n, hash): what remains of each tree."""
    lone = leaves.where("n = 1").select("tree", "n", "hash")
    return lone.union(_nodes(leaves.sparkSession, path).where(F.col("level") == _height_of(F.col("n"))).select("tree", "n", "hash"))


def _siblings(level: int, extra: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a run's nodes of `level`: the siblings inside the run, then those of the run's own ancestors."""

    def run(own: pa.Table, above: pa.Table) -> pa.Table:
        own = own.sort_by([("l", "ascending"), ("pos", "ascending")])
        pos = own["pos"].to_numpy()
        start = np.searchsorted(own["l"].to_numpy(), np.arange(RUN_LEVELS + 1))
        n, m, blank = own["n"][0].as_py(), int(start[1]), len(own)
        upper = [above[side][0].as_py() for side in ("left", "right")]
        hashes = pa.array([*own["hash"].to_pylist(), "", *upper[0], *upper[1]], pa.string())
        height = min(RUN_LEVELS, _height(n) - level)
        sides = []
        for odd in (1, 0):
            index = np.full((m, height + len(upper[0])), blank)
            for j in range(height):
                node = pos[:m] >> j
                at = (node ^ 1) - pos[start[j]]
                index[:, j] = np.where((node & 1 == odd) & (at < start[j + 1] - start[j]), start[j] + at, blank)
            index[:, height:] = blank + 1 + (1 - odd) * len(upper[0]) + np.arange(len(upper[0]))
            sides.append(pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * index.shape[1]), hashes.take(pa.array(index.ravel()))))
        whole = {name: own[name].combine_chunks()[:m] for name in ("tree", "pos", "n", "hash", *extra)}
        ends = {name: pa.array([above[name][0].as_py()] * m, pa.string()) for name in ("subroot", "root")}
        return pa.table(whole | {"left": sides[0], "right": sides[1]} | ends)

    return run


def _prove(leaves: DataFrame, path: str, above: DataFrame, most: int) -> DataFrame:
    """leaves (tree, pos, n, hash, ...) with left and right, all siblings up to the root, and what `above` has of each tree.

    above: (tree, n, left, right, subroot, root). From the top down, each stripe of RUN_LEVELS levels meets the proofs of
    the stripe above it by run: a run has 2^RUN_LEVELS nodes at most, so no key is frequent.
    """
    spark = leaves.sparkSession
    extra = [c for c in leaves.columns if c not in ("tree", "pos", "n", "hash")]
    proven = None
    for level in reversed(range(0, max(_height(most), 1), RUN_LEVELS)):
        more = extra if level == 0 else []
        low = leaves.withColumn("l", F.lit(0)) if level == 0 else _nodes(spark, path).where(F.col("level") == level).withColumn("l", F.lit(0))
        high = _nodes(spark, path).where(F.col("level").between(level + 1, level + RUN_LEVELS - 1)).withColumn("l", F.col("level") - level)
        rows = low.select("tree", "pos", "n", "hash", "l", *more).unionByName(high.select("tree", "pos", "n", "hash", "l"), allowMissingColumns=True)
        rows = rows.where(F.col("n") > (1 << level if level else 0)).withColumn("run", F.expr(f"shiftright(pos, {RUN_LEVELS} - l)"))
        ends = above.where((F.col("n") <= 1 << level + RUN_LEVELS) & (F.col("n") > (1 << level if level else 0))).select("tree", F.lit(0).cast("bigint").alias("run"), "left", "right", "subroot", "root")
        if proven is not None:
            ends = ends.union(proven.select("tree", F.col("pos").alias("run"), "left", "right", "subroot", "root"))
        schema = T.StructType([leaves.schema[c] for c in ("tree", "pos", "n", "hash", *more)]).simpleString()[7:-1].replace(":", " ", 4 + len(more))
        found = rows.groupBy("tree", "run").cogroup(ends.groupBy("tree", "run")).applyInArrow(_siblings(level, more), f"{schema}, {_ABOVE}")
        proven = written(found, "merkle-proofs") if level else found
    return proven


def write_manifest(docs: DataFrame, path: str, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), doc_id: str = "doc_id", group: str = "lang", claimed: Column | None = None) -> None:
    """Write the Merkle manifest of docs below path: leaves, nodes and top, each a Parquet table.

    A row's leaf is leaf_digest() of its fields. Rows of a group are one tree in the order of doc_id (null first; rows of
    one id in the order of their leaves), a null group one of its own. While several nodes remain, each two in a row
    become the digest of both, the last alone if it has no partner. What remains of the groups, null first, then by the
    bytes of their names, is a tree again, with the root of all. claimed: a digest to be held against the manifest, kept
    beside its row's leaf. An empty table has an empty manifest. Other columns are ignored.

    leaves hold each row's place; nodes and top are partitioned by level, and each pass reads one level's files, in runs of
    2^RUN_LEVELS nodes, and writes the levels above. Only nodes of one run meet in a task.
    """
    spark = docs.sparkSession
    scratch_root(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    tree = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    digests = docs.select(tree.alias("tree"), F.col(doc_id).cast(kind).alias("doc_id"), leaf_digest(*map(F.col, fields)).alias("hash"), (F.lit(None).cast("string") if claimed is None else claimed).alias("claimed"))
    _placed(written(digests, "merkle-leaves"), ["doc_id", "hash"]).write.parquet(f"{path}/leaves")
    leaves = spark.read.parquet(f"{path}/leaves")
    _grow(leaves, f"{path}/nodes")
    tops = _tops(leaves, f"{path}/nodes").select(F.lit("").alias("tree"), F.col("tree").alias("group"), F.col("n").alias("rows"), "hash")
    _placed(tops, ["group"]).write.parquet(f"{path}/tops")
    _grow(spark.read.parquet(f"{path}/tops"), f"{path}/top")


def read_proofs(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, leaf, claimed, pos, left, right, subroot, root): every row's proof from a manifest that write_manifest() left.

    left and right hold, for every level from the leaf to the root, the sibling on that side, or an empty text.
    """
    tops, leaves = spark.read.parquet(f"{path}/tops"), spark.read.parquet(f"{path}/leaves")
    none = F.array().cast("array<string>")
    last = _tops(tops, f"{path}/top").select("tree", "n", none.alias("left"), none.alias("right"), F.lit("").alias("subroot"), F.col("hash").alias("root"))
    groups = _prove(tops, f"{path}/top", last, tops.agg(F.max("n")).first()[0] or 0)
    above = written(groups.select(F.col("group").alias("tree"), F.col("rows").alias("n"), "left", "right", F.col("hash").alias("subroot"), "root"), "merkle-tops")
    found = _prove(leaves, f"{path}/nodes", above, leaves.agg(F.max("n")).first()[0] or 0)
    return found.select("doc_id", F.col("hash").alias("leaf"), "claimed", "pos", "left", "right", "subroot", "root")
