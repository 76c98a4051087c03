"""Exact nearest neighbours by inner product: blocks of queries meet the blocks of items that bounds cannot rule out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomset.functions.vectors import dot, doubles
from loomset.operators.scratch import materialized

#: Up to so many items (a count proves it; 32 MB at 64 dimensions) are broadcast to the queries.
BROADCAST_ROWS = 1 << 16
#: Rows of a block at least; there are MOST_BLOCKS and one a centre at most, so that what bounds need of blocks is bounded.
BLOCK_ROWS, MOST_BLOCKS, CENTRES = 4_096, 4_096, 256
#: Blocks of queries, and of items, that meet in one task.
GROUP_BLOCKS = 16
#: Up to so many queries are sent to the items, which are then scanned once and not dealt to blocks.
FEW_QUERIES = 1_024
#: Scores that a task holds at once (16 MB), whatever the numbers of queries, items and blocks.
SCORES_AT_ONCE = 1 << 21
#: How far a score from a matrix product may lie from the sum in order, as a part of the vectors' lengths.
_SLACK = 1e-12
_SCORES = "query bigint, ix bigint, score double"


def top_by_block(items: DataFrame, queries: DataFrame, k: int, exclude_self: bool = True, broadcast_rows: int = BROADCAST_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query, ix, score, place): the k items of the largest inner product with each query, ties to the smaller ix.

    items: (ix, v array<double>), queries: (query, v), each key once. Up to broadcast_rows items go to the queries, whose
    batches answer for themselves: nothing is shuffled. Beyond, up to FEW_QUERIES queries go to the items, which are
    scanned once. Else items and queries are dealt to blocks around centres. A block of queries first meets the item
    block of its own centre; its k-th best score there rules out, query by query, every block whose centre and radius
    (q.c + |q| r) cannot reach it. The pairs of blocks that are left meet in tasks of GROUP_BLOCKS blocks on either
    side, so that a vector is sent once a task. Matrix products only find candidates: scores are sums in order, so that
    copies of a vector tie exactly. An item whose ix is the query is left out with exclude_self.
    """
    own = items.select(F.col("ix").cast("bigint").alias("ix"), doubles(F.col("v")).alias("v"))
    asked = queries.select(F.col("query").cast("bigint").alias("query"), doubles(F.col("v")).alias("v"))
    few = own.limit(broadcast_rows + 1).toArrow()  # bounded; tells whether there are more
    if len(few) <= broadcast_rows:
        return _by_broadcast(few, asked, k, exclude_self)
    del few
    wanted = asked.limit(FEW_QUERIES + 1).toArrow()  # bounded
    if len(wanted) <= FEW_QUERIES:
        return _by_scan(own, *_arrays(wanted), k, exclude_self)
    blocks, kept = item_blocks(own, block_rows, k)
    first = _first_answers(blocks, kept, asked, k, exclude_self)
    pairs = block_pairs(blocks, kept, first)
    return _ranked(_unpacked(first).unionByName(_later_answers(blocks, first, pairs, k, exclude_self)), k)


def top_of_vectors(items: DataFrame, queries: dict[int, list[float]], k: int) -> DataFrame:
    """top_by_block() of a few queries (ix: vector) that the driver holds: one scan of items, k rows a batch and query."""
    ids, matrix = np.array(list(queries), np.int64), np.array(list(queries.values()), float)
    return _by_scan(items.select(F.col("ix").cast("bigint").alias("ix"), doubles(F.col("v")).alias("v")), ids, matrix, k, True)


def _by_scan(own: DataFrame, ids: np.ndarray, matrix: np.ndarray, k: int, exclude_self: bool) -> DataFrame:
    held = own.sparkSession.sparkContext.broadcast((ids, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = held.value
        for batch in batches:
            if len(batch) and len(ids):
                yield _scores(*_best(ids, matrix, *_arrays(batch), k, exclude_self)[:3])

    return _ranked(own.mapInArrow(run, _SCORES), k)


def top_in_plan(items: DataFrame, query: list[float], k: int) -> DataFrame:
    """(ix, score): the k best items for one vector, as one expression over the scan: for a single small query."""
    v = F.array(*map(F.lit, map(float, query)))
    return items.select("ix", dot(doubles(F.col("v")), v).alias("score")).orderBy(F.col("score").desc(), "ix").limit(k)


def _arrays(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys, and vectors as a matrix, of (key, v)."""
    v = batch.column(1)
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    return batch.column(0).to_numpy(), v.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1 if len(batch) else 1)


def _scores(query: np.ndarray, ix: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query), pa.array(ix), pa.array(score)], names=["query", "ix", "score"])


def _firsts(own: np.ndarray, vectors: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(own, vectors) in the order of own, without those that have n copies before them: they are among no n best."""
    order = np.argsort(own, kind="stable")
    own, vectors = own[order], np.ascontiguousarray(vectors[order])
    if not len(own) or not vectors.shape[1]:
        return own, vectors
    which = np.unique(vectors.view(np.dtype((np.void, vectors.shape[1] * 8))).reshape(-1), return_inverse=True)[1].reshape(-1)
    by = np.argsort(which, kind="stable")
    stays = np.ones(len(own), bool)
    stays[by] = np.arange(len(by)) - np.searchsorted(which[by], which[by]) < n
    return own[stays], vectors[stays]


def _sums(a: np.ndarray, r: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows r of a with rows c of b, each summed in order, so that equal vectors give equal scores."""
    out = np.zeros(len(r))
    for d in range(a.shape[1]):
        out += a[r, d] * b[c, d]
    return out


def _best(ids: np.ndarray, queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, k: int, exclude_self: bool, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, ix, score, place) of the k best of own for each query, of at least `least` if given; in runs of queries."""
    out = []
    rows = max(1, min(512, SCORES_AT_ONCE // max(1, len(own))))
    rising = (np.diff(own) > 0).all()
    longest = np.sqrt((vectors * vectors).sum(axis=1)).max(initial=0.0)
    for a in range(0, len(ids), rows):
        some = queries[a : a + rows]
        scores = some @ vectors.T
        if exclude_self:
            if not rising:
                scores[ids[a : a + rows, None] == own[None, :]] = -np.inf
            else:
                at = np.searchsorted(own, ids[a : a + rows])
                same = np.flatnonzero(own[np.minimum(at, len(own) - 1)] == ids[a : a + rows])
                scores[same, at[same]] = -np.inf
        n = min(k, len(own))
        cut = np.partition(scores, len(own) - n, axis=1)[:, len(own) - n]
        if least is not None:
            cut = np.maximum(cut, least[a : a + rows])
        slack = _SLACK * np.sqrt((some * some).sum(axis=1)) * longest
        r, c = np.nonzero(scores >= (cut - slack)[:, None])
        sure = np.isfinite(scores[r, c])
        r, c = r[sure], c[sure]
        s = _sums(some, r, vectors, c)
        order = np.lexsort((own[c], -s, r))
        r, c, s = r[order], c[order], s[order]
        place = np.arange(len(r)) - np.searchsorted(r, r) + 1
        top = place <= k
        out.append((ids[a : a + rows][r[top]], own[c[top]], s[top], place[top].astype(np.int32)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (ids[:0], own[:0], np.zeros(0), np.zeros(0, np.int32))


def _by_broadcast(few: pa.Table, asked: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    held = asked.sparkSession.sparkContext.broadcast(_firsts(*_arrays(few), k + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, vectors = held.value
        for batch in batches:
            if len(batch) and len(own):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _best(*_arrays(batch), own, vectors, k, exclude_self)], names=["query", "ix", "score", "place"])

    return asked.mapInArrow(run, f"{_SCORES}, place int")


_BLOCK = "block int, own binary, v binary, middle array<double>, radius double"


def _schema(columns: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in columns.split(", ")])


def _packed(key: str, copies: int | None) -> Callable[[pa.Table], pa.Table]:
    """Of the rows (key, v, block) of one block: one row in the order of the key, with the block's middle and radius."""

    def run(table: pa.Table) -> pa.Table:
        own, v = _firsts(*_arrays(table.select([key, "v"])), copies or len(table))
        middle = v.mean(axis=0)
        radius = float(np.sqrt(((v - middle) ** 2).sum(axis=1).max())) * (1 + 1e-12)
        return pa.Table.from_pylist([{"block": table["block"][0].as_py(), "own": own.tobytes(), "v": v.tobytes(), "middle": middle.tolist(), "radius": radius}], schema=_schema(_BLOCK))

    return run


def _numbers(cell: pa.Scalar, kind: type = np.float64) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), kind)


def _read(table: pa.Table | pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys, and vectors as a matrix, of a row with own and v, without copying them."""
    own = _numbers(table.column("own")[i], np.int64)
    return own, _numbers(table.column("v")[i]).reshape(len(own), -1)


def _dealt(rows: DataFrame, key: str, centres: np.ndarray, block_rows: int, copies: int | None = None) -> DataFrame:
    """Blocks of rows (key, v): those nearest to one centre, dealt to several blocks by a hash if they are many."""
    held = rows.sparkSession.sparkContext.broadcast(centres)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        half = (c * c).sum(axis=1) / 2
        step = max(1, SCORES_AT_ONCE // len(c))
        for batch in batches:
            for a in range(0, len(batch), step):
                part = batch.slice(a, step)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.argmax(_arrays(part)[1] @ c.T - half, axis=1), pa.int32())], names=[key, "v", "cell"])

    placed = materialized(rows.mapInArrow(near, f"{key} bigint, v array<double>, cell int"), "cells")
    counts = sorted(tuple(r) for r in placed.groupBy("cell").count().collect())  # one row a centre
    size = max(block_rows, -(-sum(n for _, n in counts) // MOST_BLOCKS))
    plan, block = [], 0
    for cell, n in counts:
        plan.append((cell, block, -(-n // size)))
        block += plan[-1][2]
    where = F.broadcast(rows.sparkSession.createDataFrame(plan, "cell int, first int, blocks int"))  # one row a centre
    numbered = placed.join(where, "cell").select(key, "v", (F.col("first") + F.pmod(F.xxhash64(key), "blocks")).cast("int").alias("block"))
    return numbered.groupBy("block").applyInArrow(_packed(key, copies), _BLOCK)


def item_blocks(own: DataFrame, block_rows: int = BLOCK_ROWS, k: int | None = None) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(blocks, (block, centre, radius)): items in blocks, and around what each lies. Centres begin as a bounded sample.

    With k, a block holds of copies of a vector only the first that can be among the k best.
    """
    sample = np.array([r["v"] for r in own.orderBy(F.xxhash64("ix"), "ix").select("v").limit(CENTRES).collect()], float)
    blocks = materialized(_dealt(own, "ix", sample, block_rows, None if k is None else k + 1), "item-blocks")
    kept = blocks.select("block", "middle", "radius").orderBy("block").collect()  # MOST_BLOCKS + CENTRES rows at most
    return blocks, (np.array([r["block"] for r in kept]), np.array([r["middle"] for r in kept]), np.array([r["radius"] for r in kept]))


_FIRST = "block int, own binary, v binary, home int, least binary, query binary, ix binary, score binary"


def _first_answers(blocks: DataFrame, kept: tuple, asked: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """Blocks of queries with their answers from one item block each, and the k-th best score of each query there."""
    # a query's centre is the nearest block of items, so its answers from there are good ones
    numbers, middles, _ = kept
    half = (middles * middles).sum(axis=1) / 2
    groups = materialized(_dealt(asked.withColumnRenamed("query", "ix"), "ix", middles, BLOCK_ROWS), "query-blocks")
    homes = [(r["block"], int(numbers[np.argmax(middles @ np.array(r["middle"]) - half)])) for r in groups.select("block", "middle").collect()]  # as many as blocks of items, and MOST_BLOCKS
    home = F.broadcast(asked.sparkSession.createDataFrame(homes, "block int, home int"))
    # a group is one block of queries and its block of items
    asking = groups.join(home, "block").select("block", "own", "v", "home", F.lit(True).alias("asks"))
    items = blocks.withColumnRenamed("block", "home").join(home, "home").select("block", "own", "v", "home", F.lit(False).alias("asks"))

    def answer(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_pylist().index(True)
        ids, v = _read(table, asks)
        query, ix, score, place = _best(ids, v, *_read(table, 1 - asks), k, exclude_self)
        least = np.full(len(ids), -np.inf)
        full = place == k
        least[np.searchsorted(ids, query[full])] = score[full]
        row = {c: table[c][asks].as_py() for c in ("block", "own", "v", "home")}
        return pa.Table.from_pylist([{**row, "least": least.tobytes(), "query": query.tobytes(), "ix": ix.tobytes(), "score": score.tobytes()}], schema=_schema(_FIRST))

    return materialized(asking.unionByName(items).groupBy("block").applyInArrow(answer, _FIRST), "first-answers")


def _unpacked(first: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for query, ix, score in zip(*batch.columns, strict=True):
                yield _scores(_numbers(query, np.int64), _numbers(ix, np.int64), _numbers(score))

    return first.select("query", "ix", "score").mapInArrow(run, _SCORES)


_PAIR = "item_block int, query_block int, own binary"


def block_pairs(blocks: DataFrame, kept: tuple, first: DataFrame) -> DataFrame:
    """(item_block, query_block, own): of each block of queries, those that an item block may still answer better."""
    numbers, middles, radii = kept
    lengths = np.abs(middles).sum(axis=1)

    def run(table: pa.Table) -> pa.Table:
        ids, v = _read(table, 0)
        least, home, block = _numbers(table["least"][0]), table["home"][0].as_py(), table["block"][0].as_py()
        may, step = np.zeros((len(ids), len(numbers)), bool), max(1, SCORES_AT_ONCE // len(numbers))
        for a in range(0, len(ids), step):
            part = v[a : a + step]
            length = np.sqrt((part * part).sum(axis=1))[:, None]
            # rounding of sums may not rule a block out
            may[a : a + step] = part @ middles.T + length * radii + 1e-9 * (1 + length * (radii + lengths)) >= least[a : a + step, None]
        may[:, numbers == home] = False
        met = np.flatnonzero(may.any(axis=0))
        return pa.Table.from_pylist([{"item_block": int(numbers[j]), "query_block": block, "own": ids[may[:, j]].tobytes()} for j in met], schema=_schema(_PAIR))

    return materialized(first.select("block", "own", "v", "home", "least").groupBy("block").applyInArrow(run, _PAIR), "block-pairs")


def _later_answers(blocks: DataFrame, first: DataFrame, pairs: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """Answers of the pairs of blocks that are left: GROUP_BLOCKS blocks of items and of queries at most meet in a task."""
    group = lambda c: F.floor(F.col(c) / GROUP_BLOCKS).cast("int")
    placed = pairs.withColumns({"item_group": group("item_block"), "query_group": group("query_block")})
    of_items = placed.select("item_block", "item_group", "query_group").distinct().join(blocks.select(F.col("block").alias("item_block"), "own", "v"), "item_block")
    of_queries = placed.select("query_block", "item_group", "query_group").distinct().join(first.select(F.col("block").alias("query_block"), "own", "v", "least"), "query_block")
    every = placed.unionByName(of_items, allowMissingColumns=True).unionByName(of_queries, allowMissingColumns=True)

    def run(table: pa.Table) -> pa.Table:
        items, asking, met = {}, {}, []
        for i, (item, query) in enumerate(zip(table["item_block"].to_pylist(), table["query_block"].to_pylist(), strict=True)):
            if query is None:
                items[item] = _read(table, i)
            elif item is None:
                asking[query] = (*_read(table, i), _numbers(table["least"][i]).copy())
            else:
                met.append((query, item, i))
        out = []
        for query, item, i in sorted(met):
            ids, v, least = asking[query]
            at = np.searchsorted(ids, _numbers(table["own"][i], np.int64))
            found = _best(ids[at], v[at], *items[item], k, exclude_self, least[at])
            out.append(_scores(*found[:3]))
        return pa.Table.from_batches(out)

    return every.groupBy("item_group", "query_group").applyInArrow(run, _SCORES)


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "ix"))
    return scores.withColumn("place", place).where(F.col("place") <= k).select("query", "ix", "score", "place")
