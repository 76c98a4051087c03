"""Near-duplicate vectors: cover trees with halving radii, exact threshold pairs by dual traversal."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomset.llm.common import scratch_root, split_join, written
from loomset.llm.components import connected_components

LEAST_COSINE = 0.9
#: The upper levels are built on so many distinct vectors, the first by a hash of their components.
SAMPLE = 1_024
#: Rows of a block, which holds one lower tree: a 32nd of all, within these bounds. So many blocks make a strip at most.
BLOCK_ROWS, PARTS, STRIP_BLOCKS = (512, 4_096), 32, 16
#: Radii halve from 2, which covers all unit vectors, down to this; below stand the vectors themselves.
LEAST_RADIUS = 2.0**-5
#: Pairs of nodes whose vectors are gathered at once, where too few are left for a product of whole levels.
_GATHER = 1 << 16


@dataclass
class Tree:
    """Unit vectors in the order of the tree. A node is a range of them, its centre the first, so levels nest.

    starts[k], radii[k]: the first places of the nodes of level k and how far from the centre their vectors lie at most.
    The first level is one node, the last has every vector as its own.
    """

    key: np.ndarray
    weight: np.ndarray
    unit: np.ndarray
    starts: list[np.ndarray]
    radii: list[np.ndarray]

    def __post_init__(self) -> None:
        self.plain = self.unit.astype(np.float32)
        self.before = np.concatenate(([0], np.cumsum(self.weight)))

    def ends(self, level: int) -> np.ndarray:
        return np.append(self.starts[level][1:], len(self.key))


def unit_vectors(raw: np.ndarray) -> np.ndarray:
    """Rows at length one in double precision; they are scaled first, so that no square overflows."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _chord(cosine: np.ndarray | float) -> np.ndarray | float:
    return np.sqrt(np.maximum(2.0 - 2.0 * cosine, 0.0))


def _order(unit: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(order, levels): rows so that every node is a range, and by level the node of each row in that order.

    From one radius to its half, a node's rows are taken by its centre first, then by the first row that is left.
    """
    n = len(unit)
    plain = unit.astype(np.float32)
    near = plain @ plain.T
    node = np.zeros(n, np.int64)
    levels = [node]
    radius = 1.0
    while radius >= LEAST_RADIUS and len(np.unique(levels[-1])) < n:
        close = (near >= 1.0 - radius * radius / 2.0) & (node[:, None] == node[None, :])
        np.fill_diagonal(close, True)
        centre = np.full(n, -1)
        alone = close.sum(axis=1) == 1
        centre[alone] = np.flatnonzero(alone)
        # the centre of a node goes first: nodes are numbered by their centres
        rest = np.flatnonzero(~alone)
        rest = rest[np.argsort(node[rest] != rest, kind="stable")]
        for i in rest.tolist():
            if centre[i] < 0:
                centre[close[i] & (centre < 0)] = i
        node = centre
        levels.append(node)
        radius /= 2.0
    levels.append(np.arange(n))
    # by level the centre's own branch first, so that a node's first row is its centre
    keys = []
    for upper, lower in zip(levels[:-1], levels[1:], strict=True):
        keys += [lower != upper, lower]
    order = np.lexsort(keys[::-1]) if n else np.zeros(0, np.int64)
    return order, [level[order] for level in levels]


def build_tree(key: np.ndarray, weight: np.ndarray, raw: np.ndarray) -> Tree:
    """The cover tree of the rows of a block. Levels that hardly split their nodes are left out."""
    unit = unit_vectors(raw)
    order, levels = _order(unit)
    unit = unit[order]
    starts, radii = [], []
    for k, level in enumerate(levels):
        first = np.flatnonzero(np.concatenate(([True], level[1:] != level[:-1])))
        if starts and k < len(levels) - 1 and (len(first) < 1.5 * len(starts[-1]) or len(unit) < 1.5 * len(first)):
            continue
        size = np.diff(np.append(first, len(unit)))
        away = _chord(np.einsum("ij,ij->i", unit, unit[np.repeat(first, size)]))
        away[first] = 0.0
        widest = np.maximum.reduceat(away, first)
        starts.append(first)
        radii.append(np.where(size > 1, widest + 1e-6, 0.0))
    return Tree(key[order], weight[order], unit, starts, radii)


class _Links:
    """What a pair of trees links: by vector the weight of what it meets, and links that join all that meet."""

    def __init__(self, a: Tree, b: Tree) -> None:
        self.a, self.b, self.same = a, b, a is b
        self.met = [np.zeros(len(t.key) + 1, np.int64) for t in (a, b)]  # differences along the order
        self.own = np.zeros(len(a.key) + 1, np.int64)
        self.chain = [np.zeros(len(t.key) + 1, np.int64) for t in (a, b)]
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def whole(self, la: np.ndarray, ha: np.ndarray, lb: np.ndarray, hb: np.ndarray) -> None:
        """All of each range of a link with all of that of b. Within one tree, pairs come from both sides."""
        for side, (low, high, t, lo, hi) in enumerate(((la, ha, self.b, lb, hb), (lb, hb, self.a, la, ha))):
            if side and self.same:
                break
            sums = t.before[hi] - t.before[lo]
            np.add.at(self.met[side], low, sums)
            np.add.at(self.met[side], high, -sums)
        for side, (low, high) in enumerate(((la, ha), (lb, hb))):
            np.add.at(self.chain[side], low, 1)
            np.add.at(self.chain[side], high - 1, -1)
        if self.same:
            own = la == lb
            np.add.at(self.own, la[own], 1)
            np.add.at(self.own, ha[own], -1)
        self.edges.append((la, lb))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, n, label): what each linked vector meets here and the least key that it reaches here."""
        a, b = self.a, self.b
        shift = 0 if self.same else len(a.key)
        key = a.key if self.same else np.concatenate((a.key, b.key))
        n = np.cumsum(self.met[0])[:-1]
        u, v = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (list(zip(*self.edges, strict=True)) or ((), ()))]
        u, v = [u], [v + shift]
        for side, at in enumerate((0, shift)):
            step = np.flatnonzero(np.cumsum(self.chain[side])[:-1] > 0) + at
            u.append(step)
            v.append(step + 1)
        u, v = np.concatenate(u), np.concatenate(v)
        if self.same:
            n = n - np.cumsum(self.own)[:-1] * a.weight  # a vector's copies are counted with it at the end
        else:
            n = np.concatenate((n, np.cumsum(self.met[1])[:-1]))
        place = np.argsort(np.argsort(key))
        label = place.copy()
        while True:
            least = np.minimum(label[u], label[v])
            new = label.copy()
            np.minimum.at(new, u, least)
            np.minimum.at(new, v, least)
            at = np.empty_like(place)
            at[place] = np.arange(len(place))
            new = np.minimum(new, new[at[new]])
            if (new == label).all():
                break
            label = new
        linked = np.flatnonzero((n > 0) | (label != place))
        return key[linked], n[linked], np.sort(key)[label[linked]]


def _cosines(xa: np.ndarray, xb: np.ndarray, i: np.ndarray, j: np.ndarray, dense: bool) -> Iterator[tuple]:
    """(i, j, cosine) in runs, in single precision. dense: (first row, None, all cosines of a run of rows of xa with xb)."""
    if dense:
        for begin in range(0, len(xa), 1_024):
            yield begin, None, (xa[begin : begin + 1_024] @ xb.T).ravel()
    else:
        for begin in range(0, len(i), _GATHER):
            at, bt = i[begin : begin + _GATHER], j[begin : begin + _GATHER]
            yield at, bt, np.einsum("ij,ij->i", xa[at], xb[bt])


def traverse(a: Tree, b: Tree, least_cosine: float = LEAST_COSINE, seen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, n, label) of the vectors of a and b that link across (within, if a is b), by dual traversal from the roots.

    A pair of nodes is left if its centres lie further apart than both radii and the threshold together; it is taken whole
    if they lie so near that the radii cannot part any of it; else its children meet. Bounds bear the error of single
    precision; vectors that they do not decide are compared in double precision. seen: gets the number of pairs of nodes
    that were compared.
    """
    links = _Links(a, b)
    reach = _chord(least_cosine)
    slack = 4.0 * a.unit.shape[1] * np.finfo(np.float32).eps
    ka = kb = 0
    i = j = np.zeros(1, np.int64)
    while len(i):
        last = ka == len(a.starts) - 1 and kb == len(b.starts) - 1
        ra, rb = a.radii[ka], b.radii[kb]
        ea, eb = a.ends(ka), b.ends(kb)
        full = len(ra) * len(rb)
        dense = len(i) * 4 > full
        if dense:
            wanted = None
            if len(i) < full:
                wanted = np.zeros((len(ra), len(rb)), bool)
                wanted[i, j] = True
        next_i, next_j = [], []
        if seen is not None:
            seen.append(full if dense else len(i))
        # wide nodes have bounds of their own; those of one vector share one
        most = reach + ra.max() + rb.max()
        low = 1.0 - most * most / 2.0 - slack
        for at, bt, cosine in _cosines(a.plain[a.starts[ka]], b.plain[b.starts[kb]], i, j, dense):
            if dense:  # a run of whole rows: at is the first of them
                hit = np.flatnonzero(cosine >= low)
                cosine = cosine[hit]
                at, bt = hit // len(rb) + at, hit % len(rb)
                if wanted is not None:
                    ok = wanted[at, bt]
                    at, bt, cosine = at[ok], bt[ok], cosine[ok]
            bound = reach + ra[at] + rb[bt]
            ok = cosine >= 1.0 - bound * bound / 2.0 - slack
            at, bt, cosine = at[ok], bt[ok], cosine[ok]
            inner = reach - ra[at] - rb[bt]
            sure = (inner > 0) & (cosine >= 1.0 - inner * inner / 2.0 + slack)
            if last:
                doubt = np.flatnonzero(~sure)
                for begin in range(0, len(doubt), _GATHER):
                    part = doubt[begin : begin + _GATHER]
                    sure[part] = np.einsum("ij,ij->i", a.unit[a.starts[ka][at[part]]], b.unit[b.starts[kb][bt[part]]]) >= least_cosine
            if sure.any():
                links.whole(a.starts[ka][at[sure]], ea[at[sure]], b.starts[kb][bt[sure]], eb[bt[sure]])
            if not last:
                next_i.append(at[~sure])
                next_j.append(bt[~sure])
        if last:
            break
        i, j = np.concatenate(next_i), np.concatenate(next_j)
        i, j, ka, kb = _children(a, b, ka, kb, i, j)
    return links.rows()


def _children(a: Tree, b: Tree, ka: int, kb: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The pairs of children, on the next level of both trees, of pairs of nodes."""
    up, lows, highs = [], [], []
    for t, k, x in ((a, ka, i), (b, kb, j)):
        below = min(k + 1, len(t.starts) - 1)
        low = np.searchsorted(t.starts[below], t.starts[k])
        high = np.append(low[1:], len(t.starts[below]))
        lows.append(low[x])
        highs.append(high[x])
        up.append(below)
    wide = highs[1] - lows[1]
    many = (highs[0] - lows[0]) * wide
    pair = np.repeat(np.arange(len(i)), many)
    step = np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)
    return lows[0][pair] + step // wide[pair], lows[1][pair] + step % wide[pair], up[0], up[1]


_PACKED = "block int, key binary, weight binary, vectors binary, dim int, single boolean, nodes array<int>, starts binary, radii binary"


def _pack(block: int, t: Tree, raw: np.ndarray) -> dict:
    """A tree as one row; vectors as they came."""
    return {"block": block, "key": t.key.tobytes(), "weight": t.weight.tobytes(), "vectors": raw.tobytes(), "dim": raw.shape[1], "single": raw.dtype == np.float32, "nodes": [len(s) for s in t.starts], "starts": np.concatenate(t.starts).tobytes(), "radii": np.concatenate(t.radii).tobytes()}


def _unpack(row: dict) -> Tree:
    raw = np.frombuffer(row["vectors"], np.float32 if row["single"] else np.float64).reshape(-1, row["dim"])
    cut = np.cumsum(row["nodes"])[:-1]
    starts, radii = np.split(np.frombuffer(row["starts"], np.int64), cut), np.split(np.frombuffer(row["radii"], np.float64), cut)
    return Tree(np.frombuffer(row["key"], np.int64), np.frombuffer(row["weight"], np.int64), unit_vectors(raw), starts, radii)


def _matrix(lists: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1)


def _cells(unit: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of batches (key, weight, v): each row's nearest upper centre and its distance from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            cosine = unit_vectors(_matrix(batch.column("v"))) @ unit.T
            cell = cosine.argmax(axis=1)
            away = _chord(np.take_along_axis(cosine, cell[:, None], 1)[:, 0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(away)], names=[*batch.schema.names, "cell", "away"])

    return run


def _planned(counts: list[tuple[int, int]]) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray, int]:
    """(plan, strip, cell, width): (cell, first block, blocks) by cell, the (strip, cell) pairs, and the blocks of a strip.

    Cells (number, rows) come in the order of the upper tree; small neighbours share a block, large ones are dealt to several.
    """
    size = min(max(BLOCK_ROWS[0], -(-sum(n for _, n in counts) // PARTS)), BLOCK_ROWS[1])
    plan, block, filled = [], 0, 0
    for cell, n in sorted(counts):
        if filled + n > size:
            block, filled = block + (filled > 0), 0
        blocks = -(-n // size)
        plan.append((cell, block, blocks))
        if blocks > 1:
            block += blocks
        else:
            filled += n
    width = min(STRIP_BLOCKS, -(-(block + 1) // (8 * PARTS)))
    pairs = sorted({(b // width, c) for c, first, m in plan for b in range(first, first + m)})
    return plan, np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]), width


def _link_rows(rows: DataFrame, least_cosine: float) -> DataFrame:
    """(key, n, label) from rows (key, weight, v) of vectors of one length: one row for each linked vector and block it meets."""
    spark = rows.sparkSession
    single = rows.schema["v"].dataType.elementType == T.FloatType()
    sample = np.array([r["v"] for r in rows.orderBy(F.xxhash64("v"), "key").select("v").limit(SAMPLE).collect()], np.float64)
    unit = unit_vectors(sample)
    unit = unit[_order(unit)[0]]
    kind = "float" if single else "double"
    dealt = written(rows.mapInArrow(_cells(unit), f"key bigint, weight bigint, v array<{kind}>, cell int, away double"), "cover-cells")
    counts = dealt.groupBy("cell").agg(F.count("*"), F.max("away")).collect()  # one row an upper centre at most
    plan, strip, cell, width = _planned([(c, n) for c, n, _ in counts])
    radius = np.full(len(unit), -np.inf)
    for c, _, away in counts:
        radius[c] = away + 1e-6
    alive = _chord(unit @ unit.T) <= radius[:, None] + radius[None, :] + _chord(least_cosine) + 1e-6
    first = np.flatnonzero(np.concatenate(([True], strip[1:] != strip[:-1])))
    where = spark.createDataFrame(plan, "cell int, first int, blocks int")  # one row an upper centre at most
    block = F.col("first") + F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")

    def pack(table: pa.Table) -> pa.Table:
        raw = _matrix(table["v"].combine_chunks())
        key = table["key"].to_numpy()
        t = build_tree(key, table["weight"].to_numpy(), raw)
        at = np.argsort(key)
        raw = raw[at[np.searchsorted(key[at], t.key)]]
        return pa.Table.from_pylist([_pack(table["block"][0].as_py(), t, raw)], schema=_arrow(_PACKED))

    trees = written(dealt.join(F.broadcast(where), "cell").select(block.alias("block"), "key", "weight", "v").groupBy("block").applyInArrow(pack, _PACKED), "cover-trees")
    held = spark.sparkContext.broadcast((strip, cell, first, alive))

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strips, cells, begin, can = held.value
        for batch in batches:
            found = []
            for b in batch.column("block").to_pylist():
                own = cells[strips == b // width]
                met = strips[begin][np.logical_or.reduceat(can[own].any(axis=0)[cells], begin)]
                found.append([(min(b // width, s), max(b // width, s)) for s in met.tolist()])
            pairs = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array([x * (1 << 32) + y for f in found for x, y in f], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("block"), pairs], names=["block", "pairs"])

    pairs = trees.select("block").mapInArrow(partners, "block int, pairs array<bigint>").select("block", F.explode("pairs").alias("pair"))

    def meet(table: pa.Table) -> pa.Table:
        pair = table["pair"][0].as_py()
        one, other = pair >> 32, pair & 0xFFFFFFFF
        held_trees = {r["block"]: _unpack(r) for r in table.to_pylist()}
        out = []
        for x in sorted(held_trees):
            for y in sorted(held_trees):
                if (x // width, y // width) == (one, other) and x <= y:
                    out.append(traverse(held_trees[x], held_trees[y], least_cosine))
        key, n, label = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"key": key, "n": n, "label": label})

    met = pairs.join(trees, "block").groupBy("pair").applyInArrow(meet, "key bigint, n bigint, label bigint")
    return met


def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])


def _valid(v: Column) -> Column:
    """Whether a vector has only finite components, not all zero."""
    return F.coalesce(F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least_cosine: float = LEAST_COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each row of vectors, linked at a cosine of least_cosine or more.

    n_links counts the other rows that a row links with, copies among them; component_id is the smallest vec_id that links
    reach (null only if no row of the component has an id); kept: whether that is the row's own id (false without one).
    Cosines are taken in double precision. A vector that is null, empty, zero, or holds null or non-finite components
    links with nothing, and vectors of different lengths do not link. Equal vectors are one vertex with a weight. An empty
    table gives an empty result; other columns are ignored. Lengths are taken one after the other: few are expected.

    The upper levels are a cover tree of a bounded sample; their cells (all rows are indexed) are cut into blocks, and each
    block has a cover tree of its own. Blocks whose cells lie too far apart never meet; of the others, each pair of trees
    is traversed in a task. A task takes two strips of blocks, bounded in rows; links leave it as counts and labels by
    vector, not as pairs.
    """
    spark = vectors.sparkSession
    scratch_root(spark)
    kind = vectors.schema[embedding].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    v = F.col(embedding).cast("array<float>" if single else "array<double>")
    rows = written(vectors.select(F.col(vec_id).alias("vec_id"), F.when(_valid(v), v).alias("v")), "cover-rows")
    known = rows.where("v is not null")
    # equal vectors meet by value; 0.0 and -0.0 are equal
    distinct = written(known.groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight")).withColumn("key", F.monotonically_increasing_id()), "cover-distinct")
    found = None
    for (size,) in distinct.select(F.size("v").alias("s")).distinct().orderBy("s").collect():
        part = _link_rows(distinct.where(F.size("v") == size).select("key", "weight", "v"), least_cosine)
        found = part if found is None else found.union(part)
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    if found is None:
        out = alone
    else:
        found = written(found, "cover-links")
        counts = found.groupBy("key").agg(F.sum("n").alias("n"))
        label = connected_components(found.where("key <> label").select(F.col("key").alias("u"), F.col("label").alias("v"))).withColumnRenamed("node", "key")
        nodes = written(distinct.drop("v").join(counts, "key", "left").join(label, "key", "left").withColumn("label", F.coalesce("label", "key")), "cover-labels")
        least = nodes.groupBy("label").agg(F.min("least").alias("component_id"))
        named = split_join(nodes, least, "label").select("key", "component_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
        by_vector = written(distinct.select("key", "v").join(named, "key").drop("key"), "cover-found")
        out = split_join(known, by_vector, "v").select("vec_id", "n_links", "component_id").union(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
