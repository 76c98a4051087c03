"""Pairwise-ranking embeddings: bulk-synchronous epochs over anchor slots, with the item table broadcast or joined."""

from __future__ import annotations

import json
import math
import warnings
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomset.functions.vectors import dot, neg_log_sigmoid
from loomset.operators.scratch import materialized
from loomset.sources.sinks import names_in, read_text, remove, write_text

#: The item table is broadcast as float32 up to so many bytes; beyond, its vectors are joined to the triples.
BROADCAST_BYTES = 512_000_000
#: Probes on which an epoch is scored, and how many neighbours they get. The defaults.
EVAL_PROBES, EVAL_K = 2_000, 10
#: What the folders of a run begin with.
_OWN_FOLDERS = ("init", "epoch-", "step-", "grads-")


@dataclass(frozen=True)
class TrainConfig:
    """The defaults."""

    dim: int = 128
    negatives: int = 20
    learning_rate: float = 0.001
    epochs: int = 120
    patience: int = 5
    power: float = 0.75
    init_scale: float = 0.1
    steps_per_epoch: int = 8
    seed: int = 7
    beta1: float = 0.9
    beta2: float = 0.999
    epsilon: float = 1e-8
    min_gain: float = 1e-6


def negative_cdf(freq: DataFrame, power: float = 0.75, item: str = "item") -> DataFrame:
    """(item, p, cdf_prev, cdf): sampling shares in proportion to freq to a power; items without a row count 1.

    The running sum goes by ranges of items, so no task sees all of them.
    """
    weight = F.pow(F.greatest("freq", F.lit(1)).cast("double"), F.lit(power))
    own = Window.partitionBy("r").orderBy(item)
    ranged = freq.select(item, weight.alias("w")).withColumn("r", F.floor(F.col(item) / 65_536))
    ranged = ranged.withColumn("inside", F.sum("w").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ranged = ranged.withColumn("earlier", F.coalesce(F.lag("inside").over(own), F.lit(0.0)))
    # a range ends where its last running sum does, so that each item begins exactly where the one before it ends
    sums = ranged.groupBy("r").agg(F.max("inside").alias("s"))
    total = F.sum("s").over(Window.partitionBy())
    before = sums.select("r", total.alias("total"), F.coalesce(F.sum("s").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))
    out = ranged.join(F.broadcast(before), "r")  # one row for 65,536 items
    until = lambda c: (F.col("before") + F.col(c)) / F.col("total")
    return out.select(item, (F.col("w") / F.col("total")).alias("p"), until("earlier").alias("cdf_prev"), until("inside").alias("cdf"))


def drawn_items(draws: DataFrame, cdf: DataFrame, item: str = "item", buckets: int = 1 << 20) -> DataFrame:
    """draws (u in (0, 1], others) with the item whose share of negative_cdf() holds u.

    Both sides meet by equal slices of (0, 1]: an item stands in every slice that its share touches, a draw in one.
    """
    slices = lambda c: F.least(F.floor(c * buckets), F.lit(buckets - 1))
    spread = cdf.select(item, "cdf_prev", "cdf", F.explode(F.sequence(slices(F.col("cdf_prev")), slices(F.col("cdf")))).alias("__slice"))
    held = (F.col("u") > F.col("cdf_prev")) & (F.col("u") <= F.col("cdf"))
    return draws.withColumn("__slice", slices(F.col("u"))).join(spread, "__slice").where(held).select(*draws.columns, item)


def anchors(adj: DataFrame) -> DataFrame:
    """(items, at, anchor): every slot of every list of two or more items anchors once."""
    return adj.where(F.size("items") >= 2).select("items", F.posexplode("items").alias("at", "anchor"))


def positive(items: Column, at: Column, u: Column) -> Column:
    """Another slot's item: u in [0, 1) picks evenly among the other slots."""
    n = F.size(items)
    return F.get(items, F.pmod(at + 1 + F.floor(u * (n - 1)).cast("int"), n))


def triple_loss(triples: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: mean -ln sigmoid(a.p - a.n) of triples (anchor, pos, neg) over vectors (ix, v array<double>)."""
    side = lambda name: vectors.select(F.col("ix").alias(name), F.col("v").alias(f"v_{name}"))
    joined = triples.join(side("anchor"), "anchor").join(side("pos"), "pos").join(side("neg"), "neg")
    return joined.agg(F.avg(neg_log_sigmoid(dot(F.col("v_anchor"), F.col("v_pos")) - dot(F.col("v_anchor"), F.col("v_neg")))).alias("loss"), F.count("*").alias("n"))


def initial_table(spark: SparkSession, n_items: int, config: TrainConfig) -> DataFrame:
    """(ix, v, m1, m2, t): normal vectors of deviation init_scale / sqrt(dim), the same for the same seed."""
    scale = config.init_scale / math.sqrt(config.dim)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v = [np.random.default_rng([config.seed, int(i)]).normal(0, scale, config.dim) for i in batch["id"]]
            zero = [np.zeros(config.dim)] * len(batch)
            yield pd.DataFrame({"ix": batch["id"], "v": v, "m1": zero, "m2": zero, "t": 0})

    return spark.range(n_items).mapInPandas(run, "ix bigint, v array<double>, m1 array<double>, m2 array<double>, t int")


def drawn(slots: DataFrame, config: TrainConfig, step: int) -> DataFrame:
    """(anchor, pos, us): each slot's positive, and config.negatives numbers in (0, 1] that name its negatives.

    All come from hashes of the seed, the step and the slot, so a task that runs again draws the same.
    """
    uniform = lambda j: (F.shiftrightunsigned(F.xxhash64(F.lit(config.seed), F.lit(step), "anchor", "at", "items", j), 11) + 1) * F.lit(2.0**-53)
    pos = positive(F.col("items"), F.col("at"), uniform(F.lit(-1)) - F.lit(2.0**-53))
    return slots.select("anchor", pos.alias("pos"), F.transform(F.sequence(F.lit(0), F.lit(config.negatives - 1)), uniform).alias("us"))


def _summed(a: np.ndarray, p: np.ndarray, q: np.ndarray, va: np.ndarray, vp: np.ndarray, vq: np.ndarray) -> pd.DataFrame:
    """(ix, grad, n, loss) of triples by item; n and loss stand on the first row."""
    n, k, dim = vq.shape
    margin = (va * vp).sum(1)[:, None] - np.einsum("nd,nkd->nk", va, vq)
    loss = np.logaddexp(0, -margin)
    slope = -1 / (1 + np.exp(np.clip(margin, -500, 500))) / k
    whole = slope.sum(1)[:, None]
    rows = np.concatenate([a, p, q.ravel()])
    parts = np.concatenate([whole * vp - np.einsum("nk,nkd->nd", slope, vq), whole * va, (-slope[:, :, None] * va[:, None, :]).reshape(-1, dim)])
    ix, inverse = np.unique(rows, return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    grad = np.add.reduceat(parts[order], np.searchsorted(inverse[order], np.arange(len(ix))), axis=0)
    share, count = np.zeros(len(ix)), np.zeros(len(ix), np.int64)
    share[0], count[0] = loss.mean(1).sum(), n
    return pd.DataFrame({"ix": ix, "grad": list(grad), "n": count, "loss": share})


def gradients(slots: DataFrame, table: DataFrame, cdf: DataFrame, config: TrainConfig, step: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(ix, grad, n, loss): summed gradients of one step over anchor slots (items, at, anchor), by item.

    Up to broadcast_bytes of float32 vectors the table is broadcast; beyond, vectors are joined to the triples, which
    gives the same sums. Each Arrow batch adds up its own gradients, so one row an item and batch is shuffled.
    """
    last = table.agg(F.max("ix")).first()[0]
    n = 0 if last is None else last + 1
    held = table.select("ix", F.col("v").cast("array<float>").alias("v"))
    make = _by_broadcast if n * config.dim * 4 <= broadcast_bytes else _by_join
    found = make(drawn(slots, config, step), held, cdf, n)
    dims = [F.sum(F.get("grad", F.lit(i))).alias(f"g{i}") for i in range(config.dim)]
    return found.groupBy("ix").agg(*dims, F.sum("n").alias("n"), F.sum("loss").alias("loss")).select("ix", F.array(*(f"g{i}" for i in range(config.dim))).alias("grad"), "n", "loss")


_GRADIENTS = "ix bigint, grad array<double>, n bigint, loss double"


def _by_broadcast(triples: DataFrame, table: DataFrame, cdf: DataFrame, n: int) -> DataFrame:
    rows, shares = table.toArrow(), cdf.select("item", "cdf").toArrow()
    vectors = np.stack(rows.column("v").to_numpy()) if len(rows) else np.zeros((0, 1), np.float32)
    weights, bounds = np.zeros((n, vectors.shape[1]), np.float32), np.zeros(n)
    weights[rows.column("ix").to_numpy()] = vectors
    bounds[shares.column("item").to_numpy()] = shares.column("cdf").to_numpy()
    held = triples.sparkSession.sparkContext.broadcast((weights, np.maximum.accumulate(bounds)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, bounds = held.value
        for batch in batches:
            if len(batch):
                a, p = batch["anchor"].to_numpy(), batch["pos"].to_numpy()
                q = np.minimum(np.searchsorted(bounds, np.stack(batch["us"].to_numpy())), len(bounds) - 1)
                yield _summed(a, p, q, *(weights[x].astype(float) for x in (a, p, q)))

    return triples.mapInPandas(run, _GRADIENTS)


def _by_join(triples: DataFrame, table: DataFrame, cdf: DataFrame, n: int) -> DataFrame:
    # written once, so that a slot keeps its number
    slots = materialized(triples.withColumn("slot", F.monotonically_increasing_id()), "slots")
    draws = slots.select("slot", F.posexplode("us").alias("j", "u"))
    side = lambda name: table.select(F.col("ix").alias(name), F.col("v").alias(f"v_{name}"))
    q = drawn_items(draws, cdf).join(side("item"), "item").groupBy("slot").agg(F.sort_array(F.collect_list(F.struct("j", "item", "v_item"))).alias("q"))  # config.negatives rows a slot
    full = slots.select("slot", "anchor", "pos").join(side("anchor"), "anchor").join(side("pos"), "pos").join(q, "slot")
    flat = full.select("anchor", "pos", "v_anchor", "v_pos", F.transform("q", lambda x: x["item"]).alias("q"), F.flatten(F.transform("q", lambda x: x["v_item"])).alias("v_q"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                a, p, q = batch["anchor"].to_numpy(), batch["pos"].to_numpy(), np.stack(batch["q"].to_numpy())
                va, vp, vq = (np.stack(batch[c].to_numpy()).astype(float) for c in ("v_anchor", "v_pos", "v_q"))
                yield _summed(a, p, q, va, vp, vq.reshape(*q.shape, -1))

    return flat.mapInPandas(run, _GRADIENTS)


def adam_step(table: DataFrame, grads: DataFrame, config: TrainConfig, anchors_seen: int) -> DataFrame:
    """The table after one lazy Adam step: only items with a gradient move, each by its own step count."""
    mean = F.transform("grad", lambda g: g / anchors_seen)
    out = table.join(grads.select("ix", mean.alias("grad")), "ix", "left")
    hit = F.col("grad").isNotNull()
    t = F.col("t") + 1
    m1 = F.zip_with("m1", "grad", lambda m, g: config.beta1 * m + (1 - config.beta1) * g)
    m2 = F.zip_with("m2", "grad", lambda m, g: config.beta2 * m + (1 - config.beta2) * g * g)
    out = out.select("ix", "v", F.when(hit, m1).otherwise(F.col("m1")).alias("m1"), F.when(hit, m2).otherwise(F.col("m2")).alias("m2"), F.when(hit, t).otherwise(F.col("t")).alias("t"), hit.alias("hit"))
    c1, c2 = 1 - F.pow(F.lit(config.beta1), F.col("t")), 1 - F.pow(F.lit(config.beta2), F.col("t"))
    moved = F.zip_with("v", F.zip_with("m1", "m2", lambda a, b: config.learning_rate * (a / c1) / (F.sqrt(b / c2) + config.epsilon)), lambda x, d: x - d)
    return out.select("ix", F.when(F.col("hit"), moved).otherwise(F.col("v")).alias("v"), "m1", "m2", "t")


def train(adj: DataFrame, freq: DataFrame, n_items: int, config: TrainConfig, run_dir: str, evaluate=None, resume: bool = False, held: DataFrame | None = None, broadcast_bytes: int = BROADCAST_BYTES, keep_all: bool = False) -> tuple[DataFrame, list[dict]]:
    """Train on lists (collection, items); returns the best table (ix, v) and the history of epochs.

    State is written below run_dir after every step as Parquet, with settings and history in meta.json, which is moved
    into place whole. An epoch's score, larger is better, is evaluate(table) if given; else the recall at EVAL_K of the
    first EVAL_PROBES of held (probes of held-out collections) by a hash; without either minus the epoch's loss. Training
    stops after config.patience epochs without a gain of config.min_gain, and the best epoch's table is what comes back.
    Gradients and tables of steps go once the next table is written, tables of epochs but the best and the last once
    meta.json names these, unless keep_all. resume goes on from the last epoch: other items or dimensions, or no epoch left to run, are
    errors, another number of negatives is a warning.
    """
    spark = adj.sparkSession
    if evaluate is None and held is not None:
        from loomset.operators.evaluate import recall_evaluator

        evaluate = recall_evaluator(held.orderBy(F.xxhash64(F.lit(config.seed), "query"), "query").limit(EVAL_PROBES), EVAL_K)
    cdf = materialized(negative_cdf(freq, config.power), "cdf")
    slots = materialized(anchors(adj).withColumn("step", F.pmod(F.xxhash64("anchor", "at", F.hash("items")), F.lit(config.steps_per_epoch))), "anchors")
    settings = {"n_items": n_items, "dim": config.dim, "negatives": config.negatives}
    history: list[dict] = []
    if resume:
        text = read_text(spark, f"{run_dir}/meta.json")
        if text is None:
            raise ValueError(f"no checkpoint at {run_dir}")
        meta = json.loads(text)
        if any(meta[k] != settings[k] for k in ("n_items", "dim")):
            raise ValueError(f"the checkpoint has {meta}, not {settings}")
        history = meta["history"]
        if len(history) >= config.epochs:
            raise ValueError(f"the checkpoint has {len(history)} epochs; none of {config.epochs} is left to run")
        if meta["negatives"] != config.negatives:
            warnings.warn(f"the checkpoint was trained with {meta['negatives']} negatives and goes on with {config.negatives}", stacklevel=2)
        table = spark.read.parquet(f"{run_dir}/epoch-{len(history) - 1}")
    else:
        initial_table(spark, n_items, config).write.mode("overwrite").parquet(f"{run_dir}/init")
        table = spark.read.parquet(f"{run_dir}/init")
    best = max(range(len(history)), key=lambda i: history[i]["score"], default=None)
    for epoch in range(len(history), config.epochs):
        loss, seen, path = 0.0, 0, ""
        for step in range(config.steps_per_epoch):
            own = slots.where(F.col("step") == step)
            sums = f"{run_dir}/grads-{epoch}-{step}"
            gradients(own, table, cdf, config, epoch * config.steps_per_epoch + step, broadcast_bytes).write.mode("overwrite").parquet(sums)
            grads = spark.read.parquet(sums)
            part = grads.agg(F.sum("loss"), F.sum("n")).first()
            if not part[1]:
                remove(spark, sums)
                continue
            before = path
            loss, seen = loss + part[0], seen + part[1]
            path = f"{run_dir}/epoch-{epoch}" if step == config.steps_per_epoch - 1 else f"{run_dir}/step-{epoch}-{step}"
            adam_step(table, grads, config, part[1]).write.mode("overwrite").parquet(path)
            table = spark.read.parquet(path)
            if not keep_all:
                remove(spark, sums, *([before] if before else []))
        if not path.endswith(f"epoch-{epoch}"):
            table.write.mode("overwrite").parquet(f"{run_dir}/epoch-{epoch}")
            table = spark.read.parquet(f"{run_dir}/epoch-{epoch}")
        mean = loss / max(1, seen)
        score = float(evaluate(table.select("ix", "v"))) if evaluate else -mean
        history.append({"epoch": epoch, "loss": mean, "anchors": seen, "score": score})
        if best is None or score > history[best]["score"] + config.min_gain:
            best = epoch
        write_text(spark, f"{run_dir}/meta.json", json.dumps(settings | {"config": asdict(config), "history": history, "best": best}))
        if not keep_all:
            kept = {f"epoch-{best}", f"epoch-{epoch}"}
            remove(spark, *(f"{run_dir}/{name}" for name in names_in(spark, run_dir) if name.startswith(_OWN_FOLDERS) and name not in kept))
        if epoch - best >= config.patience:
            break
    return spark.read.parquet(f"{run_dir}/epoch-{best}").select("ix", "v"), history
