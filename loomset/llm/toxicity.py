"""Toxicity scores by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomset.llm.common import free_name, give_back, scratch_root, slices, text_of, word_lists, written

#: The classifier is fitted on so many labelled rows of each class at most, drawn by a hash of their ids ...
EXAMPLES_PER_CLASS = 2_000
#: ... and on so many different terms of them in all, summed over the examples of a class in that order.
TERMS_PER_CLASS = 2_000_000
NEIGHBOURS = 15
BLOCK = 64
#: A document's blocks of the largest bounds, which are scored first.
FIRST_BLOCKS = 4
#: Weight of the prior in the vote, in units of one perfect neighbour.
PRIOR_WEIGHT = 0.1
THRESHOLD = 0.3
#: Documents are scored in groups whose scores with all examples take so many numbers.
_SCORES = 40_000
_TRIM = ".,;:!?\"'()[]{}|*#%$&<>-_=/\\`~@^+"


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): each word's 64-bit hash, in lower case without punctuation around it; pure punctuation goes."""
    lists = word_lists(texts)
    coded = lists.flatten().dictionary_encode()
    plain = pc.utf8_trim(pc.utf8_lower(coded.dictionary), _TRIM).to_pylist()
    own = np.fromiter([xxhash.xxh64_intdigest(w) if w else 0 for w in plain], np.uint64, len(plain))
    h = own[coded.indices.to_numpy()] if len(own) else np.zeros(0, np.uint64)
    full = h != 0
    return h[full], np.concatenate(([0], np.cumsum(full)))[lists.offsets.to_numpy()[1:]]


def _runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers begin .. begin + size - 1 of all runs one after another."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


@dataclass
class Index:
    """Labelled examples as unit TF-IDF vectors in a block-max inverted index.

    codes: the terms' hashes in order, scale: what a term's frequency is multiplied by. The examples stand in blocks of
    BLOCK. A cell is a term in a block: cells first[t] .. first[t + 1] - 1 are those of term t, each with its block,
    the largest weight there and the place where its postings (example, weight) begin.
    """

    codes: np.ndarray
    scale: np.ndarray
    rare: float
    ids: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float
    neighbours: int
    first: np.ndarray
    cell_block: np.ndarray
    cell_max: np.ndarray
    cell_begin: np.ndarray
    example: np.ndarray
    weight: np.ndarray

    @property
    def blocks(self) -> int:
        return math.ceil(len(self.ids) / BLOCK)

    def vectors(self, h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, weight) of the unit vectors of documents' known terms; h, ends as terms() gives them."""
        doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        at = np.minimum(np.searchsorted(self.codes, h), max(0, len(self.codes) - 1))
        known = self.codes[at] == h if len(self.codes) else np.zeros(len(h), bool)
        key, n = np.unique(doc[known] * len(self.codes) + at[known], return_counts=True)
        doc, term = np.divmod(key, max(1, len(self.codes)))
        w = (1 + np.log(n)) * self.scale[term]
        norm = np.sqrt(np.bincount(doc, w * w, minlength=len(ends)))
        return doc, term, w / norm[doc]

    def nearest(self, doc: np.ndarray, term: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines), n x k: the k examples nearest to each of n documents; ties go to the smaller example.

        A block's bound for a document is the sum of its weights times the cells' largest weights. The FIRST_BLOCKS
        blocks of the largest bounds are scored, then all others whose bound reaches the k-th cosine found; the
        postings of the rest are never read. The result is exact. Cosines of 0 come with example -1.
        """
        k, blocks = min(self.neighbours, len(self.ids)), self.blocks
        size = self.first[term + 1] - self.first[term]
        cell = _runs(self.first[term], size)
        at = np.repeat(doc, size) * blocks + self.cell_block[cell]
        own = np.repeat(w, size)
        bound = np.bincount(at, own * self.cell_max[cell], minlength=n * blocks).reshape(n, blocks)
        chosen = np.zeros((n, blocks), bool)
        np.put_along_axis(chosen, np.argsort(-bound, axis=1, kind="stable")[:, :FIRST_BLOCKS], True, axis=1)
        scores = self._scores(at, cell, own, chosen)
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        rest = (bound > 0) & (bound >= kth[:, None] - 1e-9) & ~chosen
        if rest.any():
            scores += self._scores(at, cell, own, rest)
        scores = np.round(scores, 9)
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        row, example = np.nonzero(scores >= np.maximum(kth, 1e-9)[:, None])
        value = scores[row, example]
        order = np.lexsort((example, -value, row))
        row, example, value = row[order], example[order], value[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        examples, cosines = np.full((n, k), -1), np.zeros((n, k))
        few = place < k
        examples[row[few], place[few]], cosines[row[few], place[few]] = example[few], value[few]
        return examples, cosines

    def _scores(self, at: np.ndarray, cell: np.ndarray, own: np.ndarray, use: np.ndarray) -> np.ndarray:
        """Sums of products over the postings of the cells in the blocks in use, by document and example."""
        n, width = len(use), self.blocks * BLOCK
        held = use.reshape(-1)[at]
        at, cell, own = at[held], cell[held], own[held]
        size = self.cell_begin[cell + 1] - self.cell_begin[cell]
        posting = _runs(self.cell_begin[cell], size)
        place = np.repeat(at // self.blocks * width, size) + self.example[posting]
        return np.bincount(place, np.repeat(own, size) * self.weight[posting], minlength=n * width).reshape(n, width)

    def score(self, h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores, nearest examples' ids, cosines) of documents; id -1 and cosine 0 where no term is known.

        Votes weigh the square of the cosine times what a row of the class stands for; the prior votes too.
        """
        n = len(ends)
        scores, near, cosines = np.full(n, self.prior), np.full(n, -1), np.zeros(n)
        if not len(self.ids):
            return scores, near, cosines
        doc, term, w = self.vectors(h, ends)
        step = max(1, _SCORES // len(self.ids))
        for a in range(0, n, step):
            b = min(n, a + step)
            lo, hi = np.searchsorted(doc, (a, b))
            examples, cosine = self.nearest(doc[lo:hi] - a, term[lo:hi], w[lo:hi], b - a)
            votes = cosine**2 * self.weights[examples] / self.weights.mean()
            scores[a:b] = np.clip(((votes * self.labels[examples]).sum(1) + PRIOR_WEIGHT * self.prior) / (votes.sum(1) + PRIOR_WEIGHT), 0, 1)
            near[a:b], cosines[a:b] = np.where(examples[:, 0] >= 0, self.ids[examples[:, 0]], -1), cosine[:, 0]
        return scores, near, cosines


def _best_of(row: np.ndarray, term: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Each row's term of the largest value, ties to the smaller; -1: a row without terms."""
    order = np.lexsort((term, -value, row))
    out = np.full(n, -1)
    first = np.flatnonzero(np.diff(row[order], prepend=-1))
    out[row[order][first]] = term[order][first]
    return out


def build(ids: np.ndarray, labels: np.ndarray, stands_for: np.ndarray, hashes: np.ndarray, counts: np.ndarray, sizes: np.ndarray, neighbours: int = NEIGHBOURS, weigh_labels: bool = True) -> Index:
    """The index of examples: hashes and counts are their terms one after another, sizes[i] of them example i's.

    A term weighs (1 + ln count) x idf x (1 + chi square), where chi square (2 x 2, with continuity correction) tells
    how much more often the term comes in toxic examples; it is 0 where it does not. No term is left out. The last factor
    departs from plain TF-IDF: a few dozen telling terms then make most of a toxic example's length, and a text is near to
    it by them. Without weigh_labels terms weigh plain TF-IDF; README has the figures of both.
    """
    n = len(ids)
    codes, term = np.unique(hashes, return_inverse=True)
    row = np.repeat(np.arange(n), sizes)
    every, toxic = np.bincount(term, minlength=len(codes)), np.bincount(term, labels[row], minlength=len(codes))
    share = labels.mean() if n else 0.0
    excess = np.maximum(0.0, toxic - every * share - 0.5)
    chi = excess**2 / np.maximum(1e-12, every * share * (1 - share))
    whole = stands_for.sum()
    idf = np.log(1 + whole / np.bincount(term, stands_for[row], minlength=len(codes)))
    scale = idf * (1 + chi) if weigh_labels else idf
    w = (1 + np.log(counts)) * scale[term]
    w = w / np.sqrt(np.bincount(row, w * w, minlength=n))[row]
    # examples of one most common term (most often those of a language), and then of one leading term, stand side by
    # side, which makes the bounds of blocks tight
    common, lead = (_best_of(row, term, x, n) for x in (every[term], w))
    order = np.lexsort((ids, lead, labels, common))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    at = place[row]
    order_p = np.lexsort((at, term))
    t, example, weight = term[order_p], at[order_p], w[order_p]
    block = example // BLOCK
    start = np.flatnonzero(np.diff(t, prepend=-1) | np.diff(block, prepend=-1))
    return Index(
        codes, scale, math.log(1 + whole), ids[order], labels[order], stands_for[order], float(labels @ stands_for / whole) if n else 0.0, neighbours,
        np.searchsorted(t[start], np.arange(len(codes) + 1)), block[start].astype(np.int32), np.maximum.reduceat(weight, start) if len(start) else weight, np.append(start, len(t)), example.astype(np.int32), weight,
    )


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0)) % 4 == 2


def _count_terms(docs: DataFrame) -> DataFrame:
    """(doc_id, toxic, h, terms array, counts array) of (doc_id, toxic, h, t): the hashes of a text's terms, and how often each comes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                h, ends = terms(part.column(3))
                own = [np.unique(h[a:b], return_counts=True) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                kind = pa.list_(pa.int64())
                lists = [pa.array([x.view(np.int64) for x, _ in own], kind), pa.array([n for _, n in own], kind)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *lists], names=["doc_id", "toxic", "h", "terms", "counts"])

    return docs.mapInArrow(run, "doc_id bigint, toxic int, h bigint, terms array<bigint>, counts array<bigint>")


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", per_class: int = EXAMPLES_PER_CLASS, terms_per_class: int = TERMS_PER_CLASS, neighbours: int = NEIGHBOURS, weigh_labels: bool = True) -> Index:
    """Fit on the labelled rows that are not held out, in the order of a hash of their ids.

    Of each class per_class rows at most are drawn, and of those, in that order, each that still fits into
    terms_per_class different terms in all; a row that does not fit is left out by itself: this bounds what the driver and
    each task hold, whatever the tables. doc_id must be whole numbers, or a text id is an error under ANSI. Rows with a null id or label are left out; of
    several labels of one id the largest holds; copies of a text in a class are one example, different texts of one id
    are examples of their own. Examples stand for all labelled rows of their class in idf, votes and prior. Without
    examples every score is 0.
    """
    spark = docs.sparkSession
    scratch_root(spark)
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~held_out(doc_id)).groupBy(F.col(doc_id).cast("bigint").alias("doc_id")).agg((F.max(label) > 0).cast("int").alias("toxic"))
    known = written(known, "toxicity-labels")
    total = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    drawn = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    # at most 2 * per_class ids of 12 bytes
    sample = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_of(text).alias("t")).join(F.broadcast(drawn[0].union(drawn[1])), "doc_id")
    sample = sample.groupBy("toxic", "t").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic", F.xxhash64("t").alias("h"), "t")
    counted = written(_count_terms(sample).withColumn("n", F.size("terms")), "toxicity-examples")
    fits = []
    for y in (0, 1):
        room = terms_per_class
        for r in counted.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id", "h").select("doc_id", "toxic", "h", "n").limit(per_class).collect():
            if r["n"] <= room:
                room -= r["n"]
                fits.append((r["doc_id"], r["toxic"], r["h"]))
    # 2 * per_class keys at most
    kept = counted.join(F.broadcast(spark.createDataFrame(fits, "doc_id bigint, toxic int, h bigint")), ["doc_id", "toxic", "h"], "left_semi")
    found = kept.select("doc_id", "toxic", "h", "terms", "counts").toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending"), ("h", "ascending")]).combine_chunks()
    labels_of = found.column("toxic").to_numpy().astype(float)
    n = {y: max(1, int((labels_of == y).sum())) for y in (0, 1)}
    flat = lambda c: pc.list_flatten(found.column(c)).to_numpy()
    stands_for = np.where(labels_of == 1, total.get(1, 0) / n[1], total.get(0, 0) / n[0])
    return build(found.column("doc_id").to_numpy(), labels_of, stands_for, flat("terms").view(np.uint64), flat("counts"), pc.list_value_length(found.column("terms")).to_numpy(), neighbours, weigh_labels)


def toxicity_scores(docs: DataFrame, index: Index, text: str = "text", keep: bool = False, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1), predicted (1 if score >= threshold), neighbour (nearest example's id) and cosine.

    Each whole text is scored by itself; a text without a term that an example has gets the prior, no neighbour and
    cosine 0, as null and empty texts do. The new columns are named toxic_score, toxic_predicted, toxic_neighbour and
    toxic_cosine, with underscores before them where docs has such a name in any case; with keep only the columns of
    docs come back, and only rows that are not predicted.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)
    give_back()  # what fitting and sending the index took of the driver
    names = [free_name(docs, x) for x in ("toxic_score", "toxic_predicted", "toxic_neighbour", "toxic_cosine")]
    own = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for part in slices(batch, text):
                score, near, cosine = index.score(*terms(pc.fill_null(part.column(own.index(text)), "")))
                if keep:
                    yield pa.RecordBatch.from_arrays(part.filter(pa.array(score < threshold)).columns, names=own)
                else:
                    more = [pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(near, pa.int64(), mask=near < 0), pa.array(cosine)]
                    yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*own, *names])

    if keep:
        return docs.mapInArrow(run, docs.schema)
    added = [T.StructField(n, k) for n, k in zip(names, (T.DoubleType(), T.IntegerType(), T.LongType(), T.DoubleType()), strict=True)]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))
