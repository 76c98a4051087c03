"""Benchmark decontamination by spaced-seed hashing with a substitution-tolerant check of each hit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.llm.common import broadcast_or_shuffle, row_key, scratch_root, slices, text_of, without_keys, word_lists, written

#: The positions that each mask keeps; it ignores the others, so substitutions there do not matter. Wherever a fifth of
#: 9 to 14 words differ, some mask falls on equal words; of the patterns of 15 words 0.998 have one.
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 3, 4, 6, 7), (0, 2, 3, 5, 6, 8), (0, 1, 2, 5, 7, 8), (0, 1, 2, 4, 5, 6), (0, 1, 3, 5, 6, 8), (0, 1, 2, 3, 4, 7))
MIN_OVERLAP = 13
MIN_IDENTITY = 0.8
#: log2 of the bits of the hash bitmap that the documents' side tests first: 1,024 bits a seed, between these bounds (128 KB
#: and 32 MB). With 10 million seeds 0.001 of other places pass, beyond more and more, which the join then drops.
LEAST_BITS, MOST_BITS = 20, 28
_TRIM = ".,;:!?\"'()[]{}|*#%$&<>-_=/\\`~@^+"


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): a 64-bit hash of each word, lower-cased and without punctuation around it; pure punctuation goes."""
    lists = word_lists(texts)
    coded = lists.flatten().dictionary_encode()
    plain = pc.utf8_trim(pc.utf8_lower(coded.dictionary), _TRIM).to_pylist()
    own = np.fromiter([xxhash.xxh64_intdigest(w) if w else 0 for w in plain], np.uint64, len(plain))
    h = own[coded.indices.to_numpy()] if len(own) else np.zeros(0, np.uint64)
    ends = lists.offsets.to_numpy()[1:].astype(np.int64)
    full = h != 0
    if not full.all():
        ends = np.concatenate(([0], np.cumsum(full)))[ends]
        h = h[full]
    return h, ends


def _factors(n: int) -> np.ndarray:
    """Odd multipliers, one for each kept position."""
    return np.random.default_rng(20240229).integers(1, 1 << 62, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _seed_hashes(h: np.ndarray, mask: tuple[int, ...], number: int) -> np.ndarray:
    """The mask's hash at each place where its span fits in h."""
    n = len(h) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, number + 1, np.uint64)
    for offset, factor in zip(mask, _factors(len(mask)), strict=True):
        out += h[offset : offset + n] * factor
    return out ^ out >> np.uint64(29)


def _masks(short: tuple[int, ...]) -> list[tuple[int, ...]]:
    """All masks: the fixed ones, and a full one for each length of items too short for a fixed one."""
    return [*MASKS, *(tuple(range(n)) for n in short)]


def _bits(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """Three places of a bitmap of 2 ** bits: the hash's highest, lowest and middle bits."""
    mask = np.uint64((1 << bits) - 1)
    return [x.astype(np.int64) for x in (h >> np.uint64(64 - bits), h & mask, h >> np.uint64(20) & mask)]


def _set(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the bits at these places are set."""
    return (bitmap[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def _bitmap(seeds: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of all seeds' hashes as 64-bit words: at most 2 ** (bits - 6) rows reach the driver."""
    mask = F.lit((1 << bits) - 1)
    places = seeds.select(F.explode(F.array(F.shiftrightunsigned("hash", 64 - bits), F.col("hash").bitwiseAND(mask), F.shiftrightunsigned("hash", 20).bitwiseAND(mask))).alias("bit"))
    found = places.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit").bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toPandas()
    packed = np.zeros(1 << bits - 6, np.int64)
    packed[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return packed.view(np.uint64)


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, tokens) of the items with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, ends = tokens(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["item_id", "tokens"])

    named = benchmark.select(F.col(item_id).alias("item_id"), text_of(text).alias("t"))
    return named.mapInArrow(run, f"item_id {named.schema['item_id'].dataType.simpleString()}, tokens array<bigint>").where("size(tokens) > 0")


def _seeds(items: DataFrame, short: tuple[int, ...]) -> DataFrame:
    """(hash, item, at): every seed of every different item (item: its key, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = np.array(own, np.int64).view(np.uint64)
                for number, mask in enumerate(_masks(short)):
                    if number < len(MASKS) or len(mask) == len(h):
                        found = _seed_hashes(h, mask, number)
                        if len(found):
                            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array([key] * len(found), pa.int64()), pa.array(np.arange(len(found), dtype=np.int32))], names=["hash", "item", "at"])

    return items.mapInArrow(run, "hash bigint, item bigint, at int")


def _regions(docs: DataFrame, bitmap, bits: int, short: tuple[int, ...], reach: int) -> DataFrame:
    """The stretches of documents around places whose seed hash is in the bitmap.

    (doc_id, row_key, start, tokens, hits): reach tokens more on either side; hits has each different hash with all its
    places, which count in the document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, masks = bitmap.value, _masks(short)
        for batch in batches:
            for part in slices(batch, "t"):
                h, ends = tokens(part.column(2))
                at, found = [], []
                for number, mask in enumerate(masks):
                    own = _seed_hashes(h, mask, number)
                    first, *more = _bits(own, bits)
                    near = np.flatnonzero(_set(held, first))
                    for x in more:
                        near = near[_set(held, x[near])]
                    doc = np.searchsorted(ends, near, "right")
                    inside = near + mask[-1] < ends[np.minimum(doc, len(ends) - 1)]
                    at.append(near[inside])
                    found.append(own[near[inside]])
                place, hit = np.concatenate(at), np.concatenate(found).view(np.int64)
                if not len(place):
                    continue
                order = np.argsort(place, kind="stable")
                place, hit = place[order], hit[order]
                doc = np.searchsorted(ends, place, "right")
                cut = np.flatnonzero((np.diff(doc) != 0) | (np.diff(place) > reach)) + 1
                rows: dict[str, list] = {k: [] for k in ("i", "start", "tokens", "hits")}
                for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(place)], strict=True):
                    d = int(doc[a])
                    first, last = int(ends[d - 1]) if d else 0, int(ends[d])
                    lo, hi = max(first, int(place[a]) - reach), min(last, int(place[b - 1]) + reach + 16)
                    rows["i"].append(d)
                    rows["start"].append(lo - first)
                    rows["tokens"].append(h[lo:hi].view(np.int64))
                    by = np.argsort(hit[a:b], kind="stable")
                    own, at = hit[a:b][by], (place[a:b][by] - first).astype(np.int32)
                    cuts = np.flatnonzero(np.diff(own)) + 1
                    rows["hits"].append([{"hash": h_, "at": x} for h_, x in zip(own[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts), strict=True)])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows["i"])), part.column(1).take(pa.array(rows["i"])), pa.array(rows["start"], pa.int32()), pa.array(rows["tokens"], pa.list_(pa.int64())), pa.array(rows["hits"], pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.list_(pa.int32()))])))], names=["doc_id", "row_key", "start", "tokens", "hits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, row_key bigint, start int, tokens array<bigint>, hits array<struct<hash:bigint,at:array<int>>>")


def best_overlap(own: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """(start, length, matches) of the longest ungapped overlap of item laid on own at diagonal that holds to MIN_IDENTITY.

    Of stretches of one length the one with most matches, then the first. A match counts 1 and a substitution as much
    less as MIN_IDENTITY demands, so a stretch holds to it if the running sum is no lower at its end than at its start.
    """
    lo, hi = max(0, diagonal), min(len(own), diagonal + len(item))
    if hi <= lo:
        return lo, 0, 0
    same = own[lo:hi] == item[lo - diagonal : hi - diagonal]
    total = np.concatenate(([0], np.cumsum(np.where(same, 1, -round(MIN_IDENTITY / (1 - MIN_IDENTITY))))))
    # for each end the first start whose sum is no higher: running minima never rise
    begin = np.searchsorted(-np.minimum.accumulate(total), -total)
    length = np.arange(len(total)) - begin
    ends = np.flatnonzero(length == length.max())
    matches = np.concatenate(([0], np.cumsum(same)))
    found = matches[ends] - matches[begin[ends]]
    end = int(ends[np.argmax(found)])
    return lo + int(begin[end]), int(length[end]), int(found.max())


def best_of_diagonals(own: np.ndarray, item: np.ndarray, diagonals: list[int]) -> tuple[int, int, int]:
    """best_overlap() of the best of several diagonals: the longest, then the one with most matches, then the first."""
    found = [best_overlap(own, item, d) for d in sorted(set(diagonals))]
    return max(found, key=lambda f: (f[1], f[2], -f[0]))


def _verified(pairs: DataFrame, doc_kind: str, min_overlap: int) -> DataFrame:
    """(doc_id, row_key, item, start, overlap, matched) of the regions that leak their item: one row each of both goes in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, key, start, own, item, other, hits, at in zip(*(c.to_numpy(zero_copy_only=False) if pa.types.is_list(c.type) else c.to_pylist() for c in batch.columns), strict=True):
                diagonals = np.unique(np.concatenate([np.subtract.outer(np.asarray(h), np.asarray(a)).ravel() for h, a in zip(hits, at, strict=True)])) - start
                found, length, matches = best_of_diagonals(np.asarray(own, np.int64), np.asarray(other, np.int64), diagonals.tolist())
                whole = len(other) <= max(m[-1] for m in MASKS)
                if length >= min(min_overlap, len(other)) and (matches == length or not whole):
                    out.append((doc, key, item, start + found, length, matches))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "row_key", "item", "start", "overlap", "matched"])

    return pairs.mapInArrow(run, f"doc_id {doc_kind}, row_key bigint, item bigint, start int, overlap int, matched int")


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", min_overlap: int = MIN_OVERLAP) -> DataFrame:
    """(doc_id, row_key, item_id, start, overlap, matched): the best overlap of each document with each item it leaks.

    Words are compared in lower case without punctuation around them. A leak is a stretch of at least min_overlap words
    (all words of a shorter item) that differs by substitutions in a fifth of its words at most. start counts words.
    Found if a mask of MASKS falls on equal words somewhere in the stretch, as any run of six equal words does; items
    shorter than nine words only if all are equal. Of one region the longest stretch of all diagonals with a hit counts,
    of a document's regions the one with most matches. Null or empty texts and items leak nothing; repeated rows of docs
    give one row; an empty benchmark or corpus gives an empty result. A region of a repetitive text meets a repetitive
    item in one row, whatever the number of their common seeds.
    """
    spark = docs.sparkSession
    scratch_root(spark)
    items = written(_items(benchmark, item_id, item_text).withColumn("item", F.xxhash64("tokens")), "decontam-items")
    different = items.groupBy("item").agg(F.first("tokens").alias("item_tokens"))
    lengths = items.agg(F.max(F.size("tokens")), F.array_sort(F.collect_set(F.when(F.size("tokens") <= max(m[-1] for m in MASKS), F.size("tokens"))))).first()
    reach, short = lengths[0] or 0, tuple(lengths[1] or ())
    seeds = written(_seeds(different, short), "decontam-seeds")
    bits = min(MOST_BITS, max(LEAST_BITS, (1024 * seeds.count()).bit_length()))
    bitmap = spark.sparkContext.broadcast(_bitmap(seeds, bits))
    named = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("row_key"), text_of(text).alias("t"))
    regions = written(_regions(named, bitmap, bits, short, reach), "decontam-regions")
    # a seed that comes often in a region or an item is one row of each side with the list of its places
    hits = regions.select("row_key", "start", F.explode("hits").alias("h")).select("row_key", "start", F.col("h.hash").alias("hash"), F.col("h.at").alias("hits"))
    places = seeds.groupBy("hash", "item").agg(F.collect_list("at").alias("at"))
    lines = hits.join(broadcast_or_shuffle(places, 1_000_000), "hash").groupBy("row_key", "start", "item").agg(F.collect_list("hits").alias("hits"), F.collect_list("at").alias("at"))
    full = regions.dropDuplicates(["row_key", "start"]).select("doc_id", "row_key", "start", "tokens")
    pairs = lines.join(full, ["row_key", "start"]).join(broadcast_or_shuffle(different, 100_000), "item").select("doc_id", "row_key", "start", "tokens", "item", "item_tokens", "hits", "at")
    best = _verified(pairs, named.schema["doc_id"].dataType.simpleString(), min_overlap).groupBy("row_key", "item").agg(F.max(F.struct("matched", -F.col("overlap"), -F.col("start"), "doc_id")).alias("b"))
    return best.join(items.select("item", "item_id").distinct(), "item").select("b.doc_id", "row_key", "item_id", (-F.col("b.col3")).alias("start"), (-F.col("b.col2")).alias("overlap"), "b.matched")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", broadcast_rows: int = 1_000_000) -> DataFrame:
    """The rows of docs that leak no item. Texts are shuffled only if more than broadcast_rows rows leak."""
    found = written(benchmark_leaks(docs, benchmark, doc_id, text).select("row_key").distinct(), "decontam-drop")
    return without_keys(docs, found, doc_id, text, broadcast_rows)
