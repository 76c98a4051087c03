"""Near-duplicates by the Jaccard similarity of word shingles: MinHash bands find candidates, whole shingle sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.llm.common import broadcast_or_shuffle, give_back, row_key, scratch_root, slices, split_join, text_of, word_lists, written
from loomset.llm.components import connected_components
from loomset.llm.simhash import SEED, fingerprint_links, fingerprints, one_of_each

WIDTH = 5
MIN_SIMILARITY = 0.8
#: Bands of so many minima each: a pair of similarity 0.8 shares no band with a chance of 0.0007, one of 0.9 with 1e-8.
BANDS, ROWS = 24, 6
#: Texts of either side of a block in which texts are compared, and their characters; a longer text stands alone.
CHUNK, CHUNK_CHARS = 500, 4_000_000
MANY_BLOCKS, SALTS = 1_000, 64
_FACTORS = np.random.default_rng(SEED).integers(1, 1 << 62, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    """The finalizer of MurmurHash3."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ h >> np.uint64(33)) * np.uint64(factor)
    return h ^ h >> np.uint64(33)


def shingles(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(hashes, offsets, keys): the shingle hashes of each text, repeats included, and a key of its words.

    Words are those of simhash_fingerprints. Fewer words than width: one shingle of them all. No words: none, and key 0.
    """
    lists = word_lists(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    own = np.fromiter([xxhash.xxh64_intdigest(w, SEED) for w in coded.dictionary.to_pylist()], np.uint64, len(coded.dictionary))
    h = own[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.uint64)
    ends = lists.offsets.to_numpy().astype(np.int64)
    n = np.diff(ends)
    offsets = np.concatenate(([0], np.cumsum(np.where(n < width, np.minimum(n, 1), n - width + 1))))
    out = np.zeros(offsets[-1], np.uint64)
    if len(h) >= width:
        every = np.zeros(len(h) - width + 1, np.uint64)
        for i in range(width):
            every = every * _STEP + h[i : i + len(every)]
        doc = np.repeat(np.arange(len(n)), n)[: len(every)]
        inside = np.arange(len(every)) + width <= ends[1:][doc]
        out[np.repeat(n >= width, np.diff(offsets))] = _mixed(every[inside] + np.uint64(width))
    for i in np.flatnonzero((n > 0) & (n < width)).tolist():
        short = np.zeros(1, np.uint64)
        for x in h[ends[i] : ends[i + 1]]:
            short = short * _STEP + x
        out[offsets[i]] = _mixed(short + np.uint64(n[i]))[0]
    keys = [xxhash.xxh64_intdigest(h[a:b].tobytes(), SEED) if b > a else 0 for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return out, offsets, keys


def band_keys(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts with a shingle, BANDS): a key of each band's minima."""
    begin = offsets[:-1][np.diff(offsets) > 0]
    out = np.zeros((len(begin), BANDS), np.uint64)
    for band in range(BANDS if len(begin) else 0):
        key = np.full(len(begin), band, np.uint64)
        for factor in _FACTORS[band]:
            key = _mixed(key * _STEP + np.minimum.reduceat(hashes * factor, begin))
        out[:, band] = key
    return out


def _prints(docs: DataFrame, doc_id: str, text: str, simhash: bool = False) -> DataFrame:
    """(doc_id, row_key, fp, chars, bands) by row; fp: the key of the text's words. With simhash, also its SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                h, offsets, keys = shingles(part.column(2))
                bands = pa.array(band_keys(h, offsets).view(np.int64).reshape(-1))
                at = np.concatenate(([0], np.cumsum(np.diff(offsets) > 0))) * BANDS
                chars = pc.binary_length(part.column(2)).cast(pa.int64())
                more = {"simhash": pa.array(fingerprints(part.column(2)).view(np.int64))} if simhash else {}
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.array(keys, np.uint64).view(np.int64)), chars, pa.ListArray.from_arrays(pa.array(at, pa.int32()), bands), *more.values()], names=["doc_id", "row_key", "fp", "chars", "bands", *more])

    named = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("row_key"), text_of(text).alias("t"))
    return named.mapInArrow(run, f"doc_id {named.schema['doc_id'].dataType.simpleString()}, row_key bigint, fp bigint, chars bigint, bands array<bigint>{', simhash bigint' if simhash else ''}")


def similar_pairs(first: list[np.ndarray], second: list[np.ndarray], least: float = MIN_SIMILARITY) -> list[tuple[int, int]]:
    """Pairs (i, j) of sets of different hashes with a Jaccard similarity of least or more, every first with every second."""
    if not first or not second:
        return []
    sizes = np.array([len(x) for x in second])
    flat = np.concatenate([*second, *first])
    ids = np.unique(flat, return_inverse=True)[1]
    begin, own = np.cumsum(sizes) - sizes, ids[: sizes.sum()]
    mark, out, at = np.zeros(len(ids) + 1, np.int64), [], int(sizes.sum())
    for i, x in enumerate(first):
        mine = ids[at : at + len(x)]
        at += len(x)
        mark[mine] = 1
        both = np.add.reduceat(mark[own], begin)
        mark[mine] = 0
        out += [(i, j) for j in np.flatnonzero(both >= least * (sizes + len(x) - both) - 1e-9).tolist()]
    return out


def _compared(docs: DataFrame, blocks: DataFrame, doc_id: str, text: str, broadcast_rows: int) -> DataFrame:
    """(u, v): links between the texts of both sides of each block. blocks: (block, side, fp, row_key), about CHUNK rows a side."""

    def run(table: pa.Table) -> pa.Table:
        h, offsets, _ = shingles(table.column("t").combine_chunks())
        sets = [np.unique(h[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        fp, side = table.column("fp").to_numpy(), table.column("side").to_numpy()
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        found = similar_pairs([sets[i] for i in one], [sets[i] for i in two])
        links = np.array([(fp[one[i]], fp[two[j]]) for i, j in found if fp[one[i]] != fp[two[j]]], np.int64).reshape(-1, 2)
        del sets, h
        give_back()
        return pa.table({"u": links[:, 0], "v": links[:, 1]})

    wanted = blocks.select("fp", "row_key").distinct()
    named = docs.select(row_key(doc_id, text).alias("row_key"), text_of(text).alias("t"))
    texts = written(named.join(broadcast_or_shuffle(wanted, broadcast_rows), "row_key").dropDuplicates(["fp"]).select("fp", "t"), "near-text-texts")
    full = _with_texts(blocks.select("block", "side", "fp"), texts, broadcast_rows)
    return full.groupBy("block").applyInArrow(run, "u bigint, v bigint").distinct()


def _with_texts(blocks: DataFrame, texts: DataFrame, broadcast_rows: int) -> DataFrame:
    """(block, side, fp, t): a text in more than MANY_BLOCKS blocks, as a large group's first, is dealt to SALTS tasks."""
    many = blocks.groupBy("fp").agg(F.count("*").alias("n")).where(F.col("n") > MANY_BLOCKS).select("fp").checkpoint()
    if many.isEmpty():
        return blocks.join(texts, "fp").select("block", "side", "fp", "t")
    many = broadcast_or_shuffle(many, broadcast_rows)
    salted = texts.join(many, "fp", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("salt", F.col("salt").cast("bigint"))
    hot = blocks.join(many, "fp", "left_semi").withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(SALTS))).join(salted, ["fp", "salt"])
    cold = blocks.join(many, "fp", "left_anti").join(texts, "fp")
    return hot.select("block", "side", "fp", "t").union(cold.select("block", "side", "fp", "t"))


def _chunks(n: Column, chars: Column) -> Column:
    """How many chunks so many members with so many characters make: about CHUNK and CHUNK_CHARS each."""
    return F.greatest(F.ceil(n / CHUNK), F.ceil(chars / CHUNK_CHARS))


def _chunk(fp: str, n: Column, chars: Column) -> Column:
    """The chunk of a member."""
    return F.pmod(F.xxhash64(F.col(fp), F.lit("chunk")), _chunks(n, chars))


def _blocks(pairs: DataFrame, broadcast_rows: int) -> DataFrame:
    """(block, side, fp, row_key) of pairs (one, one_row, fp, row_key, chars): each text `one` with about a chunk of its partners."""
    sums = pairs.groupBy("one").agg(F.count("*").alias("n"), F.sum("chars").alias("sum"))
    counted = pairs.join(broadcast_or_shuffle(sums, broadcast_rows), "one")
    placed = written(counted.withColumn("block", F.xxhash64("one", _chunk("fp", F.col("n"), F.col("sum")))), "near-text-blocks")
    return placed.select("block", F.lit(1).alias("side"), "fp", "row_key").union(placed.groupBy("block").agg(F.lit(0).alias("side"), F.first("one").alias("fp"), F.first("one_row").alias("row_key")))


def may_link(docs: DataFrame, members: DataFrame, doc_id: str, text: str, broadcast_rows: int, least: float = MIN_SIMILARITY) -> DataFrame:
    """(fp): the members that may be similar to one of another label, one of the two a stray; no others are.

    members: (fp, row_key, label, stray), each fp once. Each text's shingles stand in the order of how many members have
    them, rare ones first. Of a pair of similarity `least` or more, the first common shingle is among the first
    n - ceil(2 least / (1 + least) n) + 1 of the smaller set and the first m - ceil(least m) + 1 of the larger. So who has
    no shingle there in common with another label goes, whatever boilerplate texts share. No pairs are made: a shingle's
    texts are told by the least and the largest of their labels.
    """
    named = docs.select(row_key(doc_id, text).alias("row_key"), text_of(text).alias("t"))
    texts = named.join(broadcast_or_shuffle(members.select("fp", "row_key"), broadcast_rows), "row_key").dropDuplicates(["fp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                h, offsets, _ = shingles(part.column(1))
                sets = [np.unique(h[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                sizes = np.array([len(x) for x in sets])
                fp, flat = np.repeat(part.column(0).to_numpy(), sizes), np.concatenate(sets).view(np.int64)
                for a in range(0, len(flat), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(fp[a : a + 100_000]), pa.array(flat[a : a + 100_000])], names=["fp", "shingle"])

    every = written(texts.select("fp", "t").mapInArrow(run, "fp bigint, shingle bigint"), "near-text-shingles")
    ranked = split_join(every, every.groupBy("shingle").agg(F.count("*").alias("in_texts")), "shingle")
    ordered = ranked.groupBy("fp").agg(F.sort_array(F.collect_list(F.struct("in_texts", "shingle"))).alias("s"))  # one text's
    n = F.size("s")
    kept = ordered.select("fp", (n - F.ceil(n * (2 * least / (1 + least)) - 1e-9) + 1).alias("narrow"), F.posexplode(F.slice("s", F.lit(1), (n - F.ceil(n * least - 1e-9) + 1).cast("int"))).alias("at", "s"))
    prefixes = written(kept.select("fp", (F.col("at") < F.col("narrow")).alias("narrow"), F.col("s.shingle").alias("shingle")).join(broadcast_or_shuffle(members.select("fp", "label", "stray"), broadcast_rows), "fp"), "near-text-prefixes")
    ends = prefixes.groupBy("shingle").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.max("narrow").alias("any_narrow"), F.max("stray").alias("any_stray"))
    met = split_join(prefixes, written(ends.where("least < most and any_narrow and any_stray").select("shingle"), "near-text-met"), "shingle")
    return written(met.select("fp").distinct(), "near-text-may")


def _simhash_links(own: DataFrame) -> DataFrame:
    """(u, v): every fp of (fp, simhash) with the least of its SimHash, and the least ones of SimHashes that link, see simhash.fingerprint_links()."""
    own = written(own.select("fp", F.col("simhash").alias("node")), "near-text-own")
    prints = own.groupBy("node").agg(F.min("fp").alias("least")).checkpoint()
    inner = split_join(own, prints, "node").select(F.col("fp").alias("u"), F.col("least").alias("v"))
    # the pairs go to the classes of near_classes() as they are: classes of SimHashes alone would be found a second time there
    pairs = fingerprint_links(prints.select(F.col("node").alias("fp")))
    one, two = (prints.select(F.col("node").alias(x), F.col("least").alias(f"{x}_least")) for x in "uv")
    outer = pairs.join(one, "u").join(two, "v").select("u_least", "v_least")
    return inner.union(outer).where("u <> v")


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", broadcast_rows: int = 1_000_000, simhash: bool = False) -> DataFrame:
    """(doc_id, row_key, fp, label): one row for each row of docs; label: the least fp of its class.

    Texts of the same words are one vertex; vertices link if their sets of WIDTH-word shingles have a Jaccard similarity
    of MIN_SIMILARITY or more. Texts that share a band's key are candidates. First each is compared with the least of
    every key it has. Where a key's members are then in several classes, those outside its largest class are strays; of
    the members of such keys, may_link() leaves those that may be similar to one of another class, and of these each
    stray is compared with all members of its keys, so no pair of candidates is left out but those that are in one class
    already. With simhash, texts within three bits of each other's SimHash are linked too, whatever their shingles: the
    classes of simhash.near_duplicates() are then parts of these. All comparisons go by blocks of about CHUNK texts and CHUNK_CHARS characters, however many texts have a key. Texts without a word are one class.
    """
    scratch_root(docs.sparkSession)
    rows = written(_prints(docs, doc_id, text, simhash), "near-text")
    own = rows.groupBy("fp").agg(F.min("row_key").alias("row_key"), F.first("chars").alias("chars"), F.first("bands").alias("bands"))
    keyed = written(own.select("fp", "row_key", "chars", F.explode("bands").alias("key")), "near-text-bands")
    shared = keyed.groupBy("key").agg(F.min("fp").alias("least"), F.max("fp").alias("most"), F.min_by("row_key", "fp").alias("least_row")).where("least < most").select("key", "least", "least_row").checkpoint()
    members = written(keyed.join(broadcast_or_shuffle(shared, broadcast_rows), "key"), "near-text-members")

    star = members.where("fp <> least").groupBy("fp", F.col("least").alias("one")).agg(*(F.first(c).alias(n) for c, n in (("row_key", "row_key"), ("least_row", "one_row"), ("chars", "chars"))))
    sides = _blocks(star, broadcast_rows)
    links = written(_compared(docs, sides, doc_id, text, broadcast_rows), "near-text-links")
    if simhash:
        links = links.union(_simhash_links(rows.groupBy("fp").agg(F.first("simhash").alias("simhash"))))

    label = connected_components(links)
    label = label.where("node <> label").checkpoint()
    named = written(members.select("key", "fp", "row_key", "chars").join(broadcast_or_shuffle(label.select(F.col("node").alias("fp"), "label"), broadcast_rows), "fp", "left").withColumn("label", F.coalesce("label", "fp")), "near-text-named")
    sizes = named.groupBy("key", "label").agg(F.count("*").alias("n"))
    split = sizes.groupBy("key").agg(F.max(F.struct("n", -F.col("label"))).alias("main"), F.sum("n").alias("n"), F.count("*").alias("labels")).where("labels > 1").checkpoint()
    # keys with the same members are looked at once
    same = named.join(broadcast_or_shuffle(split.select("key"), broadcast_rows), "key", "left_semi").groupBy("key").agg(F.sum(F.xxhash64("fp").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64("fp", F.lit(1))).alias("xor"), F.count("*").alias("c")).groupBy("sum", "xor", "c").agg(F.min("key").alias("key"))
    open_ = split.join(same.select("key"), "key").select("key", (-F.col("main.col2")).alias("main")).checkpoint()
    if not open_.isEmpty():
        full = written(named.join(broadcast_or_shuffle(open_, broadcast_rows), "key").withColumn("stray", F.col("label") != F.col("main")), "near-text-open")
        open_texts = full.groupBy("fp").agg(F.first("row_key").alias("row_key"), F.first("label").alias("label"), F.max("stray").alias("stray"))
        full = full.join(broadcast_or_shuffle(may_link(docs, written(open_texts, "near-text-open-texts"), doc_id, text, broadcast_rows), broadcast_rows), "fp")
        total = full.groupBy("key").agg(F.count("*").alias("n"), F.sum("chars").alias("sum"), F.count_if("stray").alias("strays"), F.sum(F.when(F.col("stray"), F.col("chars"))).alias("stray_sum")).where("n > strays or n > 1").where("strays > 0")
        full = written(full.join(broadcast_or_shuffle(total, broadcast_rows), "key"), "near-text-left")
        mine, theirs = _chunks(F.col("n"), F.col("sum")), _chunks(F.col("strays"), F.col("stray_sum"))
        every = full.withColumn("a", _chunk("fp", F.col("n"), F.col("sum"))).withColumn("b", F.explode(F.sequence(F.lit(0), theirs - 1)))
        stray = full.where("stray").withColumn("b", _chunk("fp", F.col("strays"), F.col("stray_sum"))).withColumn("a", F.explode(F.sequence(F.lit(0), mine - 1)))
        sides = [x.select(F.xxhash64("key", F.col("a").cast("bigint"), F.col("b").cast("bigint")).alias("block"), F.lit(side).alias("side"), "fp", "row_key") for side, x in ((1, every), (0, stray))]
        more = _compared(docs, written(sides[0].union(sides[1]), "near-text-stray-blocks"), doc_id, text, broadcast_rows)
        # the classes so far are stars and stand for all links that made them
        label = connected_components(label.toDF("u", "v").union(more)).where("node <> label").checkpoint()
    label = label.select(F.col("node").alias("fp"), "label")
    return rows.select("doc_id", "row_key", "fp").join(broadcast_or_shuffle(label, broadcast_rows), "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def drop_near_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", broadcast_rows: int = 1_000_000, simhash: bool = False) -> DataFrame:
    """One row of each class of near_classes(), as simhash.drop_near_duplicates() chooses it. Columns are those of docs."""
    return one_of_each(docs, written(near_classes(docs, doc_id, text, broadcast_rows, simhash), "near-text-classes"), doc_id, text, broadcast_rows)
