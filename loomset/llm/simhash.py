"""SimHash near-duplicates, linked by Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.llm import golay
from loomset.llm.common import broadcast_or_shuffle, free_name, row_key, scratch_root, slices, split_join, text_of, without_keys, word_lists, written
from loomset.llm.components import connected_components

SEED = 42
MAX_DISTANCE = 3
#: Segments (shift, width) of the 64 bits and, for each, its halves.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Counters of 16 bits: so many shingles are summed at once.
_LANE = 60_000


def _lanes() -> np.ndarray:
    """By byte: its 8 bits spread to 8 counters of 16 bits in two words."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.uint64)
    shift = (np.arange(4) * 16).astype(np.uint64)
    return np.stack([(bits[:, :4] << shift).sum(axis=1), (bits[:, 4:] << shift).sum(axis=1)], axis=1)


_LANES = _lanes()


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set."""
    out = np.zeros(64, np.int64)
    for a in range(0, len(hashes), _LANE):
        lanes = _LANES[hashes[a : a + _LANE].view(np.uint8).reshape(-1, 8)].sum(axis=0)
        out += (lanes[:, :, None] >> (np.arange(4) * 16).astype(np.uint64) & np.uint64(0xFFFF)).astype(np.int64).reshape(64)
    return out


def fingerprints(texts: pa.Array, width: int = 3) -> np.ndarray:
    """Unsigned 64-bit SimHash of each text over its word shingles; see simhash_fingerprints."""
    lists = word_lists(pc.ascii_lower(pc.fill_null(texts, "")))
    joined = pc.binary_join(lists, " ")
    ends = lists.offsets.to_numpy()
    sizes = pc.binary_length(lists.flatten()).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros(len(lists), np.uint64)
    power = np.uint64(1) << np.arange(64, dtype=np.uint64)
    h = xxhash.xxh64_intdigest
    for i, text in enumerate(joined):
        n = int(ends[i + 1] - ends[i])
        if not n:
            continue
        data = text.as_buffer().to_pybytes()
        k = min(width, n)
        own = sizes[ends[i] : ends[i + 1]] + 1
        stop = np.cumsum(own)
        begin = (stop - own)[: n - k + 1].tolist()
        stop = (stop - 1)[k - 1 :].tolist()
        hashes = np.fromiter([h(data[a:b], SEED) for a, b in zip(begin, stop, strict=True)], np.uint64, n - k + 1)
        out[i] = power[2 * _bit_counts(hashes) > n - k + 1].sum(dtype=np.uint64)
    return out


def simhash_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, row_key, fp bigint): the SimHash of every whole text, as a signed 64-bit number.

    Words are lower-cased (A-Z) runs without ASCII white space; shingles of `width` words, repeats included, are hashed
    by XXH64 with seed 42; a bit is set if it is set in over half of the hashes. Fewer words: one shingle of them all.
    Null, empty and blank texts: 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fingerprints(part.column(2), width).view(np.int64))], names=["doc_id", "row_key", "fp"])

    named = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("row_key"), text_of(text).alias("t"))
    kind = named.schema["doc_id"].dataType.simpleString()
    return named.mapInArrow(run, f"doc_id {kind}, row_key bigint, fp bigint")


def _mix(parts: list[np.ndarray], table: int) -> np.ndarray:
    """One 64-bit key from a table's number and at most 60 bits of parts (part, bits)."""
    key = np.full(len(parts[0][0]), table, np.int64)
    for value, bits in parts:
        key = key << bits | value
    return key


def _keys(fp: np.ndarray, near: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of fingerprints. near: keys of all words within distance 1 of the decoded segment; else of the segment.

    With at most 3 differing bits over 3 segments, either some segment differs nowhere, and of the other two one
    differs in at most one bit (tables 0-5: equal segment, Golay index of another), or each segment differs in exactly
    one bit, which leaves one half of each of the last two equal (tables 6-9: Golay index of the first, two halves).
    """
    segment = [(fp >> np.uint64(s) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    code = [golay.decode_near(x) if near else (np.arange(len(x)), golay.decode(x)) for x in segment]
    rows, keys = [], []
    for table, (i, j) in enumerate((i, j) for i in range(3) for j in range(3) if i != j):
        row, index = code[j]
        rows.append(row)
        keys.append(_mix([(segment[i][row], SEGMENTS[i][1]), (index, 12)], table))
    row, index = code[0]
    for table in range(4):
        halves = [(segment[1 + k][row] >> 11 if table >> k & 1 else segment[1 + k][row] & 0x7FF, 11) for k in (0, 1)]
        rows.append(row)
        keys.append(_mix([(index, 12), *halves], 6 + table))
    return np.concatenate(rows), np.concatenate(keys)


def fuzzy_keys(prints: DataFrame, near: bool) -> DataFrame:
    """(fp, key) for distinct fingerprints (fp bigint): the Golay keys that pairs within distance 3 share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            for a in range(0, len(own), 20_000):
                part = own[a : a + 20_000]
                row, key = _keys(part.view(np.uint64), near)
                yield pa.RecordBatch.from_arrays([pa.array(part[row]), pa.array(key)], names=["fp", "key"])

    return prints.select("fp").mapInArrow(run, "fp bigint, key bigint")


def fingerprint_links(prints: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(u, v), u < v: pairs of distinct fingerprints (fp bigint) within max_distance (3 at most) bits; each pair once."""
    if not 0 <= max_distance <= MAX_DISTANCE:
        raise ValueError(f"max_distance must be 0 to {MAX_DISTANCE}")
    left = fuzzy_keys(prints, False).select(F.col("fp").alias("u"), "key")
    right = fuzzy_keys(prints, True).select(F.col("fp").alias("v"), "key")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_distance
    # Spark takes the keys for no more rows than the fingerprints and would send all of them through the driver
    return left.join(right.hint("merge"), "key").where((F.col("u") < F.col("v")) & near).select("u", "v").distinct()


def _classes(docs: DataFrame, doc_id: str, text: str, width: int, max_distance: int) -> DataFrame:
    """(doc_id, row_key, fp, label, component_id) by row; label: the class's least fingerprint."""
    scratch_root(docs.sparkSession)
    rows = written(simhash_fingerprints(docs, doc_id, text, width), "simhash")
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("least")).checkpoint()
    label = connected_components(fingerprint_links(prints, max_distance)).withColumnRenamed("node", "fp")
    named = prints.join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    return split_join(rows, written(named.join(least, "label").select("fp", "label", "component_id"), "simhash-classes"), "fp")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, row_key, fingerprint, component_id): one row for each input row, in classes of linked fingerprints.

    Fingerprints link at max_distance or fewer differing bits; component_id is the smallest doc_id reachable (null only
    if no row of the class has an id). Rows of one text share their fingerprint, so copies are one vertex and are never
    paired. An empty table gives an empty result; other columns of docs are ignored.
    """
    found = _classes(docs, doc_id, text, width, max_distance)
    return found.select("doc_id", "row_key", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", broadcast_rows: int = 1_000_000) -> DataFrame:
    """One row of each near-duplicate class: the one with the smallest doc_id, of equal ids that of the least row key.

    A row without an id stays only if no row of its class has one. Columns are those of docs. Texts are shuffled only
    if more than broadcast_rows row keys go.
    """
    return one_of_each(docs, written(_classes(docs, doc_id, text, 3, MAX_DISTANCE), "simhash-found"), doc_id, text, broadcast_rows)


def one_of_each(docs: DataFrame, found: DataFrame, doc_id: str, text: str, broadcast_rows: int) -> DataFrame:
    """One row of docs for each label of found (doc_id, row_key, fp, label by row), as drop_near_duplicates() chooses it."""
    # the first row of each fingerprint and then of each class, so that no join meets all rows of a class
    own = found.groupBy("fp").agg(F.first("label").alias("label"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("own")).checkpoint()
    first = split_join(own, own.groupBy("label").agg(F.min("own").alias("first")), "label").select("fp", F.col("first.row_key").alias("first"))
    keyed = written(split_join(found, first, "fp").groupBy("row_key").agg(F.first(F.col("row_key") == F.col("first")).alias("stays"), F.count("*").alias("n")).where("not stays or n > 1"), "simhash-drop")
    left = without_keys(docs, keyed.where("not stays").select("row_key"), doc_id, text, broadcast_rows)
    again = keyed.where("stays").select("row_key")
    if again.isEmpty():
        return left
    # whole rows that are repeated: one of each stays
    name = free_name(docs, "__key")
    twice = broadcast_or_shuffle(again.toDF(name), broadcast_rows)
    once = left.withColumn(name, row_key(doc_id, text)).join(twice, name, "left_semi").dropDuplicates([name]).select(docs.columns)
    return without_keys(left, again, doc_id, text, broadcast_rows).union(once)
