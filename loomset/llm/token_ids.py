"""Token ids as fixed-width packed binary files with block offsets: encode, write, read whole or at random."""

from __future__ import annotations

import itertools
import json
import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomset.llm.common import give_back, slices, text_of, word_lists

#: A file: magic, header length (4 bytes), JSON header, then the sections that it names (offset, bytes), little-endian.
MAGIC = b"PKTOKEN1"
BLOCK_IDS = 4096
SHARD_IDS = 3_000_000
#: What a worker remembers of words and their ids.
MEMO_BYTES = 64_000_000


def width_of(vocabulary: int) -> int:
    """The least number of bits that holds every id below vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """ids in width bits each, least bit first; padded to whole groups of 64 ids, which take width 64-bit words."""
    lanes = np.zeros((math.ceil(len(ids) / 64), 64), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(lanes), width), np.uint64)
    for lane in range(64):
        word, shift = divmod(lane * width, 64)
        out[:, word] |= lanes[:, lane] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= lanes[:, lane] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    """The first n ids of packed data, as unsigned 32-bit numbers."""
    words = np.frombuffer(data, "<u8").reshape(-1, width)
    out = np.empty((len(words), 64), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for lane in range(64):
        word, shift = divmod(lane * width, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | words[:, word + 1] << np.uint64(64 - shift)
        out[:, lane] = value & mask
    return out.reshape(-1)[:n]


#: Letters that lower-case one by one, are composed already and are letters in every version of Unicode.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
#: Marks that may follow them in a word and are one piece together; none starts a contraction or a special token's string.
_MARKS = '.,;:!?|)"#$%&*('
#: Normalizer and pre-tokenizer of which it is known that words between white space are encoded by themselves, and plain
#: words by their pieces. A tokenizer with any other gets whole texts.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def _ragged(pool: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, ends): the runs pool[begin : begin + size] one after another."""
    ends = np.cumsum(size)
    return pool[np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)], ends


class Memo:
    """Ids of strings: by string a number, and by number where its ids begin in a pool and how many there are."""

    #: A string of the memo takes about so many bytes beside its characters and ids.
    ENTRY = 170

    def __init__(self):
        self.number: dict[str, int] = {}
        self.begin, self.size, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.nbytes = 0

    def numbers(self, words: list[str]) -> np.ndarray:
        """The number of each string; -1: unknown."""
        return np.fromiter(map(self.number.get, words, itertools.repeat(-1)), np.int64, len(words))

    def add(self, words: list[str], size: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Put in different strings that are unknown, with their ids one after another; their numbers."""
        first = len(self.size)
        self.number.update(zip(words, range(first, first + len(words)), strict=True))
        self.begin = np.concatenate((self.begin, len(self.pool) + np.cumsum(size) - size))
        self.size, self.pool = np.concatenate((self.size, size)), np.concatenate((self.pool, ids))
        self.nbytes += len(words) * self.ENTRY + sum(map(len, words)) + ids.nbytes
        return np.arange(first, first + len(words))


class Encoder:
    """A public tokenizer that remembers the ids of words.

    If its normalizer and pre-tokenizer are those above, a text's ids are those of its words one after another. A word of
    plain letters and marks after them is two pieces, whose ids follow each other; letters go straight to the library's
    BPE model. All other words, special tokens' strings among them, go through the library's encode. Any other tokenizer
    encodes whole texts. The memo starts anew once it holds memo_bytes.
    """

    def __init__(self, path: str, memo_bytes: int = MEMO_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        self.by_word = made["normalizer"] == _NORMALIZER and made["pre_tokenizer"] == _PRE_TOKENIZER and made["post_processor"] is None and made["truncation"] is None
        self.memo, self.memo_bytes = Memo(), memo_bytes
        # how the library writes the bytes of each character that a plain piece can hold
        level = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in map(chr, range(33, 0x180)) if re.match(f"[{_LETTERS}]", c)})

    def _know(self, words: list[str], letters: bool) -> np.ndarray:
        """The numbers of different words; unknown ones go into the memo. letters: they are plain letters in lower case."""
        memo = self.memo
        at = memo.numbers(words)
        new = np.flatnonzero(at < 0)
        missing = [words[i] for i in new.tolist()]
        if letters:
            bpe, table = self.tokenizer.model.tokenize, self.letters
            own = [[t.id for t in bpe(w.translate(table))] for w in missing]
        else:
            own = [e.ids for e in self.tokenizer.encode_batch_fast(missing, add_special_tokens=False)]
        size = np.fromiter(map(len, own), np.int64, len(own))
        at[new] = memo.add(missing, size, np.fromiter(itertools.chain.from_iterable(own), np.uint32, int(size.sum())))
        return at

    def pieces(self, words: pa.Array) -> np.ndarray:
        """(words, 2): the memo's numbers of each different word's letters and of the marks after them, or of it and ""."""
        stems = pc.utf8_rtrim(words, _MARKS)
        plain = pc.match_substring_regex(stems, f"^[{_LETTERS}]+$").to_numpy(zero_copy_only=False)
        out = np.empty((len(words), 2), np.int64)
        out[:, 1] = self._know([""], False)
        coded = pc.utf8_lower(stems.filter(pa.array(plain))).dictionary_encode()
        out[plain, 0] = self._know(coded.dictionary.to_pylist(), True)[coded.indices.to_numpy()]
        marked = plain & (pc.binary_length(words).to_numpy() > pc.binary_length(stems).to_numpy())
        coded = pc.utf8_ltrim(words.filter(pa.array(marked)), "".join(c for c in map(chr, range(65, 0x180)) if re.match(f"[{_LETTERS}]", c))).dictionary_encode()
        out[marked, 1] = self._know(coded.dictionary.to_pylist(), False)[coded.indices.to_numpy()]
        out[~plain, 0] = self._know(words.filter(pa.array(~plain)).to_pylist(), False)
        return out

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts in one array, each text followed by end_id."""
        if not self.by_word:
            own = [[*e.ids, end_id] for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))
            return np.fromiter(itertools.chain.from_iterable(own), np.uint32, int(ends[-1]) if len(ends) else 0), ends
        if self.memo.nbytes > self.memo_bytes:
            self.memo = Memo()
        lists = word_lists(texts)
        coded = lists.flatten().dictionary_encode()
        at = self.pieces(coded.dictionary)[coded.indices.to_numpy()].reshape(-1)
        flat, until = _ragged(self.memo.pool, self.memo.begin[at], self.memo.size[at])
        ends = np.concatenate(([0], until))[2 * lists.offsets.to_numpy()[1:]]
        return np.insert(flat, ends, end_id), ends + np.arange(1, len(ends) + 1)


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_shard(uri: str, doc_ids: np.ndarray, known: np.ndarray, ends: np.ndarray, ids: np.ndarray, vocabulary: int) -> None:
    """Write one file under a temporary name, then rename it: a task that runs again writes the same bytes."""
    width = width_of(vocabulary)
    if len(ids) and int(ids.max()) >= vocabulary:
        raise ValueError(f"id {int(ids.max())} is outside the vocabulary of {vocabulary}")
    blocks = [pack(ids[a : a + BLOCK_IDS], width) for a in range(0, len(ids), BLOCK_IDS)]
    offsets = np.concatenate(([0], np.cumsum([len(b) for b in blocks]))).astype("<u8")
    sections = {"doc_ids": doc_ids.astype("<i8").tobytes(), "known": known.astype(np.uint8).tobytes(), "ends": ends.astype("<u8").tobytes(), "block_offsets": offsets.tobytes(), "blocks": b"".join(blocks)}
    places = np.concatenate(([0], np.cumsum([len(s) for s in sections.values()])))
    header = {"width": width, "vocabulary": vocabulary, "block_ids": BLOCK_IDS, "docs": len(doc_ids), "ids": len(ids), "sections": {k: [int(a), len(s)] for (k, s), a in zip(sections.items(), places, strict=False)}}
    text = json.dumps(header).encode()
    store, path = _open(uri)
    context = TaskContext.get()
    part = f"{path}.{context.taskAttemptId() if context else 0}.part"
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(part) as out:
        out.write(MAGIC + len(text).to_bytes(4, "little") + text)
        for s in sections.values():
            out.write(s)
    store.move(part, path)


class Shard:
    """A packed file: whole reads and random access by document or by range of ids."""

    def __init__(self, uri: str):
        store, path = _open(uri)
        self.file = store.open_input_file(path)
        head = self.file.read_at(12, 0)
        if head[:8] != MAGIC:
            raise ValueError(f"{uri} is no packed token file")
        n = int.from_bytes(head[8:], "little")
        self.header = json.loads(self.file.read_at(n, 12))
        self.base = 12 + n
        self.doc_ids, self.known = self._section("doc_ids", "<i8"), self._section("known", np.uint8).astype(bool)
        self.ends, self.block_offsets = self._section("ends", "<u8").astype(np.int64), self._section("block_offsets", "<u8").astype(np.int64)

    def _section(self, name: str, kind) -> np.ndarray:
        at, n = self.header["sections"][name]
        return np.frombuffer(self.file.read_at(n, self.base + at), kind)

    def ids(self, begin: int, end: int) -> np.ndarray:
        """The ids from begin to end, reading only the blocks that hold them."""
        end = min(end, self.header["ids"])
        if begin >= end:
            return np.zeros(0, np.uint32)
        size, width = self.header["block_ids"], self.header["width"]
        a, b = begin // size, (end - 1) // size + 1
        at = self.base + self.header["sections"]["blocks"][0]
        lo, hi = int(self.block_offsets[a]), int(self.block_offsets[b])
        # every block but the last is a whole number of groups, so blocks side by side unpack as one
        return unpack(self.file.read_at(hi - lo, at + lo), min(b * size, self.header["ids"]) - a * size, width)[begin - a * size : end - a * size]

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, with its end id."""
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))

    def close(self) -> None:
        self.file.close()


def write_token_ids(docs: DataFrame, out: str, tokenizer: str, vocabulary: int, end_id: int, doc_id: str = "doc_id", text: str = "text", partitions: int | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write the ids of all texts in ascending order of doc_id to files below `out`, a URI that all executors share.

    Returns the manifest (shard, part, file, docs, ids, start), also kept as out/manifest: start is the number of ids
    in all files before. Order: null ids first, equal ids by their text's hash. Null texts are empty and hold end_id
    alone. An empty table gives no file and an empty manifest. Tasks hold shard_ids ids at once besides one text.
    """
    spark = docs.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    named = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_of(text).alias("t")).withColumn("h", F.xxhash64("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard = Encoder(tokenizer), TaskContext.get().partitionId()
        kept: list[tuple] = []
        count = itertools.count()

        def flush() -> pa.RecordBatch:
            part, uri = next(count), ""
            doc_ids, known, sizes, ids = (np.concatenate(x) for x in zip(*kept, strict=True))
            kept.clear()
            uri = f"{out}/ids/{shard:06d}-{part:06d}.tok"
            write_shard(uri, doc_ids, known, np.cumsum(sizes), ids, vocabulary)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([part], pa.int32()), pa.array([uri]), pa.array([len(doc_ids)], pa.int64()), pa.array([len(ids)], pa.int64())], names=["shard", "part", "file", "docs", "ids"])

        held = 0
        for batch in batches:
            for piece in slices(batch, "t"):
                ids, ends = own.encode(piece.column(1), end_id)
                known = pc.is_valid(piece.column(0)).to_numpy(zero_copy_only=False)
                kept.append((pc.fill_null(piece.column(0), 0).to_numpy(), known, np.diff(ends, prepend=0), ids))
                held += len(ids)
                if held >= shard_ids:
                    yield flush()
                    held = 0
        if kept:
            yield flush()
        del own  # a worker that lives on would keep the tokenizer and its memo
        give_back()

    # a key of (id, hash) deals even one very frequent id over several files' worth of ranges
    dealt = named.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h").select("doc_id", "t")
    dealt.mapInArrow(run, "shard int, part int, file string, docs bigint, ids bigint").write.parquet(f"{out}/files")
    files = spark.read.schema("shard int, part int, file string, docs bigint, ids bigint").parquet(f"{out}/files")
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file, not a document
    files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0))).write.parquet(f"{out}/manifest")
    return read_manifest(spark, out)


def read_manifest(spark: SparkSession, out: str) -> DataFrame:
    """The files that write_token_ids wrote below out."""
    return spark.read.schema("shard int, part int, file string, docs bigint, ids bigint, start bigint").parquet(f"{out}/manifest")


def read_token_ids(spark: SparkSession, out: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]): every document read back from the files below out.

    start counts the ids of all documents before it; ids_crc32 is the CRC-32 of the ids as little-endian 32-bit numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(uri)
                ends = shard.ends
                begins = np.concatenate(([0], ends[:-1]))
                for a in range(0, len(ends), 2000):
                    b = min(a + 2000, len(ends))
                    ids = shard.ids(int(begins[a]), int(ends[b - 1])).astype("<u4")
                    at = begins[a : b + 1] - begins[a]
                    cut = [ids[x:y] for x, y in zip(at[: b - a], ends[a:b] - begins[a], strict=True)]
                    columns = [pa.array(shard.doc_ids[a:b], mask=~shard.known[a:b]), pa.array(begins[a:b] + start), pa.array(ends[a:b] - begins[a:b]), pa.array([zlib.crc32(c.tobytes()) for c in cut], pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.array([c.astype(np.int32) for c in cut], pa.list_(pa.int32())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                shard.close()

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    files = read_manifest(spark, out).select("file", "start").repartition(n, "file")
    return files.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)
