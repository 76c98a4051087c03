"""URL rules by exact membership in Bloom filter cascades, without joins on the pages' side."""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.llm.common import scratch_root, written

#: (verdict, host and path) of the production rules; fixed values.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DEFAULT = "allow"
#: Listed keys of one cascade; more are split by their hashes into as many cascades as it takes, one pass over the pages each.
MAX_KEYS = 20_000_000
MAX_LEVELS = 48
#: Keys that share their 64-bit hash with a key of another kind are held as they are, at most so many: with 20 million
#: listed and 10^12 other keys about one pair is expected.
MAX_CLASHES = 1_000_000
_HALF_RATE_BITS = 1.44


@dataclass
class Level:
    bits: np.ndarray
    size: int
    hashes: int


def _places(h: np.ndarray, level: int, size: int, hashes: int) -> list[np.ndarray]:
    """Bit places of hashes in a level of so many bits: multiplied by odd numbers that differ by level."""
    odd = np.random.default_rng([4711, level]).integers(1, 1 << 62, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = []
    for f in odd:
        x = h * f
        x = (x ^ x >> np.uint64(32)) * f
        out.append(((x >> np.uint64(20)) % np.uint64(size)).astype(np.int64))
    return out


def _passes(h: np.ndarray, level: Level, number: int) -> np.ndarray:
    ok = np.ones(len(h), bool)
    for at in _places(h, number, level.size, level.hashes):
        ok &= (level.bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
    return ok


@dataclass
class Cascade:
    """Levels 0, 2, ... encode listed keys, levels 1, 3, ... what wrongly passed the level before.

    For every key of the universe it was built over the answer is exact: a key rejected by an even level is not
    listed, one rejected by an odd level is; one that passes all levels is what the last level encodes.
    """

    levels: list[Level]

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """Membership of 64-bit key hashes."""
        h = keys.view(np.uint64)
        out, live = np.zeros(len(h), bool), np.arange(len(h))
        for number, level in enumerate(self.levels):
            ok = _passes(h[live], level, number)
            out[live[~ok]] = number % 2 == 1
            live = live[ok]
        out[live] = len(self.levels) % 2 == 1
        return out


def _fill(keys: DataFrame, number: int, size: int, hashes: int) -> np.ndarray:
    """The bits of one level, gathered over all keys (h bigint): at most size / 64 rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(_places(batch.column(0).to_numpy().view(np.uint64), number, size, hashes))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["word", "bits"])

    found = keys.select("h").mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    bits = np.zeros(size // 64 + 1, np.int64)
    bits[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return bits.view(np.uint64)


def build_cascade(universe: DataFrame) -> Cascade:
    """A cascade over a universe of keys (h bigint, listed boolean), each once.

    The first level's rate is the share of listed keys, the others' a half, so all levels together are in proportion to
    the listed keys. Raises if a listed and another key have one hash, for then no cascade can tell them apart.
    """
    spark = universe.sparkSession
    counts = {r["listed"]: r["count"] for r in universe.groupBy("listed").count().collect()}
    levels: list[Level] = []
    shared = []

    def rest(listed: bool) -> DataFrame:
        """The keys of one side that pass all levels so far."""
        own = universe.where(F.col("listed") == listed).select("h")
        held = shared[-1] if shared else None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h = batch.column(0).to_numpy().view(np.uint64)
                ok = np.ones(len(h), bool)
                for number, level in enumerate(held.value):
                    ok &= _passes(h, level, number)
                yield batch.filter(pa.array(ok))

        return own.mapInArrow(run, "h bigint") if held else own

    listed = True
    while True:
        own = rest(listed)
        n = own.count()
        if not n:
            break
        if len(levels) == MAX_LEVELS:
            raise ValueError("a listed and another key have one hash")
        ratio = max(2.0, counts.get(False, 0) / n) if not levels else 2.0
        hashes = max(1, round(math.log2(ratio)))
        size = max(64, math.ceil(n * _HALF_RATE_BITS * hashes))
        levels.append(Level(_fill(own, len(levels), size, hashes), size, hashes))
        shared.append(spark.sparkContext.broadcast(list(levels)))
        listed = not listed
    return Cascade(levels)


def url_host(url: Column) -> Column:
    """What stands between the first :// and the next /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"\A[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; else empty."""
    return F.regexp_extract(_after_scheme(url), r"\A[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def key_hash(key: Column) -> Column:
    """The 64-bit hash by which keys are told apart."""
    return F.xxhash64(key)


def _clashes(universe: DataFrame, named: DataFrame) -> dict[int, dict[str, int]]:
    """{hash: {key: mark}} of hashes that keys of different marks share; named (key, verdict) has the keys in clear."""
    shared = universe.groupBy("h").agg(F.min("mark").alias("a"), F.max("mark").alias("z")).where("a <> z").select("h")
    hashes = [r["h"] for r in shared.limit(MAX_CLASHES + 1).collect()]
    if not hashes:
        return {}
    own = named.where(key_hash(F.col("key")).isin(hashes)) if len(hashes) <= 1_000 else named.join(F.broadcast(shared), key_hash(F.col("key")) == F.col("h"), "left_semi")
    rows = own.groupBy("key").agg(F.max("verdict").alias("verdict")).select(key_hash(F.col("key")).alias("h"), "key", _mark().alias("mark")).limit(MAX_CLASHES + 1).collect()
    if max(len(rows), len(hashes)) > MAX_CLASHES:
        raise ValueError(f"more than {MAX_CLASHES} keys share a hash with another kind")
    out: dict[int, dict[str, int]] = {}
    for r in rows:
        out.setdefault(r["h"], {})[r["key"]] = r["mark"]
    return out


def _mark() -> Column:
    return F.when(F.col("verdict").isNull(), 0).when(F.col("verdict") == "block", 2).otherwise(1)


def _marked(keyed: DataFrame, universe: DataFrame, clashes: dict[int, dict[str, int]], part: int, parts: int) -> DataFrame:
    """keyed with marks (array<int>) filled in for the hashes of one part: 0 not listed, 1 allowed, 2 blocked."""
    spark = keyed.sparkSession
    own = universe.where(F.pmod("h", F.lit(parts)) == part)
    if clashes:
        own = own.join(F.broadcast(spark.createDataFrame([(h,) for h in clashes], "h bigint")), "h", "left_anti")
    listed = build_cascade(own.select("h", (F.col("mark") > 0).alias("listed")))
    blocked = build_cascade(own.where("mark > 0").select("h", (F.col("mark") == 2).alias("listed")))
    held = spark.sparkContext.broadcast((listed, blocked, clashes))
    keys_at, hashes_at, marks_at = (keyed.columns.index(c) for c in ("keys", "hashes", "marks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, blocked, clashes = held.value
        shared = np.array(sorted(clashes), np.int64)
        for batch in batches:
            h = batch.column(hashes_at).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            marks = batch.column(marks_at).flatten().to_numpy(zero_copy_only=False).astype(np.int32)
            mine = np.flatnonzero(h % parts == part)
            hit = mine[listed.contains(h[mine])]
            marks[hit] = 1 + blocked.contains(h[hit])
            if clash := mine[np.isin(h[mine], shared)].tolist() if len(shared) else []:
                keys = batch.column(keys_at).flatten()
                marks[clash] = [clashes[int(h[i])].get(keys[i].as_py(), 0) for i in clash]
            offsets = batch.column(marks_at).offsets.to_numpy()
            columns = list(batch.columns)
            columns[marks_at] = pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(marks))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return keyed.mapInArrow(run, keyed.schema)


def judge_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = DEFAULT, max_keys: int = MAX_KEYS) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages.

    rules: (verdict, rule), rule being a host and a path that starts with /, each once; null rows are left out. A rule
    fits its host and all subdomains if the path starts with the rule's; the longest wins, of equal ones that with the
    longer host. Pages that no rule fits have rule null and the default verdict, for then they are on no list. Null and
    broken urls have an empty host and path. Keys of a url are its host's endings with its path's beginnings, in the
    shapes (labels, path length) that the rules have. Keys of different kinds under one 64-bit hash are told apart by
    their text.
    """
    spark = pages.sparkSession
    scratch_root(spark)
    rules = written(rules.where("verdict is not null and instr(rule, '/') > 0").select("verdict", "rule").distinct(), "url-rules")
    head = F.substring_index("rule", "/", 1)
    shapes = [tuple(r) for r in rules.select(F.size(F.split(head, r"\.")), F.length("rule") - F.length(head)).distinct().collect()]
    named = pages.select(F.col(page_id).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    labels = F.size(F.split("host", r"\."))
    ends = [(F.substring_index("host", ".", -n), size, labels >= n) for n, size in sorted(shapes)]
    made = F.array(*(F.when(fits & (F.length("path") >= size), F.struct((-F.length(end) - size).alias("a"), (-F.length(end)).alias("b"), F.concat(end, F.left("path", F.lit(size))).alias("key"))) for end, size, fits in ends)) if ends else F.array().cast("array<struct<a:int,b:int,key:string>>")
    keyed = named.withColumn("keys", F.transform(F.sort_array(F.filter(made, lambda x: x.isNotNull())), lambda x: x["key"]))
    clear = keyed.select(F.explode("keys").alias("key"), F.lit(None).cast("string").alias("verdict")).union(rules.select("rule", "verdict"))
    universe = written(clear.groupBy("key").agg(F.max("verdict").alias("verdict")).select(key_hash(F.col("key")).alias("h"), _mark().alias("mark")), "url-keys")
    clashes = _clashes(universe, clear)
    parts = max(1, math.ceil(rules.count() / max_keys))
    marked = keyed.withColumn("hashes", F.transform("keys", key_hash)).withColumn("marks", F.transform("keys", lambda _: F.lit(0)))
    for part in range(parts):
        marked = _marked(marked if part == 0 else written(marked, "url-marks"), universe, clashes, part, parts)
    # keys are in order, so the first listed one fits best
    first = F.array_position(F.transform("marks", lambda m: m > 0), F.lit(True)).cast("int")
    rule = F.when(first > 0, F.get("keys", first - 1))
    return marked.select("page_id", "host", "path", rule.alias("rule"), F.when(first > 0, F.when(F.get("marks", first - 1) == 2, "block").otherwise("allow")).otherwise(default).alias("verdict"))


def rules_frame(spark, rules=RULES) -> DataFrame:
    """The rules as (verdict, rule)."""
    return spark.createDataFrame(list(rules), "verdict string, rule string")
