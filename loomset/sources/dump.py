"""SQL dumps as typed tables: statement scan, INSERT routing, a tokenizer of VALUES lists, numeric casts."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomset.operators.scratch import scratch

#: The tables of a dump with their columns; s string, i bigint, f double.
SCHEMAS = {
    "album": (("id", "s"), ("name", "s"), ("uri", "s")),
    "artist": (("id", "s"), ("name", "s"), ("uri", "s")),
    "playlist": (("id", "s"), ("name", "s"), ("followers", "i"), ("uri", "s"), ("total_tracks", "i")),
    "track": (("id", "s"), ("name", "s"), ("duration", "i"), ("popularity", "f"), ("explicit", "s"), ("preview_url", "s"), ("uri", "s"), ("album_id", "s")),
    "track_artist1": (("track_id", "s"), ("artist_id", "s")),
    "track_playlist1": (("track_id", "s"), ("playlist_id", "s")),
}
#: Sets of tables by name.
PRESETS = {"all": tuple(SCHEMAS), "artist-lookup": ("album", "artist", "track", "track_artist1", "track_playlist1")}
_TYPES = {"s": "string", "i": "bigint", "f": "double"}
#: What a letter after a backslash stands for; any other character stands for itself.
ESCAPES = {"0": "\0", "b": "\b", "n": "\n", "r": "\r", "t": "\t", "Z": "\x1a"}
_INSERT = r"^[\r\n]*INSERT INTO `([^`]+)` VALUES "


#: A cell, a string or a bare word up to the next comma or bracket, with the comma or the end of its list after it; what
#: stands between lists is skipped. No such mark after a string: another cell follows, which spoils the list's length.
_CELL = re.compile(r"(?:'([^'\\]*(?:\\.[^'\\]*)*)'|(?!')([^,)]*))(?:(,)|(\))[^(]*\(?)?", re.S)
_ESCAPE = re.compile(r"\\(.)", re.S)


def tuples(payload: str) -> Iterator[list[str | None]]:
    """The value lists of a VALUES payload; NULL is None, other bare words stay as text, a torn last list is dropped."""
    start, n = payload.find("("), len(payload)
    if start < 0:
        return
    cells: list[str | None] = []
    for found in iter(_CELL.scanner(payload, start + 1).match, None):  # stops at a string without an end
        text, word, comma, close = found.groups()
        if text is None:
            word = word.strip()
            cells.append(None if word == "NULL" else word)
        else:
            cells.append(_ESCAPE.sub(lambda m: ESCAPES.get(m[1], m[1]), text) if "\\" in text else text)
        if close:
            yield cells
            cells = []
        elif not comma and found.end() == n:
            return


def parsed(payloads: DataFrame) -> DataFrame:
    """(name, cells) of payloads (name, payload): a row for each value list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lists = tuples(payload or "")
                while part := list(itertools.islice(lists, 20_000)):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array(part, pa.list_(pa.string()))], names=["name", "cells"])

    return payloads.select(F.col("name").cast("string").alias("name"), "payload").mapInArrow(run, "name string, cells array<string>")


def statements(spark: SparkSession, path: str, terminated: bool | None = None, limit_bytes: int | None = None) -> DataFrame:
    """(value): the statements of a dump file, cut at ; and line end, in a splittable scan; invalid UTF-8 is replaced.

    A last statement without its terminator is dropped, and only that: others equal to it stay. limit_bytes takes the
    first so many bytes alone, for a trial run: they are copied to the scratch folder as a stream, whatever the file's size.
    """
    if limit_bytes is not None:
        path, terminated = _prefix(spark, path, limit_bytes), None
    rows = spark.read.option("lineSep", ";\n").text(path)
    if terminated is None:
        terminated = _ends_with(spark, path, b";\n")
    if not terminated:
        tail = F.col("value").cast("binary") == F.lit(bytearray(_last_statement(spark, path)))
        # equal statements cannot be told apart, so one of them less is the last one less
        rows = rows.where(~tail).union(rows.where(tail).withColumn("n", F.row_number().over(Window.partitionBy("value").orderBy("value"))).where("n > 1").select("value"))
    return rows.select(F.call_function("make_valid_utf8", F.col("value")).alias("value"))


def _prefix(spark: SparkSession, path: str, n: int) -> str:
    """A copy of a file's first n bytes."""
    fs, p, size = _file(spark, path)
    out = f"{scratch(spark, 'dump-prefix')}/part.sql"
    target = spark._jvm.org.apache.hadoop.fs.Path(out)
    source, sink = fs.open(p), target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        spark._jvm.org.apache.commons.io.IOUtils.copyLarge(source, sink, 0, min(n, size))
    finally:
        source.close()
        sink.close()
    return out


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, p, fs.getFileStatus(p).getLen()


def _tail(spark: SparkSession, path: str, n: int) -> bytes:
    fs, p, size = _file(spark, path)
    n = min(n, size)
    stream = fs.open(p)
    try:
        stream.seek(size - n)
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.readFully(stream, n))  # arrays come back by value only
    finally:
        stream.close()


def _ends_with(spark: SparkSession, path: str, end: bytes) -> bool:
    return _tail(spark, path, len(end)) == end


def _last_statement(spark: SparkSession, path: str, step: int = 1 << 20) -> bytes:
    size = _file(spark, path)[2]
    n = step
    while True:
        found = _tail(spark, path, n)
        if b";\n" in found or n >= size:
            return found.rpartition(b";\n")[2]
        n *= 4


def chosen_tables(tables: list[str] | None = None, preset: str | None = None) -> tuple[str, ...]:
    """Names of the wanted tables, by list or preset but not both; unknown names are errors."""
    if tables is not None and preset is not None:
        raise ValueError("tables or preset, not both")
    names = tuple(tables) if tables is not None else PRESETS[preset or "all"] if (preset or "all") in PRESETS else None
    if names is None or set(names) - set(SCHEMAS):
        raise ValueError(f"unknown: {preset if names is None else sorted(set(names) - set(SCHEMAS))}")
    return names


def read_dump(spark: SparkSession, path: str, tables: list[str] | None = None, preset: str | None = None, limit_bytes: int | None = None, terminated: bool | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """({table: rows}, dropped) of a dump: typed rows by table, and (table, n) of value lists of a wrong length.

    '' and text that is no number are null in numeric columns. path may be a folder of files that all end with their
    terminator if terminated says so. The dump is parsed once, into a scratch table by name, of
    which each table reads its own part.
    """
    names = chosen_tables(tables, preset)
    found = statements(spark, path, terminated, limit_bytes).select(F.regexp_extract("value", _INSERT, 1).alias("name"), F.regexp_replace("value", _INSERT, "").alias("payload")).where(F.col("name").isin(*names))
    place = scratch(spark, "dump-cells")
    parsed(found).write.partitionBy("name").parquet(place)
    cells = spark.read.schema("cells array<string>, name string").parquet(place)
    typed = {}
    for name in names:
        columns = SCHEMAS[name]
        own = cells.where((F.col("name") == name) & (F.size("cells") == len(columns)))
        typed[name] = own.select(*(_typed(F.get("cells", F.lit(i)), kind).alias(c) for i, (c, kind) in enumerate(columns)))
    lengths = F.create_map(*(F.lit(x) for n in names for x in (n, len(SCHEMAS[n]))))
    dropped = cells.where(F.size("cells") != F.element_at(lengths, F.col("name"))).groupBy("name").agg(F.count("*").alias("n"))
    return typed, dropped


def _typed(c, kind: str):
    return c if kind == "s" else F.trim(c).try_cast(_TYPES[kind])


def table_schema(name: str) -> T.StructType:
    """The fixed schema of a table."""
    return T._parse_datatype_string(", ".join(f"{c} {_TYPES[k]}" for c, k in SCHEMAS[name]))
