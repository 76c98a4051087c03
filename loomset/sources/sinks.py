"""Sinks: compressed tables, ordered tables, versions behind a pointer, runs and their promotion, history, column rewrites."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: In a table's folder: the file that names the current version, and what versions' folders begin with.
POINTER, VERSION = "_current", "_version-"
#: In the folder of a table dealt by buckets of its key: the file that names each bucket's folder.
BUCKETS = "_buckets.json"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_table(df: DataFrame, path: str, order_by: str | None = None, mode: str = "errorifexists", row_group_bytes: int | None = None) -> None:
    """Zstandard Parquet; with order_by in ranges of that column, each file sorted; row_group_bytes sizes its row groups."""
    if order_by:
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartitionByRange(n, order_by).sortWithinPartitions(order_by)
    out = df.write.mode(mode).option("compression", "zstd")
    if row_group_bytes:
        out = out.option("parquet.block.size", row_group_bytes)
    out.parquet(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file under a temporary name, then moved over path in one step: path always holds a whole text."""
    fs, target = _fs(spark, path)
    jvm = spark._jvm
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    how = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(how, 1)
    options[0] = how.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(target).toUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(part), fs.makeQualified(target), options)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None if there is none."""
    fs, target = _fs(spark, path)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders or files; what is not there is no error."""
    for path in paths:
        fs, p = _fs(spark, path)
        fs.delete(p, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder."""
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def write_history(spark: SparkSession, path: str, history: list[dict]) -> None:
    """The history of a training run as JSON."""
    write_text(spark, path, json.dumps(history))


def table_path(spark: SparkSession, path: str) -> str | None:
    """Where the rows of the table at path are: its current version, or path itself if it is a plain folder; None: no table."""
    if read_text(spark, f"{path}/{BUCKETS}"):
        return path
    if name := read_text(spark, f"{path}/{POINTER}"):
        return f"{path}/{name}"
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return path if any(n[0] not in "_." for n in names) or "_SUCCESS" in names else None


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table that write_table(), replace_table() or upsert_buckets() left at path."""
    if held := read_text(spark, f"{path}/{BUCKETS}"):
        return _buckets(spark, path, json.loads(held))
    found = table_path(spark, path)
    if found is None:
        raise FileNotFoundError(f"no table at {path}")
    return spark.read.parquet(found)


def replace_table(df: DataFrame, path: str) -> None:
    """Make df the table at path, from which df may itself be read.

    The rows are written as a new version in the folder, then the pointer is moved to it in one step. A crash before
    that leaves the table as it was, one after it the new table; versions but the last two go.
    """
    spark = df.sparkSession
    fs, folder = _fs(spark, path)
    old = read_text(spark, f"{path}/{POINTER}")
    name = f"{VERSION}{time.time_ns():020d}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(f"{path}/{name}")
    write_text(spark, f"{path}/{POINTER}", name)
    for s in fs.listStatus(folder):
        own = s.getPath().getName()
        if own not in (POINTER, name, old) and not own.endswith(".part"):
            fs.delete(s.getPath(), True)


def _buckets(spark: SparkSession, path: str, held: dict, only: list[int] | None = None) -> DataFrame:
    folders = [f"{path}/{f}" for b, f in held["folders"].items() if only is None or int(b) in only]
    schema = T.StructType.fromJson(held["schema"])
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def upsert_buckets(batch: DataFrame, path: str, key: str, merged: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = 256) -> list[int]:
    """Merge a batch into the table at path, which is dealt by hashes of its key; returns the buckets that were rewritten.

    merged(old, batch) gets the old rows of the batch's buckets alone. Their new rows are written first, then the file
    that names all buckets' folders is replaced in one step, so a crash leaves the old table and a batch that runs again
    changes nothing. The number of buckets is fixed by the first batch; old folders of rewritten buckets go.
    """
    spark = batch.sparkSession
    text = read_text(spark, f"{path}/{BUCKETS}")
    held = json.loads(text) if text else {"n": buckets, "schema": json.loads(batch.schema.json()), "folders": {}}
    number = F.pmod(F.xxhash64(key), F.lit(held["n"])).cast("int")
    hit = sorted(r[0] for r in batch.select(number).distinct().collect())  # one number a bucket
    if not hit:
        return []
    old = _buckets(spark, path, held, hit)
    name = f"{VERSION}{time.time_ns():020d}-{uuid.uuid4().hex}"
    new = merged(old, batch.select(*old.columns)).withColumn("__bucket", number)
    new.repartition("__bucket").write.partitionBy("__bucket").option("compression", "zstd").parquet(f"{path}/{name}")
    gone = [f"{path}/{held['folders'][str(b)]}" for b in hit if str(b) in held["folders"]]
    held["folders"] |= {str(b): f"{name}/__bucket={b}" for b in hit}
    write_text(spark, f"{path}/{BUCKETS}", json.dumps(held))
    remove(spark, *gone)
    return hit


def promote(spark: SparkSession, run: str, target: str, confirm: bool = False) -> None:
    """Copy a run's table to the place that is served; only on demand is an existing one replaced."""
    if table_path(spark, target) is not None and not confirm:
        raise FileExistsError(f"{target} exists; confirm to replace it")
    replace_table(read_table(spark, run), target)


def rewrite_column(spark: SparkSession, path: str, column: str, value: Column, order_by: str) -> None:
    """Replace one column of a table in place, keeping its columns' order and its rows in the order of a key."""
    df = read_table(spark, path)
    replace_table(df.select(*(value.alias(c) if c == column else F.col(c) for c in df.columns)).orderBy(order_by), path)


def export_vectors(table: DataFrame, path: str) -> None:
    """The vectors (ix, v) of a training table as float32, in ranges of ix; nothing of the optimizer's state."""
    write_table(table.select("ix", F.col("v").cast("array<float>").alias("v")), path, order_by="ix", mode="overwrite")
