"""Parquet and .npy sources, and the roles that the sample tables play."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.operators.releases import Tables


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A Parquet table, projected to columns if any are named."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def sample_tables(spark: SparkSession, folder: str) -> Tables:
    """Parts as tracks of the release of their brand and type, suppliers as creators, customers as collections."""
    part = table(spark, folder, "part", "p_partkey", "p_name", "p_size", "p_brand", "p_type")
    release_id = F.concat("p_brand", F.lit("|"), "p_type")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = table(spark, folder, "lineitem", "l_orderkey", "l_partkey", "l_suppkey")
    orders = table(spark, folder, "orders", "o_orderkey", "o_custkey")
    return Tables(
        part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_size").cast("long") * 60000).alias("duration"), release_id.alias("release_id")),
        # dealt by number, so that Spark does not merge the parts: what a task holds follows the session's partitions
        lines.select(F.col("l_partkey").alias("track_id"), F.col("l_suppkey").alias("creator_id")).repartition(n, "track_id", "creator_id").distinct(),
        table(spark, folder, "supplier", "s_suppkey", "s_name").toDF("id", "name"),
        # both sides as well: merged parts would give one task millions of lines to sort
        lines.repartition(n, "l_orderkey").join(orders.repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("track_id"), F.col("o_custkey").alias("collection_id")),
        table(spark, folder, "customer", "c_custkey", "c_name").toDF("id", "name"),
        part.select(release_id.alias("id"), F.col("p_type").alias("name")).distinct(),
    )


def _opened(path: str):
    full = path if "://" in path else path.replace(":/", ":///", 1)
    store, place = pafs.FileSystem.from_uri(full)
    return store.open_input_file(place)


def vectors_from_npy(spark: SparkSession, path: str, range_bytes: int = 64 << 20) -> DataFrame:
    """(ix, v) of the rows of .npy matrices, each file numbered from 0, read by ranges of rows of about range_bytes.

    Only headers are read to find the ranges, so a file may be of any size; both memory orders will do. Files lie in a
    store that pyarrow.fs knows. What is no matrix of numbers is an error; a matrix without rows gives none.
    """

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["path"]:
                with _opened(name) as f:
                    version = np.lib.format.read_magic(f)
                    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
                    shape, by_column, kind = read(f)
                    start = f.tell()
                if len(shape) != 2 or kind.kind not in "fiu":
                    raise ValueError(f"{name} holds {kind} in {len(shape)} dimensions, no matrix of numbers")
                step = max(1, range_bytes // max(1, shape[1] * kind.itemsize))
                first = np.arange(0, shape[0], step)
                yield pd.DataFrame({"path": name, "start": start, "n": shape[0], "dim": shape[1], "kind": kind.str, "by_column": by_column, "a": first, "b": np.minimum(first + step, shape[0])})

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                kind = np.dtype(r.kind)
                # runs of bytes in the file: one for a range of rows, one a column where columns lie together
                runs = [(r.a + c * r.n, r.b - r.a) for c in range(r.dim)] if r.by_column else [(r.a * r.dim, (r.b - r.a) * r.dim)]
                with _opened(r.path) as f:
                    parts = [np.frombuffer(f.read_at(n * kind.itemsize, r.start + at * kind.itemsize), kind) for at, n in runs]
                part = np.stack(parts, 1) if r.by_column and parts else (parts[0] if parts else np.zeros(0, kind)).reshape(r.b - r.a, r.dim)
                for i in range(0, len(part), 10_000):
                    piece = part[i : i + 10_000].astype(np.float32)
                    yield pd.DataFrame({"ix": np.arange(r.a + i, r.a + i + len(piece)), "v": list(piece)})

    files = spark.read.format("binaryFile").load(path).select("path")  # names only: contents are not read here
    found = files.mapInPandas(ranges, "path string, start bigint, n bigint, dim bigint, kind string, by_column boolean, a bigint, b bigint")
    return found.repartition(spark.sparkContext.defaultParallelism).mapInPandas(rows, "ix bigint, v array<float>")


def verify_file(path: str, size: int | None = None, md5: str | None = None, sha256: str | None = None) -> bool:
    """Whether a local file has the given size and digests."""
    digests = {"md5": hashlib.md5(), "sha256": hashlib.sha256()}
    n = 0
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            n += len(block)
            for d in digests.values():
                d.update(block)
    return (size is None or n == size) and (md5 is None or digests["md5"].hexdigest() == md5) and (sha256 is None or digests["sha256"].hexdigest() == sha256)
