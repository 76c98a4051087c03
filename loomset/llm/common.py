"""What the operators share: the shared scratch folder, columns under fixed names, Arrow word arrays."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of all word definitions here, as a Java regex class body.
SPACE = r"\x20\x09-\x0D"
#: Rows of an Arrow batch where the session leaves Spark's default, which is made for rows without long texts.
BATCH_ROWS = 2_000
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_OWN: dict[str, str] = {}
#: Of the GNU C library; others have none.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a temporary one only where that is unset on a local master.

    As every operator begins here, the session's Arrow batches are also bounded to BATCH_ROWS, unless it has set its own.
    """
    sc = spark.sparkContext
    if spark.conf.get(_ARROW_ROWS) == "10000":
        spark.conf.set(_ARROW_ROWS, str(BATCH_ROWS))
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _OWN.setdefault("root", "file://" + tempfile.mkdtemp(prefix="loomset-"))
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(root)
    path = sc._jvm.org.apache.hadoop.fs.Path(root)
    full = path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return full if "://" in full else full.replace(":/", ":///", 1)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder. It is removed when the driver ends."""
    path = f"{scratch_root(spark)}/loomset-{name}-{uuid.uuid4().hex}"
    atexit.register(remove_path, spark, path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Spark's own file systems, if the session still lives."""
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    with contextlib.suppress(Py4JError, OSError):  # the JVM may have gone before
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df to the shared folder as Parquet and read it again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    """The text as a string; null is empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def row_key(doc_id: str, text: str) -> Column:
    """A key of a row's id and text: rows of one key are copies of one row."""
    return F.xxhash64(F.col(doc_id), text_of(text))


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without_keys(docs: DataFrame, keys: DataFrame, doc_id: str, text: str, broadcast_rows: int) -> DataFrame:
    """The rows of docs whose row_key() is not in keys (one column, key). Beyond broadcast_rows keys, texts are shuffled."""
    name = free_name(docs, "__key")
    gone = broadcast_or_shuffle(keys.toDF(name), broadcast_rows)
    return docs.withColumn(name, row_key(doc_id, text)).join(gone, name, "left_anti").select(docs.columns)


def words_expr(text: Column) -> Column:
    """JVM words [^\\x20\\x09-\\x0D]+ as an array; no words: an empty array."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def word_lists(texts: pa.Array) -> pa.ListArray:
    """Words of each text (ASCII white space between them) as one Arrow list array without empty words."""
    lists = pc.ascii_split_whitespace(texts)
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    if full.all():
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
    before = np.concatenate(([0], np.cumsum(full)))
    return pa.ListArray.from_arrays(pa.array(before[offsets], pa.int32()), flat.filter(pa.array(full)))


def give_back() -> None:
    """Return what Arrow and the C library have freed to the system, or workers that live on would keep their peak."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def slices(batch: pa.RecordBatch, column: str, chars: int = 2_000_000):
    """Cut a batch into runs of rows whose texts hold about so many bytes; a longer text stands alone. Then give_back()."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, total, begin = [], 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > chars:
            ends.append((begin, i))
            begin, total = i, 0
        total += int(n)
    if len(sizes) > begin:
        ends.append((begin, len(sizes)))
    for a, b in ends:
        yield batch.slice(a, b - a)
    give_back()


def split_join(rows: DataFrame, keyed: DataFrame, key: str, how: str = "inner", least_hot: int = 10_000, most_hot: int = 1_000_000) -> DataFrame:
    """rows joined (inner or left) to keyed, which has one row a key, without meeting a frequent key's rows in one task.

    Keys of more than least_hot rows, or of more than a most_hot-th of all rows, are most_hot at most; what keyed has of
    them is broadcast. Only the rows of other keys are shuffled. Rows of a null key meet nothing and are not shuffled.
    rows are read several times: they should be a written table.
    """
    known = rows.where(F.col(key).isNotNull())
    hot = known.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > least_hot).checkpoint()
    if hot.isEmpty():
        out = known.join(keyed, key, how)
    else:
        hot = hot.where(F.col("__n") > rows.count() // most_hot).select(key)
        small = keyed.join(F.broadcast(hot), key, "left_semi")
        warm = known.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(small), key, how)
        out = known.join(F.broadcast(hot), key, "left_anti").join(keyed, key, how).unionByName(warm)
    if how == "left":
        out = out.unionByName(rows.where(F.col(key).isNull()).join(keyed.limit(0), key, "left"))
    return out


def broadcast_or_shuffle(small: DataFrame, max_rows: int) -> DataFrame:
    """Mark a side for broadcasting only if a count proves it within max_rows; else it is joined by shuffle."""
    return F.broadcast(small) if small.limit(max_rows + 1).count() <= max_rows else small
