"""Key-value lookups with a lifetime for misses: latest rows, valid rows, work lists, read-through resolution."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.functions.text import image_key, mangle, valid_id
from loomset.operators.keys import contiguous_index
from loomset.sources.sinks import read_table, read_text, replace_table, table_path, write_text

#: Seconds for which a miss holds; fetchers at once; rows of a batch; seconds of back-off, doubling.
MISS_SECONDS = 30 * 24 * 3600
FETCHERS, BATCH = 16, 500
BACKOFF = (2.0, 60.0)


def upserted(old: DataFrame, new: DataFrame, key: str = "id", at: str = "fetched_at") -> DataFrame:
    """The latest row of each key of both tables; of equal times the new one. Combines before its one shuffle."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    row = F.struct(*old.columns)
    return both.groupBy(key).agg(F.max_by(row, F.struct(at, "__new")).alias("r")).select("r.*")


def valid_rows(cache: DataFrame, now: int, value: str = "value", at: str = "fetched_at", lifetime: int = MISS_SECONDS) -> DataFrame:
    """Rows with a value, and rows without one that are younger than lifetime."""
    return cache.where((F.coalesce(value, F.lit("")) != "") | (F.lit(now) - F.col(at) < lifetime))


def cache_stats(cache: DataFrame, value: str = "value") -> DataFrame:
    """One row: rows, and rows with a value."""
    return cache.agg(F.count("*").alias("n"), F.count(F.nullif(F.col(value), F.lit(""))).alias("found"))


def work_list(candidates: DataFrame, known: DataFrame, limit: int, key: str = "id", pop: str = "pop", check: bool = True) -> DataFrame:
    """The most popular valid candidates, cut at limit, and of those the ones not known: the cut comes first."""
    good = candidates.where(valid_id(F.col(key))) if check else candidates
    return good.orderBy(F.col(pop).desc(), key).limit(limit).join(known.select(key), key, "left_anti")


def first_seen(ids: DataFrame, key: str = "id", place: str = "place") -> DataFrame:
    """Each id once, at its first place."""
    return ids.groupBy(key).agg(F.min(place).alias(place)).orderBy(place)


def fetched(ids: DataFrame, fetch: Callable[[str], tuple[str, dict] | None], now: int, key: str = "id", sleep: Callable[[float], None] = time.sleep, attempts: int = 8, rate: float | None = None) -> DataFrame:
    """(id, value, title, fetched_at) of different ids by an injected fetch in at most FETCHERS tasks.

    rate bounds the requests a second of all tasks together: each keeps to its share. fetch(id) gives (value, {"title": ...}), ("", {}) for a definite miss, or None for a passing failure, after which the
    task waits twice as long, up to a bound, and tries again; ids that keep failing are left out.
    """

    gap = FETCHERS / rate if rate else 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        due = time.monotonic() + gap
        for batch in batches:
            for begin in range(0, len(batch), BATCH):
                rows, wait = [], BACKOFF[0]
                for i in batch["id"].iloc[begin : begin + BATCH]:
                    for _ in range(attempts):
                        if gap:
                            sleep(max(0.0, due - time.monotonic()))
                            due = max(due, time.monotonic()) + gap
                        if (found := fetch(i)) is not None:
                            rows.append((i, found[0], found[1].get("title") or "", now))
                            wait = BACKOFF[0]
                            break
                        sleep(wait)
                        wait = min(wait * 2, BACKOFF[1])
                yield pd.DataFrame(rows, columns=["id", "value", "title", "fetched_at"])

    different = ids.select(F.col(key).alias("id")).distinct().repartition(FETCHERS, "id")
    return different.mapInPandas(run, _ANSWERS)


_ANSWERS = "id string, value string, title string, fetched_at bigint"


def fetch_all(candidates: DataFrame, fetch: Callable[[str], tuple[str, dict] | None], path: str, now: int, key: str = "id", pop: str = "pop", batch: int = BATCH, **how) -> DataFrame:
    """The answers (see fetched()) of all candidates, the most popular first, committed below path after every `batch` ids.

    The first call writes the list of work; a later one, after a job that died, takes that list and goes on behind the
    last committed batch, so at most one batch is asked again. Ids that kept failing are in no answer; the next work list
    has them. A candidate in several rows is asked once, at its most popular place.
    """
    spark = candidates.sparkSession
    work, done = f"{path}/work", f"{path}/done"
    if table_path(spark, work) is None:
        order = candidates.groupBy(F.col(key).alias("id")).agg(F.max(pop).alias("pop")).select("id", F.struct(-F.coalesce("pop", F.lit(0)), "id").alias("order"))
        placed = contiguous_index(order, "order", "place").select("id", "place")
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        replace_table(placed.repartitionByRange(n, "place").sortWithinPartitions("place"), work)
    listed = read_table(spark, work)
    batches = math.ceil(listed.count() / batch)
    for number in range(int(read_text(spark, done) or 0), batches):
        own = listed.where((F.col("place") >= number * batch) & (F.col("place") < (number + 1) * batch)).select("id")
        # one file a batch: its rows are few by definition
        fetched(own, fetch, now, **how).repartition(1).write.mode("overwrite").parquet(f"{path}/answers/batch={number}")
        write_text(spark, done, str(number + 1))
    if not batches:
        return spark.createDataFrame([], _ANSWERS)
    return spark.read.schema(f"{_ANSWERS}, batch int").parquet(f"{path}/answers").drop("batch")


def resolve(ids: DataFrame, cache: DataFrame, fetch: Callable[[str], tuple[str, dict] | None], now: int, **how) -> tuple[DataFrame, DataFrame]:
    """(answers, cache): answers (id, value) for ids, cached or fetched, without misses; and the table with what is new."""
    asked = ids.select("id").distinct().where(valid_id(F.col("id")))
    held = valid_rows(cache, now)
    new = fetched(asked.join(held.select("id"), "id", "left_anti"), fetch, now, **how).persist()
    full = upserted(cache, new.select(*cache.columns))
    return full.join(asked, "id", "left_semi").where("value <> ''").select("id", "value"), full


def parsed_answers(answers: DataFrame) -> DataFrame:
    """(id, value, title) from JSON bodies (id, body): the image key of thumbnail_url, empty for a definite miss."""
    key = image_key(F.get_json_object("body", "$.thumbnail_url"))
    return answers.select("id", F.coalesce(key, F.lit("")).alias("value"), F.coalesce(F.get_json_object("body", "$.title"), F.lit("")).alias("title"))


def repaired_names(names: DataFrame, titles: DataFrame, key: str = "id", name: str = "name") -> DataFrame:
    """names with those that provably are a mangled title replaced by it; other columns and rows stay."""
    found = names.join(titles.select(key, F.col("title").alias("__title")), key, "left")
    good = (F.col("__title") != F.col(name)) & (mangle(F.col("__title")) == F.col(name)) & (F.col("__title") != "")
    return found.select(*(F.when(good, F.col("__title")).otherwise(F.col(c)).alias(c) if c == name else F.col(c) for c in names.columns))
