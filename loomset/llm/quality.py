"""Quality rules by document and by host: host failure rates shrunk by an empirical beta prior."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.llm.common import SPACE, scratch_root, split_join, text_of, words_expr, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host is rejected if its shrunk failure rate is above this.
MAX_HOST_RATE = 0.6


def _neighbour(array: str, i: Column, step: int) -> Column:
    return F.get(F.col(array), i + step)["h"]


def text_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without its text, with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all bigint).

    Words are runs without ASCII white space. n_repeat_words counts words inside some 3-word window that occurs twice
    or more in the text. Windows are compared by 64-bit hashes; all steps take time in proportion to n log n of a text.
    Null texts have no word.
    """
    own = [c for c in docs.columns if c != text]
    made = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "__t", "__w", "__l", "__h", "__v", "__s", "__p"}
    if made & {c.lower() for c in own}:
        raise ValueError(f"docs has {sorted(made & {c.lower() for c in own})} already")
    out = docs.select(*own, text_of(text).alias("__t")).withColumn("__w", words_expr(F.col("__t")))
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    out = out.select(
        *own,
        F.size("__w").cast("bigint").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("__t", F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        lines.alias("__l"),
        F.transform("__w", lambda w: F.xxhash64(w)).alias("__h"),
    )
    windows = F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 3), lambda i: F.xxhash64(F.get("__h", i), F.get("__h", i + 1), F.get("__h", i + 2))))
    counts = [*own, "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    out = out.select(*counts[:-1], (F.size("__l") - F.size(F.array_distinct("__l"))).cast("bigint").alias("n_dup_lines"), windows.alias("__v"))
    # only a text with some window twice needs its windows in order
    again = F.size(F.array_distinct("__v")) < F.size("__v")
    out = out.select(*counts, F.when(again, F.sort_array(F.transform("__v", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("__s"))
    equal = F.transform("__s", lambda s, i: F.when((s["h"] == _neighbour("__s", i, -1)) | (s["h"] == _neighbour("__s", i, 1)), s["i"]))
    out = out.select(*counts, F.sort_array(F.filter(equal, lambda x: x.isNotNull())).alias("__p"))
    # a window covers 3 words, or as many as lie before the next one
    cover = F.aggregate(F.transform("__p", lambda p, i: F.least(F.lit(3), F.get("__p", i + 1) - p)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return out.select(*counts, F.coalesce(cover, F.lit(0).cast("bigint")).alias("n_repeat_words"))


def base_failure(n_words: str = "n_words", n_repeat_words: str = "n_repeat_words") -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (F.col(n_words) < MIN_WORDS) | (100 * F.col(n_repeat_words) > MAX_REPEAT_PERCENT * F.col(n_words))


def host_verdicts(rows: DataFrame, host: str, failed: str, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(host, n, failures, rate, rejected): failure rates by host under a beta prior fitted to all hosts by moments.

    The prior has the mean of all rows and the variance of the hosts' rates beyond what their sizes explain; rate is
    the posterior mean. Null is a host of its own. One row of five sums comes to the driver.
    """
    scratch_root(rows.sparkSession)
    hosts = rows.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), F.sum(F.col(failed).cast("bigint")).alias("failures")).checkpoint()
    p = F.col("failures") / F.col("n")
    s = hosts.agg(F.sum("n").alias("n"), F.sum("failures").alias("k"), F.var_pop(p).alias("v"), F.avg(1 / F.col("n")).alias("i")).first()
    mean = (s["k"] or 0) / s["n"] if s["n"] else 0.0
    between = (s["v"] or 0.0) - mean * (1 - mean) * (s["i"] or 0.0)
    # without variance between hosts the prior is as strong as it gets; hosts all alike then share the mean
    strength = min(1e6, max(2.0, mean * (1 - mean) / between - 1)) if between > 0 else 1e6
    rate = (F.col("failures") + mean * strength) / (F.col("n") + strength)
    return hosts.select("host", "n", "failures", rate.alias("rate"), (rate > max_rate).alias("rejected"))


def quality_verdicts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(doc_id, host, the five features, base_failed, host_rate, kept): one row for each row of docs.

    kept: neither the document fails its rules nor its host is rejected. An empty table gives no row.
    """
    rows = written(text_features(docs.select(F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(text).alias("__text")), "__text").withColumn("base_failed", base_failure()), "quality")
    verdicts = host_verdicts(rows, "host", "base_failed", max_rate).select(F.col("host").alias("h"), F.col("rate").alias("host_rate"), "rejected")
    if verdicts.limit(200_001).count() <= 200_000:
        joined = rows.join(F.broadcast(verdicts), F.col("host").eqNullSafe(F.col("h")))
    else:  # the null host under a name that is none
        named = lambda c: F.coalesce(F.concat(F.lit("h"), c), F.lit("-")).alias("__host")
        joined = split_join(rows.select("*", named(F.col("host"))), verdicts.select(named(F.col("h")), "host_rate", "rejected"), "__host")
    return joined.select(*rows.columns, "host_rate", (~F.col("base_failed") & ~F.col("rejected")).alias("kept"))
