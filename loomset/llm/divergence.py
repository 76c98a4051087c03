"""Divergence of sources: byte-level term counts by group, then exact divergences over CSR matrices of term blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomset.llm.common import broadcast_or_shuffle, give_back, scratch_root, slices, split_join, text_of, written

#: A term counts in a group (language) if so many of its documents have it.
LEAST_DOCUMENTS = 10
#: Ranks of the terms that are reported of a source.
TOP_TERMS = 10
#: Probabilities are whole numbers of this scale.
SCALE = 1_000_000_000
#: A task takes the terms of so many (source, term) counts, against so many sources at once.
BLOCK_COUNTS, BLOCK_SOURCES = 50_000, 256
#: Different (group, source, term) that a task adds up before it passes them on, and bytes of texts read at once.
HELD, BATCH_CHARS = 800_000, 4_000_000
BROADCAST_ROWS = 200_000
_COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def _byte_table() -> np.ndarray:
    """By byte: a space between terms, else the byte itself, A-Z in lower case. Terms: ASCII letters and all bytes beyond ASCII."""
    table = np.full(256, ord(" "), np.uint8)
    table[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
    table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1]
    table[128:] = np.arange(128, 256)
    return table


_BYTES = _byte_table()


def _coded(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, different): the number of each 64-bit key among the different ones, in the order in which they appear."""
    coded = pa.array(keys.view(np.int64)).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_numpy()


def slice_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(row, code, terms): of each term slice of the texts in order, its row and the number of its term in terms.

    The texts stand in one buffer, a separator between them; a table over bytes finds the slices. They are grouped by
    xxhash; each is then compared byte by byte with the first of its group, and should one differ, all are grouped by
    their bytes.
    """
    texts = texts.cast(pa.string())
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "\n")[0]
    data = _BYTES[np.frombuffer(joined.as_buffer(), np.uint8)] if len(texts) else np.zeros(0, np.uint8)
    ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64) + 1)
    inside = np.concatenate(([False], data != ord(" ")))
    begin = np.flatnonzero(inside[1:] & ~inside[:-1])
    found = data.tobytes().split()
    row = np.searchsorted(ends, begin, side="right")
    code, different = _coded(np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)))
    first = np.zeros(len(different), np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    terms = [found[i] for i in first.tolist()]
    if not all(map(eq, found, map(terms.__getitem__, code.tolist()))):
        known: dict[bytes, int] = {}
        code = np.fromiter([known.setdefault(w, len(known)) for w in found], np.int64, len(found))
        terms = list(known)
    return row, code, terms


def _group_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each (lang, source, term), added up in the task; each (lang, source) also comes with a null term and 0."""
    held: list[pa.Table] = []
    rows = 0

    def added() -> pa.Table:
        return pa.concat_tables(held).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for part in slices(batch, "t", BATCH_CHARS):
            names = pa.table([part.column("lang"), part.column("source")], names=["lang", "source"]).append_column("at", pa.array(np.arange(len(part))))
            names = names.group_by(["lang", "source"]).aggregate([("at", "list")])
            group = np.empty(len(part), np.int64)
            group[names["at_list"].combine_chunks().flatten().to_numpy()] = np.repeat(np.arange(len(names)), pc.list_value_length(names["at_list"]).to_numpy())
            row, code, terms = slice_terms(part.column("t"))
            many = max(len(terms), 1)
            at, in_row = _coded(row * many + code)  # one for each row and term
            docs_at, own = _coded(group[in_row // many] * many + in_row % many)  # and for each group and term
            n = np.bincount(docs_at, weights=np.bincount(at, minlength=len(in_row)), minlength=len(own)).astype(np.int64)
            docs = np.bincount(docs_at, minlength=len(own))
            which = np.concatenate((own // many, np.arange(len(names))))
            words = pa.array(terms, pa.binary()).cast(pa.string()).take(pa.array(np.concatenate((own % many, np.zeros(len(names), np.int64))), mask=np.arange(len(which)) >= len(own)))
            zero = np.zeros(len(names), np.int64)
            chosen = names.select(["lang", "source"]).take(pa.array(which))
            held.append(pa.table([chosen["lang"], chosen["source"], words, pa.array(np.concatenate((n, zero))), pa.array(np.concatenate((docs, zero)))], names=["lang", "source", "term", "n", "docs"]))
            rows += len(which)
            if rows > HELD:
                held = [added()]
                rows = len(held[0])
                if rows > HELD // 2:
                    yield from held.pop().to_batches(max_chunksize=20_000)
                    rows = 0
    if held:
        yield from added().to_batches(max_chunksize=20_000)
    give_back()


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term in each group, and a null term by group."""
    named = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), text_of(text).alias("t"))
    # dealt by language and term, which is also how the terms to keep are found: one shuffle for both
    counted = named.mapInArrow(_group_counts, _COUNTS).repartition("lang", "term")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probabilities(count: np.ndarray, total: np.ndarray | int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)) in whole numbers, by long division, so nothing overflows."""
    rest, size = np.asarray(count, np.int64) + 2, np.asarray(total, np.int64) + 2 * terms
    out = rest // size * SCALE
    rest = rest % size
    scale = SCALE
    while scale > 1:
        rest = rest * 1000
        scale //= 1000
        out = out + rest // size * scale
        rest = rest % size
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); both are at most SCALE + 1, so the square fits 64 bits."""
    d = p - q
    return d * d // (p + q)


def _block(top: int) -> Callable[[pa.Table], pa.Table]:
    """Of one block of a language's terms: partial sums of pairs, and the leading terms, of one block of sources."""

    def run(table: pa.Table) -> pa.Table:
        lang, n_terms, lang_total, mine = (table[c][0].as_py() for c in ("lang", "v", "lang_n", "part"))
        heads = table.filter(pc.is_null(table["term"])).sort_by("source")
        cells = table.filter(pc.is_valid(table["term"]))
        names, total = heads["source"].combine_chunks(), heads["total"].to_numpy()
        own = np.flatnonzero(heads["source_part"].to_numpy() == mine)
        terms = cells["term"].combine_chunks().dictionary_encode()
        words, col = terms.dictionary, terms.indices.to_numpy().astype(np.int64)
        row = pc.index_in(cells["source"].combine_chunks(), names).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.lexsort((col, row))
        row, col, n = row[order], col[order], cells["n"].to_numpy()[order]
        start = np.searchsorted(row, np.arange(len(names) + 1))  # CSR: the cells of source i are start[i] to start[i + 1]
        full = np.flatnonzero(np.diff(start))  # sources with a cell, at whose starts reduceat adds up
        p = probabilities(n, total[row], n_terms) if len(row) else np.zeros(0, np.int64)
        none = probabilities(np.zeros(len(names), np.int64), total, n_terms) if n_terms else np.zeros(len(names), np.int64)

        def by_source(values: np.ndarray) -> np.ndarray:
            out = np.zeros(len(names), np.int64)
            if len(full):
                out[full] = np.add.reduceat(values, start[full])
            return out

        kinds, sources, items, values = [], [], [], []
        for i in own.tolist():
            at = slice(start[i], start[i + 1])
            dense = np.full(len(words), none[i], np.int64)
            dense[col[at]] = p[at]
            has = np.zeros(len(words), bool)
            has[col[at]] = True
            met = has[col]
            f = by_source(divergence(dense[col], p)) if len(col) else np.zeros(len(names), np.int64)
            # terms of i alone: all of its terms against what each other source has of a term without a count, less the common ones
            common = by_source(np.where(met, divergence(dense[col], none[row]), 0)) if len(col) else 0
            level, times = np.unique(p[at], return_counts=True)
            alone = np.zeros(len(names), np.int64)
            for v, k in zip(level.tolist(), times.tolist(), strict=True):
                alone += k * divergence(np.int64(v), none)
            both = by_source(met.astype(np.int64)) if len(col) else 0
            rest = len(words) - np.diff(start) - (start[i + 1] - start[i]) + both
            f = f + alone - common + (rest * divergence(none[i], none) if n_terms else 0)
            others = np.flatnonzero(np.arange(len(names)) != i)
            kinds.append(np.zeros(len(others), np.int64))
            sources.append(np.full(len(others), i))
            items.append(others)
            values.append(f[others])
        pairs = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (sources, items, values)]
        q = probabilities(np.bincount(col, weights=n, minlength=len(words)).astype(np.int64), lang_total, n_terms)[col] if len(col) else p
        lead = np.flatnonzero((p > q) & np.isin(row, own))
        f = divergence(p[lead], q[lead])
        place = pc.rank(words, "ascending").to_numpy()[col[lead]] if len(lead) else f  # binary order of the terms
        best = np.lexsort((place, -f, row[lead]))
        at = row[lead][best]
        best = best[np.arange(len(at)) - np.searchsorted(at, at) < top]
        chosen = lead[best]
        return pa.table(
            {
                "lang": pa.array([lang] * (len(pairs[0]) + len(chosen)), pa.string()),
                "source": names.take(pa.array(np.concatenate((pairs[0], row[chosen])))),
                "part": pa.array(["pair"] * len(pairs[0]) + ["term"] * len(chosen), pa.string()),
                "item": pa.concat_arrays([names.take(pa.array(pairs[1])), words.take(pa.array(col[chosen]))]),
                "value": pa.array(np.concatenate((pairs[2], f[best]))),
            }
        )

    return run


def _joined(rows: DataFrame, keyed: DataFrame, key: str) -> DataFrame:
    """rows with what keyed, one row a key, has of their key: broadcast within a bound, beyond it without a hot key in one task."""
    small = broadcast_or_shuffle(keyed, BROADCAST_ROWS)
    return rows.join(small, key) if small is not keyed else split_join(rows, keyed, key)


def source_divergences(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_documents: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source's terms differ from those of other sources and of its language.

    Terms are runs of ASCII letters, A-Z in lower case, and characters beyond ASCII; a language keeps those that at least
    least_documents of its documents have. Each group, and each language as a whole, gives each kept term p = 1 +
    floor(SCALE * (count + 2) / (N + 2 * V)); f = floor((p - q)^2 / (p + q)). Part pair: the sum of f over all kept terms
    for each other source of the language, 0 without kept terms. Part term: f of the terms that the source has more often
    than its language, the first `top`. Ranks run by value from the largest, then by the item's bytes.

    Null text, lang and source are empty texts. A group without terms counts, an empty table gives no rows, equal rows count
    each, very long texts and terms are taken whole, other columns are ignored. All sums are whole numbers: they are exact
    up to 9e15 terms in a language.
    """
    scratch_root(docs.sparkSession)
    own = Window.partitionBy("lang", "term")
    counts = term_counts(docs, lang, source, text).withColumns({"in_docs": F.sum("docs").over(own), "leads": F.min("source").over(own) == F.col("source")})
    kept = written(counts.where(F.col("term").isNull() | (F.col("in_docs") >= least_documents)).select("lang", "source", "term", "n", "leads"), "divergence-counts")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("term").alias("cells"), F.count(F.when(F.col("leads") & F.col("term").isNotNull(), 1)).alias("leads"))
    heads = written(sums, "divergence-groups")
    langs = heads.groupBy("lang").agg(F.sum("total").alias("lang_n"), F.sum("cells").alias("cells"), F.count("*").alias("sources"), F.sum("leads").alias("v"))
    langs = langs.select("lang", "v", "lang_n", F.ceil(F.greatest("cells", F.lit(1)) / BLOCK_COUNTS).cast("int").alias("blocks"), F.ceil(F.col("sources") / BLOCK_SOURCES).cast("int").alias("parts")).checkpoint()
    cells = _joined(kept.where("term is not null"), langs, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    cells = cells.select("lang", "source", "term", "n", F.lit(0).cast("bigint").alias("total"), F.lit(0).alias("source_part"), "v", "lang_n", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    every = _joined(heads.drop("cells", "leads"), langs, "lang").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    every = every.select("lang", "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("bigint").alias("n"), "total", F.pmod(F.xxhash64("source"), F.col("parts")).cast("int").alias("source_part"), "v", "lang_n", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    found = cells.union(every).groupBy("lang", "block", "part").applyInArrow(_block(top), "lang string, source string, part string, item string, value bigint")
    values = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    return values.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
