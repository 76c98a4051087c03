"""Licence scans: TF-IDF cosine of headers and licence files to templates, then inheritance from directories above."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.llm.common import SPACE, scratch_root, slices, split_join, text_of, word_lists, written
from loomset.llm.license_texts import SPDX, TEMPLATES

MIN_COSINE = 0.8
#: A file whose units with a licence hold so much of its words is a licence file.
FILE_SHARE = 0.5
FILE_NAMES = ("license", "licence", "copying", "notice")
_WORD = re.compile(f"[^{SPACE}]+")
_TRIM = ".,;:!?\"'()[]{}|*#%$&<>_=\\`~@^+"


class Templates:
    """Unit TF-IDF vectors of the templates; words they lack weigh as if one template had them."""

    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES, min_cosine: float = MIN_COSINE):
        self.names = [n for n, texts in sorted(templates.items()) for _ in texts]
        counts = [Counter(w for w in (x.lower().strip(_TRIM) for x in t.split()) if w) for _, texts in sorted(templates.items()) for t in texts]
        self.min_cosine = min_cosine
        df = Counter(w for c in counts for w in c)
        self.idf = {w: math.log(1 + len(counts) / n) for w, n in df.items()}
        self.rare = math.log(1 + len(counts))
        self.vectors = [self._unit(c) for c in counts]
        #: By word the square of its weight in each template. A text whose different words have less than min_cosine
        #: squared of a template's squares cannot reach min_cosine with it (Cauchy-Schwarz), nor can any part of it.
        self.words = {w: i for i, w in enumerate(sorted(df))}
        self.squares = np.array([[v.get(w, 0.0) ** 2 for v in self.vectors] for w in self.words])
        self.lengths = [sum(c.values()) for c in counts]
        self.by_identifier = {n.lower(): n for n in templates}

    def may_match(self, words) -> bool:
        """Whether a text of these words can reach min_cosine with some template."""
        own = [self.words[w] for w in set(words) if w in self.words]
        return bool(own) and bool(self.squares[own].sum(axis=0).max() >= self.min_cosine**2 - 1e-9)

    def _unit(self, counts: Counter) -> dict[str, float]:
        own = {w: (1 + math.log(n)) * self.idf.get(w, self.rare) for w, n in counts.items()}
        norm = math.sqrt(sum(x * x for x in own.values()))
        return {w: x / norm for w, x in own.items()}

    def windows(self, words: list[str]) -> list[tuple[int, int]]:
        """(begin, end) of the stretches of a text's words, as long as a template, that may reach min_cosine with it.

        A stretch is left out if its words together have less than min_cosine squared of the template's squares; of
        stretches that begin at neighbouring words the one with most of them is taken.
        """
        known = np.array([self.words.get(w, -1) for w in words], np.int64)
        squares = np.where(known[:, None] >= 0, self.squares[known], 0.0)
        total = np.concatenate((np.zeros((1, squares.shape[1])), np.cumsum(squares, axis=0)))
        found = set()
        for t, n in enumerate(self.lengths):
            if n >= len(words):
                continue
            held = total[n:, t] - total[:-n, t]
            at = np.flatnonzero(held >= self.min_cosine**2 - 1e-9)
            for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                if len(run):
                    begin = int(run[np.argmax(held[run])])
                    found.add((begin, begin + n))
        return sorted(found)

    def identified(self, text: str) -> str | None:
        """The licence of the first line with an SPDX identifier of a template."""
        for name in re.findall(SPDX, text):
            known = self.by_identifier.get(re.sub("(-only|-or-later|[+])$", "", name.lower()))
            if known:
                return known
        return None

    def best(self, words: list[str]) -> tuple[float, str | None]:
        """(cosine, licence) of the nearest template, of equal ones the first by name; below min_cosine: no licence."""
        if not words:
            return 0.0, None
        own = self._unit(Counter(words))
        cosine, at = max((sum(x * v.get(w, 0.0) for w, x in own.items()), -i) for i, v in enumerate(self.vectors))
        cosine = round(cosine, 9)
        return (cosine, self.names[-at]) if cosine >= self.min_cosine else (0.0, None)


def _plain(text: str) -> list[str]:
    """The words of a text, in lower case without punctuation around them; pure punctuation goes."""
    return [w for w in (x.strip(_TRIM) for x in _WORD.findall(text.lower())) if w]


def _units(text: str) -> list[str]:
    """Headers of a text: its lines, its runs of lines without a blank one between, and the whole."""
    lines = text.split("\n")
    found, run = [x for x in lines if x.strip()], []
    for x in [*lines, ""]:
        if x.strip():
            run.append(x)
        else:
            if len(run) > 1:
                found.append("\n".join(run))
            run = []
    return [*found, text] if len(found) > 1 else found


def own_licenses(files: DataFrame, templates: Templates | None = None) -> DataFrame:
    """(id, path, license, cosine, is_file) of files (id, path, t): the best of each whole text's units and windows.

    A unit is a line, a run of lines without a blank one between, or the whole text; a window is a stretch of as many
    words as a template has, wherever it stands. Of several with a licence the one of the largest cosine times its words
    counts, for short notices stand in longer texts of other licences. An SPDX line comes first, with a cosine of 1.
    """
    own = templates or Templates()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                lists = word_lists(part.column(2))
                coded = lists.flatten().dictionary_encode()
                plain = pc.utf8_trim(pc.utf8_lower(coded.dictionary), _TRIM).to_pylist()
                ends = lists.offsets.to_numpy()[1:]
                known = np.array([own.words.get(w, -1) for w in plain] or [-1])[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
                hit = np.flatnonzero(known >= 0)
                pairs = np.unique(np.searchsorted(ends, hit, "right") * len(own.words) + known[hit])
                cover = np.zeros((len(part), own.squares.shape[1]))
                np.add.at(cover, pairs // len(own.words), own.squares[pairs % len(own.words)])
                named = pc.match_substring(part.column(2), "SPDX-License-Identifier:").to_numpy(zero_copy_only=False)
                docs = np.flatnonzero((cover.max(axis=1) >= own.min_cosine**2 - 1e-9) | named)
                license: list[str | None] = [None] * len(part)
                cosine, whole = np.zeros(len(part)), np.zeros(len(part), bool)
                for d in docs.tolist():
                    lines = block = 0
                    text = part.column(2)[d].as_py()
                    every = _plain(text)
                    found = [(c * (b - a), c, name) for a, b in own.windows(every) for c, name in (own.best(every[a:b]),) if name]
                    for unit in _units(text):
                        words = _plain(unit)
                        if not own.may_match(words):
                            continue
                        c, name = own.best(words)
                        if name:
                            found.append((c * len(words), c, name))
                        if name and "\n" in unit:
                            block = max(block, len(words))
                        elif name:
                            lines += len(words)
                    if found:
                        _, cosine[d], license[d] = max(found, key=lambda f: (round(f[0], 6), f[1], f[2]))
                    if named[d] and (name := own.identified(text)):
                        cosine[d], license[d] = 1.0, name
                    whole[d] = license[d] is not None and max(lines, block) >= FILE_SHARE * int(ends[d] - (ends[d - 1] if d else 0))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(license, pa.string()), pa.array(cosine), pa.array(whole)], names=["id", "path", "license", "cosine", "is_file"])

    kind = files.schema["id"].dataType.simpleString()
    return files.select("id", "path", "t").mapInArrow(run, f"id {kind}, path string, license string, cosine double, is_file boolean")


def scan_licenses(files: DataFrame, file_id: str = "doc_id", path: str = "path", text: str = "text", templates: Templates | None = None) -> DataFrame:
    """(id, path, license, cosine, origin, origin_dir): one row for each row of files.

    origin is own for a licence in the text itself, inherited for that of a licence file in the nearest directory at or
    above the file's (origin_dir), null for none; of several licence files in a directory those so named come first, then the
    largest cosine, then the licence's name. A licence file is named as one of FILE_NAMES or consists of notices by FILE_SHARE of its words. Null paths
    are in no directory; null and empty texts have no own licence.
    """
    scratch_root(files.sparkSession)
    named = files.select(F.col(file_id).alias("id"), F.col(path).alias("path"), text_of(text).alias("t"))
    rows = written(own_licenses(named, templates), "licenses")
    parent = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", r"/[^/]*\z", "")).otherwise(F.when(F.col("path").isNotNull(), F.lit("")))
    base = F.regexp_extract(F.lower(F.substring_index("path", "/", -1)), r"\A[^.]*", 0)
    by_name = base.isin(*FILE_NAMES)
    held = rows.where("license is not null and path is not null").where(F.col("is_file") | by_name).select("license", "cosine", parent.alias("dir"), (~by_name).alias("by_text"))
    best = F.min(F.struct("by_text", (-F.col("cosine")).alias("c"), F.col("license").alias("l"))).alias("best")
    dirs = held.groupBy("dir").agg(best).select("dir", F.col("best.l").alias("from"), (-F.col("best.c")).alias("from_cosine"))
    # the directories without licence of their own are few against the files, so the walk upwards is over distinct ones
    lacking = rows.where("license is null and path is not null").select(parent.alias("at")).distinct()
    steps = F.split("at", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    walked = lacking.withColumn("dir", F.explode(F.array_distinct(above))).join(dirs, "dir")
    near = walked.groupBy("at").agg(F.max(F.struct(F.length("dir").alias("n"), "dir", "from", "from_cosine")).alias("near"))
    placed = rows.withColumn("at", F.when(F.col("license").isNull(), parent))
    near = near.checkpoint()
    joined = placed.join(F.broadcast(near), "at", "left") if near.limit(200_001).count() <= 200_000 else split_join(placed, near, "at", "left")
    mine = F.col("license").isNotNull()
    return joined.select("id", "path", F.coalesce("license", "near.from").alias("license"), F.when(mine, F.col("cosine")).otherwise(F.col("near.from_cosine")).alias("cosine"), F.when(mine, "own").when(F.col("near").isNotNull(), "inherited").alias("origin"), F.when(mine, parent).otherwise(F.col("near.dir")).alias("origin_dir"))
