"""Requests over the serving tables: search, recommendation, arithmetic, cards, lookups, with their limits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.functions.text import CARD_URL, card_url, haystack, id_list
from loomset.functions.vectors import doubles, normalized
from loomset.operators.analogy import MAX_TERMS, MIN_POP, analogy
from loomset.operators.cache import cache_stats, resolve
from loomset.operators.keys import assert_contiguous
from loomset.operators.recommend import recommend
from loomset.operators.search import search
from loomset.sources.params import ParamsFile

#: Limits of requests.
MIN_QUERY, MAX_RESULTS, MAX_SEEDS, MAX_IDS = 2, 100, 20, 60


class BadRequest(ValueError):
    """A request outside its limits."""


class NotFound(LookupError):
    """A key that no row has."""


def _between(name: str, value: int | None, low: int, high: int | None = None, optional: bool = False) -> None:
    if value is None and optional:
        return
    if not isinstance(value, int) or isinstance(value, bool) or value < low or high is not None and value > high:
        raise BadRequest(f"{name} must be {low}{f' to {high}' if high is not None else ' or more'}, not {value!r}")


@dataclass(frozen=True)
class SearchRequest:
    q: str
    limit: int = 20
    min_pop: int = 0
    max_pop: int | None = None

    def __post_init__(self) -> None:
        if len(self.q) < MIN_QUERY:
            raise BadRequest(f"q needs {MIN_QUERY} characters")
        _between("limit", self.limit, 1, MAX_RESULTS)
        _between("min_pop", self.min_pop, 0)
        _between("max_pop", self.max_pop, 0, optional=True)


@dataclass(frozen=True)
class RecommendRequest:
    seeds: tuple[int, ...]
    exclude_same_artist: bool = False
    min_pop: int = 0
    max_pop: int | None = None

    def __post_init__(self) -> None:
        if not 1 <= len(self.seeds) <= MAX_SEEDS:
            raise BadRequest(f"1 to {MAX_SEEDS} seeds")
        _between("min_pop", self.min_pop, 0)


@dataclass(frozen=True)
class ArithmeticRequest:
    terms: tuple[tuple[int, str], ...]
    exclude_input: bool = True
    min_pop: int = MIN_POP
    max_pop: int | None = None

    def __post_init__(self) -> None:
        if not 1 <= len(self.terms) <= MAX_TERMS or any(op not in ("+", "-", "*") for _, op in self.terms):
            raise BadRequest(f"1 to {MAX_TERMS} terms with + - or *")
        _between("min_pop", self.min_pop, 0)


class Service:
    """The serving tables of one load. Weights come from the parameter file, never from requests.

    releases: (release_ix, release_id, release, creator_ix, creator, n_tracks, minutes, pop), creators: (creator_ix,
    creator_id, creator, pop), vectors: (ix, v) of each. Loading checks that keys run from 0 and have a vector each.
    """

    def __init__(self, releases: DataFrame, creators: DataFrame, release_vectors: DataFrame, creator_vectors: DataFrame, params: ParamsFile, card_base: str = CARD_URL):
        self.params, self.card_base = params, card_base
        self.n_releases = assert_contiguous(releases, "release_ix")
        self.n_creators = assert_contiguous(creators, "creator_ix")
        for name, vectors, n in (("release", release_vectors, self.n_releases), ("creator", creator_vectors, self.n_creators)):
            if assert_contiguous(vectors, "ix") != n:
                raise ValueError(f"{name} vectors do not match their index of {n} rows")
        unit = lambda df: df.select("ix", normalized(doubles(F.col("v"))).alias("v"))
        self.releases = releases.withColumn("hay", haystack(F.col("creator"), F.col("release"))).persist()
        self.creators = creators.withColumn("hay", haystack(F.col("creator"))).persist()
        self.items = unit(release_vectors).join(releases.select(F.col("release_ix").alias("ix"), F.col("creator_ix").alias("creator"), "pop"), "ix").persist()
        self.creator_items = unit(creator_vectors).join(creators.select(F.col("creator_ix").alias("ix"), "pop"), "ix").persist()

    def release_card(self, df: DataFrame) -> DataFrame:
        """Rows as cards: minutes to one digit, and the page's address below card_base."""
        return df.select("release_ix", "release", "creator", "release_id", "pop", "n_tracks", F.round("minutes", 1).alias("minutes"), card_url("album", F.col("release_id"), self.card_base).alias("url"), *(c for c in df.columns if c not in (*self.releases.columns, "ix", "v")))

    def creator_card(self, df: DataFrame) -> DataFrame:
        """Rows of creators as cards, with the page's address below card_base."""
        return df.drop("hay").withColumn("url", card_url("artist", F.col("creator_id"), self.card_base))

    def search(self, request: SearchRequest) -> DataFrame:
        """Releases whose creator and title hold every term, the most popular first."""
        return self.release_card(search(self.releases, request.q, limit=request.limit, min_pop=request.min_pop, max_pop=request.max_pop, key="release_ix"))

    def search_creators(self, request: SearchRequest) -> DataFrame:
        """Creators whose name holds every term, the most popular first."""
        return self.creator_card(search(self.creators, request.q, limit=request.limit, min_pop=request.min_pop, max_pop=request.max_pop, key="creator_ix"))

    def config(self) -> dict:
        """The active parameters and where they come from."""
        return asdict(self.params.get()) | {"source": self.params.path}

    def _check(self, ids, n: int) -> None:
        bad = [i for i in ids if not 0 <= i < n]
        if bad:
            raise BadRequest(f"keys out of range: {bad}")

    def recommend(self, request: RecommendRequest) -> DataFrame:
        """The best releases for the seeds, with the parts of their scores to four digits."""
        self._check(request.seeds, self.n_releases)
        p = self.params.with_filters(exclude_same_artist=request.exclude_same_artist, min_pop=request.min_pop, max_pop=request.max_pop)
        found = recommend(self.items, self.creator_items.select(F.col("ix").alias("creator"), "v"), list(request.seeds), p)
        digits = {c: 4 for c in ("score", "cos_album", "cos_artist", "spread", "cons", "worst", "pop_boost")} | {"dup": 3}
        shown = found.select("ix", *(F.round(c, n).alias(c) for c, n in digits.items()), "rank_album", "place", "shift")
        return self.release_card(self.releases.join(F.broadcast(shown), F.col("release_ix") == F.col("ix"))).orderBy("place")

    def _arithmetic(self, items: DataFrame, n: int, request: ArithmeticRequest) -> DataFrame:
        self._check([i for i, _ in request.terms], n)
        try:
            return analogy(items, list(request.terms), request.exclude_input, request.min_pop, request.max_pop).withColumn("score", F.round("score", 4))
        except ValueError as e:
            raise BadRequest(str(e)) from e

    def release_arithmetic(self, request: ArithmeticRequest) -> DataFrame:
        """The release nearest to the terms' vector."""
        found = self._arithmetic(self.items.select("ix", "pop", "v"), self.n_releases, request)
        return self.release_card(self.releases.join(F.broadcast(found.select("ix", "score")), F.col("release_ix") == F.col("ix")))

    def creator_arithmetic(self, request: ArithmeticRequest) -> DataFrame:
        """The creator nearest to the terms' vector."""
        found = self._arithmetic(self.creator_items.select("ix", "pop", "v"), self.n_creators, request)
        return self.creator_card(self.creators).join(F.broadcast(found.select("ix", "score")), F.col("creator_ix") == F.col("ix")).drop("ix")

    def release(self, ix: int) -> DataFrame:
        """One release's card."""
        if not 0 <= ix < self.n_releases:
            raise NotFound(f"release {ix}")
        return self.release_card(self.releases.where(F.col("release_ix") == ix))

    def creator(self, ix: int) -> DataFrame:
        """One creator's card."""
        if not 0 <= ix < self.n_creators:
            raise NotFound(f"creator {ix}")
        return self.creator_card(self.creators.where(F.col("creator_ix") == ix))


def lookup(ids: str, cache: DataFrame, fetch: Callable, now: int, **how) -> tuple[DataFrame, DataFrame]:
    """(answers, cache) for a comma-separated list of at most MAX_IDS valid ids."""
    spark = cache.sparkSession
    asked = spark.createDataFrame([(i,) for i in id_list(ids, MAX_IDS)], "id string")
    return resolve(asked, cache, fetch, now, **how)


def lookup_stats(cache: DataFrame) -> DataFrame:
    """Rows of a lookup table, and those with a value."""
    return cache_stats(cache)
