"""From raw tables to the weighted edge list: the cut, main creators, variants of a title, lookups, indexes.

Tables: track (id, name, duration in ms, release_id), track_creator (track_id, creator_id), creator (id, name),
track_collection (track_id, collection_id), collection (id, name), release (id, name).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.functions.text import dedup_key, title_norm
from loomset.functions.vectors import half_up
from loomset.operators.keys import contiguous_index, shared_index
from loomset.operators.scratch import materialized

MIN_MINUTES = 20.0
MS_PER_MINUTE = 60000.0


@dataclass(frozen=True)
class Tables:
    """The raw tables."""

    track: DataFrame
    track_creator: DataFrame
    creator: DataFrame
    track_collection: DataFrame
    collection: DataFrame
    release: DataFrame

    def without_sentinels(self) -> Tables:
        """All tables without rows whose id is empty or null."""
        return Tables(filled(self.track, "id"), filled(self.track_creator, "track_id", "creator_id"), filled(self.creator, "id"), filled(self.track_collection, "track_id", "collection_id"), filled(self.collection, "id"), filled(self.release, "id"))


def filled(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose columns are neither null nor, if they are text, empty: plain comparisons, which reach the scan."""
    text = dict(df.dtypes)
    for c in columns:
        df = df.where(F.col(c) != "" if text[c] == "string" else F.col(c).isNotNull())
    return df


def release_sizes(track: DataFrame) -> DataFrame:
    """(release_id, n_tracks, minutes) over tracks with a release; minutes are null where all durations are."""
    return filled(track, "release_id").groupBy("release_id").agg(F.count("*").alias("n_tracks"), (F.sum("duration") / F.lit(MS_PER_MINUTE)).alias("minutes"))


def kept_releases(track: DataFrame, min_minutes: float = MIN_MINUTES) -> DataFrame:
    """Releases of at least min_minutes."""
    return release_sizes(track).where(F.col("minutes") >= min_minutes)


def main_creators(track: DataFrame, track_creator: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """(release_id, creator_id): the creator of most of a release's tracks, of equal ones the smallest id."""
    own = filled(track, "release_id").select("id", "release_id")
    if kept is not None:
        own = own.join(kept.select("release_id"), "release_id", "left_semi")
    pairs = own.join(track_creator, own["id"] == track_creator["track_id"]).groupBy("release_id", "creator_id").agg(F.count("*").alias("n"))
    # the largest count and then the smallest id, in one aggregation that combines before the shuffle
    return pairs.groupBy("release_id").agg(F.min_by("creator_id", F.struct(-F.col("n"), "creator_id")).alias("creator_id"))


def title_keys(release: DataFrame, creators: DataFrame, ampersand: bool = True, with_owner: bool = True) -> DataFrame:
    """(release_id, creator_id, title, title_norm, title_key) of named releases with a main creator."""
    named = filled(release, "name").join(creators, release["id"] == creators["release_id"]).select("release_id", "creator_id", F.col("name").alias("title"))
    normed = named.withColumn("title_norm", title_norm(F.col("title"), ampersand))
    return normed.withColumn("title_key", dedup_key(F.col("title"), F.col("title_norm"), F.col("release_id"), F.col("creator_id") if with_owner else None))


def collection_lengths(track_collection: DataFrame) -> DataFrame:
    """(collection_id, length): all rows of a collection, repeats included."""
    return track_collection.groupBy("collection_id").agg(F.count("*").alias("length"))


def collection_releases(track: DataFrame, track_collection: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """(collection_id, release_id, n_tracks): different tracks of a release in a collection.

    Repeats go before the join, and a track has one release, so a plain count follows.
    """
    own = filled(track, "release_id").select(F.col("id").alias("track_id"), "release_id")
    if kept is not None:
        own = own.join(kept.select("release_id"), "release_id", "left_semi")
    links = track_collection.select("track_id", "collection_id").distinct()
    return links.join(own.distinct(), "track_id").groupBy("collection_id", "release_id").agg(F.count("*").alias("n_tracks"))


def known_releases(edges: DataFrame, kept: DataFrame, release: DataFrame, creators: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """(release_id, name, creator_id, n_tracks, minutes, title_key) of releases with an edge and a row.

    Titles are keyed in passing unless title_keys() are given: null without a name or a main creator.
    """
    known = kept.join(edges.select("release_id"), "release_id", "left_semi").join(release.select(F.col("id").alias("release_id"), "name"), "release_id")
    full = known.join(creators, "release_id", "left")
    if keys is not None:
        full = full.join(keys.select("release_id", "title_key"), "release_id", "left")
    else:
        key = dedup_key(F.col("name"), F.col("__norm"), F.col("release_id"), F.col("creator_id"))
        full = full.withColumn("__norm", title_norm(F.col("name"))).withColumn("title_key", F.when((F.col("name") != "") & F.col("creator_id").isNotNull(), key))
    return full.select("release_id", "name", "creator_id", "n_tracks", half_up(F.col("minutes"), 2).alias("minutes"), "title_key")


def known_creators(releases: DataFrame, creator: DataFrame) -> DataFrame:
    """(creator_id, name) of the main creators that have a row."""
    return creator.select(F.col("id").alias("creator_id"), "name").join(releases.where("creator_id is not null").select("creator_id"), "creator_id", "left_semi")


def known_collections(edges: DataFrame, collection: DataFrame) -> DataFrame:
    """(collection_id, name) of the collections with an edge and a row."""
    return collection.select(F.col("id").alias("collection_id"), "name").join(edges.select("collection_id"), "collection_id", "left_semi")


def _numbered_releases(known: DataFrame, ix: dict[str, DataFrame]) -> DataFrame:
    clusters = ix["cluster_ix"].withColumnRenamed("title_key", "__key")
    full = known.join(ix["release_ix"], "release_id").join(clusters, F.col("title_key").eqNullSafe(F.col("__key")), "left")
    return full.select("release_ix", "release_id", "name", "creator_id", "n_tracks", "minutes", "cluster_ix")


def release_lookup(edges: DataFrame, kept: DataFrame, release: DataFrame, creators: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """(release_ix, release_id, name, creator_id, n_tracks, minutes, cluster_ix) of releases with an edge and a row."""
    known = materialized(known_releases(edges, kept, release, creators, keys), "releases")
    return _numbered_releases(known, shared_index({"cluster_ix": known.select("title_key").distinct(), "release_ix": known.select("release_id")}))


def creator_lookup(releases: DataFrame, creator: DataFrame) -> DataFrame:
    """(creator_ix, creator_id, name) of the main creators that have a row; of releases only creator_id is read."""
    return contiguous_index(known_creators(releases, creator), "creator_id", "creator_ix").select("creator_ix", "creator_id", "name")


def collection_lookup(edges: DataFrame, collection: DataFrame, lengths: DataFrame) -> DataFrame:
    """(collection_ix, collection_id, name, length) of the collections with an edge and a row."""
    return contiguous_index(known_collections(edges, collection), "collection_id", "collection_ix").join(lengths, "collection_id").select("collection_ix", "collection_id", "name", "length")


def star_lookups(edges: DataFrame, kept: DataFrame, release: DataFrame, creators: DataFrame, creator: DataFrame, collection: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """release_lookup(), creator_lookup() and collection_lookup() at once: all their keys are numbered in one pass."""
    known = materialized(known_releases(edges, kept, release, creators), "releases")
    owners, listed = known_creators(known, creator), known_collections(edges, collection)
    ix = shared_index({"cluster_ix": known.select("title_key").distinct(), "release_ix": known.select("release_id"), "creator_ix": owners.select("creator_id"), "collection_ix": listed.select("collection_id")})
    named = creator.select(F.col("id").alias("creator_id"), "name").join(ix["creator_ix"], "creator_id")
    sized = collection.select(F.col("id").alias("collection_id"), "name").join(ix["collection_ix"], "collection_id").join(lengths, "collection_id")
    numbered = materialized(_numbered_releases(known, ix), "releases")  # the star and the indexes both read it
    return numbered, named.select("creator_ix", "creator_id", "name"), sized.select("collection_ix", "collection_id", "name", "length")


def indexed_pairs(edges: DataFrame, releases: DataFrame, collections: DataFrame, creators: DataFrame) -> DataFrame:
    """(collection_ix, release_ix, creator_ix, n_tracks, length): the edge list under contiguous keys."""
    dims = releases.select("release_id", "release_ix", "creator_id").join(creators.select("creator_id", "creator_ix"), "creator_id", "left")
    star = edges.join(dims, "release_id").join(collections.select("collection_id", "collection_ix", "length"), "collection_id")
    return star.select("collection_ix", "release_ix", "creator_ix", F.col("n_tracks").cast("smallint").alias("n_tracks"), F.col("length").cast("int").alias("length"))


def creator_pairs(pairs: DataFrame) -> DataFrame:
    """(collection_ix, item, n_tracks): the edge list summed by main creator; pairs without one are left out."""
    return pairs.where("creator_ix is not null").groupBy("collection_ix", F.col("creator_ix").alias("item")).agg(F.sum("n_tracks").alias("n_tracks"))


def index_summary(index: DataFrame) -> DataFrame:
    """One row: rows of a serving table, rows with a popularity and rows with a creator."""
    return index.agg(F.count("*").alias("n"), F.count_if(F.col("pop") > 0).alias("with_pop"), F.count_if(F.col("creator_ix").isNotNull()).alias("with_creator"))


def release_index(releases: DataFrame, creators: DataFrame, pairs: DataFrame) -> DataFrame:
    """Serving rows of releases: with the creator's key and name, and pop, the number of different collections."""
    pop = pairs.groupBy("release_ix").agg(F.count_distinct("collection_ix").alias("pop"))
    named = releases.join(creators.select("creator_id", "creator_ix", F.col("name").alias("creator")), "creator_id", "left").join(pop, "release_ix", "left")
    return named.select("release_ix", "release_id", F.col("name").alias("release"), "creator_ix", "creator", "n_tracks", "minutes", F.coalesce("pop", F.lit(0)).cast("int").alias("pop"))


def creator_index(creators: DataFrame, releases: DataFrame) -> DataFrame:
    """Serving rows of creators: pop is the sum of their releases' pops, so a collection counts once a release."""
    pop = releases.where("creator_ix is not null").groupBy("creator_ix").agg(F.sum("pop").alias("pop"))
    return creators.join(pop, "creator_ix", "left").select("creator_ix", "creator_id", F.col("name").alias("creator"), F.coalesce("pop", F.lit(0)).cast("int").alias("pop"))
