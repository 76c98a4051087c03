"""The queries of the engine by name, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomset.plans import oracles
from loomset.plans import queries as q

_ALL = (
    q.cardinalities, q.playlist_length_quantiles, q.playlist_length_buckets_share, q.album_minutes_cut, q.main_artist, q.album_pairs,
    q.album_pairs_summary, q.n_tracks_buckets, q.long_tail_counts, q.album_lookup, q.artist_lookup, q.playlist_lookup, q.pairs_star,
    q.album_index, q.artist_index, q.largest_dedup_groups, q.dedup_group_summary, q.title_norm, q.latin1_repair, q.fold_search, q.gram_search, q.price_quantiles,
    q.probe_match_fallback, q.id_validation, q.url_hash_extract, q.json_props, q.top_neighbours, q.cosine_topn_union, q.recommend,
    q.recommend_filtered, q.analogy_add, q.analogy_sub_mul, q.popularity_hump, q.zscore, q.csr_adjacency, q.holdout_split,
    q.holdout_split_seeded, q.recall_at_k, q.recall_by_seed_stratum, q.recall_by_target_stratum, q.popularity_bias, q.same_artist_share,
    q.popularity_baseline_lift, q.final_evaluation, q.artist_pairs, q.index_summary, q.neg_sampling_cdf, q.neg_sampling_lookup, q.cache_latest_ttl, q.cache_stats, q.work_list,
    q.bpr_step_loss, q.bpr_train, q.dump_tokenizer, q.dump_scan, q.read_through, q.contiguous_keys, q.windowed_events,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
ORACLE_SQL: dict[str, str] = oracles.SQL
