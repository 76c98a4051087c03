"""DuckDB SQL of the queries over the sample tables."""

from __future__ import annotations

_ROLES = """
track AS (SELECT p_partkey AS id, p_name AS name, CAST(p_size AS BIGINT) * 60000 AS duration, p_brand || '|' || p_type AS release_id FROM part),
track_creator AS (SELECT DISTINCT l_partkey AS track_id, l_suppkey AS creator_id FROM lineitem),
creator AS (SELECT s_suppkey AS id, s_name AS name FROM supplier),
track_collection AS (SELECT l_partkey AS track_id, o_custkey AS collection_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
collection AS (SELECT c_custkey AS id, c_name AS name FROM customer),
release AS (SELECT DISTINCT p_brand || '|' || p_type AS id, p_type AS name FROM part),
sizes AS (SELECT release_id, count(*) AS n_tracks, sum(duration) / 60000.0::DOUBLE AS minutes FROM track GROUP BY 1),
lengths AS (SELECT collection_id, count(*) AS length FROM track_collection GROUP BY 1)
"""

_PAIRS = """
all_pairs AS (SELECT c.collection_id, t.release_id, count(DISTINCT t.id) AS n_tracks FROM track_collection c JOIN track t ON t.id = c.track_id GROUP BY 1, 2)
"""

#: Runs of the flow with the cut at 20 minutes.
_FLOW = f"""
{_ROLES}, kept AS (SELECT * FROM sizes WHERE minutes >= 20),
edges AS (SELECT c.collection_id, t.release_id, count(DISTINCT t.id) AS n_tracks FROM track_collection c JOIN track t ON t.id = c.track_id JOIN kept k ON k.release_id = t.release_id GROUP BY 1, 2),
main AS (
  SELECT release_id, creator_id FROM (
    SELECT t.release_id, a.creator_id, row_number() OVER (PARTITION BY t.release_id ORDER BY count(*) DESC, a.creator_id) AS r
    FROM track t JOIN kept k ON k.release_id = t.release_id JOIN track_creator a ON a.track_id = t.id GROUP BY 1, 2
  ) WHERE r = 1
),
keys AS (SELECT r.id AS release_id, m.creator_id || '|' || trim(regexp_replace(lower(strip_accents(r.name)), '[^\\p{{L}}\\p{{N}} ]', '', 'g')) AS title_key FROM release r JOIN main m ON m.release_id = r.id),
releases AS (
  SELECT row_number() OVER (ORDER BY e.release_id) - 1 AS release_ix, e.release_id, r.name, m.creator_id, k.n_tracks, round(k.minutes, 2) AS minutes,
    dense_rank() OVER (ORDER BY g.title_key NULLS LAST) - 1 AS cluster_ix
  FROM (SELECT DISTINCT release_id FROM edges) e JOIN kept k USING (release_id) JOIN release r ON r.id = e.release_id LEFT JOIN main m USING (release_id) LEFT JOIN keys g USING (release_id)
),
creators AS (SELECT row_number() OVER (ORDER BY a.id) - 1 AS creator_ix, a.id AS creator_id, a.name FROM creator a WHERE a.id IN (SELECT creator_id FROM releases)),
collections AS (SELECT row_number() OVER (ORDER BY c.id) - 1 AS collection_ix, c.id AS collection_id, c.name, l.length FROM collection c JOIN lengths l ON l.collection_id = c.id WHERE c.id IN (SELECT collection_id FROM edges)),
star AS (
  SELECT c.collection_ix, r.release_ix, a.creator_ix, CAST(e.n_tracks AS SMALLINT) AS n_tracks, CAST(c.length AS INTEGER) AS length
  FROM edges e JOIN releases r USING (release_id) JOIN collections c USING (collection_id) LEFT JOIN creators a ON a.creator_id = r.creator_id
),
release_index AS (
  SELECT r.release_ix, r.release_id, r.name AS release, a.creator_ix, a.name AS creator, r.n_tracks, r.minutes, CAST(coalesce(p.pop, 0) AS INTEGER) AS pop
  FROM releases r LEFT JOIN creators a USING (creator_id) LEFT JOIN (SELECT release_ix, count(DISTINCT collection_ix) AS pop FROM star GROUP BY 1) p USING (release_ix)
)
"""

_ITEMS = f"""
{_ROLES},
raw AS (SELECT vec_id AS ix, CAST(label AS BIGINT) AS creator, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
items AS (
  SELECT r.ix, r.creator, coalesce(p.pop, 0) AS pop, list_transform(e, lambda x: x / (sqrt(list_dot_product(e, e)) + 1e-9)) AS v
  FROM raw r LEFT JOIN (SELECT track_id AS ix, count(DISTINCT collection_id) AS pop FROM track_collection GROUP BY 1) p USING (ix)
)
"""

_PROBES = f"""
{_ITEMS},
vec_pairs AS (SELECT DISTINCT collection_id AS collection_ix, track_id AS item FROM track_collection WHERE track_id IN (SELECT ix FROM items)),
lists AS (SELECT collection_ix, list(item ORDER BY item) AS l FROM vec_pairs WHERE collection_ix % 10 = 0 GROUP BY 1),
probes AS (SELECT collection_ix, l[1] AS seed, l[2:] AS targets FROM lists WHERE len(l) >= 2),
near AS (
  SELECT s.ix AS seed, i.ix AS item, row_number() OVER (PARTITION BY s.ix ORDER BY list_dot_product(s.v, i.v) DESC, i.ix) AS place
  FROM items s JOIN items i ON i.ix <> s.ix WHERE s.ix IN (SELECT seed FROM probes)
),
top AS (SELECT seed, item FROM near WHERE place <= 10),
found AS (
  SELECT p.collection_ix, p.seed, p.target, CASE WHEN t.item IS NULL THEN 0 ELSE 1 END AS hit
  FROM (SELECT collection_ix, seed, unnest(targets) AS target FROM probes) p LEFT JOIN top t ON t.seed = p.seed AND t.item = p.target
),
freq AS (SELECT i.ix AS item, count(p.item) AS freq FROM items i LEFT JOIN (SELECT item FROM vec_pairs WHERE collection_ix % 10 <> 0) p ON p.item = i.ix GROUP BY 1)
"""

_STRATUM = "CASE WHEN freq < 10 THEN 'a. <10' WHEN freq < 50 THEN 'b. 10-49' WHEN freq < 200 THEN 'c. 50-199' WHEN freq < 1000 THEN 'd. 200-999' ELSE 'e. >=1000' END"


def _norm(column: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(strip_accents({column})), '&', 'and'), "
        rf"'\s*[\(\[][^\)\]]*(deluxe|remaster|expanded|anniversary|edition|version|bonus|reissue|mono|stereo|explicit|clean|special|collector)[^\)\]]*[\)\]]', '', 'g'), "
        rf"'\s*[-–:]\s*(deluxe|remastered|remaster|expanded|anniversary|special)\b.*$', '', 'g'), '[^\p{{L}}\p{{N}} ]', '', 'g'))"
    )


def _z(column: str) -> str:
    return f"CASE WHEN stddev_pop({column}) OVER () > 1e-8 THEN ({column} - avg({column}) OVER ()) / stddev_pop({column}) OVER () ELSE 0.0 END"


def _recommend(seeds: list[int], n: int, k: int, weights: tuple[float, float, float], dup: bool, where: str, columns: str) -> str:
    wa, wr, wp = weights
    values = ", ".join(f"({i}, {s})" for i, s in enumerate(seeds))
    occ = "row_number() OVER (PARTITION BY creator ORDER BY prelim DESC, ix) - 1 + CASE WHEN creator IN (SELECT creator FROM seeds) THEN 1 ELSE 0 END" if dup else "0"
    return f"""
WITH {_ITEMS},
wanted(place, ix) AS (VALUES {values}),
seeds AS (SELECT w.place, i.ix, i.creator, i.v, c.v AS cv FROM wanted w JOIN items i ON i.ix = w.ix JOIN items c ON c.ix = i.creator),
valid AS (SELECT * FROM items WHERE ix NOT IN (SELECT ix FROM wanted) {where}),
pool AS (SELECT DISTINCT ix FROM (SELECT v.ix, row_number() OVER (PARTITION BY s.place ORDER BY list_dot_product(v.v, s.v) DESC, v.ix) AS r FROM valid v, seeds s) WHERE r <= {n}),
feat AS (
  SELECT v.ix, v.creator, v.pop, sum(list_dot_product(v.v, s.v)) AS raw, stddev_pop(list_dot_product(v.v, s.v)) AS spread, min(list_dot_product(v.v, s.v)) AS worst,
    sum(list_dot_product(c.v, s.cv)) AS c_raw, count(*) AS ns
  FROM valid v JOIN pool USING (ix) JOIN items c ON c.ix = v.creator, seeds s GROUP BY ALL
),
boost AS (SELECT *, raw - 0.5 * spread * ns AS ca, exp(-pow(ln(greatest(pop, 1)) - ln(30.0), 2) / 2.0) AS pop_boost FROM feat),
fixed AS (SELECT *, {wa} * ({_z('ca')}) + {wp} * pop_boost AS f, {wr} * ({_z('c_raw')}) AS zr FROM boost),
pre AS (SELECT *, f + zr AS prelim FROM fixed),
occ AS (SELECT *, 0.1::DOUBLE * ({occ}) AS dup FROM pre),
cr AS (SELECT *, c_raw - dup AS cr FROM occ),
scored AS (SELECT *, f + {wr} * ({_z('cr')}) AS score, row_number() OVER (ORDER BY raw DESC, ix) AS rank_album FROM cr),
best AS (SELECT *, row_number() OVER (ORDER BY score DESC, ix) AS place FROM scored)
SELECT {columns} FROM best WHERE place <= {k}
"""


def _analogy(target: str, terms: str, low: int, high: int | None) -> str:
    return f"""
WITH {_ITEMS}, t AS ({target}),
u AS (SELECT list_transform(t, lambda x: x / sqrt(list_dot_product(t, t))) AS u FROM t)
SELECT ix, pop, round(list_dot_product(v, u), 6) AS score FROM items, u
WHERE ix NOT IN ({terms}) AND pop >= {low} {f'AND pop <= {high}' if high else ''} ORDER BY list_dot_product(v, u) DESC, ix LIMIT 5
"""


_VARIANTS = f"""
{_ROLES},
named AS (SELECT t.id AS release_id, t.name AS title, o.creator_id FROM track t JOIN (SELECT track_id, min(creator_id) AS creator_id FROM track_creator GROUP BY 1) o ON o.track_id = t.id),
keyed AS (SELECT release_id, creator_id, {_norm('title')} AS n, title FROM named),
groups AS (SELECT creator_id, CASE WHEN length(title) - length(replace(title, '?', '')) >= 2 OR n = '' THEN 'ID:' || release_id ELSE n END AS title_key, count(*) AS variants FROM keyed GROUP BY 1, 2)
"""

SQL: dict[str, str] = {
    "cardinalities": f"WITH {_ROLES} SELECT (SELECT count(*) FROM release) AS n_releases, (SELECT count(*) FROM creator) AS n_creators, (SELECT count(*) FROM track) AS n_tracks, (SELECT count(*) FROM collection) AS n_collections, (SELECT count(*) FROM track_collection) AS n_links",
    "playlist_length_quantiles": f"WITH {_ROLES} SELECT count(*) AS n, round(avg(length), 1) AS mean, quantile_cont(length, 0.5) AS p50, quantile_cont(length, 0.9) AS p90, quantile_cont(length, 0.99) AS p99, quantile_cont(length, 0.999) AS p999, max(length) AS max FROM lengths",
    "playlist_length_buckets_share": f"""WITH {_ROLES}, b AS (SELECT CASE WHEN length <= 50 THEN 'a. <=50' WHEN length <= 250 THEN 'b. 51-250' WHEN length <= 1000 THEN 'c. 251-1000' WHEN length <= 5000 THEN 'd. 1001-5000' ELSE 'e. >5000' END AS bucket, length FROM lengths)
SELECT bucket, count(*) AS n, CAST(sum(length) AS BIGINT) AS total, round(100.0::DOUBLE * sum(length) / sum(sum(length)) OVER (), 2) AS pct FROM b GROUP BY 1 ORDER BY 1""",
    "album_minutes_cut": f"WITH {_ROLES} SELECT count(*) AS n, count(*) FILTER (minutes >= 20) AS kept_20, count(*) FILTER (minutes >= 300) AS kept_300, round(100.0::DOUBLE * count(*) FILTER (minutes >= 300) / count(*), 2) AS pct_300 FROM sizes",
    "main_artist": f"""WITH {_ROLES}, n AS (SELECT t.release_id, a.creator_id, count(*) AS n FROM track t JOIN track_creator a ON a.track_id = t.id GROUP BY 1, 2)
SELECT release_id, creator_id FROM n QUALIFY row_number() OVER (PARTITION BY release_id ORDER BY n DESC, creator_id) = 1""",
    "album_pairs": f"WITH {_ROLES}, {_PAIRS} SELECT collection_id, release_id, p.n_tracks FROM all_pairs p JOIN sizes USING (release_id) WHERE minutes >= 300",
    "album_pairs_summary": f"WITH {_ROLES}, {_PAIRS} SELECT count(*) AS pairs, count(DISTINCT release_id) AS releases, count(DISTINCT collection_id) AS collections, round(avg(n_tracks), 2) AS mean, quantile_cont(n_tracks, 0.5) AS p50, quantile_cont(n_tracks, 0.9) AS p90, max(n_tracks) AS max FROM all_pairs",
    "n_tracks_buckets": f"""WITH {_ROLES}, {_PAIRS} SELECT CASE WHEN n_tracks = 1 THEN '1' WHEN n_tracks = 2 THEN '2' WHEN n_tracks <= 5 THEN '3-5' WHEN n_tracks <= 10 THEN '6-10' ELSE '>10' END AS bucket,
count(*) AS n, CAST(sum(n_tracks) AS BIGINT) AS total, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS pct FROM all_pairs GROUP BY 1""",
    "long_tail_counts": f"WITH {_ROLES}, {_PAIRS}, f AS (SELECT release_id, count(*) AS n FROM all_pairs GROUP BY 1) SELECT " + ", ".join(f"count(*) FILTER (n >= {s}) AS ge{s}" for s in (1, 3, 5, 10, 20, 50)) + " FROM f",
    "album_lookup": f"WITH {_FLOW} SELECT * FROM releases",
    "artist_lookup": f"WITH {_FLOW} SELECT * FROM creators",
    "playlist_lookup": f"WITH {_FLOW} SELECT * FROM collections",
    "pairs_star": f"WITH {_FLOW} SELECT * FROM star",
    "album_index": f"WITH {_FLOW} SELECT * FROM release_index",
    "artist_index": f"WITH {_FLOW} SELECT c.creator_ix, c.creator_id, c.name AS creator, CAST(coalesce(p.pop, 0) AS INTEGER) AS pop FROM creators c LEFT JOIN (SELECT creator_ix, sum(pop) AS pop FROM release_index WHERE creator_ix IS NOT NULL GROUP BY 1) p USING (creator_ix)",
    "largest_dedup_groups": f"WITH {_VARIANTS} SELECT c.name AS creator, g.creator_id, g.title_key, g.variants FROM groups g JOIN creator c ON c.id = g.creator_id ORDER BY variants DESC, g.creator_id, title_key LIMIT 15",
    "dedup_group_summary": f"WITH {_VARIANTS} SELECT count(*) AS groups, CAST(sum(variants) AS BIGINT) AS releases, round(avg(variants), 3) AS mean, quantile_cont(variants, 0.5) AS p50, quantile_cont(variants, 0.99) AS p99, max(variants) AS max, CAST(sum(CASE WHEN variants > 1 THEN variants - 1 ELSE 0 END) AS BIGINT) AS redundant FROM groups",
    "title_norm": f"""WITH t AS (SELECT doc_id, text || ' & (Deluxe Edition)' AS title FROM documents), n AS (SELECT doc_id, title, {_norm('title')} AS title_norm FROM t)
SELECT doc_id, title_norm, CASE WHEN length(title) - length(replace(title, '?', '')) >= 2 OR title_norm = '' THEN 'ID:' || doc_id ELSE (doc_id % 10) || '|' || title_norm END AS title_key FROM n""",
    "latin1_repair": """WITH t AS (SELECT doc_id, text || ' 宇宙' AS official FROM documents),
b AS (SELECT doc_id, official, regexp_replace(official, '[^\\x00-\\xFF]', '?', 'g') AS m, CASE WHEN doc_id % 3 = 0 THEN 'another' ELSE regexp_replace(official, '[^\\x00-\\xFF]', '?', 'g') END AS name FROM t),
r AS (SELECT doc_id, CASE WHEN official <> name AND m = name THEN official ELSE name END AS name FROM b) SELECT doc_id, name, contains(name, '?') AS broken FROM r""",
    "fold_search": """WITH h AS (SELECT doc_id AS ix, n_chars AS pop, lower(strip_accents(coalesce(source, '') || '  ' || coalesce(text, ''))) AS hay FROM documents)
SELECT ix, pop FROM h WHERE contains(hay, 'des') AND contains(hay, 'entre') AND pop BETWEEN 100 AND 5000 ORDER BY pop DESC, ix LIMIT 20""",
    "gram_search": """WITH h AS (SELECT doc_id AS ix, n_chars AS pop, lower(strip_accents(coalesce(source, '') || '  ' || coalesce(text, ''))) AS hay FROM documents)
SELECT ix, pop FROM h WHERE contains(hay, 'des') AND contains(hay, 'entre') AND pop BETWEEN 100 AND 5000 ORDER BY pop DESC, ix LIMIT 20""",
    "price_quantiles": "SELECT round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.01), 4) AS p1, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.5), 4) AS p50, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.9), 4) AS p90, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.999), 4) AS p999 FROM lineitem",
    "probe_match_fallback": f"""WITH {_ROLES}, r AS (SELECT r.id, r.name, split_part(r.id, '|', 1) AS owner, s.n_tracks FROM release r JOIN sizes s ON s.release_id = r.id),
p AS (SELECT owner, split_part(name, ' ', 1) AS word FROM r ORDER BY owner, name LIMIT 1)
SELECT r.id, r.name, r.n_tracks, CAST(CASE WHEN r.name = p.word THEN 0 ELSE 1 END AS BIGINT) AS tier FROM r JOIN p ON p.owner = r.owner WHERE starts_with(r.name, p.word) ORDER BY tier, n_tracks DESC, id LIMIT 1""",
    "id_validation": "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \\n.,]+'), lambda x: regexp_matches(x, '^[0-9A-Za-z]{22}$'))) AS valid FROM documents",
    "url_hash_extract": "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE substr(md5(CAST(doc_id AS VARCHAR)), 1, 24) END AS image_key FROM documents",
    "json_props": "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k, coalesce(json_extract_string(props, '$.title'), '') AS title FROM events",
    "top_neighbours": f"""WITH {_ITEMS}, s AS (SELECT q.ix AS query, i.ix, list_dot_product(q.v, i.v) AS score FROM items q JOIN items i ON i.ix <> q.ix)
SELECT query, ix, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, ix) AS place FROM s QUALIFY place <= 8""",
    "cosine_topn_union": f"""WITH {_ITEMS}, s AS (SELECT q.ix AS query, i.ix, row_number() OVER (PARTITION BY q.ix ORDER BY list_dot_product(q.v, i.v) DESC, i.ix) AS r FROM items q, items i WHERE q.ix IN (3, 17, 42) AND i.ix NOT IN (3, 17, 42))
SELECT DISTINCT ix FROM s WHERE r <= 50""",
    "recommend": _recommend([3, 17, 42], 50, 20, (0.6, 0.15, 0.25), True, "", "ix, creator, pop, round(score, 6) AS score, round(raw / ns, 6) AS cos_album, round(cr / ns, 6) AS cos_artist, round(spread, 6) AS spread, round(0.5 * spread, 6) AS cons, round(worst, 6) AS worst, round(dup, 6) AS dup, round(pop_boost, 6) AS pop_boost, rank_album, place, rank_album - place AS shift"),
    "recommend_filtered": _recommend([5, 5, 11], 40, 10, (0.6, 0.0, 0.25), False, "AND pop >= 25 AND pop <= 40 AND creator NOT IN (SELECT creator FROM seeds)", "ix, creator, pop, round(score, 6) AS score, round(raw / ns, 6) AS cos_album, round(spread, 6) AS spread, round(dup, 6) AS dup"),
    "analogy_add": _analogy("SELECT list_transform(list_zip(a.v, b.v, c.v), lambda x: x[1] + x[2] + x[3]) AS t FROM items a, items b, items c WHERE a.ix = 1 AND b.ix = 2 AND c.ix = 9", "1, 2, 9", 20, None),
    "analogy_sub_mul": _analogy("SELECT list_transform(list_zip(a.v, b.v, c.v), lambda x: (x[1] - x[2]) * x[3]) AS t FROM items a, items b, items c WHERE a.ix = 4 AND b.ix = 8 AND c.ix = 6", "4, 8, 6", 20, 45),
    "popularity_hump": f"WITH {_ITEMS} SELECT ix, round(exp(-pow(ln(greatest(pop, 1)) - ln(30.0), 2) / 2.0), 6) AS boost FROM items",
    "zscore": f"WITH {_ITEMS}, p AS (SELECT ix, CAST(pop AS DOUBLE) AS pop FROM items) SELECT ix, round({_z('pop')}, 6) AS z, 0.0::DOUBLE AS flat FROM p",
    "csr_adjacency": f"""WITH {_ITEMS}, vp AS (SELECT DISTINCT collection_id AS collection_ix, track_id AS item FROM track_collection WHERE track_id IN (SELECT ix FROM items)),
l AS (SELECT collection_ix, string_agg(CAST(item AS VARCHAR), ',' ORDER BY item) AS items, count(*) AS n FROM vp GROUP BY 1)
SELECT collection_ix, items, CAST(sum(n) OVER (ORDER BY collection_ix) - n AS BIGINT) AS start FROM l""",
    "holdout_split": f"""WITH {_ITEMS}, vp AS (SELECT DISTINCT collection_id AS c, track_id AS item FROM track_collection WHERE track_id IN (SELECT ix FROM items))
SELECT c % 10 = 0 AS held, count(*) AS pairs, count(DISTINCT c) AS collections FROM vp GROUP BY 1""",
    "recall_at_k": f"WITH {_PROBES} SELECT CAST(sum(hit) AS BIGINT) AS hits, count(*) AS targets, round(sum(hit) / count(*)::DOUBLE, 6) AS recall FROM found",
    "recall_by_seed_stratum": f"WITH {_PROBES} SELECT {_STRATUM} AS stratum, CAST(sum(hit) AS BIGINT) AS hits, count(*) AS targets, round(sum(hit) / count(*)::DOUBLE, 6) AS recall FROM found JOIN freq ON freq.item = found.seed GROUP BY 1",
    "recall_by_target_stratum": f"WITH {_PROBES} SELECT {_STRATUM} AS stratum, CAST(sum(hit) AS BIGINT) AS hits, count(*) AS targets, round(sum(hit) / count(*)::DOUBLE, 6) AS recall FROM found JOIN freq ON freq.item = found.target GROUP BY 1",
    "popularity_bias": f"WITH {_PROBES}, r AS (SELECT item, row_number() OVER (ORDER BY freq DESC, item) - 1 AS rank FROM freq) SELECT round(avg(rank), 6) AS mean_rank, round(100.0 * avg(rank) / (SELECT count(*) FROM items), 6) AS percentile FROM probes p JOIN top t ON t.seed = p.seed JOIN r ON r.item = t.item",
    "same_artist_share": f"WITH {_PROBES} SELECT round(avg(CASE WHEN a.creator = b.creator THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS share, count(*) AS n FROM probes p JOIN top t ON t.seed = p.seed JOIN items a ON a.ix = p.seed JOIN items b ON b.ix = t.item",
    "popularity_baseline_lift": f"""WITH {_PROBES}, ranked AS (SELECT item, row_number() OVER (ORDER BY freq DESC, item) AS r FROM freq QUALIFY r <= 10),
base AS (SELECT count(*) AS n FROM found f JOIN ranked r ON r.item = f.target)
SELECT CAST(sum(hit) AS BIGINT) AS hits, any_value(n) AS pop_hits, count(*) AS targets, round(sum(hit) / greatest(any_value(n), 1)::DOUBLE, 6) AS lift FROM found, base""",
    "final_evaluation": f"""WITH {_PROBES}, popular AS (SELECT item, row_number() OVER (ORDER BY freq DESC, item) AS r FROM freq QUALIFY r <= 100),
every AS (SELECT f.target, n.place, p.r FROM (SELECT p.seed, unnest(p.targets) AS target FROM probes p) f LEFT JOIN near n ON n.seed = f.seed AND n.item = f.target LEFT JOIN popular p ON p.item = f.target),
ks AS (SELECT unnest([10, 50, 100])::BIGINT AS k)
SELECT k, count(*) FILTER (place <= k) AS hits, count(*) FILTER (r <= k) AS pop_hits, count(*) AS targets, round(count(*) FILTER (place <= k) / count(*)::DOUBLE, 6) AS recall,
round(count(*) FILTER (r <= k) / count(*)::DOUBLE, 6) AS pop_recall, round(count(*) FILTER (place <= k) / greatest(count(*) FILTER (r <= k), 1)::DOUBLE, 6) AS lift FROM every, ks GROUP BY k""",
    "artist_pairs": f"WITH {_FLOW} SELECT collection_ix, creator_ix AS item, CAST(sum(n_tracks) AS BIGINT) AS n_tracks FROM star WHERE creator_ix IS NOT NULL GROUP BY 1, 2",
    "index_summary": f"WITH {_FLOW} SELECT count(*) AS n, count(*) FILTER (pop > 0) AS with_pop, count(*) FILTER (creator_ix IS NOT NULL) AS with_creator FROM release_index",
    "neg_sampling_cdf": f"""WITH {_ROLES}, f AS (SELECT track_id AS item, pow(greatest(count(*), 1)::DOUBLE, 0.75) AS w FROM track_collection GROUP BY 1),
s AS (SELECT item, w, sum(w) OVER (ORDER BY item) AS c, sum(w) OVER () AS t FROM f) SELECT item, round(w / t, 9) AS p, round((c - w) / t, 9) AS cdf_prev, round(c / t, 9) AS cdf FROM s""",
    "neg_sampling_lookup": f"""WITH {_ROLES}, f AS (SELECT track_id AS item, pow(greatest(count(*), 1)::DOUBLE, 0.75) AS w FROM track_collection GROUP BY 1),
s AS (SELECT item, (sum(w) OVER (ORDER BY item) - w) / sum(w) OVER () AS a, sum(w) OVER (ORDER BY item) / sum(w) OVER () AS b FROM f), d AS (SELECT range AS draw, (range + 0.5) / 64 AS u FROM range(64))
SELECT draw, item FROM d JOIN s ON u > a AND u <= b """,
    "cache_latest_ttl": """WITH e AS (SELECT user_id AS id, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS value, CAST(floor(epoch(ts)) AS BIGINT) * 1000000 + event_id AS fetched_at FROM events),
k AS (SELECT * FROM e WHERE id % 2 = 0 OR value <> 'view' OR value = 'view'), l AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY id ORDER BY fetched_at DESC) = 1)
SELECT id, value, fetched_at FROM l WHERE value <> '' OR 1704067200::BIGINT * 1000000 - fetched_at < 20 * 86400 * 1000000::BIGINT""",
    "cache_stats": "SELECT count(*) AS n, count(nullif(CASE WHEN event_type = 'error' THEN '' ELSE event_type END, '')) AS found FROM events",
    "work_list": f"WITH {_ITEMS}, t AS (SELECT ix AS id, pop FROM items ORDER BY pop DESC, ix LIMIT 100) SELECT id, pop FROM t WHERE id % 3 <> 0",
    "bpr_step_loss": f"""WITH {_ITEMS}, t AS (SELECT ix AS a, (ix * 7 + 1) % c AS p, (ix * 13 + 5) % c AS n FROM items, (SELECT count(*) AS c FROM items)),
m AS (SELECT list_dot_product(a.v, p.v) - list_dot_product(a.v, n.v) AS x FROM t JOIN items a ON a.ix = t.a JOIN items p ON p.ix = t.p JOIN items n ON n.ix = t.n)
SELECT round(avg(ln(1 + exp(-x))), 6) AS loss, count(*) AS n FROM m""",
    "dump_tokenizer": "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer",
    "dump_scan": """SELECT CAST(s_suppkey AS VARCHAR) AS id, CASE WHEN s_suppkey % 3 = 0 THEN s_name || chr(65533) ELSE '''' || s_name || '\\;' END AS name FROM supplier""",
    "read_through": """SELECT lpad(CAST(c_custkey AS VARCHAR), 22, '0') AS id, CASE WHEN c_custkey % 4 = 0 THEN 'held' ELSE 'got ' || c_custkey END AS value FROM customer
WHERE c_custkey % 4 = 0 OR c_custkey % 4 <> 1 AND c_custkey % 5 <> 0""",
    "contiguous_keys": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ix FROM orders",
    "windowed_events": "SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
