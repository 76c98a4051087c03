from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomset.operators import analogy, cache, evaluate, keys, profile, recommend, releases, retrieval, search, train
from loomset.operators.scratch import scratch


def tables(spark):
    df = spark.createDataFrame
    return releases.Tables(
        df([("t1", "a", 600_000, "r1"), ("t2", "b", 600_000, "r1"), ("t3", "c", 1_199_999, "r2"), ("t4", "d", None, "r3"), ("t5", "e", 2_000_000, None), ("t6", "f", 2_000_000, ""), ("", "s", 1, "r1"), ("t7", "g", 1_500_000, "r9"), ("t8", "h", 1_500_000, "r4"), ("t9", "i", 1_500_000, "r5")], "id string, name string, duration bigint, release_id string"),
        df([("t1", "c2"), ("t2", "c1"), ("t3", "c1"), ("t7", "c1"), ("t8", "cX"), ("", "c1"), ("t9", "c1")], "track_id string, creator_id string"),
        df([("c1", "One"), ("c2", "Two"), ("", "none")], "id string, name string"),
        df([("t1", "p1"), ("t1", "p1"), ("t2", "p1"), ("t3", "p1"), ("t1", "p2"), ("t7", "p2"), ("t8", "pX"), ("t8", "p2"), ("t9", "p2"), (None, "p1")], "track_id string, collection_id string"),
        df([("p1", "first"), ("p2", "second"), ("p3", "idle")], "id string, name string"),
        df([("r1", "Foo (Deluxe Edition)"), ("r2", "Bar"), ("r4", "???"), ("r5", None), ("r3", "x")], "id string, name string"),
    ).without_sentinels()


def test_flow_from_raw_tables_to_indexes(spark):
    t = tables(spark)
    sizes = {r["release_id"]: r["minutes"] for r in releases.release_sizes(t.track).collect()}
    assert sizes["r1"] == 20.0 and sizes["r3"] is None and sizes["r2"] < 20
    kept = releases.kept_releases(t.track)
    assert {r["release_id"] for r in kept.collect()} == {"r1", "r9", "r4", "r5"}
    main = releases.main_creators(t.track, t.track_creator, kept)
    assert {tuple(r) for r in main.collect()} == {("r1", "c1"), ("r9", "c1"), ("r4", "cX"), ("r5", "c1")}
    edges = releases.collection_releases(t.track, t.track_collection, kept)
    assert {tuple(r) for r in edges.collect()} == {("p1", "r1", 2), ("p2", "r1", 1), ("p2", "r9", 1), ("pX", "r4", 1), ("p2", "r4", 1), ("p2", "r5", 1)}
    titles = releases.title_keys(t.release, main)
    assert {r["release_id"]: r["title_key"] for r in titles.collect()} == {"r1": "c1|foo", "r4": "ID:r4"}
    look = releases.release_lookup(edges, kept, t.release, main, titles)
    # the release without a title key comes last in the order of clusters
    assert [tuple(r)[:2] + (r["cluster_ix"],) for r in look.orderBy("release_ix").collect()] == [(0, "r1", 1), (1, "r4", 0), (2, "r5", 2)]
    creators = releases.creator_lookup(look, t.creator)
    assert [tuple(r) for r in creators.collect()] == [(0, "c1", "One")]
    collections = releases.collection_lookup(edges, t.collection, releases.collection_lengths(t.track_collection))
    assert {r["collection_id"]: r["length"] for r in collections.collect()} == {"p1": 4, "p2": 4}
    pairs = releases.indexed_pairs(edges, look, collections, creators)
    assert {tuple(r) for r in pairs.collect()} == {(0, 0, 0, 2, 4), (1, 0, 0, 1, 4), (1, 1, None, 1, 4), (1, 2, 0, 1, 4)}
    index = releases.release_index(look, creators, pairs)
    assert {r["release_id"]: (r["creator_ix"], r["pop"]) for r in index.collect()} == {"r1": (0, 2), "r4": (None, 1), "r5": (0, 1)}
    assert [tuple(r) for r in releases.creator_index(creators, index).collect()] == [(0, "c1", "One", 3)]


def test_shared_index(spark):
    numbers = [(v,) for v in (70, 3, -5, 12, None)]
    words = [(f"w{v:04d}",) for v in np.random.default_rng(3).permutation(900)]
    tables = {
        "a_ix": spark.createDataFrame(numbers, "a bigint"),
        "b_ix": spark.createDataFrame(words, "b string"),
        "c_ix": spark.createDataFrame([], "c string"),
        "d_ix": spark.createDataFrame([("z",), ("w0001",)], "d string"),
    }
    got = {name: [tuple(r) for r in df.orderBy(name).collect()] for name, df in keys.shared_index(tables, 7).items()}
    assert got["a_ix"] == [(-5, 0), (3, 1), (12, 2), (70, 3), (None, 4)]
    assert got["b_ix"] == [(w, i) for i, w in enumerate(sorted(w for w, in words))]
    assert got["c_ix"] == [] and got["d_ix"] == [("w0001", 0), ("z", 1)]
    assert keys.shared_index({}) == {}


def test_contiguous_and_dense_index(spark):
    rng = np.random.default_rng(0)
    values = [int(x) for x in rng.permutation(5000)]
    got = keys.contiguous_index(spark.createDataFrame([(f"k{v:05d}",) for v in values], "k string"), "k", "ix", 7).orderBy("ix").collect()
    assert [r["ix"] for r in got] == list(range(5000)) and [r["k"] for r in got] == sorted(f"k{v:05d}" for v in values)
    dense = keys.dense_index(spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "k string"), "k", "ix").collect()
    assert {r["k"]: r["ix"] for r in dense} == {"a": 0, "b": 1, None: 2}
    with pytest.raises(ValueError, match="runs from"):
        keys.assert_contiguous(spark.createDataFrame([(1,), (3,)], "ix int"), "ix")


def test_buckets_and_shares(spark):
    df = spark.createDataFrame([(1,), (50,), (51,), (5001,)], "n bigint")
    got = {r["bucket"]: (r["n"], r["pct"]) for r in profile.shares(df, "n", profile.LENGTH_BUCKETS, weighted=False).collect()}
    assert got == {"a. <=50": (2, 50.0), "b. 51-250": (1, 25.0), "e. >5000": (1, 25.0)}


def catalogue(spark, n=120, d=8, seed=1):
    rng = np.random.default_rng(seed)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    v, c = unit(rng.normal(size=(n, d))), unit(rng.normal(size=(10, d)))
    creator, pop = rng.integers(0, 10, n), rng.integers(0, 200, n)
    items = spark.createDataFrame([(i, int(creator[i]), int(pop[i]), v[i].tolist()) for i in range(n)], "ix bigint, creator bigint, pop bigint, v array<double>")
    owners = spark.createDataFrame([(i, c[i].tolist()) for i in range(10)], "creator bigint, v array<double>")
    return items, owners, v, c, creator, pop


def greedy(v, c, creator, pop, seeds, p):
    """The recommender as a loop over candidates."""
    z = lambda x: (x - x.mean()) / x.std() if x.std() > 1e-8 else x * 0
    ok = [i for i in range(len(v)) if i not in seeds and pop[i] >= p.min_pop and (p.max_pop is None or pop[i] <= p.max_pop) and not (p.exclude_same_artist and creator[i] in {creator[s] for s in seeds})]
    pool = sorted({i for s in seeds for i in sorted(ok, key=lambda i: (-(v[i] @ v[s]), i))[: p.n_candidates]})
    cos = np.array([[v[i] @ v[s] for s in seeds] for i in pool])
    raw, spread = cos.sum(1), cos.std(1)
    ca = raw - p.w_consistency * spread * len(seeds)
    cr = np.array([sum(c[creator[i]] @ c[creator[s]] for s in seeds) for i in pool])
    boost = np.exp(-((np.log(np.maximum(pop[pool], 1)) - math.log(p.pop_peak)) ** 2) / (2 * p.pop_width**2))
    score = lambda x: p.w_album * z(ca) + p.w_artist * z(x) + p.w_pop * boost
    occ = np.zeros(len(pool))
    if p.dup_penalty > 0 and p.w_artist > 0:
        seen = {creator[s]: 1 for s in seeds}
        for j in np.argsort(-score(cr), kind="stable"):
            occ[j] = seen.get(creator[pool[j]], 0)
            seen[creator[pool[j]]] = occ[j] + 1
    final = score(cr - p.dup_penalty * occ)
    order = np.lexsort((pool, -final))
    return [pool[j] for j in order], final[order], occ[order]


@pytest.mark.parametrize("how", [{}, {"n_candidates": 10}, {"w_artist": 0.0}, {"dup_penalty": 0.0}, {"exclude_same_artist": True, "min_pop": 20, "max_pop": 150}, {"n_candidates": 5000}])
@pytest.mark.parametrize("seeds", [[3], [3, 17, 42], [5, 5, 11]])
def test_recommendation_equals_the_loop(spark, how, seeds):
    items, owners, *arrays = catalogue(spark)
    p = recommend.Params(**how)
    got = recommend.scored_candidates(items, owners, seeds, p).orderBy(F.col("score").desc(), "ix").collect()
    ids, score, occ = greedy(*arrays, seeds, p)
    assert [r["ix"] for r in got] == ids
    assert np.allclose([r["score"] for r in got], score) and [r["occ"] for r in got] == occ.tolist()


def test_recommendation_edges(spark):
    items, owners, *_ = catalogue(spark)
    assert recommend.recommend(items, owners, [1], recommend.Params(min_pop=10_000)).count() == 0
    with pytest.raises(ValueError, match="unknown"):
        recommend.recommend(items, owners, [999])
    lost = items.withColumn("creator", F.when(F.col("ix") % 2 == 0, F.col("creator")))
    got = recommend.scored_candidates(lost, owners, [3], recommend.Params()).where("creator is null").collect()
    assert got and all(r["dup"] == 0 and r["cos_artist"] == 0 for r in got)


def test_top_by_block_is_exact(spark):
    items, _, v, *_ = catalogue(spark, n=300)
    queries = items.where("ix < 25").select(F.col("ix").alias("query"), "v")
    got = retrieval.top_by_block(items.repartition(5).select("ix", "v"), queries, 7).collect()
    for q in range(25):
        s = v @ v[q]
        s[q] = -9
        want = np.lexsort((np.arange(300), -s))[:7].tolist()
        assert [r["ix"] for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["place"])] == want
    assert [r["ix"] for r in retrieval.top_in_plan(items, v[4].tolist(), 3).collect()] == np.argsort(-(v @ v[4]))[:3].tolist()


@pytest.mark.parametrize("k", [1, 9])
def test_blocks_that_cannot_reach_are_skipped(spark, monkeypatch, k):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(40, 8)) * 3
    v = np.concatenate([m + 0.1 * rng.normal(size=(60, 8)) for m in middle])
    v[7] = v[2_000]  # a tie
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "ix bigint, v array<double>").repartition(6)
    asked = frame.where("ix % 3 <> 1").select(F.col("ix").alias("query"), "v").union(spark.createDataFrame([(-5, [0.0] * 8), (-6, (-v[3]).tolist())], "query bigint, v array<double>"))
    monkeypatch.setattr(retrieval, "CENTRES", 64)
    monkeypatch.setattr(retrieval, "GROUP_BLOCKS", 2)
    pairs, make = [], retrieval.block_pairs
    monkeypatch.setattr(retrieval, "block_pairs", lambda *a: pairs.append((make(*a), len(a[1][0]))) or pairs[-1][0])
    got = sorted(map(tuple, retrieval.top_by_block(frame, asked, k, broadcast_rows=100, block_rows=32).collect()))
    want = []
    for q, x in [(i, v[i]) for i in range(len(v)) if i % 3 != 1] + [(-5, np.zeros(8)), (-6, -v[3])]:
        s = v @ x
        if q >= 0:
            s[q] = -np.inf
        want += [(q, i, float(s[i]), place + 1) for place, i in enumerate(np.lexsort((np.arange(len(v)), -s))[:k].tolist())]
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in sorted(want)] and np.allclose([g[2] for g in got], [w[2] for w in sorted(want)])
    met = sum(len(r["own"]) // 8 for r in pairs[0][0].select("own").collect())
    assert 0 < met < 1_600 * pairs[0][1] / 3  # pairs of a query and a block, of all such


def test_arithmetic(spark):
    items, _, v, _, _, pop = catalogue(spark)
    target = (v[1] - v[2]) * v[3]
    score = v @ (target / np.linalg.norm(target))
    want = [i for i in np.argsort(-score).tolist() if i not in (1, 2, 3) and pop[i] >= 50][0]
    assert analogy.analogy(items, [(1, "*"), (2, "-"), (3, "*")], min_pop=50).first()["ix"] == want
    with pytest.raises(ValueError, match="cancel"):
        analogy.analogy(items, [(1, "+"), (1, "-")])
    assert analogy.analogy(items, [(1, "+")]).count() == 0  # the default floor of popularity


def test_search_and_match(spark):
    df = spark.createDataFrame([(1, "Björk  Début", 5), (2, "bjork  post", 9), (3, "other", 99)], "ix bigint, name string, pop bigint").withColumn("hay", F.lower(F.col("name")))
    from loomset.functions.text import haystack

    df = df.withColumn("hay", haystack(F.col("name")))
    assert [r["ix"] for r in search.search(df, "BJÖRK").collect()] == [2, 1]
    assert [r["ix"] for r in search.search(df, "bjork debut", max_pop=8).collect()] == [1]
    assert search.search(df, "   ").count() == 0 and search.search(df, "%").count() == 0
    m = spark.createDataFrame([("a", "Hex", 3, 1), ("a", "Hex II", 9, 2), ("b", "Hex", 9, 3)], "o string, t string, n int, k int")
    match = lambda t: [r["k"] for r in search.match_title(m, F.col("o"), F.col("t"), "a", t, "n", "k").collect()]
    assert match("Hex") == [1] and match("He") == [2] and match("Zed") == []


def test_holdout_is_disjoint_and_stable(spark):
    pairs = spark.createDataFrame([(i % 50, i) for i in range(400)], "collection_ix bigint, item bigint")
    a, b = evaluate.holdout_split(pairs, 10, seed=3)
    ids = lambda df: {r[0] for r in df.select("collection_ix").distinct().collect()}
    assert len(ids(b)) == 10 and not ids(a) & ids(b) and ids(evaluate.holdout_split(pairs.repartition(7), 10, seed=3)[1]) == ids(b)


def test_strata_have_inclusive_lower_bounds(spark):
    got = [r[0] for r in spark.createDataFrame([(x,) for x in (0, 9, 10, 49, 50, 199, 200, 999, 1000)], "f bigint").select(evaluate.stratum(F.col("f"))).collect()]
    assert [g[0] for g in got] == list("aabbccdde")


def test_frequency_has_zeros(spark):
    got = evaluate.item_frequency(spark.createDataFrame([(0, 1), (1, 1)], "c bigint, item bigint"), 3).orderBy("item").collect()
    assert [r["freq"] for r in got] == [0, 2, 0]


def test_positive_is_another_slot_and_each_slot_anchors_once(spark):
    adj = spark.createDataFrame([(0, [7, 8, 9]), (1, [4]), (2, [5, 6])], "c bigint, items array<bigint>")
    slots = train.anchors(adj).withColumn("u", F.explode(F.array(*(F.lit(x / 10) for x in range(10)))))
    got = slots.withColumn("pos", train.positive(F.col("items"), F.col("at"), F.col("u"))).collect()
    assert all(r["pos"] != r["anchor"] and r["pos"] in r["items"] for r in got)
    assert sorted({(r["at"], r["anchor"]) for r in got}) == [(0, 5), (0, 7), (1, 6), (1, 8), (2, 9)]


def test_training_learns_planted_blocks(spark):
    rng = np.random.default_rng(0)
    lists = [(i, sorted(int(x) for x in rng.choice(10, 5, replace=False) + 10 * (i % 3))) for i in range(150)]
    adj = spark.createDataFrame(lists, "collection_ix bigint, items array<bigint>")
    freq = adj.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("freq"))
    folder = scratch(spark, "planted")
    config = train.TrainConfig(dim=8, negatives=5, learning_rate=0.2, epochs=3, steps_per_epoch=3)
    table, history = train.train(adj, freq, 30, config, folder)
    assert history[-1]["loss"] < history[0]["loss"] < math.log(2) + 0.05 and history[-1]["loss"] < 0.5
    assert all(h["anchors"] == 750 for h in history)
    v = np.array([r["v"] for r in table.orderBy("ix").collect()])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = np.argsort(-(v @ v.T - 9 * np.eye(30)), axis=1)[:, :5]
    assert (near // 10 == np.arange(30)[:, None] // 10).mean() > 0.9
    _, more = train.train(adj, freq, 30, train.TrainConfig(dim=8, negatives=5, learning_rate=0.2, epochs=4, steps_per_epoch=3), folder, resume=True)
    assert len(more) == 4 and more[:3] == history
    with pytest.raises(ValueError, match="checkpoint"):
        train.train(adj, freq, 31, config, folder, resume=True)
    with pytest.raises(ValueError, match="left to run"):
        train.train(adj, freq, 30, config, folder, resume=True)
    with pytest.warns(UserWarning, match="negatives"):
        train.train(adj, freq, 30, train.TrainConfig(dim=8, negatives=2, epochs=5, steps_per_epoch=1), folder, resume=True)


def test_training_by_joins_equals_training_by_broadcast(spark):
    rng = np.random.default_rng(3)
    lists = [(i, sorted(int(x) for x in rng.choice(12, 4, replace=False))) for i in range(40)]
    adj = spark.createDataFrame(lists, "collection_ix bigint, items array<bigint>")
    freq = adj.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("freq"))
    config = train.TrainConfig(dim=4, negatives=3, learning_rate=0.1, epochs=2, steps_per_epoch=2)
    held = evaluate.probes(adj.where("collection_ix < 10"))
    tables, histories = zip(*(train.train(adj, freq, 12, config, scratch(spark, "both"), held=held, broadcast_bytes=n) for n in (1 << 20, 0)), strict=True)
    v = [np.array([r["v"] for r in t.orderBy("ix").collect()]) for t in tables]
    assert np.allclose(*v, atol=1e-9) and [h["anchors"] for h in histories[0]] == [160, 160]
    assert all(math.isclose(a["loss"], b["loss"], rel_tol=1e-9) and a["score"] == b["score"] and 0 <= a["score"] <= 1 for a, b in zip(*histories, strict=True))


def test_evaluators_and_probes(spark):
    items, _, v, *_ = catalogue(spark, n=40)
    tests = spark.createDataFrame([(0, 3, [int(np.argsort(-(v @ v[3]))[1]), 39])], "query bigint, seed bigint, targets array<bigint>")
    assert evaluate.recall_evaluator(tests, 1)(items.select("ix", "v")) in (0.5, 1.0)
    triples = spark.createDataFrame([(1, 2, 3)], "anchor bigint, pos bigint, neg bigint")
    assert math.isclose(-evaluate.loss_evaluator(triples)(items.select("ix", "v")), math.log(1 + math.exp(-(v[1] @ v[2] - v[1] @ v[3]))), rel_tol=1e-9)
    rows = items.select("ix", F.lit("o").alias("owner"), F.concat(F.lit("t"), F.col("ix").cast("string")).alias("title"), F.lit(1).alias("n_tracks"))
    assert [r["ix"] for r in evaluate.nearest_to_title(rows, items.select("ix", "v"), "o", "t7", 3).collect()] == np.argsort(-(v @ v[7]))[1:4].tolist()
    assert evaluate.nearest_to_title(rows, items.select("ix", "v"), "o", "none").count() == 0


def test_sampling_shares(spark):
    freq = spark.createDataFrame([(0, 16), (1, 0), (70_000, 81)], "item bigint, freq bigint")
    got = {r["item"]: r for r in train.negative_cdf(freq).collect()}
    assert np.allclose([got[i]["p"] for i in (0, 1, 70_000)], np.array([8, 1, 27]) / 36) and math.isclose(got[70_000]["cdf"], 1) and got[0]["cdf_prev"] == 0


ID = "0123456789abcdefghij{:02d}"


def test_draws_find_the_items_whose_shares_hold_them(spark):
    rng = np.random.default_rng(4)
    freq = rng.integers(0, 50, 500)
    freq[7] = 90_000  # one item with most of the shares
    cdf = train.negative_cdf(spark.createDataFrame([(i * 300, int(n)) for i, n in enumerate(freq)], "item bigint, freq bigint"), 1.0)
    u = [*((np.arange(200) + 0.5) / 200), 1.0]
    got = {r["u"]: r["item"] for r in train.drawn_items(spark.createDataFrame([(float(x),) for x in u], "u double"), cdf, buckets=64).collect()}
    share = np.cumsum(np.maximum(freq, 1)) / np.maximum(freq, 1).sum()
    assert [got[float(x)] for x in u] == [int(np.searchsorted(share, x - 1e-12)) * 300 for x in u]
    rows = cdf.orderBy("item").collect()
    assert rows[0]["cdf_prev"] == 0 and all(a["cdf"] == b["cdf_prev"] for a, b in zip(rows, rows[1:]))


def test_final_evaluation(spark):
    items, _, v, *_ = catalogue(spark, n=40)
    tests = spark.createDataFrame([(i, i, [(i + 1) % 40, (i + 2) % 40]) for i in range(20)], "query bigint, seed bigint, targets array<bigint>")
    freq = spark.createDataFrame([(i, 100 - i) for i in range(40)], "item bigint, freq bigint")
    for sample in (5_000, 8):
        got = {r["k"]: r for r in evaluate.final_evaluation(tests, items.select("ix", "v"), freq, (3, 10), sample).collect()}
        if sample == 5_000:
            for k in (3, 10):
                near = [set(np.lexsort((np.arange(40), -np.where(np.arange(40) == i, -9, v @ v[i])))[:k].tolist()) for i in range(20)]
                hits = sum(len(near[i] & {i + 1, i + 2}) for i in range(20))
                popular = sum(t < k for i in range(20) for t in (i + 1, i + 2))
                assert (got[k]["hits"], got[k]["pop_hits"], got[k]["targets"]) == (hits, popular, 40)
        else:
            assert got[3]["targets"] == 16


def test_creator_pairs_and_summary(spark):
    pairs = spark.createDataFrame([(0, 1, 5, 2), (0, 2, 5, 3), (0, 3, None, 9), (1, 1, 6, 1)], "collection_ix bigint, release_ix bigint, creator_ix bigint, n_tracks smallint")
    assert {tuple(r) for r in releases.creator_pairs(pairs).collect()} == {(0, 5, 5), (1, 6, 1)}
    index = spark.createDataFrame([(0, 3, 1), (1, 0, None)], "release_ix bigint, pop int, creator_ix bigint")
    assert tuple(releases.index_summary(index).first()) == (2, 1, 1)


def test_grouped_digits_and_card_urls(spark):
    from loomset.functions import text

    df = spark.createDataFrame([(0, "a"), (999, None), (1000, "b"), (-1234567, "c")], "n bigint, i string")
    got = df.select(text.grouped_digits(F.col("n")), text.card_url("album", F.col("i"), "https://x.example.org")).collect()
    assert [tuple(r) for r in got] == [("0", "https://x.example.org/album/a"), ("999", None), ("1.000", "https://x.example.org/album/b"), ("-1.234.567", "https://x.example.org/album/c")]


def test_cache_lifetimes_and_upserts(spark):
    old = spark.createDataFrame([(ID.format(1), "v", "", 10), (ID.format(2), "", "", 10), (ID.format(3), "", "", 100)], "id string, value string, title string, fetched_at bigint")
    assert {r["id"][-1] for r in cache.valid_rows(old, 120, lifetime=50).collect()} == {"1", "3"}
    new = spark.createDataFrame([(ID.format(1), "w", "", 10), (ID.format(2), "x", "", 5)], old.schema)
    assert {r["id"][-1]: r["value"] for r in cache.upserted(old, new).collect()} == {"1": "w", "2": "", "3": ""}
    assert tuple(cache.cache_stats(old).first()) == (3, 1)


def test_read_through(spark):
    old = spark.createDataFrame([(ID.format(1), "have", "t", 1_000_000)], "id string, value string, title string, fetched_at bigint")
    asked = spark.createDataFrame([(ID.format(i),) for i in (1, 2, 2, 3, 4)] + [("bad",)], "id string")

    def fetch(i):
        n = int(i[-2:])
        return {2: ("two", {"title": "T"}), 3: ("", {}), 4: None}[n]

    answers, table = cache.resolve(asked, old, fetch, 1_000_001, sleep=lambda s: None)
    assert {r["id"][-1]: r["value"] for r in answers.collect()} == {"1": "have", "2": "two"}
    assert {r["id"][-1]: r["value"] for r in table.collect()} == {"1": "have", "2": "two", "3": ""}


def test_work_list_is_cut_before_known_ids_go(spark):
    c = spark.createDataFrame([(ID.format(i), 100 - i) for i in range(10)] + [("bad", 999)], "id string, pop bigint")
    assert {r["id"][-1] for r in cache.work_list(c, c.where("pop > 98"), 4).collect()} == {"2", "3"}


def test_answers_and_name_repair(spark):
    body = '{"title": null, "thumbnail_url": "https://i.example.com/image/ab67616d00001e020123456789abcdef01234567"}'
    got = cache.parsed_answers(spark.createDataFrame([("a", body), ("b", "{}")], "id string, body string")).orderBy("id").collect()
    assert [tuple(r) for r in got] == [("a", "0123456789abcdef01234567", ""), ("b", "", "")]
    names = spark.createDataFrame([("a", 1, "??"), ("b", 2, "ok")], "id string, ix int, name string")
    fixed = cache.repaired_names(names, spark.createDataFrame([("a", "日本"), ("b", "other")], "id string, title string"))
    assert [tuple(r) for r in fixed.orderBy("id").collect()] == [("a", 1, "日本"), ("b", 2, "ok")]


def test_batches_of_answers_outlive_a_job_that_dies(spark, tmp_path):
    log, stop = tmp_path / "asked", tmp_path / "stop"
    stop.touch()

    def fetch(i):
        import os

        n = int(i[-2:])
        if n == 13 and os.path.exists(stop):
            raise RuntimeError("the job dies")
        with open(log, "a") as f:
            f.write(f"{n}\n")
        return None if n == 17 else ("", {}) if n % 2 else (f"v{n}", {})

    ids = spark.createDataFrame([(ID.format(i), 100 - i) for i in range(20)] + [(ID.format(0), 1), (ID.format(19), None)], "id string, pop bigint")
    how = {"batch": 5, "sleep": lambda s: None, "attempts": 1}
    with pytest.raises(Exception, match="the job dies"):
        cache.fetch_all(ids, fetch, str(tmp_path / "run"), 9, **how)
    first = [int(x) for x in log.read_text().split()]
    assert sorted(x for x in first if x < 10) == list(range(10)) and not [x for x in first if x > 14]
    stop.unlink()
    # the list of work stays that of the first call
    got = cache.fetch_all(ids.limit(0), fetch, str(tmp_path / "run"), 9, **how)
    assert {r["id"][-2:]: r["value"] for r in got.collect()} == {f"{i:02d}": "" if i % 2 else f"v{i}" for i in range(20) if i != 17}
    every = [int(x) for x in log.read_text().split()]
    assert all(every.count(i) == 1 for i in (*range(10), *range(15, 20))) and len(got.columns) == 4
    assert cache.fetch_all(ids, fetch, str(tmp_path / "run"), 9, **how).count() == 19 and len(log.read_text().split()) == len(every)
    assert cache.fetch_all(ids.limit(0), fetch, str(tmp_path / "none"), 9).count() == 0


def test_requests_keep_to_one_rate(spark):
    import time

    ids = spark.createDataFrame([(ID.format(i),) for i in range(40)], "id string")
    fetch = lambda i: (str(time.time()), {})
    at = sorted(float(r["value"]) for r in cache.fetched(ids, fetch, 0, rate=40.0).collect())
    # no more than the tasks' first requests come at once
    assert len(at) == 40 and all(b - a > 0.3 for a, b in zip(at, at[cache.FETCHERS :]))


@pytest.mark.parametrize("values", [
    [1.0], [2.0, 1.0], [5.0] * 9, [-1e308, 1e308, 0.0, 5e-324, -5e-324], [0.0, 5e-324], [math.inf, -math.inf, 1.0, 2.0, math.inf],
    [1.0, None, math.nan, 3.0], list(np.random.default_rng(1).normal(size=5_000)), list(10.0 ** np.random.default_rng(2).uniform(-60, 60, 500)), [], [None],
])
def test_quantiles_by_narrowing(spark, values):
    df = spark.createDataFrame([(None if x is None else float(x),) for x in values], "x double").cache()
    points = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.999, "e": 1.0}
    got = profile.wide_quantiles(df, "x", points, bins=16).first()
    want = df.where("not isnan(x)").agg(*(F.percentile("x", p).alias(name) for name, p in points.items())).first()
    assert [r if r is None else float(r) for r in got] == pytest.approx(list(want), rel=1e-12) if any(x is not None for x in values) else list(got) == list(want)


def test_gram_search_equals_the_scan(spark, tmp_path):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcé日 x"), rng.integers(1, 7))) for _ in range(60)]
    rows = [(i, int(rng.integers(0, 50)), None if i == 3 else "" if i == 4 else " ".join(rng.choice(words, rng.integers(1, 6)))) for i in range(400)]
    df = spark.createDataFrame(rows, "ix bigint, pop int, text string").select("ix", "pop", F.lower("text").alias("hay"))
    from loomset.functions.text import fold

    df = df.withColumn("hay", fold(F.col("hay"))).cache()
    path = str(tmp_path / "grams")
    search.write_gram_index(df, path)
    tested = []
    for _ in range(25):
        query = " ".join(rng.choice(words, 2))
        want = search.search(df, query, limit=400).collect()
        assert search.indexed_search(df, path, query, limit=400).collect() == want
        if (found := search.gram_candidates(spark, path, query)) is not None:
            n = found[0].count()
            assert len(want) <= n <= found[1]
            tested.append(n)
    assert tested and np.mean(tested) < 100
    print(f"of 400 rows {np.mean(tested):.0f} were tested on average")
    assert search.indexed_search(df, path, "zzzz").count() == 0 and search.indexed_search(df, path, " ").count() == 0
    search.write_gram_index(df.limit(0), str(tmp_path / "empty"))
    assert search.indexed_search(df, str(tmp_path / "empty"), "abc").count() == 0


def test_grams_take_linear_time(spark):
    import time

    took = []
    for n in (20_000, 200_000):
        df = spark.range(1).select(F.repeat(F.lit("ab cd é "), n // 8).alias("t"))
        begin = time.perf_counter()
        assert df.select(F.size(search.grams(F.col("t")))).first()[0] == 8
        took.append(time.perf_counter() - begin)
    assert took[1] < 30 * max(took[0], 0.1)


def test_a_run_keeps_its_best_and_last_epoch(spark, tmp_path):
    lists = [(i, [i % 6, (i + 1) % 6, (i + 2) % 6]) for i in range(30)]
    adj = spark.createDataFrame(lists, "collection_ix bigint, items array<bigint>")
    freq = spark.createDataFrame([(i, 15) for i in range(6)], "item bigint, freq bigint")
    config = train.TrainConfig(dim=2, negatives=2, epochs=3, steps_per_epoch=2)
    scores = iter([0.1, 0.9, 0.2])
    best, _ = train.train(adj, freq, 6, config, str(tmp_path / "run"), evaluate=lambda _: next(scores))
    assert {p.name for p in (tmp_path / "run").iterdir() if not p.name.startswith(".")} == {"meta.json", "epoch-1", "epoch-2"}
    assert best.count() == 6
    scores = iter([0.1, 0.2, 0.3])
    train.train(adj, freq, 6, config, str(tmp_path / "all"), evaluate=lambda _: next(scores), keep_all=True)
    assert {"init", "epoch-0", "epoch-1", "epoch-2", "step-1-0", "grads-2-1"} <= {p.name for p in (tmp_path / "all").iterdir()}


def test_image_addresses(spark):
    from loomset.functions import text

    df = spark.createDataFrame([("0123456789abcdef01234567",), (None,), ("",)], "k string")
    got = [r[0] for r in df.select(text.image_url("artist", F.col("k"), "md", "https://x.example.org/i")).collect()]
    assert got == ["https://x.example.org/i/ab676161000051740123456789abcdef01234567", None, None]
    assert df.select(text.image_key(text.image_url("album", F.col("k"), "lg"))).first()[0] == "0123456789abcdef01234567"
    for bad in (("album", "xl"), ("artist", "xs"), ("track", "sm")):
        with pytest.raises(ValueError, match="size"):
            text.image_url(bad[0], F.col("k"), bad[1])


def test_copies_tie_exactly_and_scores_are_few_at_once(spark, monkeypatch):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(9, 64))[rng.integers(0, 9, 700)]
    ids = np.arange(700)
    runs, partition = [], np.partition
    monkeypatch.setattr(np, "partition", lambda a, *x, **y: runs.append(a.size) or partition(a, *x, **y))
    monkeypatch.setattr(retrieval, "SCORES_AT_ONCE", 7_000)
    for n in (700, 333, 5):
        query, ix, _, _ = retrieval._best(ids, v, *retrieval._firsts(ids[:n], v[:n], 13), 12, True)
        for q in range(700):
            same = [i for i in range(n) if i != q and (v[i] == v[q]).all()][:12]
            assert ix[query == q][: len(same)].tolist() == same
    assert max(runs) <= 7_000


@pytest.mark.parametrize("few", [0, 10_000])
def test_copies_are_counted_by_any_path(spark, monkeypatch, few):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(40, 64))[rng.integers(0, 40, 900)]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "ix bigint, v array<double>").repartition(5)
    for name, value in (("FEW_QUERIES", few), ("CENTRES", 8), ("GROUP_BLOCKS", 3)):
        monkeypatch.setattr(retrieval, name, value)
    got = retrieval.top_by_block(frame, frame.select(F.col("ix").alias("query"), "v"), 30, broadcast_rows=100, block_rows=64).collect()
    assert len(got) == 900 * 30
    for q in range(0, 900, 9):
        s = sum(v[q, d] * v[:, d] for d in range(64))
        s[q] = -np.inf
        assert [r["ix"] for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["place"])] == np.lexsort((np.arange(900), -s))[:30].tolist()


def test_grams_of_many_texts_are_those_of_each(spark, monkeypatch):
    monkeypatch.setattr(search, "_CHARS", 12)
    texts = ["", "ab", "abcabc", "\U0001f600\U0001f600xy", "x" * 50, None, "été été", "abc"]
    df = spark.createDataFrame(list(enumerate(texts)), "ix bigint, hay string").repartition(1)
    held = search._held_grams(df, "hay", "ix").collect()
    want = {(t[i : i + 3], k) for k, t in enumerate(texts) for i in range(len(t or "") - 2)}
    assert {(r["gram"], r["key"]) for r in held} == want and len(held) == len(want)


def test_links_to_creators_keep_the_sessions_partitions(spark):
    from loomset.sources.tables import sample_tables

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sample_tables(spark, "/root/testdata/sf0.001").track_creator.rdd.getNumPartitions() == n > 1


def test_links_of_collections_are_dealt_to_the_sessions_partitions(spark):
    from loomset.plans.queries import _vec_pairs
    from loomset.sources.tables import sample_tables

    n, folder = int(spark.conf.get("spark.sql.shuffle.partitions")), "/root/testdata/sf0.001"
    assert sample_tables(spark, folder).track_collection.rdd.getNumPartitions() == n > 1
    assert _vec_pairs(spark, folder).rdd.getNumPartitions() == n


def test_lengths_are_taken_once_a_vector(spark):
    import time

    from loomset.functions.vectors import normalized

    wide = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda x: x.cast("double")).alias("v"))
    began = time.time()
    total = wide.select(F.aggregate(normalized(F.col("v")), F.lit(0.0), lambda s, x: s + x)).first()[0]
    assert time.time() - began < 10  # one length an element took over 30 s
    x = np.arange(1, 20_001, dtype=float)
    assert total == pytest.approx((x / (np.sqrt((x * x).sum()) + 1e-9)).sum())
    odd = spark.createDataFrame([(1, []), (2, None), (3, [1.0, None]), (4, [0.0, 0.0])], "i int, v array<double>").orderBy("i")
    assert [r[0] for r in odd.select(normalized(F.col("v"))).collect()] == [[], None, [None, None], [0.0, 0.0]]


def test_evaluation_writes_few_files(spark, monkeypatch):
    from loomset.plans import queries

    written, write = [], queries.materialized
    monkeypatch.setattr(queries, "materialized", lambda df, name: written.append((name, out := write(df, name))) or out)
    monkeypatch.setattr(queries, "PART_VECTORS", 50)
    folder = "/root/testdata/sf0.001"
    tests, items, freq, n = queries._evaluation(spark, folder, k=0)
    # probes once, and vectors dealt though their table is one file; never all pairs, a file a partition
    assert [name for name, _ in written] == ["probes", "vectors"]
    assert 1 < len(items.inputFiles()) <= -(-n // 50) and items.count() == n
    assert all("loomset-probes" in f for f in tests.inputFiles())
    pairs = queries._vec_pairs(spark, folder)
    assert freq.agg(F.sum("freq")).first()[0] == pairs.where("collection_ix % 10 <> 0").count()
    held = pairs.where("collection_ix % 10 = 0").groupBy("collection_ix").count().where("count > 1")
    assert tests.count() == held.count() and tests.select(F.sum(F.size("targets") + 1)).first()[0] == held.agg(F.sum("count")).first()[0]


@pytest.mark.parametrize("by", ["seed", "target"])
def test_strata_count_by_item_before_the_join(spark, by):
    found = spark.range(3_000).select(F.when(F.col("id") < 2_000, F.lit(1)).when(F.col("id") < 2_900, F.lit(2)).otherwise(F.lit(None)).cast("long").alias(by), (F.col("id") % 2).cast("int").alias("hit"))
    freq = spark.createDataFrame([(1, 1_000), (2, 10), (3, 5)], "item bigint, freq bigint")
    out = evaluate.recall_by_stratum(found, freq, by)
    assert {tuple(r) for r in out.collect()} == {("e. >=1000", 1_000, 2_000, 0.5), ("b. 10-49", 450, 900, 0.5), ("a. <10", 50, 100, 0.5)}
    below = out._jdf.queryExecution().optimizedPlan().toString().partition("Join LeftOuter")[2].splitlines()[1]
    assert below.lstrip(" :+-").startswith("Aggregate")
