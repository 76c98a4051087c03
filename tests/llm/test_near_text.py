"""Near-duplicate texts of the pipeline: all pairs of five-word similarity 0.8 or more, and no others, by brute force."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from test_llm_operators import brute_print, frame, words

import corpus_pipeline
from loomset.llm import components, near_text


def brute_sets(texts):
    parts = [t.lower().split() for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in parts]


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_labels(sets):
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if label[i] != label[j] and similarity(sets[i], sets[j]) >= 0.8:
                label = [label[j] if x == label[i] else x for x in label]
    return label


def test_stage_drops_all_texts_of_similarity_four_fifths(spark):
    rng = np.random.default_rng(21)
    texts, far = [None, "", " \n", "Two words", "two WORDS", "three"], 0
    for n in (60, 90, 200, 600):
        for share in (0.01, 0.02, 0.03, 0.04, 0.05, 0.08):
            base = words(rng, n).split()
            copy = [w if rng.random() > share else "zz" for w in base]
            texts += [" ".join(base), " ".join(copy)]
    sets = brute_sets([t or "" for t in texts])
    label = brute_labels(sets)
    for a in range(6, len(texts), 2):
        far += label[a] == label[a + 1] and (brute_print(texts[a]) ^ brute_print(texts[a + 1])).bit_count() > 3
    assert far > 5  # the three-bit rule of op9 misses these
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts)] + [(7, texts[7], "s"), (7, texts[7], "s")])
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({x: i for i, x in reversed(list(enumerate(label)))}.values())
    assert near_text.drop_near_texts(docs.limit(0)).count() == 0


def test_similar_pairs_are_all_pairs():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, int(n))) for n in rng.integers(40, 400, 30)] + [np.arange(3)]
    got = near_text.similar_pairs(sets[:12], sets[5:])
    want = [(i, j) for i in range(12) for j in range(26) if similarity(set(sets[i].tolist()), set(sets[5 + j].tolist())) >= 0.8]
    assert got == want and 0 < len(want) < 12 * 26
    assert near_text.similar_pairs([], sets) == near_text.similar_pairs(sets, []) == []


def test_a_large_group_is_compared_in_small_blocks(spark, monkeypatch):
    # chains of texts, each near the next only, in groups larger than a block
    monkeypatch.setattr(near_text, "CHUNK", 4)
    monkeypatch.setattr(near_text, "MANY_BLOCKS", 1)
    rng = np.random.default_rng(31)
    texts = []
    for _ in range(6):
        now = words(rng, 150).split()
        for _ in range(12):
            texts.append(" ".join(now))
            at = int(rng.integers(0, 140))
            now = now[:at] + words(rng, 7).split() + now[at + 7 :]
    sets = brute_sets(texts)
    label = brute_labels(sets)
    got = near_text.near_classes(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()
    by = {}
    for r in got:
        by.setdefault(r["label"], set()).add(r["doc_id"])
    want = {}
    for i, x in enumerate(label):
        want.setdefault(x, set()).add(i)
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, want.values()))
    assert any(similarity(sets[i], sets[j]) < 0.8 for w in want.values() for i in w for j in w)


def test_texts_of_one_boilerplate_are_not_compared_in_pairs(spark, monkeypatch):
    """Texts that share four fifths of their words without linking: what is compared grows with their number only."""
    counted, compare = [], near_text._compared
    monkeypatch.setattr(near_text, "_compared", lambda docs, blocks, *a: counted.append(blocks.count()) or compare(docs, blocks, *a))
    rng = np.random.default_rng(7)
    common, made = words(rng, 96), {}
    for n in (400, 1_200):
        texts = [f"{common} {words(rng, 24)}" for _ in range(n)] + [f"{common} one two three", f"{common} one two three four"]
        counted.clear()
        got = near_text.near_classes(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()
        assert len({r["label"] for r in got}) == n + 1
        made[n] = counted[:]
    # with the least of its bands, a text meets few others, BANDS at most; as strays, only the two that are similar meet
    assert all(sum(c) < 8 * n and sum(c[1:]) <= 24 * 4 for n, c in made.items()), made


def test_prefixes_miss_no_similar_pair(spark):
    rng = np.random.default_rng(9)
    texts = []
    for _ in range(12):
        base = words(rng, int(rng.integers(6, 120))).split()
        texts += [" ".join(base)] + [" ".join(base[: len(base) - int(rng.integers(0, 30))] + words(rng, int(rng.integers(1, 12))).split()) for _ in range(8)]
    sets = brute_sets(texts)
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    rows = near_text.written(near_text._prints(docs, "doc_id", "text"), "test")
    ids = {r["fp"]: r["doc_id"] for r in rows.collect()}
    members = rows.select("fp", "row_key", rows["fp"].alias("label"), (rows["doc_id"] % 3 == 0).alias("stray")).dropDuplicates(["fp"])
    found = {ids[r["fp"]] for r in near_text.may_link(docs, members, "doc_id", "text", 1_000).collect()}
    want = {x for i in range(len(texts)) for j in range(i) if (i % 3 == 0 or j % 3 == 0) and similarity(sets[i], sets[j]) >= 0.8 and texts[i] != texts[j] for x in (i, j)}
    assert want and want <= found
    far = frame(spark, [(i, words(rng, 96) + f" {words(rng, 24)}", "s") for i in range(20)])
    rows = near_text.written(near_text._prints(far, "doc_id", "text"), "test")
    assert near_text.may_link(far, rows.select("fp", "row_key", rows["fp"].alias("label"), F.lit(True).alias("stray")), "doc_id", "text", 1_000).count() == 0


def test_long_texts_stand_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_text, "CHUNK_CHARS", 20_000)
    rng = np.random.default_rng(11)
    base = words(rng, 3_000).split()
    texts = [" ".join(base[:i] + ["zz"] + base[i + 1 :]) for i in range(0, 3_000, 150)]
    counted, compare = [], near_text._compared
    monkeypatch.setattr(near_text, "_compared", lambda docs, blocks, *a: counted.append(blocks.groupBy("block").count().agg({"count": "max"}).first()[0]) or compare(docs, blocks, *a))
    got = near_text.near_classes(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()
    assert len({r["label"] for r in got}) == 1 and counted[0] < 10


def test_shingles_do_not_cross_texts():
    texts = ["a b c d e f", "", "a b", "b c d e f", "c", None, "a b c d e"]
    h, offsets, keys = near_text.shingles(pa.array(texts))
    assert np.diff(offsets).tolist() == [2, 0, 1, 1, 1, 0, 1] and keys[1] == keys[5] == 0 and len(set(keys)) == 6
    alone = [near_text.shingles(pa.array([t], pa.string()))[0].tolist() for t in texts]
    assert h.tolist() == sum(alone, []) and alone[0] == alone[6] + alone[3]


def test_stage_links_what_simhash_links(spark):
    rng = np.random.default_rng(33)
    texts = [words(rng, 300) for _ in range(6)]
    # many changed words in a long repeated text: few bits differ, and few shingle sets are alike
    long = " ".join(f"w{i % 40}" for i in range(4_000))
    texts += [long, long + " " + " ".join(f"u{i}" for i in range(60))]
    bits = (brute_print(texts[6]) ^ brute_print(texts[7])).bit_count()
    sets = brute_sets(texts)
    assert bits <= 3 and len(sets[6] & sets[7]) / len(sets[6] | sets[7]) < 0.8
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    # a copy of the second by shingles goes with the first, which is like it by SimHash only
    docs = docs.union(frame(spark, [(8, texts[7] + " end", "s")]))
    assert sorted(r["doc_id"] for r in near_text.drop_near_texts(docs).collect()) == list(range(8))
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == list(range(7))


def test_stars_take_no_round_of_components(spark, monkeypatch):
    """The driver holds what a round's plan takes: edges that are stars are told by a look, and no round only proves the last."""
    rounds, star = [], components._star
    monkeypatch.setattr(components, "_star", lambda edges, large: rounds.append(large) or star(edges, large))

    def labels(edges):
        rounds.clear()
        got = components.connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
        assert len(got) == len({r["node"] for r in got})
        return {r["node"]: r["label"] for r in got}, len(rounds) // 2

    # either way round, repeated, with a loop and negative ids
    assert labels([(1, -4), (-4, 2), (2, -4), (7, 7), (9, 8)]) == ({1: -4, 2: -4, -4: -4, 9: 8, 8: 8}, 0)
    assert labels([(1, 2), (2, 3), (1, 3)]) == ({1: 1, 2: 1, 3: 1}, 1)
    assert labels([]) == ({}, 0)
    rng = np.random.default_rng(41)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 300, (260, 2))] + [(i, i + 1) for i in range(1_000, 1_060)]
    want = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in want:
        for u, v in edges:
            if u != v:
                want[u] = want[v] = min(want[u], want[v])
    assert labels(edges)[0] == want


def test_stage_finds_components_of_texts_only(spark, monkeypatch):
    """SimHashes that link go to the classes of texts as they are, and later links to the stars of the classes so far."""
    calls, find = [], components.connected_components
    monkeypatch.setattr(near_text, "connected_components", lambda edges: calls.append(edges.count()) or find(edges))
    rng = np.random.default_rng(43)
    common = words(rng, 96)
    texts = [words(rng, 300) for _ in range(6)] + [f"{common} {words(rng, 24)}" for _ in range(40)]
    texts += [f"{common} one two three", f"{common} one two three four"]
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    prints = [brute_print(t) for t in texts]
    sets = brute_sets(texts)
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8 or (prints[i] ^ prints[j]).bit_count() <= 3:
                label = [label[j] if x == label[i] else x for x in label]
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.count() == len(set(label)) < len(texts)
    assert 1 <= len(calls) <= 2
