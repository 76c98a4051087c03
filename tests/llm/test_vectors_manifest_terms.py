"""Cover trees, the Merkle manifest and source divergences against brute force and on awkward rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomset.llm import cover_tree, divergence, merkle
from loomset.llm.common import scratch_path


def brute_links(rows, least=0.9):
    """(vec_id, n_links, component_id, kept) by all pairs; rows: (vec_id, vector)."""
    usable = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, up = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for size in {len(rows[i][1]) for i in usable}:
        own = [i for i in usable if len(rows[i][1]) == size]
        x = np.array([rows[i][1] for i in own], float)
        x /= np.abs(x).max(axis=1)[:, None]
        x /= np.linalg.norm(x, axis=1)[:, None]
        near = x @ x.T >= least
        np.fill_diagonal(near, False)
        for a, s in zip(own, near.sum(axis=1), strict=True):
            n[a] = int(s)
        for a, b in np.argwhere(np.triu(near)):
            up[root(own[a])] = root(own[b])
    least_id = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least_id[root(i)] = min(least_id.get(root(i), k), k)
    return sorted(((k, n[i], least_id.get(root(i)), k is not None and k == least_id.get(root(i))) for i, (k, _) in enumerate(rows)), key=str)


def vectors(dim=16, groups=20, each=40, seed=1):
    """Groups from very tight to loose, so that nodes are left, taken whole and opened."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(groups, dim))
    made = np.concatenate([b + rng.normal(size=(each, dim)) * rng.random((each, 1)) * w for b, w in zip(base, np.linspace(0.01, 0.5, groups), strict=True)])
    return made.astype(np.float32).astype(float).tolist()


@pytest.mark.parametrize(("kind", "rows_of_a_block"), [("float", (512, 4096)), ("float", (64, 64)), ("double", (64, 64))])
def test_vectors_link_as_by_all_pairs(spark, monkeypatch, kind, rows_of_a_block):
    monkeypatch.setattr(cover_tree, "BLOCK_ROWS", rows_of_a_block)
    rows = list(enumerate(vectors()))
    rows += [(5000 + i, rows[3][1]) for i in range(60)] + [(6000 + i, [2 * x for x in rows[3][1]]) for i in range(3)]  # copies, and longer ones
    rows += [(7000, None), (7001, []), (7002, [0.0] * 16), (7003, [1.0] * 15 + [float("nan")]), (7004, [1.0] * 15 + [float("inf")]), (7005, [1.0] * 15 + [None])]
    rows += [(7006, [1.0, 2.0]), (7007, [1.0, 2.1]), (None, rows[50][1]), (7, rows[8][1]), (7008, [3e38] * 16), (7010, [-0.0] + [1.0] * 15), (7011, [0.0] + [1.0] * 15), (None, [1.0] * 3)]
    if kind == "double":
        rows += [(8000, [1e200] * 16), (8001, [1e-200] * 16)]
    df = spark.createDataFrame([(k, v, "x", 1, "y") for k, v in rows], f"vec_id bigint, embedding array<{kind}>, key string, n int, label string")
    stored = [(k, v and [None if x is None else float(np.float32(x)) if kind == "float" else x for x in v]) for k, v in rows]
    assert sorted((tuple(r) for r in cover_tree.near_vectors(df).collect()), key=str) == brute_links(stored)


def test_vectors_at_the_threshold_and_none(spark):
    assert cover_tree.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).collect() == []
    c = 0.9
    rows = [(1, [1.0, 0.0]), (2, [c + 1e-12, float(np.sqrt(1 - c * c))]), (3, [c - 1e-9, -float(np.sqrt(1 - c * c))])]
    got = {r["vec_id"]: r["n_links"] for r in cover_tree.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert got == {1: 1, 2: 1, 3: 0}


def test_traversal_leaves_most_pairs_out():
    """Vectors of a low intrinsic dimension: bounds rule out nearly all pairs, and tight groups are taken whole."""
    rng = np.random.default_rng(3)
    t = rng.random(4_000) * 2 * np.pi
    flat = np.stack([np.cos(t), np.sin(t), 0.05 * rng.normal(size=4_000)], axis=1)
    raw = np.concatenate((flat, np.zeros((4_000, 13))), axis=1)
    trees = [cover_tree.build_tree(np.arange(a, a + 2_000), np.ones(2_000, np.int64), raw[a : a + 2_000]) for a in (0, 2_000)]
    for one in trees:  # nested levels: a node's centre is its first vector, and covers it
        for starts, radii in zip(one.starts, one.radii, strict=True):
            own = np.searchsorted(starts, np.arange(2_000), side="right") - 1
            assert (np.linalg.norm(one.unit - one.unit[starts[own]], axis=1) <= radii[own] + 1e-9).all()
        assert all(set(a) <= set(b) for a, b in zip(one.starts[:-1], one.starts[1:], strict=True))
    seen: list[int] = []
    key, n, _ = cover_tree.traverse(*trees, 0.999, seen)
    unit = cover_tree.unit_vectors(raw)
    near = unit[:2_000] @ unit[2_000:].T >= 0.999
    want = dict(enumerate(near.sum(axis=1))) | dict(enumerate(near.sum(axis=0), 2_000))
    assert dict(zip(key.tolist(), n.tolist(), strict=True)) == {k: v for k, v in want.items() if v}
    assert sum(seen) < 2_000 * 2_000 / 4
    loose: list[int] = []
    cover_tree.traverse(*trees, 0.5, loose)  # two thirds of a circle link: whole nodes count
    assert sum(loose) < 2_000 * 2_000 / 4


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute_manifest(rows, false=()):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root) of rows (doc_id, source, lang, n_chars, text)."""

    def leaf(r):
        return digest("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in r))

    def levels(now):
        out = [now]
        while len(out[-1]) > 1:
            out.append([digest("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
        return out

    def path(tree, i):
        for level in tree[:-1]:
            beside = level[i ^ 1] if i ^ 1 < len(level) else ""
            yield (beside, "") if i & 1 else ("", beside)
            i >>= 1

    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append(r)
    names = sorted(langs, key=lambda k: (k is not None, (k or "").encode()))
    for k in names:
        langs[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {k: levels([leaf(r) for r in langs[k]]) for k in names}
    top = levels([trees[k][-1][0] for k in names])
    out = []
    for j, k in enumerate(names):
        for i, r in enumerate(langs[k]):
            proof = [*path(trees[k], i), *path(top, j)]
            own = leaf((*r[:3], r[3] + 1, r[4])) if r[0] in false else leaf(r)
            for a, b in proof:
                own = digest(a + own + b)
            out.append((r[0], leaf(r), trees[k][-1][0], top[-1][0], digest("".join(a + b for a, b in proof)), own))
    return sorted(out, key=str)


MANIFEST = "doc_id bigint, source string, lang string, n_chars bigint, text string, tree string, pos string, hash int"


def manifest(spark, rows, false=()):
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], MANIFEST)
    path = scratch_path(spark, "test-merkle")
    length = F.col("n_chars") + F.col("doc_id").isin(*false).cast("int") if false else F.col("n_chars")
    claimed = F.when(F.col("doc_id").isNull(), merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.col("text")))
    claimed = F.coalesce(claimed, merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), length, F.col("text")))
    merkle.write_manifest(docs, path, claimed=claimed)
    found = merkle.read_proofs(spark, path)
    made = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("left"), F.col("right")).alias("p"), merkle.fold(F.col("claimed"), F.col("left"), F.col("right")).alias("f"))
    return sorted((tuple(r) for r in made.collect()), key=str), path


@pytest.mark.parametrize("run_levels", [10, 2])
def test_manifest_equals_brute_force(spark, monkeypatch, run_levels):
    monkeypatch.setattr(merkle, "RUN_LEVELS", run_levels)
    rows = [(i, f"s{i % 3}", "en", i, "é日本" * (i % 4)) for i in range(133)]
    rows += [(200 + i, "s", lang, 1, "t") for lang, n in (("fr", 1), ("de", 2), ("", 3), (None, 5), ("ü", 17), ("z", 64)) for i in range(n)]
    rows += [(7, "again", "en", 3, "other")] * 2 + [(8, None, "en", 3, None)] * 40 + [(None, None, None, 5, ""), (None, "s", "en", 1, "x" * 300_000)]
    false = {5, 8, 201}
    got, path = manifest(spark, rows, false)
    want = brute_manifest(rows, false)
    assert got == want
    assert {r[0] for r in got if r[5] != r[3]} == false
    levels = {r["level"]: r["count"] for r in spark.read.parquet(f"{path}/nodes").groupBy("level").count().collect()}
    assert max(levels) == 8 and levels[1] >= 67 + 32  # a folder a level, of 177 leaves at most


@pytest.mark.parametrize("rows", [[], [(1, "a", "en", 1, "t")], [(1, "a", "en", 1, "t"), (2, "a", None, 1, "t")]])
def test_manifest_of_few_rows(spark, rows):
    assert manifest(spark, rows)[0] == brute_manifest(rows)


TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_divergences(rows, least=10, top=10):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = [w.translate(LOWER) for w in TERM.findall(text or "")]
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang in {k[0] for k in counts}:
        kept = [w for w, n in docs[lang].items() if n >= least]
        own = {s: c for (k, s), c in counts.items() if k == lang}

        def shares(c, kept=kept):
            total = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 2) // (total + 2 * len(kept)) for w in kept}

        p, q = {s: shares(c) for s, c in own.items()}, shares(sum(own.values(), Counter()))
        for s in own:
            pairs = [(sum((p[s][w] - p[o][w]) ** 2 // (p[s][w] + p[o][w]) for w in kept), o) for o in own if o != s]
            leading = [((p[s][w] - q[w]) ** 2 // (p[s][w] + q[w]), w) for w in kept if own[s][w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", leading, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(found[:most])]
    return sorted(out)


AWKWARD = (
    [("en", "a", "Foo bar é日本 x1y"), ("en", "b", None), (None, None, "only"), ("en", None, "Foo " * 5), ("en", "c", ""), ("fr", "a", "one"), ("fr", "b", "two"), ("en", "a", "word" * 200_000)]
    + [("en", "a", f"foo Zed{chr(97 + i % 3)} q" * (i % 4)) for i in range(40)]
    + [("en", "b", "Fooé")] * 12
    + [("de", "a", "x-y")] * 9
)


@pytest.mark.parametrize("blocks", [(200_000, 256), (3, 2)])
def test_divergences_equal_brute_force(spark, data, monkeypatch, blocks):
    monkeypatch.setattr(divergence, "BLOCK_COUNTS", blocks[0])
    monkeypatch.setattr(divergence, "BLOCK_SOURCES", blocks[1])
    df = spark.createDataFrame([(*r, "x", 1, True) for r in AWKWARD], "lang string, source string, text string, term string, n int, leads boolean")
    assert sorted(tuple(r) for r in divergence.source_divergences(df).collect()) == brute_divergences(AWKWARD)
    assert divergence.source_divergences(df.limit(0)).collect() == []


def test_divergences_of_many_sources(spark):
    rng = np.random.default_rng(0)
    rows = [("en", f"s{i % 700}", " ".join("abcdefgh"[j] * 2 for j in rng.integers(0, 8, 5))) for i in range(2_000)]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert sorted(tuple(r) for r in divergence.source_divergences(df).collect()) == brute_divergences(rows)


def test_slices_are_verified(monkeypatch):
    """Texts that end inside a term do not run on; with a hash that always clashes, terms are still told apart."""
    texts = pa.array(["ab", "Cd é1x", "", "ab cd", "éa"])
    for _ in range(2):
        row, code, terms = divergence.slice_terms(texts)
        assert [(r, terms[c].decode()) for r, c in zip(row.tolist(), code.tolist(), strict=True)] == [(0, "ab"), (1, "cd"), (1, "é"), (1, "x"), (3, "ab"), (3, "cd"), (4, "éa")]
        monkeypatch.setattr(divergence.xxhash, "xxh3_64_intdigest", lambda w: 1)


def test_probabilities_are_exact():
    rng = np.random.default_rng(2)
    for total in (10, 10**6, 8 * 10**15):
        c = rng.integers(0, total, 100)
        assert divergence.probabilities(c, total, 7).tolist() == [1 + 10**9 * (int(x) + 2) // (total + 14) for x in c]
