"""The operators against brute force and on awkward rows: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from loomset.llm import chat, common, decontaminate, golay, licenses, mixing, pii, quality, simhash, token_ids, toxicity, url_filter
from loomset.llm.common import scratch_path, word_lists
from loomset.llm.queries import END_ID, HOSTILE, VOCABULARY, tokenizer_path

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row_key string, t string, __key string, block int, score string"


def frame(spark, rows):
    """Documents (doc_id, text, source), with columns that clash with names inside the operators."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y", "z", 1, "w") for i, t, s in rows], SCHEMA)


def words(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    long = words(rng, 30_000)
    base = words(rng, 80)
    return [
        (1, base, "a"), (2, base, "a"), (2, base, "a"), (3, base.replace(" ", "  ", 3).upper(), "b"), (4, None, "b"), (5, "", None), (6, "  \n\t", None),
        (7, long, "a"), (8, "one", "c"), (9, "one two", "c"), (None, words(rng, 60), "c"), (None, None, None), (10, "é è\x0bü \x1c 日本", "a"), (11, base + " extra", "a"),
        (12, "the cat sat on the mat. the cat sat on the mat.\nline\nline\n\n#$%", "b"),
    ]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def test_split_join_equals_a_join(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(int(k) if k else None, i) for i, k in enumerate([*([3] * 500), *([7] * 90), *rng.integers(0, 60, 300)])], "k bigint, i bigint")
    keyed = spark.createDataFrame([(k, f"v{k}") for k in (1, 2, 3, 5, 8, 13, 99)], "k bigint, v string")
    for how in ("inner", "left"):
        for hot in (50, 10_000):
            assert sorted(map(str, common.split_join(rows, keyed, "k", how, hot).collect())) == sorted(map(str, rows.join(keyed, "k", how).collect()))


def test_words_are_runs_without_ascii_space(rows):
    texts = [t or "" for _, t, _ in rows]
    assert word_lists(pa.array(texts)).to_pylist() == [re.findall(WORD, t) for t in texts]


# 1


def test_chat_round_trip(spark):
    texts = ["plain", HOSTILE, "back\\slash <\\| <| \\", "", None, "ends <", "| starts", "a\nb\\\nc"]
    turns = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)]
    turns += [(2, 0, "assistant", "first"), (2, 0, "assistant", "first"), (2, None, None, "lost"), (3, 0, "ro\nle <|im_end|>\\", "x"), (4, 5, "user", "q"), (4, 9, "assistant", "z" * 200_000), (None, 0, "user", "n")]
    df = spark.createDataFrame([(*r, "x", "y") for r in turns], "conv_id bigint, turn bigint, role string, text string, turns string, t string")
    made = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in made.select("*", chat.read_back(F.col("formatted")).alias("back"), chat.loss_text(F.col("segments")).alias("loss")).collect()}
    assert len(got) == 5
    for conv, r in got.items():
        want = sorted(((-1 if n is None else n, role or "", t or "") for c, n, role, t in turns if c == conv))
        assert [(b["role"], b["text"]) for b in r["back"]] == [w[1:] for w in want]
        assert r["loss"] == "".join(t for _, role, t in want if role == "assistant")
        assert r["formatted"] == "".join(s["text"] for s in r["segments"])
        assert r["formatted"].count("<|im_end|>\n") == len(want)
    assert got[1]["valid"] and got[4]["valid"] and not got[2]["valid"] and not got[3]["valid"]
    assert chat.format_conversations(df.limit(0)).count() == 0


# 2


def brute_spans(t):
    luhn = lambda d: sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(kinds) for m in re.finditer(p, t) if ok(m[0]))


def test_personal_data_base_spans(spark):
    texts = [
        None, "", "a@b.c_d@e.f and x@y", "a.b+c@d-e.co.uk@f.g", "1.2.3.4.5 256.1.1.1 0001.002.3.4 1.2.3.999999999999", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (017) 555-7713 +12 +1234567890123456",
        "é😀 a@b.cc 日本 10.0.0.1", "@@@ .@. +1+2+3", "4" * 3000, "x" * 60_000 + "@", "a." * 30_000 + "a@b.c", "1.2" * 5000, "5555555555554444x@y.zz", "0" * 14, "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
    ]
    rng = np.random.default_rng(3)
    texts += ["".join(rng.choice(list("019.@+- (a_é"), 60)) for _ in range(300)]
    got = {r["doc_id"]: r for r in pii.personal_data(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        base = [tuple(s) for s in got[i]["base"]]
        assert base == brute_spans(t or ""), t
        assert set(base) <= {tuple(s) for s in got[i]["spans"]}


def test_contexts_find_unseen_identifiers(spark, none):
    rng = np.random.default_rng(8)
    rows = [(i, f"{words(rng, 5)} contact ref user{i}@mail.example.com today {words(rng, 5)}", "s") for i in range(12)]
    rows += [(100, f"{words(rng, 4)} contact ref AB-99817-X today and so on", "s"), (101, f"about 12345 {words(rng, 6)}", "s"), (102, "contact ref\u00a0", "s")]
    got = {r["doc_id"]: r for r in pii.personal_data(frame(spark, [(i, t.replace("user", "user10"), s) for i, t, s in rows])).collect()}
    new = [s for s in got[100]["spans"] if s["kind"] == 4]
    assert [rows[12][1][s["start"] : s["end"]] for s in new] == ["AB-99817-X"]
    assert not got[101]["spans"]
    assert pii.personal_data(none).count() == 0


def test_recall_of_planted_identifiers_in_several_contexts(spark):
    rng = np.random.default_rng(18)
    contexts = ["contact ref {} today", "my account number {} was", "call\tme\non {}, please", "user {} logged in", "<id>: {} </id>"]
    bases = [lambda i: f"jo.hn{i}@mail.example.com", lambda i: f"+1 (017) 555-77{10 + i}", lambda i: f"10.0.{i}.7", lambda i: "john.doe@example.org"]
    unseen = [lambda i: f"AB-{i}817-X", lambda i: f"user_{i}", lambda i: f"\"k{i}zz9\"", lambda i: f"{i}{'x' * 120}"]
    rows, want = [], {}
    for c, context in enumerate(contexts):
        for i in range(16):
            rows.append(f"{words(rng, 5)} {context.format(bases[i % 4](i + 20 * c))} {words(rng, 5)}")
        for i in range(4):
            own = unseen[i](i + 30 + 7 * c)
            rows.append(f"{words(rng, 5)} {context.format(own)} {words(rng, 3)}")
            want[len(rows) - 1] = own.strip('"')
    first = len(rows)
    rows += [f"{words(rng, 6)} {int(rng.integers(10, 10**9))} {words(rng, 6)} v{i}.2 {words(rng, 2)}" for i in range(200)]
    got = {r["doc_id"]: r for r in pii.personal_data(frame(spark, [(i, t, "s") for i, t in enumerate(rows)])).collect()}
    added = {i: [rows[i][s["start"] : s["end"]] for s in got[i]["spans"] if s["kind"] == 4] for i in got}
    assert np.mean([own in added[i] for i, own in want.items()]) >= 0.9
    assert not any(added[i] for i in range(first, len(rows)))
    for i in range(first):
        assert {tuple(s) for s in got[i]["base"]} == set(brute_spans(rows[i]))


def test_an_identifier_beside_another_keeps_its_context(spark):
    rng = np.random.default_rng(19)
    rows = [f"{words(rng, 4)} order 1234 by user{i}@mail.example.com now {words(rng, 4)}" for i in range(12)] + [f"{words(rng, 4)} order 1234 by agent-77q now {words(rng, 4)}"]
    got = {r["doc_id"]: r for r in pii.personal_data(frame(spark, [(i, t, "s") for i, t in enumerate(rows)])).collect()}
    assert "agent-77q" in [rows[12][s["start"] : s["end"]] for s in got[12]["spans"] if s["kind"] == 4]


def test_a_text_of_very_many_matches(spark):
    text = " ".join(f"x{i}.y 1.2.3.{i % 256}" for i in range(6_000))
    got = pii.personal_data(frame(spark, [(1, text, "s")])).first()
    assert [tuple(s) for s in got["base"]] == brute_spans(text)


# 3


def brute_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = []
    for verdict, rule in url_filter.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    return host, path, *(max(fits)[1:] if fits else (None, "allow"))


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "http://ORG", "https://org/", "https://a.org/x?y", "http://example.org/en/1", "http://www.example.org/en/19#f", "http://example.org/en/2", "http://xexample.org/es/", "http://x.example.org/es/q", "ftp://a.com/fr/", "a://b.com/de/z://c", "http://com/de/", "http://É.ORG/É", "http://a.org?x/", "http://a.org#/", "x://" + "a." * 3000 + "org/" + "p" * 9000]
    df = spark.createDataFrame([(i, u, "k", "h") for i, u in enumerate(urls)] + [(0, None, "k", "h")], "page_id bigint, url string, keys string, host string")
    got = url_filter.judge_urls(df, url_filter.rules_frame(spark)).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        assert tuple(r)[1:] == brute_rule(urls[r["page_id"]])
    assert url_filter.judge_urls(df.limit(0), url_filter.rules_frame(spark)).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(df, url_filter.rules_frame(spark).limit(0)).collect()} == {"allow"}


def test_rules_beyond_one_cascade(spark):
    rng = np.random.default_rng(7)
    hosts = [f"h{i}.example" for i in range(60)]
    rules = [("block" if i % 3 else "allow", f"{h}/{'p/' * (i % 2)}") for i, h in enumerate(hosts)]
    urls = [f"http://{'www.' * int(rng.integers(0, 2))}{hosts[int(rng.integers(0, 60))]}/{'p/' * int(rng.integers(0, 2))}q" for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    frame_ = url_filter.rules_frame(spark, rules)
    one, many = ({tuple(r) for r in url_filter.judge_urls(df, frame_, max_keys=n).collect()} for n in (1000, 13))
    assert one == many and {r[4] for r in one} == {"allow", "block"} and {r[3] for r in one} > {None}


@pytest.mark.parametrize("hashes", [3, 40])
def test_keys_of_one_hash_are_told_apart(spark, monkeypatch, hashes):
    rng = np.random.default_rng(8)
    hosts = [f"h{i}.example" for i in range(30)]
    frame_ = url_filter.rules_frame(spark, [("block" if i % 3 else "allow", f"{h}/{'p/' * (i % 2)}") for i, h in enumerate(hosts[:20])])
    urls = [f"http://{'www.' * int(rng.integers(0, 2))}{hosts[int(rng.integers(0, 30))]}/{'p/' * int(rng.integers(0, 2))}q" for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    want = {tuple(r) for r in url_filter.judge_urls(df, frame_).collect()}
    monkeypatch.setattr(url_filter, "key_hash", lambda key: F.pmod(F.xxhash64(key), F.lit(hashes)))
    for n in (1000, 7):
        assert {tuple(r) for r in url_filter.judge_urls(df, frame_, max_keys=n).collect()} == want
    monkeypatch.setattr(url_filter, "MAX_CLASHES", 2)
    with pytest.raises(ValueError, match="share a hash"):
        url_filter.judge_urls(df, frame_)


def test_cascade_is_exact_over_its_universe(spark):
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(-(1 << 62), 1 << 62, 30_000))
    listed = rng.random(len(keys)) < 0.02
    cascade = url_filter.build_cascade(spark.createDataFrame([(int(h), bool(x)) for h, x in zip(keys, listed, strict=True)], "h bigint, listed boolean"))
    assert len(cascade.levels) > 1
    assert (cascade.contains(keys) == listed).all()


# 4


def test_quality_features_and_hosts(spark, rows, none):
    docs = frame(spark, rows)
    got = Counter(tuple(r)[:8] for r in quality.quality_verdicts(docs).drop("host_rate", "kept").collect())
    want = Counter()
    for i, t, s in rows:
        t = t or ""
        w = re.findall(WORD, t)
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = Counter(windows)
        covered = {k + j for k, x in enumerate(windows) if n[x] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(WORD, x)]
        want[(i, s, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))] += 1
    assert got == want
    assert quality.quality_verdicts(none).count() == 0


def test_host_rates_shrink(spark):
    rows = spark.createDataFrame([("bad", True)] * 90 + [("bad", False)] * 10 + [("one", True)] + [("good", False)] * 200 + [(None, False)] * 50, "host string, failed boolean")
    got = {r["host"]: r for r in quality.host_verdicts(rows, "host", "failed").collect()}
    assert got["bad"]["rejected"] and not got["good"]["rejected"] and not got[None]["rejected"]
    assert 91 / 351 < got["one"]["rate"] < 1 and got["good"]["rate"] > 0


# 5


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(0)
    v, n = 60, 1500
    share = 1 / np.arange(1, v + 1)
    draw = lambda: np.sort(rng.choice(v, rng.integers(0, 8), replace=False, p=share / share.sum())).astype(np.uint64) + np.uint64(5)
    own = [draw() for _ in range(n)]
    sizes = np.array([len(x) for x in own])
    index = toxicity.build(np.arange(n), rng.integers(0, 2, n).astype(float), np.ones(n), np.concatenate(own), rng.integers(1, 4, sizes.sum()), sizes)
    assert index.first[-1] == len(index.cell_block) < len(index.example) == sizes.sum()
    dense = np.zeros((n, len(index.codes)))
    for t in range(len(index.codes)):
        for c in range(index.first[t], index.first[t + 1]):
            at = slice(index.cell_begin[c], index.cell_begin[c + 1])
            dense[index.example[at], t] = index.weight[at]
            assert index.cell_max[c] == index.weight[at].max() and set(index.example[at] // toxicity.BLOCK) == {index.cell_block[c]}
    assert np.allclose(np.linalg.norm(dense, axis=1), (sizes > 0)[index.ids])
    queries = [draw() for _ in range(200)]
    ends = np.cumsum([len(q) for q in queries])
    doc, term, w = index.vectors(np.concatenate(queries), ends)
    examples, cosines = index.nearest(doc, term, w, 200)
    for i in range(200):
        q = np.zeros(len(index.codes))
        q[term[doc == i]] = w[doc == i]
        score = np.round(dense @ q, 9)
        want = np.lexsort((np.arange(n), -score))[: index.neighbours]
        want = want[score[want] > 0]
        assert examples[i][: len(want)].tolist() == want.tolist() and (examples[i][len(want) :] == -1).all()
        assert np.allclose(cosines[i][: len(want)], score[want], atol=2e-9)


def test_blocks_below_the_bound_are_not_read(monkeypatch):
    # each block of examples has a term of its own, so a document with that term needs its block alone
    n = 20 * toxicity.BLOCK
    index = toxicity.build(np.arange(n), np.zeros(n), np.ones(n), np.arange(n, dtype=np.uint64) // np.uint64(toxicity.BLOCK), np.ones(n, np.int64), np.ones(n, np.int64))
    read = []
    scores_of = toxicity.Index._scores
    monkeypatch.setattr(toxicity.Index, "_scores", lambda self, at, cell, own, use: read.append(int(use.sum())) or scores_of(self, at, cell, own, use))
    examples, cosines = index.nearest(*index.vectors(np.array([3], np.uint64), np.array([1])), 1)
    assert sum(read) <= toxicity.FIRST_BLOCKS and examples[0].tolist() == list(range(3 * toxicity.BLOCK, 3 * toxicity.BLOCK + index.neighbours)) and np.allclose(cosines, 1)


def test_toxicity_scores(spark, docs, none):
    rng = np.random.default_rng(2)
    made = [(i, words(rng, 30) + (" you absolute grobnik, vexmar" if i % 5 == 0 else ""), "s") for i in range(400)]
    texts = frame(spark, made)
    labels = spark.createDataFrame([(i, int(i % 5 == 0), "q") for i in range(400)] + [(None, 1, "q"), (7, None, "q"), (9_999, 1, "q")], "doc_id bigint, toxic int, t string")
    index = toxicity.fit(texts, labels)
    weights = dict(zip(index.codes.tolist(), index.scale.tolist(), strict=True))
    assert max(weights, key=weights.get) in {xxhash.xxh64_intdigest(w) for w in ("grobnik", "vexmar", "you", "absolute")}
    # no term is left out
    assert len(index.codes) == len({w.strip(",") for i, t, _ in made for w in t.split() if zlib.crc32(str(i).encode()) % 4 != 2})
    got = toxicity.toxicity_scores(texts, index).collect()
    assert all(r["toxic_predicted"] == int(r["doc_id"] % 5 == 0) and 0 <= r["toxic_score"] <= 1 for r in got)
    odd = toxicity.toxicity_scores(docs.withColumn("Toxic_Score", F.lit(1)), index)
    assert odd.count() == docs.count() and odd.select("Toxic_Score").first()[0] == 1 and "_toxic_score" in odd.columns
    assert {r["_toxic_score"] for r in odd.where("trim(coalesce(text, '')) = ''").collect()} == {index.prior}
    kept = toxicity.toxicity_scores(texts, index, keep=True)
    assert kept.columns == texts.columns and {r["doc_id"] for r in kept.collect()} == {i for i in range(400) if i % 5}
    assert toxicity.toxicity_scores(none, index).count() == 0
    blank = toxicity.fit(none, labels.limit(0))
    assert {r["toxic_score"] for r in toxicity.toxicity_scores(docs, blank).collect()} == {0.0}


def test_held_out_rows_are_never_examples(spark):
    rng = np.random.default_rng(2)
    texts = frame(spark, [(i, words(rng, 10) + " grobnik", "s") for i in range(300)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id bigint, toxic int")
    index = toxicity.fit(texts, labels)
    assert len(index.ids) > 150 and not any(zlib.crc32(str(i).encode()) % 4 == 2 for i in index.ids.tolist())


def test_texts_of_one_id_are_examples_of_their_own_at_any_size(spark):
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id bigint, toxic int")
    for n in (2, 400):
        texts = frame(spark, [(1, "alpha " * 3, "s"), (1, " ".join(f"t{i}" for i in range(n)), "s"), (1, "alpha " * 3, "s"), (3, "beta gamma", "s")])
        index = toxicity.fit(texts, labels)
        assert sorted(index.ids.tolist()) == [1, 1, 3] and len(index.codes) == n + 3
        assert sorted(index.weights.tolist()) == [0.5, 0.5, 1.0]
    few = toxicity.fit(texts, labels, terms_per_class=10)
    assert sorted(few.ids.tolist()) == [1, 3]  # the long text is left out by itself


# 6


def test_leaks_with_substitutions(spark, docs, none):
    rng = np.random.default_rng(4)
    items = [(1, words(rng, 40)), (2, words(rng, 16)), (3, words(rng, 5)), (4, None), (5, ""), (1, words(rng, 20))]
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id bigint, text string, tokens string")

    def changed(text, step):
        return " ".join("zzz" if i % step == step - 1 else w for i, w in enumerate(text.split()))

    cases = [
        (1, words(rng, 200) + " " + items[0][1] + " " + words(rng, 50), {1}), (2, changed(items[0][1], 6) + " tail", {1}), (3, items[1][1].upper() + "!", {2}),
        (4, words(rng, 8) + " " + items[2][1] + " x", {3}), (5, " ".join(items[0][1].split()[:8]) + " " + words(rng, 100), set()), (6, words(rng, 3000), set()), (7, None, set()), (8, "", set()),
        (9, "(" + items[5][1].replace(" ", ", ") + ")", {1}), (10, " ".join(items[0][1].split()[10:26]), {1}), (11, items[1][1] + " mid " + items[2][1], {2, 3}), (None, items[1][1], {2}),
    ]
    frame_ = frame(spark, [(i, t, "s") for i, t, _ in cases] + [(3, cases[2][1], "s")])
    got = {}
    for r in decontaminate.benchmark_leaks(frame_, bench).collect():
        got.setdefault(r["doc_id"], []).append(r["item_id"])
    assert {k: sorted(v) for k, v in got.items()} == {i: sorted(want) for i, _, want in cases if want}
    left = decontaminate.drop_leaks(frame_, bench)
    assert left.columns == frame_.columns and sorted(r["doc_id"] for r in left.collect()) == [5, 6, 7, 8]
    assert decontaminate.benchmark_leaks(none, bench).count() == 0
    assert decontaminate.benchmark_leaks(docs, bench.limit(0)).count() == 0


def test_leaks_of_all_lengths_and_allowed_substitutions_are_found(spark):
    rng = np.random.default_rng(21)
    items, docs, share = [], [], {}
    for n in (9, 10, 11, 13, 16, 20, 40):
        for k in range(n // 5 + 1):
            for _ in range(25):
                own = words(rng, n).split()
                items.append((len(items), " ".join(own)))
                for i in rng.choice(n, k, replace=False):
                    own[i] = "zzz"
                docs.append((len(docs), f"{words(rng, 12)} {' '.join(own)} {words(rng, 12)}"))
                share[len(docs) - 1] = (n, k)
    found = decontaminate.benchmark_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    good = {r["doc_id"] for r in found if r["doc_id"] == r["item_id"] and r["overlap"] >= share[r["doc_id"]][0]}
    recall = {nk: np.mean([i in good for i in share if share[i] == nk]) for nk in set(share.values())}
    assert min(recall.values()) >= 0.9 and np.mean(list(recall.values())) > 0.99, recall
    # and nothing else is: brute force over all stretches of all pairs
    hashes = lambda t: decontaminate.tokens(pa.array([t]))[0].view(np.int64)
    other = {(r["doc_id"], r["item_id"]) for r in found if r["doc_id"] != r["item_id"]}
    for d, i in other:
        own, item = hashes(docs[d][1]), hashes(items[i][1])
        assert max(decontaminate.best_overlap(own, item, k)[1] for k in range(-len(item), len(own))) >= min(13, len(item))


def test_repetitive_texts_and_items_meet_in_one_row(spark):
    item = "na " * 150
    docs = spark.createDataFrame([(1, "na " * 5_000), (2, "batman " + "na " * 12), (3, "na nu " * 400), (4, "na " * 6)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, item), (2, "na nu " * 30)], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): (r["overlap"], r["matched"]) for r in decontaminate.benchmark_leaks(docs, bench).collect()}
    assert got == {(1, 1): (150, 150), (2, 1): (13, 12), (3, 2): (60, 60)}


def test_a_stretch_is_the_best_overlap():
    item = np.arange(1, 31)
    own = np.concatenate([np.full(7, 99), item, np.full(4, 98)])
    own[12] = 0
    assert decontaminate.best_overlap(own, item, 7) == (7, 30, 29)
    assert decontaminate.best_overlap(own, item, 200)[1] == 0


def test_a_stretch_bears_a_fifth_of_substitutions_anywhere(spark):
    rng = np.random.default_rng(12)
    for n, k in [(13, 1), (13, 2), (20, 4), (25, 5), (40, 8)]:
        for _ in range(30):
            item = rng.integers(1, 1 << 60, n)
            own = np.concatenate([rng.integers(1, 1 << 60, 30), item, rng.integers(1, 1 << 60, 30)])
            own[30 + rng.choice(n, k, replace=False)] = 0
            assert decontaminate.best_overlap(own, item, 30) == (30, n, n - k)
            own[30 + rng.choice(n, n // 2, replace=False)] = 0
            same = own[30 : 30 + n] == item
            brute = max((j - i for i in range(n) for j in range(i + 1, n + 1) if 5 * same[i:j].sum() >= 4 * (j - i)), default=0)
            assert decontaminate.best_overlap(own, item, 30)[1] == brute
    item = words(rng, 27).split()
    own = item[:12] + ["zzz"] * 3 + item[15:]
    docs = spark.createDataFrame([(1, " ".join(own)), (2, " ".join(item[:10] + ["zzz"] * 17)), (3, "b c d e f g yyy")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "b c d e f g h")], "item_id bigint, text string")
    assert [tuple(r)[2:] for r in decontaminate.benchmark_leaks(docs, bench).where("doc_id = 1").collect()] == [(1, 0, 27, 24)]
    assert decontaminate.benchmark_leaks(docs, bench).where("doc_id > 1").count() == 0


# 7


def test_license_scan(spark, none):
    rng = np.random.default_rng(6)
    mit = "Copyright (c) 2020 The Authors\n\n" + licenses.TEMPLATES["MIT"][3]
    files = [
        ("p/LICENSE", mit), ("p/a.py", words(rng, 20)), ("p/q/b.py", "Licensed under CC BY-NC 4.0.\n" + words(rng, 20)), ("p/q/r/c.py", words(rng, 5)), ("z/x.py", words(rng, 5)), ("p/q/COPYING.txt", "x\n\nReleased under the MIT License.\n"),
        (None, "Released under the MIT License."), ("top.py", None), ("p/q/b2.py", "licensed under license licence"), ("p/long.py", words(rng, 20_000) + "\nThis work is licensed under the GNU General Public License, version 3.\n" + words(rng, 900)),
        ("p/gpl2.py", "This work is licensed under the GNU General Public License, version 2."),
    ]
    df = spark.createDataFrame([(i, p, t, "x") for i, (p, t) in enumerate(files)], "doc_id bigint, path string, text string, license string")
    got = {r["id"]: (r["license"], r["origin"], r["origin_dir"]) for r in licenses.scan_licenses(df).collect()}
    assert got[0] == ("MIT", "own", "p") and got[1] == ("MIT", "inherited", "p") and got[2] == ("CC-BY-NC-4.0", "own", "p/q")
    assert got[3] == ("MIT", "inherited", "p/q") and got[4] == (None, None, None) and got[6] == ("MIT", "own", None) and got[7][0] is None
    assert got[8] == ("MIT", "inherited", "p/q") and got[9][:2] == ("GPL-3.0", "own") and got[10][:2] == ("GPL-2.0", "own")
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_notices_inside_lines_and_full_texts_are_found(spark):
    rng = np.random.default_rng(9)
    full = {n: max(t, key=len) for n, t in licenses.TEMPLATES.items()}
    inside = [(n, f"{words(rng, 40)} {t} {words(rng, 30)}") for n, texts in licenses.TEMPLATES.items() for t in texts if len(t.split()) >= 5]
    others = [("MIT", "# SPDX-License-Identifier: MIT"), ("GPL-2.0", words(rng, 9) + "\n// SPDX-License-Identifier: GPL-2.0-or-later\n"), (None, "SPDX-License-Identifier: Unknown-1"), (None, "the license is granted to any person under the terms and conditions of the agreement " * 4)]
    cases = [*((n, f"Copyright 2021 someone else\n\n{t}\n") for n, t in full.items()), *inside, *others]
    df = spark.createDataFrame([(i, None, t) for i, (_, t) in enumerate(cases)], "doc_id bigint, path string, text string")
    got = {r["id"]: (r["license"], r["cosine"]) for r in licenses.scan_licenses(df).collect()}
    assert [(cases[i][0], got[i]) for i in got if got[i][0] != cases[i][0]] == []
    # no stretch of a template's length that reaches the cosine lies outside the runs that windows() looks at
    t = licenses.Templates()
    for _, text in cases[len(full) : len(full) + 12]:
        w = licenses._plain(text)
        seen = t.windows(w)
        for n in sorted(set(t.lengths)):
            for a in range(len(w) - n):
                if t.best(w[a : a + n])[1]:
                    assert any(b < a + n and e > a for b, e in seen)


def test_the_bound_loses_no_template_match():
    t = licenses.Templates()
    for texts in licenses.TEMPLATES.values():
        for text in texts:
            w = [x.strip(licenses._TRIM) for x in text.lower().split()]
            rng = np.random.default_rng(len(w))
            for _ in range(50):
                part = [x for x in w if rng.random() > 0.15] + ["other"] * int(rng.integers(0, 3))
                if t.best(part)[1]:
                    assert t.may_match(part)


# 8


@pytest.mark.parametrize("width", [1, 5, 16, 17, 31, 32])
def test_pack_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1000).astype(np.uint32)
    assert (token_ids.unpack(token_ids.pack(ids, width), 1000, width) == ids).all()
    assert len(token_ids.pack(ids[:64], width)) == 8 * width


def test_token_files_read_back(spark, docs, rows, none):
    import tokenizers

    plain = tokenizers.Tokenizer.from_file(tokenizer_path())
    extra = [(20, "Don't we're I'LL a<|endoftext|>b", "s"), (21, "ΣΟΦΟΣ İstanbul ı ſ Ǆ ß ẞ 10.5, 3rd ½ Å \u0301x", "s"), (22, "word\u00a0word\u2003x\u0085y", "s")]
    every = rows + extra
    out = scratch_path(spark, "t")
    manifest = token_ids.write_token_ids(frame(spark, every), out, tokenizer_path(), VOCABULARY, END_ID, partitions=3, shard_ids=500)
    got = sorted(token_ids.read_token_ids(spark, out).collect(), key=lambda r: r["start"])
    want = sorted(((i is not None, i or 0), plain.encode(t or "", add_special_tokens=False).ids + [END_ID]) for i, t, _ in every)
    assert [r["doc_id"] for r in got] == [k[1] if k[0] else None for k, _ in want]
    assert sorted((r["doc_id"] or -1, r["ids"]) for r in got) == sorted((k[1] or -1, ids) for k, ids in want)
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    assert manifest.count() >= 3
    first = manifest.orderBy("start").first()
    shard = token_ids.Shard(first["file"])
    assert shard.document(1).tolist() == got[1]["ids"] and shard.ids(2, 9).tolist() == [x for r in got for x in r["ids"]][2:9]
    assert token_ids.write_token_ids(none, scratch_path(spark, "t"), tokenizer_path(), VOCABULARY, END_ID).count() == 0


def test_encoder_equals_the_library_whatever_the_memo_and_tokenizer():
    import public_tokenizers
    import pyarrow as pa

    texts = ["", " \t", "Foo, foo.%%% FOO&&& (foo) 'Tis we'll x1y2 3,5$ É\u0301a Straße. <|endoftext|>,", "É'S İstanbul ΣΑΣ ǅ a\u0301 12a3!!foo(bar) \u200b it's", *(f"w{'ab' * (i % 7)}{chr(97 + i % 26)}{'.' * (i % 3)}" for i in range(300))]
    for name, by_word in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        own = token_ids.Encoder(public_tokenizers.path(name), memo_bytes=2_000)
        assert own.by_word == by_word
        for a in range(0, len(texts), 50):
            part = texts[a : a + 50]
            ids, ends = own.encode(pa.array(part), END_ID)
            want = [e.ids + [END_ID] for e in own.tokenizer.encode_batch(part, add_special_tokens=False)]
            assert ids.tolist() == [x for w in want for x in w] and ends.tolist() == np.cumsum([len(w) for w in want]).tolist()


# 9


def brute_print(t):
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(prints):
    label = {p: p for p in prints}

    def find(p):
        while label[p] != p:
            p = label[p]
        return p

    own = sorted(label)
    for i, a in enumerate(own):
        for b in own[:i]:
            if (a ^ b).bit_count() <= 3:
                label[find(a)] = find(b)
    return {p: find(p) for p in own}


def test_near_duplicates(spark, docs, rows, none):
    prints = [brute_print(t) for _, t, _ in rows]
    label = brute_classes(prints)
    least = {}
    for (i, _, _), p in zip(rows, prints, strict=True):
        if i is not None:
            least[label[p]] = min(i, least.get(label[p], i))
    want = Counter((i, f"{p:016x}", least.get(label[p])) for (i, _, _), p in zip(rows, prints, strict=True))
    assert Counter(tuple(r) for r in simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()) == want
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(label.values()))
    assert {r["doc_id"] for r in kept.collect() if r["doc_id"] is not None} == set(least.values())


def test_golay_keys_meet_within_distance():
    rng = np.random.default_rng(0)
    w = rng.integers(0, 1 << 23, 3000)
    table = golay._tables()[0]
    assert (golay._remainder(w ^ table[golay._remainder(w)]) == 0).all() and max(int(x).bit_count() for x in table) == 3
    row, index = golay.decode_near(w)
    near = {}
    for r, k in zip(row.tolist(), index.tolist()):
        near.setdefault(r, set()).add(k)
    for bit in range(23):
        assert all(int(k) in near[i] for i, k in enumerate(golay.decode(w ^ (1 << bit))))


def test_links_within_three_bits_are_all_found(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    made = set(base.tolist())
    for p in base.tolist():
        for n in (1, 2, 3, 3, 3, 4):
            made.add(p ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False)))
    signed = np.array(sorted(made), np.uint64).view(np.int64).tolist()
    got = {(r["u"], r["v"]) for r in simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp bigint")).collect()}
    want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert got == want and len(want) > 200


# 10


def test_links_send_no_keys_through_the_driver(spark):
    prints = spark.range(1000).select(F.xxhash64("id").alias("fp"))
    plan = simhash.fingerprint_links(prints)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_permutation_is_one_to_one():
    for n in (1, 2, 3, 17, 64, 1000, 4097):
        x = mixing.permuted(np.arange(n), n, -77)
        assert sorted(x.tolist()) == list(range(n)) and (mixing.permuted(x, n, -77, back=True) == np.arange(n)).all()


@pytest.mark.parametrize(("size", "target"), [(1, 3.0), (10, 0.0), (256, 256.0), (257, 300.4), (1000, 2999.6), (1000, 3000.0), (5000, 4871.0), (513, 512.0)])
def test_source_plan_takes_its_target(size, target):
    blocks, slots, last = mixing.source_plan(size, target, 256, 5)
    held = [256] * (blocks - 1) + [size - 256 * (blocks - 1)]
    order = [held[i] for i in mixing.permuted(np.arange(slots) % blocks, blocks, 5)]
    assert sum(order[:-1]) + last == round(target) if slots else round(target) == 0
    assert not slots or 0 < last <= order[-1]


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest, w = total - sum(3 * sizes[s] for s in full), sum(weight[s] for s in names if s not in full)
        new = {s for s in names if s not in full and rest * weight[s] / w > 3 * sizes[s]}
        if not new:
            return {s: 3.0 * sizes[s] if s in full else rest * weight[s] / w for s in names}
        full |= new


def test_shard_counts_are_multinomial_and_sum_to_the_slots():
    slots = np.array([50_000, 20_000, 0, 1, 30_000])
    drawn = np.array(list(mixing.shard_counts(slots, 1_000, 3)))
    assert (drawn.sum(0) == slots).all() and set(drawn.sum(1)) <= {100, 101}
    # but for the last shards, the spread of a shard's counts is that of a multinomial draw
    share = slots / slots.sum()
    assert np.allclose(drawn[:500, [0, 1, 4]].mean(0), 100 * share[[0, 1, 4]], atol=1.5)
    assert np.allclose(drawn[:500, [0, 1, 4]].var(0), (100 * share * (1 - share))[[0, 1, 4]], rtol=0.3)
    assert not list(mixing.shard_counts(np.zeros(3, np.int64), 2, 1))[0].any()


def test_mixture_meets_its_targets(spark, docs, rows, none):
    rng = np.random.default_rng(12)
    made = [(i, words(rng, int(rng.integers(0, 400))), f"s{int(rng.integers(0, 6)) if i % 3 else 0}") for i in range(300)]
    made += [(400, words(rng, 7), "tiny"), (401, None, "empty"), (402, words(rng, 50), None), (402, words(rng, 50), None), (403, words(rng, 6000), "s1"), (404, "a b", "é")]
    for given in (made, rows):
        df = frame(spark, given)
        got = [tuple(r) for r in mixing.taken_words(df, block=32, shard_slots=16).select("doc_id", "size", "source_size", "target", "taken").collect()]
        assert Counter((g[0], g[1]) for g in got) == Counter((i, len(re.findall(WORD, t or ""))) for i, t, _ in given)
        assert all(0 <= g[4] <= 3 * g[1] for g in got)
        sizes = Counter()
        for _, t, s in given:
            sizes[s] += len(re.findall(WORD, t or ""))
        want = brute_targets(sizes)
        assert sorted({(g[2], round(g[3], 6)) for g in got}) == sorted({(sizes[s], round(x, 6)) for s, x in want.items()})
        assert abs(sum(g[4] for g in got) - sum(sizes.values())) <= len(sizes)
        assert sorted(got, key=str) == sorted((tuple(r) for r in mixing.taken_words(df.repartition(3), block=32, shard_slots=16).select("doc_id", "size", "source_size", "target", "taken").collect()), key=str)
    placed, slots, _ = mixing.mixture(frame(spark, made), block=32, shard_slots=16)
    placed, slots = placed.collect(), slots.collect()
    # shards are of one size, and each word is taken as often as its block's slots say
    by_shard = Counter(r["shard"] for r in slots)
    assert len({(r["source"], r["slot"]) for r in slots}) == len(slots) and max(by_shard.values()) - min(by_shard.values()) <= 1
    assert len(by_shard) == min(len(slots), max(mixing.LEAST_SHARDS, -(-len(slots) // 16)))
    of_word = Counter()
    for r in slots:
        for i in range(32 if r["words"] is None else r["words"]):
            of_word[r["source"], r["block"] * 32 + i] += 1
    brute = Counter((r["doc_id"], r["size"], sum(of_word[r["source"], r["first"] + i] for i in range(r["size"]))) for r in placed)
    assert brute == Counter((r["doc_id"], r["size"], r["taken"]) for r in mixing.taken_words(frame(spark, made), block=32, shard_slots=16).collect())
    copies = mixing.mixed_documents(docs)
    assert copies.columns == docs.columns and copies.groupBy("doc_id", "text").count().agg(F.max("count")).first()[0] <= 6
    assert mixing.taken_words(none).count() == 0


