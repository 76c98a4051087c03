from __future__ import annotations

import re
import time
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from loomset.functions import text as X


def _one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c"))).first()[0]


def test_accents_and_folding_differ(spark):
    s = "ﬁ Ｆ ① é ñ Ǻ 가 के"
    assert _one(spark, s, X.strip_accents).startswith("ﬁ Ｆ ① e n A 가")
    assert _one(spark, s, X.fold).startswith("fi f 1 e n a")
    assert X.fold_text("É") == "e" and _one(spark, None, X.fold) is None and _one(spark, None, X.strip_accents) is None
    assert unicodedata.is_normalized("NFC", _one(spark, "각é", X.strip_accents))


def test_title_norm(spark):
    want = {
        "Foo (Deluxe Edition)": "foo", "Foo - Remastered 2009": "foo", "Liege & Lief": "liege and lief", "宇宙 日本 世田谷": "宇宙 日本 世田谷", "!!!": "", "Foo - deluxe版": "foo", "Foo: special": "foo",
        "Foo - deluxed": "foo  deluxed", "Foo - deluxe_x": "foo  deluxex", "Foo [Mono Version] bar": "foo bar", None: None, "": "",
    }
    for title, norm in want.items():
        assert _one(spark, title, X.title_norm) == norm, title
    assert _one(spark, "a & b", lambda c: X.title_norm(c, ampersand=False)) == "a  b"


def test_arrow_forms_equal_unicodedata_over_all_characters(spark):
    known = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) != "Cn"]
    texts = known + ["e\u0301\u0323 q\u0323\u0307", "각 \u1100\u1161\u11a8", "\u1112\u1175\u11c2x"] + [a + "\u0301" + b for a, b in zip(known[::97], known[1::97], strict=False)]
    bare = [unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c)[0] != "M")) for s in texts]
    assert X.bare_texts(pa.array([*texts, None])).to_pylist() == [*bare, None]
    folded = ["".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)) for s in texts]
    assert X.folded_texts(pa.array([*texts, None])).to_pylist() == [*folded, None]


EDITION = rf"[ \t\n\x0b\f\r]*[\(\[][^\)\]]*({X.EDITION_WORDS})[^\)\]]*[\)\]]"
SUFFIX = rf"[ \t\n\x0b\f\r]*[-–:][ \t\n\x0b\f\r]*({X.SUFFIX_WORDS})(?![A-Za-z0-9_])[^\n]*\Z"


def test_linear_passes_equal_the_patterns(spark):
    rng = np.random.default_rng(1)
    parts = ["(", "[", ")", "]", " ", "  ", "\n", "\t", "-", "–", ":", "deluxe", "remastered", "edition", "a", "special_", "é", "(live)", " - deluxe", "[bonus]"]
    texts = ["".join(parts[i] for i in rng.integers(0, len(parts), rng.integers(0, 14))) for _ in range(20_000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r) for r in df.select(X.without_editions(F.col("t")), X.without_suffix(F.col("t"))).collect()]
    assert got == [(re.sub(EDITION, "", t), re.sub(SUFFIX, "", t)) for t in texts]


@pytest.mark.parametrize("text", ["(" * 20_000, " " * 20_000 + "x", "(deluxe " * 20_000, "- " * 20_000, ("- deluxe " * 20_000) + "\nx", " -" * 20_000, "é" + ") " * 20_000, "- deluxe\n" * 20_000])
def test_long_titles_take_linear_time(spark, text):
    df = spark.createDataFrame([(text,)], "t string").select(X.title_norm(F.col("t")).alias("n"))
    df.collect()
    begin = time.perf_counter()
    df.collect()
    assert time.perf_counter() - begin < 1.5


def test_dedup_key(spark):
    rows = spark.createDataFrame([("???", "x", "1", "o"), ("a?", "a", "2", "o"), ("!!!", "", "3", "o")], "name string, norm string, id string, owner string")
    got = [r[0] for r in rows.select(X.dedup_key(F.col("name"), F.col("norm"), F.col("id"), F.col("owner"))).collect()]
    assert got == ["ID:1", "o|a", "ID:3"]


def test_mangled_names_are_repaired_only_if_proven(spark):
    rows = spark.createDataFrame([("? é", "宇 é"), ("x", "宇"), ("?", "😀"), ("a", "a"), ("?", None)], "name string, official string")
    assert [r[0] for r in rows.select(X.repaired(F.col("name"), F.col("official"))).collect()] == ["宇 é", "x", "😀", "a", "?"]


def test_ids_and_image_keys(spark):
    good = "A" * 22
    assert X.id_list(f" {good}, {good},bad,{'B' * 22}") == [good, "B" * 22] and len(X.id_list(",".join(f"{i:022d}" for i in range(90)))) == 60
    key = "0123456789abcdef01234567"
    assert _one(spark, f"https://i.example.com/image/ab67616d00001e02{key}", X.image_key) == key
    assert _one(spark, f"https://i.example.com/image/ab67616d00001e02{key}x", X.image_key) is None
    assert _one(spark, None, X.valid_id) is False and _one(spark, good, X.valid_id) is True
