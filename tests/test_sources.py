from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomset.operators.scratch import scratch
from loomset.plans import service
from loomset.sources import dump, params, sinks, tables
from loomset.streaming.upsert import upsert_stream

DUMP = r"""-- comment
LOCK TABLES `album` WRITE;
INSERT INTO `album` VALUES ('a1','It\'s \\ \n ok','u'),('a2',NULL,'u');
INSERT INTO `other` VALUES (1);
INSERT INTO `album` VALUES ('a3','two columns');
INSERT INTO `track` VALUES ('t1','n;m',12,'','x',NULL,'u','a1'),('t2','n',abc,1.5,'x',NULL,'u','a1'),('t3','n',3.0, 7 ,'x','','u','a1');
INSERT INTO `album` VALUES ('b1','dou''bled','u'),('b2','torn
INSERT INTO `album` VALUES ('a4','no terminator','u')"""


def test_tuples():
    got = list(dump.tuples(r"('a','It\'s \\ \n \q ok',NULL,12, x ),(1),('q''r',2),('torn"))
    assert got == [["a", "It's \\ \n q ok", None, "12", "x"], ["1"], ["q", "r", "2"]]
    assert list(dump.tuples("")) == [] and list(dump.tuples("('a\\")) == [] and list(dump.tuples("(1,2")) == []


def test_tuples_round_trip():
    rng = np.random.default_rng(0)
    for _ in range(200):
        rows = [[None if rng.random() < 0.2 else "".join(rng.choice(list("ab'\\\n\0,();é"), 6)) for _ in range(3)] for _ in range(3)]
        code = lambda x: "NULL" if x is None else "'" + x.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\0", "\\0") + "'"
        assert list(dump.tuples(",".join("(" + ",".join(map(code, r)) + ")" for r in rows))) == rows


def test_the_tokenizer_is_linear():
    import time

    row = "(123,'a name of some length','uri:x:0123456789',NULL,4.5)"
    took = []
    for n in (2_000, 20_000):
        text = ",".join([row] * n)
        begin = time.process_time()
        assert sum(1 for _ in dump.tuples(text)) == n
        took.append((time.process_time() - begin) / n)
    assert took[1] < 3 * took[0]


def test_dump(spark, tmp_path):
    path = tmp_path / "d.sql"
    path.write_bytes(DUMP.replace("ok'", "ok\xff'").encode("latin-1"))
    got, dropped = dump.read_dump(spark, str(path))
    album = {r["id"]: r["name"] for r in got["album"].collect()}
    assert album == {"a1": "It's \\ \n ok\ufffd", "a2": None}
    assert {r["id"]: (r["duration"], r["popularity"]) for r in got["track"].collect()} == {"t1": (12, None), "t2": (None, 1.5), "t3": (None, 7.0)}
    assert {r["name"]: r["n"] for r in dropped.collect()} == {"album": 1}
    path.write_text("INSERT INTO `album` VALUES ('c1','dou\'\'bled','u'),('c2','n','u'),('c3','torn;\n")
    got, dropped = dump.read_dump(spark, str(path), tables=["album"])
    assert [r["id"] for r in got["album"].collect()] == ["c2"] and dropped.first()["n"] == 1
    path.write_text(DUMP)
    assert dump.read_dump(spark, str(path), limit_bytes=200)[0]["track"].count() == 0
    # a whole statement equal to the torn tail stays
    same = "INSERT INTO `album` VALUES ('d1','n','u')"
    for text, n in ((f"{same};\n{same};\n{same}", 2), (same, 0), (f"{same};\n", 1), (f"{same};\n{same};\n{same};\n", 3)):
        path.write_text(text)
        assert dump.read_dump(spark, str(path), tables=["album"])[0]["album"].count() == n
    path.write_bytes(f"{same};\nINSERT INTO `album` VALUES ('d2','".encode() + b"\xff\xfe','u')")
    assert [r["id"] for r in dump.read_dump(spark, str(path), tables=["album"])[0]["album"].collect()] == ["d1"]
    path.write_text(f"{same};\n" * 5)
    assert dump.read_dump(spark, str(path), tables=["album"], limit_bytes=2 * len(same) + 8)[0]["album"].count() == 2


def test_table_choice():
    assert dump.chosen_tables() == tuple(dump.SCHEMAS) and dump.chosen_tables(preset="artist-lookup")[0] == "album"
    for how in ({"tables": ["x"]}, {"preset": "x"}, {"tables": ["album"], "preset": "all"}):
        with pytest.raises(ValueError):
            dump.chosen_tables(**how)


def test_params_are_read_again(tmp_path):
    path = tmp_path / "p.toml"
    file = params.ParamsFile(str(path))
    assert file.get().k == 5
    path.write_text("[weights]\nw_album = 0.5\nw_artist = 0.1\nw_pop = 0.4\nconsistencia = 0.2\ndup_penalty = 0.0\n[popularity]\npico = 12\nlargura = 2.0\n[retrieval]\ncandidatos_por_seed = 9\nresultados = 3\n")
    p = file.with_filters(min_pop=4)
    assert (p.k, p.n_candidates, p.w_album, p.w_consistency, p.pop_peak, p.min_pop) == (3, 9, 0.5, 0.2, 12, 4)
    path.unlink()
    assert file.get().k == 3


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(100).withColumn("name", F.concat(F.lit("n"), F.col("id").cast("string")))
    sinks.write_table(df.orderBy(F.col("id").desc()), path, order_by="id")
    sinks.rewrite_column(spark, path, "name", F.upper("name"), "id")
    assert [tuple(r) for r in sinks.read_table(spark, path).orderBy("id").limit(2).collect()] == [(0, "N0"), (1, "N1")]
    sinks.promote(spark, path, str(tmp_path / "served"))
    with pytest.raises(FileExistsError):
        sinks.promote(spark, path, str(tmp_path / "served"))
    sinks.promote(spark, path, str(tmp_path / "served"), confirm=True)
    sinks.write_history(spark, str(tmp_path / "h.json"), [{"epoch": 0}])
    assert (tmp_path / "h.json").read_text() == '[{"epoch": 0}]'
    assert tables.verify_file(str(tmp_path / "h.json"), 14, md5=hashlib.md5(b'[{"epoch": 0}]').hexdigest()) and not tables.verify_file(str(tmp_path / "h.json"), 13)


def test_a_crash_while_a_table_is_replaced_loses_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    sinks.replace_table(spark.range(3), path)
    good = sinks.write_text

    def crash(*_):
        raise RuntimeError("crash")

    monkeypatch.setattr(sinks, "write_text", crash)
    with pytest.raises(RuntimeError):
        sinks.replace_table(spark.range(5), path)
    assert sinks.read_table(spark, path).count() == 3
    monkeypatch.setattr(sinks, "write_text", good)
    sinks.replace_table(sinks.read_table(spark, path).union(spark.range(3, 5)), path)
    assert sinks.read_table(spark, path).count() == 5
    # a first version that was never pointed to is no table
    monkeypatch.setattr(sinks, "write_text", crash)
    with pytest.raises(RuntimeError):
        sinks.replace_table(spark.range(5), str(tmp_path / "u"))
    assert sinks.table_path(spark, str(tmp_path / "u")) is None


def test_a_text_is_moved_over_the_old_one(spark, tmp_path):
    path = str(tmp_path / "x.json")
    for text in ("one", "two"):
        sinks.write_text(spark, path, text)
        assert sinks.read_text(spark, path) == text
    assert sinks.read_text(spark, str(tmp_path / "none")) is None


@pytest.mark.parametrize("dtype", ["<f4", "<f8", ">f4", "<i2"])
def test_npy(spark, tmp_path, dtype):
    m = np.arange(3_000).reshape(1_000, 3).astype(dtype)
    np.save(tmp_path / "m.npy", m)
    np.save(tmp_path / "t.npy", np.asfortranarray(m))
    np.save(tmp_path / "none.npy", m[:0])
    for name, size in (("m", 1 << 20), ("m", 100), ("t", 100), ("none", 100)):
        got = tables.vectors_from_npy(spark, str(tmp_path / f"{name}.npy"), size)
        rows = got.orderBy("ix").collect()
        assert [r["ix"] for r in rows] == list(range(len(rows))) and [r["v"] for r in rows] == (m if name != "none" else m[:0]).tolist()
        if name == "m":
            parts = got.select(F.spark_partition_id().alias("p")).distinct().count()
            assert parts == 1 if size == 1 << 20 else parts > 1
    np.save(tmp_path / "flat.npy", m.ravel())
    with pytest.raises(Exception, match="no matrix"):
        tables.vectors_from_npy(spark, str(tmp_path / "flat.npy")).collect()


def test_an_upsert_rewrites_its_buckets_alone(spark, tmp_path, monkeypatch):
    from loomset.operators.cache import upserted

    path = str(tmp_path / "t")
    merged = lambda old, new: upserted(old, new, "id", "fetched_at")
    rows = lambda ids, v: spark.createDataFrame([(f"k{i}", v, 1) for i in ids], "id string, value string, fetched_at bigint")
    files = lambda: {p for p in (tmp_path / "t").rglob("*.parquet")}
    assert len(sinks.upsert_buckets(rows(range(500), "a"), path, "id", merged, buckets=32)) == 32
    before = files()
    hit = sinks.upsert_buckets(rows((7, 900), "b"), path, "id", merged)
    assert len(hit) <= 2 and len(files() - before) == len(hit) and len(before - files()) == len(hit)
    table = {r["id"]: r["value"] for r in sinks.read_table(spark, path).collect()}
    assert len(table) == 501 and table["k7"] == table["k900"] == "b" and table["k8"] == "a"
    assert sinks.upsert_buckets(rows((), "c"), path, "id", merged) == []

    def crash(*_):
        raise RuntimeError("crash")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(sinks, "write_text", crash)
        sinks.upsert_buckets(rows((8,), "d"), path, "id", merged)
    assert {r["id"]: r["value"] for r in sinks.read_table(spark, path).collect()} == table
    sinks.promote(spark, path, str(tmp_path / "served"))
    assert sinks.read_table(spark, str(tmp_path / "served")).count() == 501


def test_stream_upsert(spark, tmp_path):
    schema = "id string, value string, fetched_at bigint"
    for rows in ([("a", "1", 1), ("b", "2", 1)], [("a", "3", 2), ("b", "0", 0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = upsert_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
        q.awaitTermination(60)
    assert {tuple(r) for r in sinks.read_table(spark, str(tmp_path / "out")).collect()} == {("a", "3", 2), ("b", "2", 1)}


def test_service(spark, tmp_path):
    rng = np.random.default_rng(3)
    n = 30
    rel = spark.createDataFrame([(i, f"r{i}", f"Títle {i}", i % 5, f"Creator {i % 5}", 3, 12.345, 600 + i) for i in range(n)], "release_ix bigint, release_id string, release string, creator_ix bigint, creator string, n_tracks bigint, minutes double, pop int")
    cre = spark.createDataFrame([(i, f"c{i}", f"Creator {i}", 900 + i) for i in range(5)], "creator_ix bigint, creator_id string, creator string, pop int")
    vec = lambda k: spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(k)], "ix bigint, v array<double>")
    s = service.Service(rel, cre, vec(n), vec(5), params.ParamsFile(str(tmp_path / "none.toml")))
    hits = s.search(service.SearchRequest("TITLE 1", limit=3)).collect()
    assert [r["release_ix"] for r in hits] == [26, 21, 19] and hits[0]["minutes"] == 12.3
    assert s.search_creators(service.SearchRequest("creator")).count() == 5
    got = s.recommend(service.RecommendRequest((1, 2))).collect()
    assert len(got) == 5 and [r["place"] for r in got] == [1, 2, 3, 4, 5] and not {r["release_ix"] for r in got} & {1, 2}
    assert s.release_arithmetic(service.ArithmeticRequest(((1, "+"), (2, "-")))).count() == 1
    assert s.creator_arithmetic(service.ArithmeticRequest(((1, "+"), (2, "*")), min_pop=0)).count() == 1
    assert s.release(3).first()["release_id"] == "r3" and s.creator(2).first()["creator_id"] == "c2" and s.config()["k"] == 5
    for bad in (lambda: service.SearchRequest("x"), lambda: service.SearchRequest("xx", limit=101), lambda: service.RecommendRequest(()), lambda: s.recommend(service.RecommendRequest((99,))), lambda: s.release_arithmetic(service.ArithmeticRequest(((1, "+"), (1, "-"))))):
        with pytest.raises(service.BadRequest):
            bad()
    with pytest.raises(service.NotFound):
        s.release(n)
    with pytest.raises(ValueError, match="vectors"):
        service.Service(rel, cre, vec(n - 1), vec(5), s.params)


def test_scratch_is_fresh(spark):
    assert scratch(spark, "x") != scratch(spark, "x")
