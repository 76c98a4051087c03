"""Queries take all rows of their tables, where the small tables cannot show it."""

from __future__ import annotations

import duckdb
from compare import assert_same

from loomset.plans import registry


def test_every_draw_finds_its_item(spark):
    got = registry.QUERIES["neg_sampling_lookup"](spark, "/root/testdata/sf0.1").collect()
    assert sorted(r["draw"] for r in got) == list(range(64)) and max(r["item"] for r in got) > 2000


def test_final_evaluation_takes_every_probe(spark, tmp_path):
    tables = {
        "part": spark.range(20).selectExpr("id AS p_partkey", "'a' AS p_name", "1 AS p_size", "'b' AS p_brand", "'t' AS p_type"),
        "supplier": spark.sql("SELECT 1L AS s_suppkey, 's' AS s_name"),
        "customer": spark.sql("SELECT 1L AS c_custkey, 'c' AS c_name"),
        "orders": spark.range(6_600).selectExpr("id AS o_orderkey", "IF(id < 6000, id * 10, id * 10 + 1) AS o_custkey"),
        "lineitem": spark.range(6_600).selectExpr("id AS l_orderkey", "explode(array(id % 20, (id * 7 + 3) % 20)) AS l_partkey", "1L AS l_suppkey"),
        "embeddings": spark.range(20).selectExpr("id AS vec_id", "1 AS label", "transform(sequence(1, 8), x -> sin(id * x)) AS embedding"),
    }
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    con = duckdb.connect()
    for name in tables:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert_same(registry.QUERIES["final_evaluation"](spark, str(tmp_path)), con, registry.ORACLE_SQL["final_evaluation"])
