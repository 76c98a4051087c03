"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomset.llm import decontaminate, mixing, near_text, token_ids, toxicity
from loomset.llm.common import scratch_path
from loomset.llm.queries import END_ID, VOCABULARY, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go."""
    index = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.toxicity_scores(docs, index, keep=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: linked by SimHash as in op9, or by a Jaccard similarity of 0.8 of whole shingle sets."""
    return near_text.drop_near_texts(docs, simhash=True)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix of their sources takes them, from never to three times."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are written as packed token ids and read back: (doc_id, start, n_tokens, ids_crc32)."""
    out = scratch_path(spark, "corpus-ids")
    token_ids.write_token_ids(docs, out, tokenizer_path(), VOCABULARY, END_ID)
    return token_ids.read_token_ids(spark, out, with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", near_dedup),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("token_ids", encoded),
]

#: SQL can express neither nearest neighbours nor the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
