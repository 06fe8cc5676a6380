"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import decontam, jaccard, linededup, oracles, packing, rabitq, secretscan, suffixtree, tokenfile, toxicity, urltree


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(spark, C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(C.table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(C.table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_deleted", "emptied", "text")


def op4_url_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltree.judge(C.table(spark, sf_dir, "pages"))


def op5_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtree.score(C.table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return toxicity.score(toxicity.fit(docs, C.table(spark, sf_dir, "labels")), docs)


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.index(tokenfile.write(C.table(spark, sf_dir, "documents")))


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rabitq.near_dedup(C.table(spark, sf_dir, "embeddings"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(C.table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(C.table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def check_unigram_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5 that SQL can express, rounded as sums of logarithms are."""
    return op5_suffix_tree(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


def check_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4 that the rules alone decide."""
    out = op4_url_tree(spark, sf_dir)
    return out.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("rule_verdict"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [op1_decontamination, op2_secret_scan, op3_line_dedup, op4_url_tree, op5_suffix_tree, op6_toxicity, op7_token_file, op8_near_vectors, op9_jaccard_join, op10_packing, pipeline, check_unigram_base, check_url_rules]
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
