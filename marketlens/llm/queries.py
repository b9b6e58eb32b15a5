"""The queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import _scratch, ann, centroids, decontaminate, hmm_score, html_extract, jaccard_join, language_id, packing, pii, prefix_trie, secrets, suffix_dedup, token_files


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.search(vectors, vectors.where("vec_id % 50 = 0"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces with their places; the CRCs are those of the ids that the sequences hold."""
    return token_files.with_checksums(packing.pack(packing.cut(_documents(spark, sf_dir))).drop("row"))


def _remainder(n: int) -> F.Column:
    """crc32(doc_id as text) modulo n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = language_id.learn(docs, _remainder(5) != 0)
    held_out = (_remainder(5) == 0).alias("held_out")
    return language_id.predict(docs, model).select("doc_id", held_out, "lang_pred", "score", "entropy", "rejected")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch.folder(spark, "tokens")
    token_files.write_tokens(_documents(spark, sf_dir), path)
    return token_files.with_checksums(token_files.read_tokens(spark, path))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(_documents(spark, sf_dir))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii(_documents(spark, sf_dir))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(_documents(spark, sf_dir))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(_documents(spark, sf_dir))


def op10_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_score.score(_documents(spark, sf_dir), _remainder(7) == 2)


def op11_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.branched(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_ann, op3_packing, op4_language_id, op5_token_files, op6_secrets, op7_pii, op8_jaccard_join, op9_suffix_dedup, op10_hmm_score, op11_html_extract, op12_centroids, op13_prefix_trie)}


def oracles() -> dict[str, str]:
    return {"op1_decontaminate": decontaminate.ORACLE_SQL, "op12_centroids": centroids.ORACLE_SQL, "op13_prefix_trie": prefix_trie.ORACLE_SQL}
