"""The registered queries of the training-data operators, thin over the operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bitplanes, classifier, html, merkle, mixing, ngram_join, packing, pii, quality, sharding, simhash, tokenfile
from ._tables import stage
from .oracles import ORACLES  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op_mix(_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    counted = stage(quality.with_counts(docs, "text", ["doc_id", "lang", "source"]), "counts")
    out = quality.judged(counted)
    return out.select("doc_id", *quality.COUNTS[:5], "base_failed", "kept", *[c for c in out.columns if c.endswith(("_low", "_high"))])


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.digest(tokenfile.write_corpus(_table(spark, sf_dir, "documents")))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.extract(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_groups(_table(spark, sf_dir, "documents"))


def op6_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(_table(spark, sf_dir, "documents"), key="for the check, not a secret")
    return out.select("doc_id", "text", "n_entities")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = classifier.train(docs, _table(spark, sf_dir, "labels"))
    return classifier.score(docs, model).select("doc_id", "expected_grade", "tail_probability", "kept")


def op10_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op_shard(_table(spark, sf_dir, "documents"))


def op11_bit_plane_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplanes.op_cluster(_table(spark, sf_dir, "embeddings"))


def op12_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.op_manifest(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_quality_rules, op3_token_files, op4_html_extract, op5_ngram_jaccard_join, op6_pack_sequences, op7_nearest_neighbours, op8_pii_surrogates, op9_quality_classifier, op10_jump_shards, op11_bit_plane_clusters, op12_simhash_groups, op13_merkle_manifest)}
