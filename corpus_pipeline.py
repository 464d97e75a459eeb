"""A training corpus from the documents table: quality rules, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and gives the next one's documents, written as Parquet in between. All but
the last keep the columns of the documents; the last gives the pieces of the packed windows.
"""

from __future__ import annotations

import os
import secrets

from pyspark.sql import DataFrame, SparkSession

from geolathe.llm import mixing, ngram_join, packing, pii, quality
from geolathe.llm._tables import stage


#: The key of the surrogates: CORPUS_PIPELINE_KEY where it is set; else one that this process draws and nobody knows, so that surrogates of two processes cannot be matched.
KEY = os.environ.get("CORPUS_PIPELINE_KEY") or secrets.token_hex(32)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.apply_rules(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(docs, key=KEY).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("surrogates for personal data", personal_data),
    ("mixing sources", mix_sources),
    ("packing", pack_windows),
]

#: SQL cannot express the tokenizer, the keyed surrogates or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
