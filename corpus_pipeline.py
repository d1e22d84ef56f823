"""Corpus pipeline: documents to token ids in five stages.

Every stage works on all rows its predecessor kept and writes them as Parquet
to the shared checkpoint folder; a lost executor repeats tasks of one stage.

- quality: rows the quality rules reject go (null and empty texts are rejected);
- near_duplicates: of each SimHash group the row of the smallest id stays;
- decontaminate: rows that leak a benchmark item go;
- personal_data: spans of personal data are replaced in the text, and n_chars
  follows the text;
- encode: the token ids of every text, decoded again for a digest.

Extra columns pass the first four stages untouched.  Null ids are ordinary
ids; repeated rows end as one in near_duplicates; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaytrace.llm import bpe, decontaminate, pii, quality, simhash
from relaytrace.session import scratch_path
from relaytrace.sources.tables import read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in out.columns else out


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    both = bpe.decode(bpe.encode(docs))
    return both.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontaminate", decontaminate_stage),
    ("personal_data", personal_data_stage),
    ("encode", encode_stage),
]

#: No SQL: the stages rest on zstandard, XXH64, boosted trees and a tokenizer;
#: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
