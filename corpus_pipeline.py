"""The corpus pipeline: stages of the training-data operators, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from otindex.llm.byte_bpe import encode_documents
from otindex.llm.decontaminate import decontaminate
from otindex.llm.line_crf import accepted, fit, learnable
from otindex.llm.pii import pseudonymize
from otindex.llm.queries import PII_KEY
from otindex.llm.simhash import deduplicate
from otindex.session import working_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose lines the classifier holds for bad."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return accepted(docs, fit(docs, learnable(labels)))


#: Seeds of the fingerprints. Those of a pair of near copies differ by chance, so with each further
#: seed more pairs come within the radius, at the cost of another set of links.
SEEDS = (42, 43, 44, 45, 46, 47)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least doc_id of each group of near copies, linked by the fingerprints of any seed."""
    return deduplicate(docs, seed=SEEDS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put stand-ins in place of personal data and secrets."""
    return pseudonymize(docs, PII_KEY)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode what is left: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("pii_surrogates", pii),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = working_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs


#: Byte-pair encoding and trained models have no SQL; tests hold the rows against a brute-force version.
ORACLE_SQL: str | None = None

QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
