"""A corpus from raw documents to packed training sequences.

Stages, each on all that the one before it kept: the quality classifier drops what it rejects; of each group of near-duplicates (five-word
shingles, similarity 0.8 or more) the document with the smallest doc_id stays; documents contaminated by benchmark passages go;
personal data is replaced in the texts (n_chars follows); the rest is tokenised and packed.

Cases: all stages but the last keep the columns of ``docs``, whatever they are. In the near-duplicate stage documents without doc_id go where
their text is a near copy; of repeated rows (same doc_id and text) one stays; of different texts under one doc_id each is judged by
itself. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import decontaminate, near_dedup, packing, pii, quality
from terrane.llm.queries import TOKENIZER
from terrane.llm.store import materialise, scratch
from terrane.session import table

QUALITY_THRESHOLD = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    machine = quality.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return docs.where(quality.score_column(machine, spark)("text") >= QUALITY_THRESHOLD)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.distinct(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return clean


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs.select("doc_id", "text"), TOKENIZER)


STAGES = [
    ("quality_classifier", keep_quality),
    ("near_dedup", keep_distinct),
    ("decontamination", keep_uncontaminated),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: SQL expresses neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``, each written as Parquet to the shared folder and read again; what a stage wrote on the way goes with it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):
            docs = materialise(stage(spark, docs, sf_dir), name, keep=True)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
