"""From raw documents to packed training sequences: five stages, each a table in and a table out.

`run` writes every stage's result as Parquet to the shared folder and reads it back for the next, so a lost
executor costs no more than its tasks. All but the last stage return the columns of documents.
Rows with a null doc_id or null text go through every stage that does not reject them by its own rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlab.llm import decontaminate, jaccard, language, packing, pii
from factorlab.llm.common import table, unused, written
from factorlab.llm.queries import tokenizer_paths


def _whole(docs: DataFrame) -> DataFrame:
    """doc_id, text and the row itself, so that no column of a document can clash with an operator's."""
    return docs.select("doc_id", "text", F.struct("*").alias("_row"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null text, or not one letter. Learns from the labelled documents."""
    samples = language.labelled_sample(docs, F.lit(True))
    if not samples:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    judged = language.identify(_whole(docs), samples, carry=("_row",))
    return judged.filter(F.col("lang_pred") != language.UNKNOWN).select("_row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near copies: five-word shingles, Jaccard similarity 0.8 or more."""
    groups = jaccard.join(docs, size=5, num=80, den=100)
    name = unused("_kept", docs.columns)
    kept = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, as it stands or with other values in its slots."""
    judged = decontaminate.decontaminate(_whole(docs), table(spark, sf_dir, "benchmark"), carry=("_row",))
    return judged.filter(~F.col("contaminated")).select("_row.*")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in texts by the name of its kind."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(docs, *tokenizer_paths())


STAGES = [
    ("language_id", identify_language),
    ("jaccard_dedup", one_of_each_group),
    ("decontamination", without_benchmark),
    ("pii", mask_personal_data),
    ("best_fit_packing", pack),
]

#: Automata, sketches and the tokenizer have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
