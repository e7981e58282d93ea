"""A training corpus from raw documents in five stages, each over all that the one before it kept.

1. quality rules: documents that the fixed rules or the corpus's own thresholds reject go;
2. n-gram Jaccard join: one document of each group of near duplicates stays, the one with the least doc_id;
3. benchmark decontamination: documents that hold a benchmark window go;
4. PII: entities and the terms that give them away are replaced in the texts, n_chars follows;
5. mixing: documents get whole copies, or a place in their source's sample, up to the source's target.

Every stage but the last returns the columns of documents as they came; the last adds `copies` (1 or more). Null texts
are empty and fail the first stage. Empty tables pass through. Repeated rows are near duplicates of each other: the second
stage leaves one. Ties go to the least doc_id there and are cut row by row in the last. Long texts stay whole in their row.
Extra columns are carried, but for names that start with _quality_, _near_, _leak_, _pii_ or _mix_; a column named copies is
replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from touchline.llm import decontam, mixing, ngram_join, pii, quality
from touchline.llm.common import forget, materialise, scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_rules(docs, docs.columns).where(f"{quality.P}kept").select(*docs.columns)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = F.col(f"{pii.P}clean")
    changed = {"text": clean.alias("text"), "n_chars": F.length(clean).cast(dict(docs.dtypes).get("n_chars", "long")).alias("n_chars")}
    return pii.sanitise(docs, docs.columns).select(*(changed.get(c, F.col(c)) for c in docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = mixing.sample_mix(docs, docs.columns).where(f"{mixing.P}copies > 0")
    return out.select(*(c for c in docs.columns if c != "copies"), F.col(f"{mixing.P}copies").alias("copies"))


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("mixing sources to target weights", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over `documents`; each stage's rows are written and read again, and what a stage wrote for
    itself is deleted when it is done."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before = docs
        with scratch(spark) as kept:
            docs = materialise(stage(spark, before, sf_dir), "stage")
            kept.append(docs)
        forget(before)
    return docs


#: The second stage groups by hashed n-gram sets and the last samples by digests: no SQL; the tests use brute force.
ORACLE_SQL = None
