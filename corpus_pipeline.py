"""A training corpus from raw documents: five stages, each on all that its predecessor kept.

Languages, near duplicates, repeated lines, benchmark passages, then packed sequences. Each stage takes and (but for the
last) returns the columns of documents; ``run`` writes every stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontaminate, language, neardup, packing, substring
from weftline.llm.common import materialise, read


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found with a margin; null texts, texts without letters and ties go.

    Rows are judged one by one, so null and repeated ids and repeated rows stay with their texts. Where no text has a language to
    learn from, all go; an empty table stays empty."""
    return language.drop_rejected(docs, docs.where(~language.held_out()))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    Rows without an id, a text or words all stay; of rows with equal id and text one stays; rows that share an id but not their
    text are documents of their own. An empty table stays empty."""
    return neardup.drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages and whole lines that repeat an earlier one are taken out of the texts; ``n_chars`` follows.

    Null texts and ids stay, null ids rank first, equal rows are one document, and a document that loses all its text stays with
    an empty one. An empty table stays empty."""
    from pyspark.sql import functions as F

    out = substring.drop_repeated(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with the benchmark.

    Rows are judged one by one; null and empty texts share nothing and stay. An empty table stays empty."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' tokens in sequences of 1024.

    Null texts are packed as empty ones, null ids and repeated rows as they come. An empty table gives no sequences."""
    return packing.pack(docs)


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: Compression, MinHash candidates and bin packing have no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
