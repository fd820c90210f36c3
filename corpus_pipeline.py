"""From raw documents to token ids: toxic documents go, repeated lines go, one of each group of near copies stays,
benchmark passages go, and what is left is encoded. Each stage is one operator of quernstone.llm over all its input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quernstone.llm import decontaminate, line_dedup, pieces, simhash, toxicity
from quernstone.llm.common import table, written

#: Words in a shingle of the near-duplicate stage, and the Jaccard similarity from which two documents are near copies.
SHINGLE, SIMILARITY = 5, 0.8


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars says how long a changed text is now."""
    if not {"text", "n_chars"} <= set(docs.columns):
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network scores at 0.5 or more go."""
    return toxicity.keep_civil(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go; a document keeps its row, even without a line."""
    return _counted(line_dedup.dedup_lines(docs, counts=False))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents whose sets of five-word shingles are similar enough the least doc_id stays."""
    return simhash.keep_one(docs, shingle=SHINGLE, similarity=SIMILARITY)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with windows of two or more benchmark items, or mostly made of them, go; single passages are cut out."""
    return _counted(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The text gives way to its ids and what they decode to."""
    return pieces.encode_decode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("pieces", encode),
]

#: Learned scores and merge rounds cannot be said in SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
