"""From raw documents to token ids: language, near duplicates, benchmark leaks, personal data, pieces."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prognos.llm import decontam, jaccard, langid, pieces, pii
from prognos.llm.common import stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is found, which becomes their `lang`; those without a letter go."""
    return langid.identified(docs, langid.fit(docs.where(~langid.held_out())))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group at a Jaccard similarity of 0.8 in five-word shingles.

    Rows that repeat both id and text are one. Rows without an id can't be named in a group; those with equal texts are one.
    """
    first = jaccard.classes(docs, n=5, num=8, den=10).where("doc_id = component_id").select("doc_id").distinct()
    # rows of one id are together after the join, so that taking repeated ones out moves no text again
    named = docs.hint("merge").join(first.hint("merge"), "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.where("doc_id is null").dropDuplicates(["text"]))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item; a document is known by its text here, so rows without an id are searched too."""
    name = "text_digest"
    while name in docs.columns:
        name += "_"
    known = docs.withColumn(name, F.sha2("text", 256))
    leaks = stored(decontam.contaminated(known, table(spark, sf_dir, "benchmark"), key=name).select(name).distinct(), "leaks")
    return known.join(leaks, name, "left_anti").select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; n_chars follows."""
    return pii.masked(docs, pii.fit(docs)).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids, round_trip) of every document."""
    out = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.col("same").alias("round_trip"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("personal_data", personal_data),
    ("sentence_pieces", sentence_pieces),
]
#: The stages can't be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
