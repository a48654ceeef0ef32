"""A cleaning pipeline over documents: each stage works on all that the one before it kept.

Language ID drops documents without a recognisable language, toxicity those flagged over their
language's threshold, the n-gram join all but one row (of the smallest id) of each group of
near-duplicates, suffix dedup rewrites texts without repeated passages, and packing assigns the remaining
documents to length buckets and token-budget batches. Rows are judged one by one, so ids may be null
or repeated; rows equal in all columns count once from the n-gram join on. Every stage gives an empty
result for an empty table and reads no column but those of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabulon.llm import jaccard, language, packing, suffixes, toxicity
from fabulon.llm.common import checkpointed

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL can express neither the trained models nor the joins; the stages are tested against brute-force versions.
ORACLE_SQL = None


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text has a recognisable language; those with a null text or one without a letter go. Repeated rows stay."""
    return language.identify(docs, carry=COLUMNS[1:]).filter(F.col("lang_pred") != language.NONE).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose score is under the threshold of their language (0.5 if lang is null or unseen). Null and empty texts and repeated rows are judged like any other; without labels of both kinds all rows stay."""
    judged = toxicity.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=COLUMNS[1:])
    return judged.filter(~F.col("flagged")).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that of the smallest id (null last; of several the one with the least hash of all columns).

    Texts without words have no near-duplicates: one row of each id stays, and of those without an id all that differ.
    """
    marked = docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("mark"))  # tells rows apart, whatever their ids
    best = jaccard.one_of_each(marked, "mark").select("mark").distinct()
    # Of rows that are equal in all columns each task sends one; then texts and chosen rows meet by mark, in one exchange.
    return marked.dropDuplicates(["mark"]).join(best, "mark", "left_semi").select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their texts without the passages of 100 bytes and more that occur earlier, cut at character borders; a null text stays null, n_chars is counted anew."""
    cut = suffixes.remove_repeats(docs, keep_text=True, carry=("lang", "source"))
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and padding of every row; null and empty texts have 0 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language_id", keep_identified),
    ("toxicity", drop_toxic),
    ("ngram_join", one_of_each_group),
    ("suffix_dedup", without_repeats),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written once and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
