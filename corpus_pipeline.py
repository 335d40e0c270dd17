"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept; run() writes
each stage's rows to the shared checkpoint folder and reads them again. No stage but the first
looks at labels, and only benchmark items decide what is contaminated.

In every stage a repeated doc_id is one document, the row whose text sorts first; rows without
doc_id are left out; texts are taken whole; an empty table gives none; further columns of docs,
whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import bpe, contamination, minhash, quality, substring
from weft.llm.core import cut, keyed

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Scores below this are rejected.
LEAST_SCORE = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject: null and empty texts get a score like any other."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.score_documents(docs, labels, carry=COLUMNS[1:])
    return scored.where(F.col("score") >= LEAST_SCORE).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near copies (Jaccard 0.8 on 5-word shingles); wordless ones stay."""
    docs = keyed(docs, *COLUMNS[1:])
    groups = minhash.near_duplicates(docs)
    stay = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    # a merge join at every size: no side is known to be small
    return docs.join(stay.hint("merge"), "doc_id", "left_semi").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 35 and more words that stand in several places; n_chars follows."""
    out = substring.dedup_substrings(docs, layout=True, carry=("lang", "source"))
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within a fifth of its words; null and empty texts hold none."""
    docs = keyed(docs, *COLUMNS[1:])
    hits = contamination.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(cut(hits, "hits"), "doc_id", "left_anti").select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document that is left; a null or empty text has no ids."""
    return bpe.encode_documents(docs, *bpe.vocabulary()).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained classifier is not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
