"""A training corpus from raw documents: filter, deduplicate, sanitise, mix, pack.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs; run() writes what a stage keeps as Parquet in
the shared folder and reads it again for the next one.  All stages but the last return the columns of documents.
Every stage takes rows with nulls in any column, empty and very long texts (worked on whole), repeated rows, ties, no
rows at all, and extra columns of any name, which are not read and not returned.  What each of them does with such rows
stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sequent.llm import jaccard, mixing, packing, pii, quality
from sequent.llm.shared import fresh_path
from sequent.llm.tokens import word_vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier accepts.

    Null, empty and blank texts go.  Repeated rows are judged alike, each on its own.  Without labels of both kinds
    every document that has a word stays.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.score(docs.select(COLUMNS), labels).where("accepted").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class; one row of those alike in doc_id and text.

    Of a class the text of the smallest doc_id stays, null ids last, then the one of the smallest hash.  Null, empty
    and blank texts are like nothing and stay, but once for each doc_id.  Of rows alike in doc_id and text the one with
    the smallest lang, source and n_chars stays, nulls first, so reruns agree.
    """
    kept = jaccard.jaccard_classes(docs).where("kept").groupBy("doc_id", "h").agg(F.count("*").alias("rows"))
    kept = kept.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), "rows")
    found = docs.select(COLUMNS).withColumn("__key", F.xxhash64("text"))
    found = found.join(kept, (F.col("__key") == F.col("__h")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    once, again = found.where("rows = 1").select(COLUMNS), found.where("rows > 1").select(COLUMNS)
    first = again.groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("row"))
    return once.unionByName(first.select("doc_id", "text", "row.*").select(COLUMNS))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced; n_chars follows the text.

    Null and empty texts stay as they are, a null one with its n_chars; repeated rows stay repeated.
    """
    return pii.sanitised(docs.select(COLUMNS)).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a document taken twice is two rows, one taken in part has that part.

    Null sources are one source.  Nothing is taken of null, empty and blank texts.  Repeated rows are documents of
    their own.
    """
    mixed = mixing.mix(docs, carry=("text", "lang")).where("taken > 0").select("doc_id", "text", "lang", "source", "cuts")
    return mixing.cut_texts(mixed).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences.

    A null or empty text is one piece, its end id; repeated rows and null doc_ids are documents of their own.
    """
    return packing.best_fit_packing(docs, word_vocabulary())


STAGES = [
    ("quality classifier", accept_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("PII", sanitise),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack),
]

#: Classifier weights, similarity search and tokenizer are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = fresh_path(spark, f"pipeline-{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
