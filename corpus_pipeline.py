"""A training corpus from `documents`: quality, near-duplicates, benchmark leaks, mixture, token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import new_dir, table
from newsloom.llm.decontaminate import without_leaks
from newsloom.llm.mixing import placed
from newsloom.llm.quality import accepted
from newsloom.llm.queries import TARGET_WEIGHTS, tokenizer_path
from newsloom.llm.simhash import one_of_each
from newsloom.llm.token_store import read_tokens, write_tokens


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, all columns as given.

    Null and empty texts are scored like others; null ids and repeated rows are kept or go by their text alone; without
    usable labels every document is kept; no documents, no rows.
    """
    return accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies, all columns as given.

    Null and empty texts are copies of each other; rows of equal id and text are kept once; a document without an id
    stays unless it is a copy of one with an id; no documents, no rows.
    """
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, all columns as given.

    Null and empty texts hold none; ids play no part and repeated rows are judged alike; no items: all documents.
    """
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, once each and all columns as given, as rows in the order of the mixture; the next stage writes its
    files in that order. Documents without a source, or of one without a weight, are mixed as one source; texts play no
    part; equal ids and repeated rows follow each other; no documents, no rows."""
    return placed(docs, TARGET_WEIGHTS).orderBy("mix_order", "doc.doc_id").select("doc.*")


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files of the documents in the order of their rows, read back: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts are the end id alone; null ids stay null; repeated rows get entries each; no documents, no rows.
    docs is read from Parquet, whose file names and row numbers are the order.
    """
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    order = [part, F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    return read_tokens(spark, write_tokens(docs, tokenizer_path(), order=order))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_files", token_files),
]

#: Neither fitting a classifier, nor SimHash components, nor the tokenizer can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each result written as Parquet and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
