"""A corpus pipeline: five stages over documents, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urnframe.llm.line_spread import without_boilerplate
from urnframe.llm.pack_curve import digest, pack_documents
from urnframe.llm.pigeonhole import without_contamination
from urnframe.llm.signature_join import one_of_each
from urnframe.llm.store import free_name, stored, table
from urnframe.llm.toxicity import fit, rejected


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below the threshold of their language; learnt from ``labels``.

    Each row is judged by its own text: repeated rows alike, a null or empty text as one without words.
    Rows with a null id are judged, too. Without labels every row stays.
    """
    model = fit(docs, table(spark, sf_dir, "labels"))
    score, flag = free_name(docs.columns, "score"), free_name(docs.columns, "rejected")
    return rejected(docs, model, score, flag).where(~F.col(flag)).drop(score, flag)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that spread over many sites.

    Every row stays; null and empty texts stay as they are, a text of such lines alone stays whole.
    A null source is a site of its own; repeated rows are cleaned alike.
    """
    return without_boilerplate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, the one with the least doc_id.

    Repeated rows are similar, one stays. Rows without words or with a null id all stay.
    """
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold nothing and stay. Rows with a null id are judged together. Without
    items every row stays.
    """
    return without_contamination(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; a null or empty text is the end token alone, repeated rows are packed each."""
    return digest(pack_documents(docs))


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]
ORACLE_SQL = None  # no stage with a trained classifier or a tokenizer can be said in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
