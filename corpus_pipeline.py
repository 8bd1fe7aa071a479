"""A training-data pipeline over ``documents``: each stage works on all that the one before it kept.

Rejected as toxic, then documents of no accepted language, then all but one document of each near-duplicate group, then documents
contaminated by the benchmark; what is left is packed into sequences of tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weft.llm import decontam, langid, packing, simhash, toxicity
from weft.llm.queries import table, tokenizer_path
from weft.operators.rest import drop, put, release, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on ``labels``, doesn't reject. Null and empty texts stay; rows are judged one by one, so a null
    or repeated doc_id changes nothing, and equal texts are judged alike. An empty table stays empty; without usable labels all stay."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough certainty by a model fitted on those that aren't held out. Texts that are null or have no
    letter go; rows are judged one by one, however long. Without a labelled row nothing can be told, and all go."""
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the smallest doc_id, of equal ones the first row; ids go before nulls. Null and
    empty texts are one group. Rows that share a doc_id but not their text are documents of their own."""
    return simhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words is hit by windows of ``benchmark``. Null and empty texts stay; each row is judged by
    its own text, whatever its doc_id. With an empty benchmark all stay."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence. A null or empty text is one piece, the end id; null and repeated doc_ids are
    packed like others. An empty table gives no piece."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: The fingerprints' hash, the trained models and the tokenizer have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn. Once a stage's table is written, those it was made from are taken away; the last stage reads its own table of pieces only."""
    docs, before = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES[:-1]:
        docs, path = put(stage(spark, docs, sf_dir), name)
        release(before, path)
    packed = STAGES[-1][1](spark, docs, sf_dir)
    drop(path)
    return packed
