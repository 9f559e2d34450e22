"""Documents to packed training rows, in five stages.

Each stage gets all that its predecessor kept; its result is written as Parquet and read again.  All but the last return the
columns of documents.

Defined results, in every stage: an empty table gives an empty result, further columns are carried and may have any name.  A null
or empty text has no words and goes with the rules.  Rows are judged by what they hold, not by their doc_id, which may be null or
repeated: of rows that repeat one another, or are near duplicates, one stays, and its text is whole where nothing else repeats it.
Without labels the classifier rejects nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairnflow.llm import fm, hostrules, neardup, packing, pfp
from cairnflow.llm.common import forget, made, materialise, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted to the table's labels, accepts."""
    return fm.keep(docs, fm.fit(docs, table(spark, sf_dir, "labels")))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host isn't rejected."""
    return hostrules.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: by five words at 0.8, where op4 takes three at 0.85."""
    return neardup.keep_one(docs, percent=80, words=5, bands=40)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 200-byte strings that occur again."""
    return pfp.clean(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its place in a training row."""
    return packing.pack(docs)[0]


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("quality rules", rules),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("best-fit packing", pack),
]

#: SQL can't express the classifier, the tokenizer or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed rows; a stage's own intermediate tables go when its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = made()
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        forget(before, made() - 1)  # all but the result, which is the last
    return docs
