"""From raw documents to packed training sequences: toxicity, quality, near duplicates, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all documents that the one before it kept. All but the last
return the columns of documents. Each stage's result is written as Parquet and read again, so that a later stage that
loses executors starts from there.

Defined results: a null or empty text is no toxic one and falls to the quality rules (it has no words); a null language
is judged by counts alone; rows without doc_id are kept by the n-gram join, which can't name them; where an id repeats,
each of its different texts is a document; without labels nothing is toxic; very long texts pass every stage whole;
columns besides doc_id, text and lang, whatever their names, pass to the last stage but one; an empty table gives an
empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm.common import table, written
from tracewright.llm.jaccard import deduplicate
from tracewright.llm.packing import pack
from tracewright.llm.pii import sanitise
from tracewright.llm.quality import filter_quality
from tracewright.llm.queries import VOCABULARY
from tracewright.llm.toxicity import filter_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filter_toxic(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filter_quality(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sanitise(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, VOCABULARY)


STAGES = [
    ("toxicity", toxicity),
    ("quality rules", quality_rules),
    ("n-gram jaccard join", ngram_jaccard),
    ("personal data", personal_data),
    ("best-fit packing", best_fit_packing),
]
#: The stages' models and tokenizer can't be written in SQL; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
