"""A corpus pipeline of five operators: quality, toxicity, recurring lines, near-duplicates, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again for the next. All but the
last return the columns of ``documents``. Models are learnt from ``labels`` and the documents that the stage is given.
Null or empty texts are scored like any other; rows with a null id pass the near-duplicate stage; an empty table gives
an empty result. SQL can't express the stages (models, a tokenizer), so ORACLE_SQL is None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwright.llm import quality_classifier, toxicity
from gapwright.llm.line_dedup import drop_recurring_lines
from gapwright.llm.minhash import deduplicated
from gapwright.llm.packing import packing_query
from gapwright.llm.queries import BYTE_BPE
from gapwright.session import remove, shared_dir, table, written

#: A name that no column of ``documents`` has.
SCORE = "\0score"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, model, out=SCORE).where(F.col(SCORE) >= quality_classifier.ACCEPT).drop(SCORE)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, out=SCORE).where(F.col(SCORE) < toxicity.ACCEPT).drop(SCORE)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_recurring_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicated(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing_query(docs, BYTE_BPE)


STAGES = [("quality", quality), ("toxicity", toxic), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; a stage's input goes when its result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = shared_dir(spark)
        docs = written(stage(spark, docs, sf_dir), path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
