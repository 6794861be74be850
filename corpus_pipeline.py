"""A training-data pipeline over `documents`: toxicity, language, near copies, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one's docs are that result,
written as Parquet and read again. Stages see all that their predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import stored, table
from plumbline.llm.jaccard import one_of_each
from plumbline.llm.langid import UNKNOWN, fit, held_out, identify
from plumbline.llm.packing import pack
from plumbline.llm.toxicity import THRESHOLD, score
from plumbline.llm.toxicity import fit as fit_chain

#: A document goes if its language is `und`, or if it is told with less than this probability.
LEAST_LANGUAGE = 0.5
#: Units whose ids a worker keeps while packing. It is a fifth of what packing alone keeps, as the workers and
#: the executor's JVM still hold what the earlier stages took, and a worker keeps it after this stage.
PACKING_CACHE = 150_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic is under the threshold, by the classifier chain.

    Null and empty texts are scored as empty ones; repeated rows and null ids are judged like others;
    columns may have any names; an empty table gives an empty one.
    """
    scored = score(docs, fit_chain(docs, table(spark, sf_dir, "labels")), docs.columns)
    return scored.where(F.col("p_toxic") < F.lit(THRESHOLD)).select("kept.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the known languages, by the byte convolutional network.

    Texts that are null or have no letter go; repeated rows and null ids are judged like others;
    columns may have any names; an empty table gives an empty one.
    """
    net = fit(docs.select("doc_id", "text", "lang"))
    told = identify(docs, net, docs.columns)
    return told.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= F.lit(LEAST_LANGUAGE))).select("kept.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies (five-word shingles, similarity 0.8 or more).

    Groups are of texts: differing texts under one doc_id are judged apart, so none is lost that has
    no near copy. Rows of null doc_id and texts without words are in no group and stay; of rows that
    repeat doc_id and text, one stays. An empty table gives an empty one.
    """
    return one_of_each(docs, words=5, num=80, den=100)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of at most 1024 tokens.

    Null and empty texts are one piece, their end id; rows of null or repeated ids are packed each;
    further columns aren't read; an empty table gives no pieces.
    """
    return pack(docs, cache=PACKING_CACHE)


STAGES = [("toxicity", toxicity), ("language_id", language_id), ("ngram_jaccard", near_copies), ("best_fit_packing", packing)]

#: The stages learn models and pack sequentially, which SQL can't express; tests/llm compare run()
#: with a version of plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage's result being stored and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
