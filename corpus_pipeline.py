"""A corpus made ready for training, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the
shared folder and reads again as the next stage's docs.  All but the last return the columns of documents, and any others that docs has.

In every stage a null text counts as an empty one, whole texts are read whatever their length, equal texts fare alike (but for the one
that near_dedup keeps), doc_ids may be null or repeated, null lang, source and n_chars change nothing, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import stored, table
from graphloom.llm.decontamination import drop_contaminated
from graphloom.llm.packing import pack_documents
from graphloom.llm.quality import keep_quality
from graphloom.llm.simhash import keep_one_of_each
from graphloom.llm.toxicity import keep_clean


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier accepts: a score of 0.5 or more, ties accepted.  Repeated rows stay as often as they come; an empty text has a score like any other."""
    return keep_quality(spark, docs, sf_dir)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not predicted toxic: a score below 0.3, at it they go.  Repeated rows stay as often as they come; an empty text has no toxic passage and stays."""
    return keep_clean(spark, docs, sf_dir)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the smallest doc_id (null last), then the smallest hash of its text, then of all its columns.  Repeated rows become one; texts without words are copies of each other."""
    return keep_one_of_each(spark, docs, sf_dir)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark; rows of one id and text go or stay together.  Empty texts, and all rows where the benchmark is empty, stay."""
    return drop_contaminated(spark, docs, sf_dir)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row, packed into sequences.  An empty text is its end id; repeated rows and ids are packed row by row."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack)]

#: Learned scores, fingerprints and tokenizer ids are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
