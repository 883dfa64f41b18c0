"""The corpus pipeline: language ID, exact dedup, near dedup, decontamination, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns
a DataFrame; each but the last returns the columns of docs. The runner writes
what a stage returns as Parquet and reads it again as the next one's docs.

Cases, of every stage: other columns are kept as they are, whatever their
names and with their nulls; very long texts are read whole; an empty table
gives an empty one. What nulls, empty texts, ties and repeated rows mean is
said with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import decontaminate, exact_dedup, language_id, near_dedup, sentencepiece_viterbi
from marginalia.llm.common import stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: those whose text is null or has no letter, or all if no row has a lang to learn from.

    Between languages that are equally near the first by name is taken; a
    repeated row is judged like its copies; a null doc_id is as good as any.
    """
    return language_id.keep(docs, language_id.fit(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays.

    Null text equals empty text; a null doc_id is the smallest; of equal rows
    with the largest doc_id one stays.
    """
    return exact_dedup.keep(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the smallest doc_id stays, with all of its rows.

    The threshold is the 80 % that stages on shingles take unless they are
    told otherwise. Rows without words or without a doc_id are near to nothing
    and stay; documents exactly at the threshold are linked.
    """
    return near_dedup.keep(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go.

    Rows without words stay, and all rows if there is no item; overlaps
    exactly at the threshold count; a null doc_id is as good as any, and rows
    that share one are judged each by its own text.
    """
    return decontaminate.keep(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids, and whether they decode to the text: one row for each of docs, with a null doc_id or a repeated one too.

    Null text is empty and has no ids; where two ways to cut a text have the
    same scores, the library's is taken.
    """
    return sentencepiece_viterbi.encode(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: Stages 1 and 5 cannot be said in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name}")
    return docs
