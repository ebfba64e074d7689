"""From raw documents to packed training sequences, one stage after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the
next one's docs. All but the last return the columns of documents, in their order, and leave any other
columns, whatever their names, as they are. An empty table goes through as an empty one. Rows with nulls
go through every stage: a null doc_id, lang or source, and a null or empty text, are rows like others
but for what a stage says of them. run() leaves its tables in the shared folder; common.clear() removes
them once the result is saved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dataward.llm import mixing, neardup, packing, pii, quality
from dataward.llm.common import table, written

NEAR_WORDS, NEAR_SIMILARITY = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity stays below their language's threshold.

    Without a language, or in one without trusted text, a document stays; repeated rows stay or go
    together; a null or empty text counts as one boundary sign.
    """
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest doc_id.

    Texts without words, null ones among them, are near copies of nothing; rows without a doc_id stay;
    of rows that repeat a doc_id, the longest text stays (then the greatest).
    """
    return neardup.one_of_each(docs, NEAR_WORDS, NEAR_SIMILARITY)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows, null where the text is null."""
    redacted = pii.redacted(docs)
    return redacted.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them, which may be never.

    A null source is one of its own; documents without words are not taken; repeated rows count one by one.
    """
    return mixing.repeated(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed token sequences with their ids; a null or empty text has its end id only."""
    return packing.packed(docs)


STAGES = [("quality", quality_stage), ("near-duplicates", neardup_stage), ("personal data", pii_stage), ("source mix", mix_stage), ("packing", pack_stage)]
#: SQL expresses neither the model nor the sketches; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
