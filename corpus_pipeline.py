"""A corpus pipeline: five stages over the documents, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheetspan.llm import exact_dedup, language_id, mixing, ngram_join, packing, tokens
from sheetspan.llm.queries import domain_of
from sheetspan.workspace import new_path, stage, table

#: Target weights of the mixing stage: shares of the largest total that documents can reach at rates up to 1.  The first domain stays all
#: but whole, the others thin out towards theirs; memberships are soft, so that thinning them takes a little of the first one too.
WEIGHTS = {"good": 0.89, "poor": 0.06, "toxic": 0.05}


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is clear.  Null texts, texts without letters and those with a narrow margin go, repeated rows
    alike; very long texts are judged whole; an empty table stays empty; all columns stay as they are."""
    return language_id.known(docs, language_id.dictionaries(docs))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the longest original, then the smallest key; null keys last.  Rows that
    repeat key and text stay or go together.  Null and empty texts are one group; an empty table stays empty."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies, five words and 0.8: that of the smallest key, null keys last.  Texts
    without words stay, very long ones are compared whole; an empty table stays empty."""
    return ngram_join.drop_similar(docs, width=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that a draw at their fitted rates keeps.  Rows that repeat key and text stay or go together, a null
    key draws by its text, null and empty texts have no tokens and a rate all the same; without labels all stay."""
    model = mixing.train(docs, table(spark, sf_dir, "labels"), domain_of())
    measured = stage(mixing.measure(docs, model), "measured")
    fitted = mixing.fit(measured, model.domains, WEIGHTS, most=1.0, total="largest")
    return mixing.thin(docs, model, fitted)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, each with its document's id (null ids stay null).  A null text is the end id alone, repeated
    rows are packed each, very long texts are cut; an empty table gives no pieces."""
    return packing.pack(docs, tokens.vocabulary_path())


STAGES = [
    ("language", known_language),
    ("copies", without_copies),
    ("near_copies", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: Language ID, mixing and packing are not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage_of in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage_of(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
