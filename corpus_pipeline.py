"""Documents to training text in five stages, each over all that the one before it kept.

run() writes every stage's result below spark.checkpoint.dir and reads it back
for the next one, so that a lost executor repeats one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm import linefreq, mixing, ordermh, piecebpe, toxicity
from sitelens.llm.common import DOCUMENT_COLUMNS, materialized, table

# Target shares of the domains by quality; totals are scaled so that no domain loses tokens.
WEIGHTS = {"1": 0.88, "0": 0.12}

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity (operator 3): documents scored 0.7 or more go.

    Null and empty texts are scored as texts without words, null ids and repeated rows like others; texts of
    any length are scored whole; extra columns are dropped by name; an empty table stays empty.
    """
    return toxicity.drop_toxic(docs.select(*DOCUMENT_COLUMNS), table(spark, sf_dir, "labels"))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup (operator 9): lines that are frequent in their source go, every document stays.

    A null source is a source of its own; a null text stays null; equal pages of a source count once; repeated rows
    each stay; a text that loses all its lines is empty; extra columns are dropped by name.
    """
    return (linefreq.drop_boilerplate(docs.select(*DOCUMENT_COLUMNS))
            .withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT_COLUMNS))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup (operator 10): one document of each class stays, that with the smallest id.

    Null and empty texts are one class; rows without an id all stay; of rows with one id the one with the smallest
    text stays, also if their texts differ; extra columns are dropped by name; an empty table stays empty.
    """
    return ordermh.keep_one_of_each_class(docs.select(*DOCUMENT_COLUMNS))


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing (operator 6): documents repeat as often as the target weights ask, each at least once.

    Null and empty texts have posteriors like others and no tokens; null ids and repeated rows have rates like
    others; extra columns are dropped by name; an empty table stays empty.
    """
    return mixing.mixed(docs.select(*DOCUMENT_COLUMNS), table(spark, sf_dir, "labels"), WEIGHTS, ["quality"])


def to_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encoding (operator 8): number and hash of the ids of every document.

    A null text counts as empty (no ids); null ids, repeated rows and texts of any length are encoded like
    others; an empty table gives an empty result.
    """
    return piecebpe.encode_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("line_dedup", without_boilerplate),
    ("near_dedup", without_near_copies),
    ("mixing", to_weights),
    ("encoding", to_ids),
]

# Trained models and encoding are not expressible in SQL; tests/llm hold run() against its parts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialized(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
