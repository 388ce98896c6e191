"""The corpus pipeline: stages that each take the documents their predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from afterbell.llm.common import materialize, table
from afterbell.llm.decontaminate import drop_contaminated
from afterbell.llm.language import keep_known_languages, learn_languages
from afterbell.llm.mixing import sample_mixture
from afterbell.llm.sharding import shard_by_bytes
from afterbell.llm.simhash import keep_one_of_each


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents without a language (null, empty or no letter) go; a missing label is filled."""
    return keep_known_languages(docs, learn_languages(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of each group of near copies one document stays, the one of least id."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that hold a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents are sampled towards tempered source, language and topic shares, four fifths of the tokens in all."""
    return sample_mixture(docs, share=0.8)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: eight contiguous shards of near-equal bytes."""
    return shard_by_bytes(docs, 8)


STAGES = [
    ("language id", language_id),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]
#: The stages hold a trained classifier, fingerprints and edit distances, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
