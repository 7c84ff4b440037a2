"""From raw documents to token digests: quality, boilerplate lines, near copies, benchmark passages, tokens."""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import DataFrame, SparkSession

from ridelake.llm import bpe, contamination, lines, quality, simhash
from ridelake.llm.common import new_folder, table
from ridelake.llm.queries import VOCABULARY


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that stand on many sites."""
    return lines.without_boilerplate(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that fingerprints of three-word shingles link at two bits or less."""
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item."""
    return contamination.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each text's token ids and of what they decode to."""
    return bpe.round_trip(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_boilerplate),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("byte_bpe", tokenize),
]

# Classifier, fingerprints and tokens are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def _stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = new_folder(spark, f"pipeline-{name}")
    df.write.parquet(path)
    return spark.read.parquet(path)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before wrote to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = _stored(spark, stage(spark, docs, sf_dir), name)
    return docs
