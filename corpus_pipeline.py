"""A corpus pipeline over ``documents``: language ID, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; ``run`` writes every stage's rows as Parquet into the
shared folder and reads them back as the next one's ``docs``.

All stages but the last return the columns of ``documents`` and pass any others through.  Rows with null id stay in every
stage (they rank last where one of several stays); null and empty texts are rejected by the first stage as unreadable;
texts of any length are taken whole; of rows that repeat id and text one stays from the near-dedup stage on, and the mix
may repeat it; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from echoline.llm import language, lines, minhash, mixing, packing
from echoline.llm.common import materialize, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents whose language is not identified go; each row is judged by its own text and marks."""
    return language.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each class of near-equal lines the first occurrence stays; short lines stay, emptied texts go."""
    return lines.drop_repeated_lines(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one document of each group of near duplicates stays."""
    return minhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: sources mixed to their target weights; a document appears as often as the mix takes it."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: tokenised documents packed into sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("source_mix", mix_sources),
    ("packing", pack),
]

#: No stage after the first can be expressed in SQL; the operators' tests hold them against plain restatements.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
