"""Corpus preparation: five stages over ``documents``, each one of the operators in codelode.llm.

A stage takes all that the one before it kept. All but the last return the columns of documents, of any names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from codelode.llm import dart, decontam, langid, linetree, mixing
from codelode.llm.common import remove, shared_dir, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents whose text has no letter (null and empty ones too), or no known language's trigrams, go.

    The model learns from this input's rows with a text and a language. Repeated rows and rows without an id are judged like any
    other, by their texts; an empty table, or one without any language, keeps nothing.
    """
    return langid.recognised(docs, langid.fit(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: lines of recurring templates go but for their first place; every document stays, and n_chars follows the text.

    A document all of whose lines recur elsewhere keeps them: emptied, it would be taken for a copy of every other empty one by
    the next stage. A null text stays null; rows of one text lose the same lines.
    """
    return linetree.rewrite_lines(docs, never_empty=True)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: one document of each class of near copies stays, that of the least id (null ids last); of repeated rows, one.

    Empty and null texts are one class.
    """
    return dart.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that hold a benchmark passage go; empty and null texts hold none; without items, all stay."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: how much the mix takes of each remaining document; a null source is a source, a text without words gives nothing."""
    return mixing.mix(docs)


STAGES = [("language", language), ("lines", lines), ("near", near), ("benchmark", benchmark), ("mixture", mixture)]

#: Language identification is a trained model, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder as Parquet and read again; a stage's input is then deleted."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
        last = path
    return docs
