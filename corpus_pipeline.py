"""A corpus pipeline of five stages over the table documents; each stage's result is written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from hopsight.llm import contamination, language, lines, minhash, mixing
from hopsight.llm.common import discard, read, result_of


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; learned from the labelled ones among them that are not held out.

    Null texts, texts without letters, letter noise and other scripts go (`language.accepted`); repeated rows stay or go
    together; an empty table gives no rows.
    """
    return language.accepted(docs, docs.filter(~language.held_out(F.col("doc_id"))))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their recurring lines, n_chars anew; one that loses all its words goes.

    Null and empty texts have no recurring line and stay; repeated rows come out alike; an empty table gives no rows.
    """
    left = lines.dedup(docs)
    changed = F.col("_dropped") > 0
    return (left.filter(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
            .withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are linked by a similarity of 0.8 or more.

    Null and blank texts are in no group and all stay; of rows equal in id and text one stays; an empty table gives no rows.
    """
    return minhash.dedup(docs, 5, 80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no item of the table benchmark.

    Null and empty texts stay; repeated rows stay or go together; an empty table gives no rows, an empty benchmark all.
    """
    return contamination.clean(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the times it takes each as `copies`.

    Documents without words are not taken; repeated rows are taken alike; a null source is one of its own; an empty table
    gives no rows.
    """
    return mixing.mixed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

#: Languages told by learned vectors cannot be stated in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn. What a stage writes on its way, and the table it read, are deleted when its result is written."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, result_of(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        if i:
            discard(before)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
