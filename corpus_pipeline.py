"""A training corpus in five stages: keep good texts, cut repeated lines, keep one of each group of near copies, drop benchmark leaks, count tokens.

Each stage reads what the one before it stored, so a stage's own intermediate tables in the shared folder can go as soon as the next
begins. Null, empty and blank texts pass through all stages that have no reason to drop them: the first scores them like any text (all
score 0.5 where there are no labels), the second drops documents that lose their lines but not those that had none, the third keeps one
row for each id of them, and they end with no tokens. Repeated rows end as one. Rows with one id and different texts, and rows without
an id, are documents of their own. Ties go by id, then by the text's hash. Empty tables give an empty result. Other columns, whatever
their names, pass through to the last stage, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import bpe, decontaminate, jaccard, line_runs, pu_quality
from tickloom.llm.common import Scratch, table, written


_last: list[Scratch] = []


def _next() -> Scratch:
    """Intermediate tables of the stage that begins. Those of the stage before go: what it returned is stored by now."""
    while _last:
        _last.pop().release()
    _last.append(Scratch())
    return _last[0]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    with _next():
        return pu_quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; those that lose all their lines go."""
    with _next():
        return line_runs.drop_repeated_lines(docs, chars_col="n_chars")


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    with _next():
        return jaccard.keep_one(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    with _next():
        return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    with _next():
        return bpe.encode_documents(docs, result="digests")


STAGES = [("quality", quality), ("lines", lines), ("copies", copies), ("leaks", leaks), ("encode", encode)]
#: The first stage learns its weights, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
