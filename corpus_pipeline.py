"""From raw documents to a training mix.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of documents. ``run`` writes each
stage's result below the shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm.decontaminate import drop_contaminated
from tidebar.llm.language import UNKNOWN, identify_language
from tidebar.llm.linededup import drop_repeated_lines
from tidebar.llm.neardup import keep_one_of_each
from tidebar.llm.queries import mix_of
from tidebar.llm.store import Workspace, read_table, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose language is less probable than this go, as do those without one.
LEAST_LANGUAGE_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents with a language stay."""
    found = identify_language(docs.select(*COLUMNS))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: later copies of repeated lines are cut; n_chars follows."""
    left = drop_repeated_lines(docs.select(*COLUMNS))
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", n_chars).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: one document of each group stays (five words, 0.8)."""
    return keep_one_of_each(docs.select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that hold a benchmark window go."""
    return drop_contaminated(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: the mix, a row for each document and epoch."""
    return mix_of(docs, ["doc_id", "text"])


STAGES = [
    ("language", language_stage),
    ("lines", line_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: SQL can't express the language model or the registers: tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with scratch():
            docs = work.materialize(stage(spark, docs, sf_dir), str(k))
        if k:
            work.drop(str(k - 1))
