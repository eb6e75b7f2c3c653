"""A training corpus from ``documents``: language, exact and near duplicates, benchmark leaks, and the mix of sources.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of ``documents``; what a stage rejects is gone. A stage first deletes the scratch
tables of the stages before it, whose results are written by then.

The rules: a text in no known language or of a score under ``LEAST_SCORE`` goes; of equal texts the row with the largest doc_id
stays; of near duplicates (5-word shingles, Jaccard 0.8) that with the least; a document with a benchmark window goes; the last stage returns what
the mix takes of each document that is left. Nulls, empty texts and repeated rows are handled as the operators say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import common
from marlstone.llm.decontaminate import decontaminate
from marlstone.llm.exact_dedup import exact_dedup
from marlstone.llm.jaccard_join import similarity_join
from marlstone.llm.langid import UNKNOWN, fit, identify
from marlstone.llm.mixing import mix

LEAST_SCORE = 0.5
#: SQL can't express the language model.
ORACLE_SQL = None

_done: list[str] = []


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.bound_batches(spark)
        _done[:] = common.release(spark, _done, docs)
        before = set(common.scratch_paths())
        out = f(spark, docs, sf_dir)
        _done.extend(p for p in common.scratch_paths() if p not in before)
        return out

    return run_stage


def _without(docs: DataFrame, name: str, gone: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The documents but those whose row numbers (``row``) the operator gives back.

    Documents and their numbers are written once, and both the operator and this function read those. What the operator gives is written too, so that Spark knows its size and plans by it.
    """
    number = "row number"
    while number in docs.columns:
        number += "_"
    rows = common.numbered(docs, name, number)
    dropped = common.materialize(gone(rows.select("doc_id", "text", number), number).select(F.col("row").alias(number)), f"{name}-dropped")
    return rows.join(dropped, number, "left_anti").select(*map(common.quoted, docs.columns))


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = identify(docs, fit(docs), keep={f"own {k}": docs[common.quoted(c)] for k, c in enumerate(docs.columns)})
    sure = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return found.where(sure).select(*(F.col(f"`own {k}`").alias(c) for k, c in enumerate(docs.columns)))


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, "pipeline-exact", lambda d, n: exact_dedup(d, row_col=n).where("NOT kept"))


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, "pipeline-near", lambda d, n: similarity_join(d, row_col=n).where("NOT first"))


@_stage
def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = common.table(spark, sf_dir, "benchmark")
    return _without(docs, "pipeline-leaks", lambda d, n: decontaminate(d, benchmark, row_col=n).where("contaminated"))


@_stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)[0]


STAGES = [("language", language), ("exact_dedup", exact), ("jaccard_join", near), ("decontaminate", leaks), ("mix", mixed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
