"""Plan A on a real workload: questions with gold SQL and candidates.

``workload/questions.json`` holds questions on the star schema of the given
tables, each with a gold statement and several candidates written in Spark
SQL.  The plan registers the tables as database ``star``, runs every
statement read-only (identical statements once), and derives executions,
pairwise EX scores and the vote.
"""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import sqltally
from sqltally.operators import execute, vote
from sqltally.plans import tables
from sqltally.sources.stored import files_version
from sqltally.session import checkpoint_dir, table_path

WORKLOAD_FILE = os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(
    os.path.abspath(__file__)))), "workload", "questions.json")
GOLD_ORD = -1

QUESTION_SCHEMA = (
    "question_id BIGINT, db_id STRING, difficulty STRING, evidence STRING, question STRING, "
    "gold_sql STRING, candidates ARRAY<STRUCT<sql: STRING, expect: STRING, oracle: STRING>>")


def read_workload(spark: SparkSession, path: str = WORKLOAD_FILE) -> DataFrame:
    """A JSON array of question objects -> one row per question."""
    return spark.read.schema(QUESTION_SCHEMA).option("multiLine", "true").json(path)


def questions(spark: SparkSession, path: str = WORKLOAD_FILE) -> DataFrame:
    return read_workload(spark, path).drop("candidates")


def statements(spark: SparkSession, path: str = WORKLOAD_FILE) -> DataFrame:
    """Gold (``ord = -1``) and candidate statements, one row each."""
    w = read_workload(spark, path)
    cands = w.select("question_id", "db_id", F.posexplode("candidates").alias("ord", "c")) \
             .select("question_id", "db_id", F.col("ord").cast("int").alias("ord"),
                     F.col("c.sql").alias("sql"))
    gold = w.select("question_id", "db_id", F.lit(GOLD_ORD).cast("int").alias("ord"),
                    F.col("gold_sql").alias("sql"))
    return gold.unionByName(cands)


def star_database(spark: SparkSession, sf_dir: str, cache: bool = False) -> execute.Database:
    return execute.register_database(
        spark, "star", {t: table_path(sf_dir, t) for t in tables.STAR_TABLES}, cache=cache)


def _results_path(spark: SparkSession, sf_dir: str, path: str) -> str:
    with open(path, "rb") as fh:
        version = files_version([tables.read(spark, sf_dir, t) for t in tables.STAR_TABLES])
        digest = hashlib.sha256(fh.read() + version.encode() + sqltally.__version__.encode()).hexdigest()[:16]
    return f"{checkpoint_dir(spark)}/sqltally/workload-results-{digest}"


def executions(spark: SparkSession, sf_dir: str, path: str = WORKLOAD_FILE,
               timeout: float = 30.0, parallelism: int = 16,
               results_path: str | None = None, reuse: bool = True) -> DataFrame:
    """All statements executed; results kept under ``spark.checkpoint.dir``
    keyed by workload, tables and library version, so reruns resume."""
    if results_path is None and reuse:
        results_path = _results_path(spark, sf_dir, path)
    db = star_database(spark, sf_dir)
    return execute.run_workload(spark, statements(spark, path), {"star": db},
                                timeout=timeout, parallelism=parallelism,
                                results_path=results_path)


def gold_of(execs: DataFrame) -> DataFrame:
    return execs.filter(F.col("ord") == GOLD_ORD).select(
        "question_id", F.col("valid").alias("gold_valid"),
        F.col("n_distinct").alias("gold_n_distinct"), F.col("fp").alias("gold_fp"))


def candidates_of(execs: DataFrame) -> DataFrame:
    return execs.filter(F.col("ord") != GOLD_ORD)


def ex_scores(execs: DataFrame) -> DataFrame:
    """Each candidate against its gold; empty = empty counts as right."""
    return vote.label_correct(candidates_of(execs), gold_of(execs), empty_gold_counts=True) \
               .select("question_id", "ord", F.col("correct").alias("res"))


def voted(execs: DataFrame) -> dict:
    labelled = vote.label_correct(candidates_of(execs), gold_of(execs))
    return vote.consensus(labelled.select("question_id", "ord", "sql", "valid", "fp", "correct"))


def oracle_rows(path: str = WORKLOAD_FILE) -> list[dict]:
    """The workload as plain records, for building oracle SQL."""
    with open(path, encoding="utf-8") as fh:
        return json.load(fh)
