"""End-to-end flows matching the kit's three entry points.

A. :func:`evaluate_files` - predictions file + gold file + questions ->
   execution accuracy by difficulty (scores, grid, metric document).
B. :func:`generate_and_vote` - prompts -> n candidates per question ->
   executions -> vote, pass@n, top-2 and their curves.
C. :func:`generate_sql` - questions + schema text -> prompts -> one cleaned
   statement per question (with bounded retries) -> packed predictions.

Every step is a DataFrame operation from the operator modules; the flows
only wire them together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqltally.functions.text import extract_sql, pack
from sqltally.operators import compare, execute, generate, metrics, prompts, vote
from sqltally.plans.consensus import vote_and_score
from sqltally.session import scratch_path
from sqltally.sources import files


def evaluate_files(spark: SparkSession, predictions_path: str, gold_path: str, questions_path: str,
                   databases: dict, timeout: float = 30.0, prediction_format: str = "document",
                   results_path: str | None = None) -> dict:
    """Flow A.  Each prediction runs on its own database, each gold statement
    on the gold's database; EX is set equality (empty = empty)."""
    pred = files.read_predictions(spark, predictions_path, fmt=prediction_format)
    gold = files.read_gold(spark, gold_path)
    questions = files.read_questions(spark, questions_path)
    statements = (pred.select("question_id", F.lit(0).alias("ord"), "db_id", "sql")
                  .unionByName(gold.select("question_id", F.lit(-1).alias("ord"), "db_id", "sql")))
    execs = execute.run_workload(spark, statements, databases, timeout=timeout, results_path=results_path)
    scores = compare.compare_results(execs.filter(F.col("ord") == 0), execs.filter(F.col("ord") == -1)) \
                    .withColumnRenamed("res", "correct")
    acc = metrics.accuracy_by_difficulty(scores, questions)
    return {"executions": execs, "scores": scores, "accuracy": acc,
            "grid": metrics.score_grid(acc), "document": metrics.metric_document(acc),
            "unmatched": metrics.unmatched_ids(scores, questions)}


def _stored(spark: SparkSession, responses: DataFrame) -> DataFrame:
    """The model's responses, written once and read from then on: a sampling
    model must not be asked again by a later action or a lost task."""
    path = scratch_path(spark, "responses")
    responses.write.parquet(path)
    return spark.read.schema(responses.schema).parquet(path)


def generate_and_vote(spark: SparkSession, prompt_table: DataFrame, questions: DataFrame, fn: Callable,
                      n: int, databases: dict, timeout: float = 30.0,
                      results_path: str | None = None, store: str | None = None, model: str = "") -> dict:
    """Flow B.  ``prompt_table(question_id, db_id, prompt)``,
    ``questions(question_id, gold_sql, difficulty)``.  With a ``store``,
    generations of ``model`` are kept there and read by later runs."""
    responses = (generate.stored_generations(prompt_table, fn, n, store, model) if store
                 else _stored(spark, generate.generate_candidates(prompt_table, fn, n)))
    cands = prompt_table.select("question_id", "db_id").join(responses, "question_id", "left") \
                        .select("question_id", F.coalesce("ord", F.lit(0)).alias("ord"), "db_id",
                                extract_sql("response").alias("sql"))
    golds = questions.join(prompt_table.select("question_id", "db_id"), "question_id") \
                     .select("question_id", F.lit(-1).alias("ord"), "db_id", F.col("gold_sql").alias("sql"))
    execs = execute.run_workload(spark, cands.unionByName(golds), databases, timeout=timeout,
                                 results_path=results_path)
    gold = execs.filter(F.col("ord") == -1).select(
        "question_id", F.col("valid").alias("gold_valid"),
        F.col("n_distinct").alias("gold_n_distinct"), F.col("fp").alias("gold_fp"))
    labelled = vote.label_correct(execs.filter(F.col("ord") >= 0), gold)
    return vote_and_score(labelled.select("question_id", "ord", "sql", "valid", "fp", "correct"),
                          questions.select("question_id", "difficulty"))


def generate_sql(spark: SparkSession, questions: DataFrame, schemas: DataFrame, fn: Callable, template: str,
                 max_attempts: int = 3) -> DataFrame:
    """Flow C: ``question_id, db_id, sql, packed`` (``sql``/``packed`` NULL
    when no attempt produced a statement)."""
    p = prompts.build_prompts(questions, schemas, template)
    responses = _stored(spark, generate.generate_candidates(p, fn, 1, max_attempts=max_attempts))
    out = p.select("question_id", "db_id").join(responses, "question_id", "left") \
           .select("question_id", "db_id", extract_sql("response").alias("sql"))
    return out.withColumn("packed", pack(F.col("sql"), F.col("db_id")))
