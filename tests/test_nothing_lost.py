"""Inputs that once lost rows or came back wrong."""

import decimal
import itertools
import time

import pytest
from pyspark.sql import functions as F

from sqltally.operators import generate, metrics, profile, vote
from sqltally.plans import flows
from sqltally.session import scratch_path
from sqltally.sources import files, sinks


def test_explode_keeps_questions_without_candidates(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "question_id bigint, pred_sqls array<string>")
    rows = sorted((r.question_id, r.ord, r.sql or "") for r in vote.explode_candidates(df).collect())
    assert rows == [(1, 0, "a"), (1, 1, "b"), (2, 0, ""), (3, 0, "")]


def test_candidate_slice_beyond_double(spark):
    big = 2**60 + 3
    df = spark.createDataFrame([(big,)], "idx bigint")
    r = vote.candidate_slice(df, 2).first()
    assert (r.question_id, r.ord) == (big // 2, 1)


def test_model_must_answer_every_prompt(spark):
    prompts = spark.createDataFrame([(1, "p"), (2, "q")], "question_id bigint, prompt string").coalesce(1)
    none = generate.generate_candidates(prompts, lambda texts, n: [["x"], []], 1).collect()
    assert sorted((r.question_id, r.ord, r.response) for r in none) == [(1, 0, "x"), (2, 0, None)]
    with pytest.raises(Exception, match="1 lists for 2 prompts"):
        generate.generate_candidates(prompts, lambda texts, n: [["x"]], 1).collect()


def test_unscored_question_counts_as_wrong(spark):
    scores = spark.createDataFrame([(1, 1)], "question_id bigint, correct int")
    questions = spark.createDataFrame([(1, "simple"), (2, "simple")], "question_id bigint, difficulty string")
    acc = {r.level: r for r in metrics.accuracy_by_difficulty(scores, questions).collect()}
    assert acc["simple"].n == 2 and acc["total"].accuracy == 50.0


def test_wide_decimals_stay_apart(spark):
    values = [decimal.Decimal(f"1234567890123456789012345678.0{i}") for i in range(3)]
    df = spark.createDataFrame([(v,) for v in values], "d decimal(30,2)")
    assert profile.column_examples("db", "t", df).count() == 3


def test_progress_log_keeps_the_last_record(spark):
    for i in range(4):
        path = scratch_path(spark, f"log-{i}")
        for value in ("old", "new"):
            sinks.append_progress(spark.createDataFrame([(7, value)], "question_id bigint, value string"), path)
            time.sleep(0.02)
        r = files.read_progress_log(spark, path).select(F.variant_get("value", "$", "string").alias("v")).collect()
        assert [x.v for x in r] == ["new"]


def test_votes_of_a_sampling_model(spark):
    """A model that never writes the same text twice, and none for one question."""
    calls = itertools.count()

    def model(texts, n):
        import os
        import time as clock
        return [[] if "skip" in t else [f"```sql\nSELECT 1 AS c /* {os.getpid()} {clock.time_ns()} {next(calls)} */\n```"
                                        for _ in range(n)] for t in texts]

    prompts = spark.createDataFrame([(i, "db", "skip" if i == 3 else "ask") for i in range(4)],
                                    "question_id bigint, db_id string, prompt string")
    questions = prompts.select("question_id", F.lit("SELECT 1").alias("gold_sql"), F.lit("simple").alias("difficulty"))
    db = {"db": __import__("sqltally.operators.execute", fromlist=["x"]).register_database(spark, "db", {})}
    out = flows.generate_and_vote(spark, prompts, questions, model, 2, db)
    per = {k: v for k, v in out.items()}
    rows = per["per_question"].collect() if "per_question" in per else per["winner"].collect()
    right = {r.question_id: (r.vote_correct if "vote_correct" in r.asDict() else r.correct) for r in rows}
    assert right == {0: 1, 1: 1, 2: 1, 3: 0}
