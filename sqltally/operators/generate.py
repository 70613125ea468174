"""Candidate generation around a user-supplied model callable.

The model runtime is not part of this package.  A caller passes
``fn(prompts: list[str], n: int) -> list[list[str]]``; it runs inside
``mapInPandas`` on the executors, one Arrow batch of prompts at a time, so
prompts are spread over the cluster (``repartition`` sets the degree of
parallelism, e.g. the number of GPU workers) and never pass through the
driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqltally.functions.text import SQL_BLOCK, extract_sql
from sqltally.sources.stored import add_to_store, read_store, written_once

RESPONSE_SCHEMA = "question_id long, ord int, response string"


def has_sql_block(response: str) -> bool:
    """G9 validity: the response holds a fenced ``sql`` block."""
    import re
    return re.search(SQL_BLOCK, response or "") is not None


def has_think_answer(response: str) -> bool:
    """G10 validity: reasoning and answer tags are both present."""
    import re
    return re.search(r"<think>(.*?)</think>\s*<answer>(.*?)</answer>", response or "", re.S) is not None


def generate_candidates(prompts: DataFrame, fn: Callable, n: int,
                        partitions: int | None = None, max_attempts: int = 1,
                        is_valid: Callable[[str], bool] = has_sql_block) -> DataFrame:
    """G8 (+G9/G10 in the callable wrapper): ``(question_id, ord, response)``.

    With ``max_attempts > 1`` a prompt is asked again, up to that many times
    (always bounded), while none of its responses passes ``is_valid``.  The
    callable must return one list for each prompt; a prompt without responses
    keeps one row, candidate 0 with a NULL response.
    """
    def ask(texts):
        outs = fn(texts, n)
        if len(outs) != len(texts):
            raise ValueError(f"the model returned {len(outs)} lists for {len(texts)} prompts")
        return outs

    src = prompts.select("question_id", "prompt")
    if partitions:
        src = src.repartition(partitions)

    def run(batches):
        import pandas as pd
        for pdf in batches:
            texts = pdf["prompt"].fillna("").tolist()
            outs = list(ask(texts))
            for _ in range(max_attempts - 1):
                retry = [i for i, o in enumerate(outs) if not any(is_valid(r) for r in o)]
                if not retry:
                    break
                again = ask([texts[i] for i in retry])
                for i, o in zip(retry, again, strict=True):
                    outs[i] = o
            qids = pdf["question_id"].tolist()
            rows = [(q, j, r) for q, o in zip(qids, outs, strict=True)
                    for j, r in enumerate(o if len(o) else [None])]
            yield pd.DataFrame(rows, columns=["question_id", "ord", "response"]).astype(
                {"question_id": "int64", "ord": "int32"})

    return src.mapInPandas(run, RESPONSE_SCHEMA)


_KEPT = "key string, ord int, response string"


def stored_generations(prompts: DataFrame, fn: Callable, n: int, store: str, model: str, **options) -> DataFrame:
    """G8 + S8: ``(question_id, ord, response)``, kept under ``store`` across runs.

    The key of a generation is the prompt's text, ``n`` and the name of the
    ``model``.  A prompt that is there is not asked again; equal prompts are asked
    once; a changed one is asked once more.
    """
    spark = prompts.sparkSession
    key = F.sha2(F.concat_ws("\x1f", F.lit(model), F.lit(str(n)), F.coalesce("prompt", F.lit(""))), 256).alias("key")
    asked = prompts.select("question_id", "prompt", key)
    schema = T._parse_datatype_string(_KEPT)
    known = read_store(spark, store, schema)
    todo = (asked.join(known.select("key").distinct(), "key", "left_anti")
            .groupBy("key").agg(F.min("question_id").alias("question_id"), F.first("prompt").alias("prompt")))
    todo = written_once(todo, "prompts-to-ask")
    if not todo.isEmpty():
        answers = generate_candidates(todo, fn, n, **options).join(todo.select("question_id", "key"), "question_id")
        add_to_store(answers.select("key", "ord", "response"), store)
    # two runs at once may both have asked: the first answer of each place counts
    kept = read_store(spark, store, schema).groupBy("key", "ord").agg(F.min("response").alias("response"))
    return asked.join(kept, "key").select("question_id", "ord", "response")


def first_valid_attempt(attempts: DataFrame, key: str = "question_id", attempt_col: str = "attempt",
                        response_col: str = "response") -> DataFrame:
    """G9/G10 in table form: the first attempt whose response holds a
    statement; questions without one keep ``sql`` NULL.  All logged attempts
    count: the bound on asking belongs to :func:`generate_candidates`.

    A grouped ``min_by`` (partial aggregation) instead of a window, so one
    question with very many attempts is still split across tasks.
    """
    a = attempts.withColumn("_sql", extract_sql(F.col(response_col)))
    return a.groupBy(key).agg(
        F.min_by("_sql", F.when(F.col("_sql").isNotNull(), F.col(attempt_col))).alias("sql"),
        F.min(F.when(F.col("_sql").isNotNull(), F.col(attempt_col))).alias("attempt"),
        F.count(F.lit(1)).alias("n_attempts"))


def resume(todo: DataFrame, done: DataFrame, key: str = "question_id") -> DataFrame:
    """Items not yet in the progress log, by id (not by count/offset)."""
    return todo.join(done.select(key), key, "left_anti")
