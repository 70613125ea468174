"""Plan B: several candidates per question -> vote -> three accuracy curves.

``candidates -> run_workload -> label_correct -> consensus -> curves`` with the
winner list, the top-2 table and a metric document as sinks (K5-K7).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqltally.operators import metrics, vote


def vote_and_score(execs: DataFrame, questions: DataFrame | None = None,
                   all_invalid_sql: str = "first") -> dict[str, DataFrame]:
    """V8: vote, then the three curves (vote, pass@n, top-2) by difficulty.

    ``execs`` must carry ``correct``; without ``questions`` it must carry
    ``difficulty``, which then travels through the per-question aggregation
    (no extra join or scan).
    """
    if questions is None:
        res = vote.consensus(execs, all_invalid_sql, carry=("difficulty",))
        pq = res["per_question"]
    else:
        base = execs.drop("difficulty") if "difficulty" in execs.columns else execs
        res = vote.consensus(base, all_invalid_sql)
        pq = metrics.attach_difficulty(res["per_question"], questions)
    res["curves"] = metrics.curves_from_columns(
        pq, {"vote": "vote_correct", "pass_at_n": "pass_correct", "top2": "top2_correct"})
    res["accuracy"] = metrics.accuracy_by_difficulty(pq, score_col="vote_correct")
    return res


def write_winner_sql(winner: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """K5: one winning SQL per line, newlines turned into spaces, by id.

    ``orderBy`` is a range-partitioned sort, so the lines of the written part
    files follow the question order without funnelling through one task.
    """
    (winner.select("question_id", F.regexp_replace("sql", "\n", " ").alias("value"))
     .orderBy("question_id").select("value")
     .write.mode(mode).text(path))


def write_top2(top2: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """K6: the top-2 table (the input of a later merge step)."""
    top2.write.mode(mode).parquet(path)
