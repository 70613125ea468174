"""Consensus voting over several executed candidates per question (V1-V8).

Input: an *executions* frame with one row per candidate::

    question_id BIGINT, ord INT, sql STRING, valid BOOLEAN, fp STRING, correct INT

``fp`` is the result fingerprint (equal results, equal ``fp``); ``correct`` is
0/1 against the gold result (see :func:`label_correct`).

``(question_id, ord)`` names a row, and ``ord`` counts from 0.

The vote runs on numbers: results are grouped by a 128-bit hash of ``fp`` and
every aggregate has a fixed width (a hash aggregation, combined map-side, so a
question with a huge number of candidates is still split over many tasks; only
its different results meet).  SQL text is fetched at the end, by ``(question_id,
ord)``, for the rows that are shown, and only where text is shown at all.

Rules (kept from the original evaluation kit):

* invalid candidates do not vote; an empty result is a legal answer;
* a group of equal results is represented by its earliest candidate;
* winner: most votes, ties to the earliest group;
* runner-up: let M be the top count and T the second count *with
  multiplicity*.  If T = M the runner-up is the winner (lists hold one entry);
  otherwise among groups with T votes the last one before the winner, else
  the first one after it;
* pass@n: any candidate right; its SQL is the last right candidate, else
  candidate 0;
* a question whose candidates are all invalid gets candidate 0's SQL (or the
  text ``Error SQL``), one vote and correctness 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ERROR_SQL = "Error SQL"


def candidate_slice(flat: DataFrame, n: int, index_col: str = "idx") -> DataFrame:
    """V1: a flat, position-indexed candidate list back to (question, ord)."""
    return flat.withColumn("question_id", F.expr(f"`{index_col}` div {int(n)}").cast("bigint")) \
               .withColumn("ord", (F.col(index_col) % F.lit(n)).cast("int"))


def explode_candidates(prompts: DataFrame, array_col: str = "pred_sqls") -> DataFrame:
    """V1: one row per candidate from an ``ARRAY<STRING>`` column.

    A question whose list is empty or NULL keeps one row, candidate 0 without a
    statement, so that it still counts as a question answered wrongly."""
    others = [c for c in prompts.columns if c != array_col]
    out = prompts.select(*others, F.posexplode_outer(array_col).alias("ord", "sql"))
    return out.withColumn("ord", F.coalesce("ord", F.lit(0)))


def label_correct(execs: DataFrame, gold: DataFrame, empty_gold_counts: bool = False) -> DataFrame:
    """V7: candidate correctness against the gold execution of its question.

    ``gold`` has ``question_id, gold_valid, gold_n_distinct, gold_fp``.  In
    voting an empty or failed gold result is never matched; pass
    ``empty_gold_counts=True`` for the pairwise (EX) rule where empty = empty.
    """
    joined = execs.join(gold, "question_id", "left")
    ok = F.col("valid") & F.coalesce(F.col("gold_valid"), F.lit(False)) & (F.col("fp") == F.col("gold_fp"))
    if not empty_gold_counts:
        ok = ok & (F.col("gold_n_distinct") > 0)
    return joined.withColumn("correct", F.coalesce(ok, F.lit(False)).cast("int")) \
                 .drop("gold_valid", "gold_n_distinct", "gold_fp")


_LOW = (1 << 31) - 1  # places are below this


def result_groups(execs: DataFrame, carry: tuple = ()) -> DataFrame:
    """Numbers of each (question, valid, result): ``votes, first_ord, correct, last_correct_ord``.

    Invalid candidates form one group per question; ``carry`` names columns that
    are the same for all candidates of a question."""
    valid = F.coalesce("valid", F.lit(False))
    rows = execs.select(
        "question_id", *carry, valid.alias("valid"), F.when(valid, F.xxhash64("fp")).alias("h1"),
        F.when(valid, F.xxhash64(F.lit("fp"), "fp")).alias("h2"), F.col("ord").cast("int").alias("ord"),
        F.coalesce("correct", F.lit(0)).cast("int").alias("correct"))
    return rows.groupBy("question_id", *carry, "valid", "h1", "h2").agg(
        F.count(F.lit(1)).alias("votes"), F.min("ord").alias("first_ord"), F.max("correct").alias("correct"),
        F.max(F.when(F.col("correct") == 1, F.col("ord"))).alias("last_correct_ord"))


def _with_text(frame: DataFrame, execs: DataFrame, ord_col: str, **columns: str) -> DataFrame:
    """``frame`` with columns of the candidate that ``ord_col`` names."""
    text = execs.select("question_id", F.col("ord").cast("int").alias(ord_col), *[F.col(c).alias(n) for n, c in columns.items()])
    return frame.join(text, ["question_id", ord_col], "left")


def vote_groups(execs: DataFrame) -> DataFrame:
    """V2: one row per (question, distinct valid result)."""
    g = result_groups(execs).filter(F.col("valid"))
    return _with_text(g, execs, "first_ord", fp="fp", sql="sql").select("question_id", "fp", "votes", "first_ord", "sql", "correct")


def _code(votes, place, correct):
    """Votes, place and correctness in one number, which orders by them."""
    return F.shiftleft(votes, 32).bitwiseOR(F.shiftleft(place.cast("bigint"), 1)).bitwiseOR(correct.cast("bigint"))


def _votes(code):
    return F.shiftright(code, 32)


def _place(code):
    return F.shiftright(code, 1).bitwiseAND(F.lit(_LOW)).cast("int")


def _right(code):
    return code.bitwiseAND(F.lit(1)).cast("int")


def question_numbers(execs: DataFrame, carry: tuple = ()) -> DataFrame:
    """Per question over all candidates: sizes, winner, runner-up and pass@n, as numbers only."""
    key = ["question_id", *carry]
    groups = result_groups(execs, carry)
    first, votes, right, low = F.col("first_ord"), F.col("votes"), F.col("correct"), F.lit(_LOW)
    won = F.max(F.when(F.col("valid"), _code(votes, low - first, right)))
    groups = groups.withColumn("w", won.over(Window.partitionBy(*key)))
    w_ord = low - _place(F.col("w"))
    before = F.max(F.when(F.col("valid") & (first < w_ord), _code(votes, first, right)))
    after = F.max(F.when(F.col("valid") & (first > w_ord), _code(votes, low - first, right)))
    q = groups.groupBy(*key).agg(
        F.sum("votes").cast("bigint").alias("sampling_num"),
        F.coalesce(F.sum(F.when(F.col("valid"), votes)), F.lit(0)).cast("bigint").alias("n_valid"),
        F.min("first_ord").alias("zero_ord"), F.max("correct").alias("any_correct"),
        F.max("last_correct_ord").alias("last_correct_ord"), F.max("w").alias("w"), before.alias("b"), after.alias("a"))
    w, b, a = F.col("w"), F.col("b"), F.col("a")
    has_valid = w.isNotNull()
    t_votes = F.greatest(_votes(b), _votes(a))
    same = t_votes.isNull() | (t_votes == _votes(w))
    from_before = _votes(b) == t_votes
    return q.select(
        *key, "sampling_num", "n_valid", "zero_ord", "any_correct", "last_correct_ord", has_valid.alias("has_valid"), same.alias("single"),
        F.when(has_valid, _votes(w)).otherwise(F.lit(1)).cast("bigint").alias("votes"),
        F.when(has_valid, _right(w)).otherwise(F.lit(0)).cast("int").alias("correct"),
        F.when(has_valid, low - _place(w)).cast("int").alias("winner_ord"),
        F.when(has_valid, F.when(same, low - _place(w)).when(from_before, _place(b)).otherwise(low - _place(a))).cast("int").alias("r_ord"),
        F.when(same, _right(w)).when(from_before, _right(b)).otherwise(_right(a)).alias("r_correct"),
        F.when(same, _votes(w)).otherwise(t_votes).alias("r_votes"))


def consensus(execs: DataFrame, all_invalid_sql: str = "first", carry: tuple = ()) -> dict[str, DataFrame]:
    """V2-V6: ``groups, winner, top2, pass_at_n`` and ``per_question`` (numbers only).

    ``all_invalid_sql``: ``"first"`` (candidate 0, deterministic) or
    ``"error"`` (the text ``Error SQL``).  ``carry`` names per-question
    columns (e.g. ``difficulty``) passed through to every output.
    """
    top = question_numbers(execs, carry)
    valid = F.col("has_valid")

    def shown(frame: DataFrame, ord_col: str) -> DataFrame:
        frame = _with_text(frame, execs, ord_col, sql="sql")
        return frame if all_invalid_sql == "first" else frame.withColumn("sql", F.when(valid, F.col("sql")).otherwise(F.lit(ERROR_SQL)))

    winner = shown(top.withColumn("shown_ord", F.coalesce("winner_ord", "zero_ord")), "shown_ord")
    both = F.col("single") | ~valid
    top2 = _with_text(winner, execs, "r_ord", r_sql="sql").select(
        "question_id", *carry, "sampling_num",
        F.when(valid, F.greatest(F.col("correct"), F.col("r_correct"))).otherwise(F.lit(0)).cast("int").alias("correct"),
        F.when(both, F.array(F.col("correct"))).otherwise(
            F.array(F.col("correct"), F.col("r_correct").cast("int"))).alias("correctness_list"),
        F.when(~valid, F.array(F.lit(0).cast("bigint"))).when(
            F.col("single"), F.array(F.col("votes"))).otherwise(
            F.array(F.col("votes"), F.col("r_votes").cast("bigint"))).alias("vote_list"),
        F.when(both, F.array(F.col("sql"))).otherwise(F.array(F.col("sql"), F.col("r_sql"))).alias("sql_list"))
    passed = F.when(valid, F.coalesce(F.col("any_correct"), F.lit(0))).otherwise(F.lit(0)).cast("int")
    pass_ord = F.when(valid, F.coalesce("last_correct_ord", "zero_ord")).otherwise(F.col("zero_ord"))
    pass_at_n = shown(top.withColumn("pass_ord", pass_ord), "pass_ord").select("question_id", *carry, passed.alias("correct"), "sql")
    per_question = top.select(
        "question_id", *carry, F.col("correct").alias("vote_correct"),
        F.when(valid, F.greatest(F.col("correct"), F.col("r_correct"))).otherwise(F.lit(0)).cast("int").alias("top2_correct"),
        passed.alias("pass_correct"))
    return {"groups": vote_groups(execs), "winner": winner.select("question_id", *carry, "votes", "correct", "sql", "winner_ord"),
            "top2": top2, "pass_at_n": pass_at_n, "per_question": per_question}


def vote_winner(execs: DataFrame, all_invalid_sql: str = "first") -> DataFrame:
    return consensus(execs, all_invalid_sql)["winner"]


def vote_top2(execs: DataFrame, all_invalid_sql: str = "first") -> DataFrame:
    return consensus(execs, all_invalid_sql)["top2"]


def pass_at_n(execs: DataFrame, all_invalid_sql: str = "first") -> DataFrame:
    return consensus(execs, all_invalid_sql)["pass_at_n"]


def all_invalid(execs: DataFrame) -> DataFrame:
    """V6: questions where no candidate is valid, with the fallback SQL."""
    q = question_numbers(execs).filter(F.col("n_valid") == 0)
    return _with_text(q, execs, "zero_ord", sql="sql").select("question_id", "sampling_num", "sql")
